"""Plain versions of the operators, text by text."""
import re
import zlib
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, lower=True):
    raw = (text or "").encode()
    return WORD.findall(raw.lower() if lower else raw)


def shingles(text, n=5):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or {tuple(w)}


def measures(text):
    text = text or ""
    w = words(text, lower=False)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x.encode())]
    return {"n_words": len(w), "word_chars": sum(len(x.decode()) for x in w),
            "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
            "n_upper": len(re.findall("[A-Z]", text)), "n_letters": len(re.findall("[A-Za-z]", text)),
            "n_symbol_words": sum(bool(re.search(rb"[#*$%&|<>]", x)) for x in w), "n_wide": sum(c >= "\x80" for c in text)}


def fails(m):
    return [m["n_words"] < 50, 100 * m["n_repeat_words"] > 50 * m["n_words"], m["n_words"] > 1_000_000,
            not 3 * m["n_words"] <= m["word_chars"] <= 20 * m["n_words"], 10 * m["n_symbols"] > 3 * m["n_words"],
            10 * m["n_symbol_words"] > 3 * m["n_words"], 2 * m["n_dup_lines"] > m["n_lines"],
            2 * m["n_upper"] > m["n_letters"], 2 * m["n_upper"] > m["n_letters"] + m["n_wide"],
            2 * m["n_wide"] <= m["word_chars"] and not 3 * m["n_words"] <= m["word_chars"] <= 20 * m["n_words"]]


#: Positions of the rules of each policy.
POLICY = {"base": [0, 1], "v2": list(range(8)), "v3": [0, 1, 4, 5, 6, 8, 9]}


def passes(text, policy="v3"):
    failed = fails(measures(text))
    return not any(failed[i] for i in POLICY[policy])


def groups(rows, percent=80):
    """Least doc_id of each row's component, over all pairs; rows are (doc_id, text)."""
    sets = [shingles(x) for _, x in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    seen = {}
    for i, s in enumerate(sets):
        if s:
            parent[root(i)] = root(seen.setdefault(frozenset(s), i))
    reps = list(seen.items())
    where = {}
    for k, (s, _) in enumerate(reps):
        for g in s:
            where.setdefault(g, []).append(k)
    for k, (s, i) in enumerate(reps):
        shared = Counter(j for g in s for j in where[g] if j < k)
        for j, o in shared.items():
            if 100 * o >= percent * (len(s) + len(reps[j][0]) - o):
                parent[root(i)] = root(reps[j][1])
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i]:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(s), least[root(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def held_out(doc_id, folds, fold):
    return zlib.crc32(str(doc_id).encode()) % folds == fold


#: Texts that break careless code: none, blank, one word, odd spaces, other scripts, long words.
AWKWARD = [None, "", " \n\t ", "one", "a b c d", "a b c d e", "éÉ ß 中文 \U0001f600 x", "x" * 5000,
           "same same same same same", "line\nline\n\nline\n \nother", "A\x0bB\x0cC\rD\x1cE", "a " * 3000, "İſK"]
