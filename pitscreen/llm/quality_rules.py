"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a document. The ledger stores what was measured and one bit
for each rule that failed. A policy is a named, versioned set of bits, so a new policy, or the
question of what a single rule costs, needs the ledger alone and never the texts again.

Cases: a null text measures like an empty one (0 words, fails ``few_words``); repeated rows get
a ledger row each; an empty table gives an empty ledger; other columns are never looked at. A very long
text is measured whole, as a block of its own (about 40 bytes a byte of text); its length alone fails
nothing since policy ``v3``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitscreen.llm import grams
from pitscreen.llm.frames import col, free_name, map_text

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
            "n_upper", "n_letters", "n_symbol_words", "n_wide"]


@dataclass(frozen=True)
class Rule:
    """``fails`` takes the column of each measurement by name; integers keep it exact."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


#: Position in this list is the bit. Append only: stored ledgers refer to positions.
RULES = [
    Rule("few_words", lambda m: m("n_words") < 50),
    Rule("repeated_words", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    Rule("many_words", lambda m: m("n_words") > 1_000_000),
    Rule("word_length", lambda m: (m("word_chars") < 3 * m("n_words")) | (m("word_chars") > 20 * m("n_words"))),
    Rule("symbols", lambda m: 10 * m("n_symbols") > 3 * m("n_words")),
    Rule("symbol_words", lambda m: 10 * m("n_symbol_words") > 3 * m("n_words")),
    Rule("repeated_lines", lambda m: 2 * m("n_dup_lines") > m("n_lines")),
    Rule("capitals", lambda m: 2 * m("n_upper") > m("n_letters")),
    # the two rules above for any script: letters beyond ASCII have no case here, and most of a text
    # in them says nothing about the length of words, as scripts without spaces are among them
    Rule("capitals_any_script", lambda m: 2 * m("n_upper") > m("n_letters") + m("n_wide")),
    Rule("word_length_ascii", lambda m: (2 * m("n_wide") <= m("word_chars"))
         & ((m("word_chars") < 3 * m("n_words")) | (m("word_chars") > 20 * m("n_words")))),
]
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BIT[n] for n in names)


#: Versioned policies: a document is kept if none of the policy's bits is set.
POLICIES = {
    "base": mask("few_words", "repeated_words"),
    "v1": mask("few_words", "repeated_words", "many_words", "symbols", "symbol_words", "capitals"),
    "v2": mask("few_words", "repeated_words", "many_words", "word_length", "symbols", "symbol_words",
               "repeated_lines", "capitals"),
    "v3": mask("few_words", "repeated_words", "symbols", "symbol_words", "repeated_lines", "capitals_any_script",
               "word_length_ascii"),
}
NEWEST = "v3"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _count(marks: np.ndarray, text_of: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text_of[marks], minlength=n)


def _measure_block(b: grams.Block) -> dict[str, np.ndarray]:
    w = b.words()
    lens = np.diff(b.offsets)
    ends = b.offsets[1:]
    first_byte = (b.data & 0xC0) != 0x80

    def per_text(marks: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return total[ends] - total[ends - lens]

    out = {"n_words": w.per_text, "word_chars": per_text(w.inside & first_byte),
           "n_upper": per_text(_UPPER[b.data]), "n_letters": per_text(_LETTER[b.data]),
           "n_wide": per_text(first_byte & (b.data >= 0x80))}
    symbol = _SYMBOL[b.data]
    out["n_symbols"] = per_text(symbol)
    total = np.concatenate([[0], np.cumsum(symbol, dtype=np.int64)])
    out["n_symbol_words"] = _count(total[w.end] > total[w.start], w.text, b.count)

    gram, at = grams.windows(w.hashes(lower=False), w.text, 3)
    order, new = grams.sorted_within(gram, w.text[at])
    run = np.cumsum(new) - 1
    twice = order[np.bincount(run, minlength=1)[run] > 1] if len(run) else order
    covered = np.zeros(len(w.text) + 2, dtype=bool)
    for k in range(3):
        covered[at[twice] + k] = True
    out["n_repeat_words"] = _count(covered[:len(w.text)], w.text, b.count)

    start, end, text = b.spans(b.data != 0x0A)
    word_bytes = np.concatenate([[0], np.cumsum(w.inside, dtype=np.int64)])
    real = word_bytes[end] > word_bytes[start]
    lens = end - start
    lines = grams.run_hashes(b.data[b.data != 0x0A], lens)[real]
    text = text[real]
    _, new = grams.sorted_within(lines, text)
    out["n_lines"] = np.bincount(text, minlength=b.count)
    out["n_dup_lines"] = _count(~new, text, b.count)
    return out


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of each text of a batch."""
    parts = [_measure_block(b) for b in grams.blocks(texts)]
    return {m: np.concatenate([p[m] for p in parts]).astype(np.int64) if parts else np.empty(0, np.int64)
            for m in MEASURES}


def fail_bits(measured: Callable[[str], Column] = F.col) -> Column:
    """The bitmask of failed rules."""
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(rule.fails(measured), F.lit(BIT[rule.name])).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its key, the measurements and ``fail_bits``."""
    m = map_text(docs, text, measure, [(n, T.LongType()) for n in MEASURES], [key], "m")
    return m.select(col(key), "m.*").withColumn("fail_bits", fail_bits())


def kept(bits: Column, policy: str | int) -> Column:
    """Whether a ledger row passes a policy, by its version or its own mask."""
    chosen = POLICIES[policy] if isinstance(policy, str) else policy
    return bits.bitwiseAND(F.lit(chosen).cast("long")) == 0


def keep(docs: DataFrame, policy: str | int = NEWEST, text: str = "text") -> DataFrame:
    """The documents that pass, with the columns of ``docs`` only.

    A single narrow pass. Only the texts go to the Python workers, and only numbers come back; all
    other columns stay where they are.
    """
    made = T.StructType([T.StructField(n, T.LongType()) for n in MEASURES])

    @F.arrow_udf(returnType=made)
    def measured(texts: pa.Array) -> pa.Array:
        found = measure(texts)
        pa.default_memory_pool().release_unused()
        return pa.StructArray.from_arrays([pa.array(found[n]) for n in MEASURES], names=MEASURES)

    name = free_name(docs, "ledger")
    # not to be moved or doubled by the optimizer: it is the whole work
    m = docs.withColumn(name, measured.asNondeterministic()(col(text).cast("string")))
    return m.where(kept(fail_bits(lambda n: col(name).getField(n)), policy)).select(*map(col, docs.columns))


def ablation(rows: DataFrame, policy: str | int) -> DataFrame:
    """What each rule of a policy does, from a ledger alone.

    Per rule: documents that fail it (``failed``), that fail nothing else of the policy
    (``only``: kept if the rule went), and documents the policy keeps without the rule
    (``kept_without``). Bit patterns are counted first, so the work after the one small
    shuffle is bounded by the number of patterns, not of documents.
    """
    chosen = POLICIES[policy] if isinstance(policy, str) else policy
    patterns = (rows.select(F.col("fail_bits").bitwiseAND(F.lit(chosen).cast("long")).alias("bits"))
                .groupBy("bits").agg(F.count("*").alias("n")))
    used = [F.struct(F.lit(r.name).alias("rule"), F.lit(BIT[r.name]).cast("long").alias("bit"))
            for r in RULES if BIT[r.name] & chosen]
    each = patterns.select("bits", "n", F.explode(F.array(*used)).alias("r")).select("bits", "n", "r.*")
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("only"),
        F.sum(F.when((F.col("bits") == 0) | (F.col("bits") == F.col("bit")), F.col("n")).otherwise(0))
        .alias("kept_without"))
