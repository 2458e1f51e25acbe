"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitscreen.llm import (
    decontaminate,
    hpy_lm,
    language_id,
    line_crf,
    ngram_join,
    quality_rules,
    secret_scan,
    source_audit,
    source_mix,
    token_alignment,
    token_files,
    toxicity,
    vector_search,
)
from pitscreen.llm.frames import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


JUDGED = ("doc_id", "held_out", "score", "predicted")


def led(df: DataFrame, *first: str) -> DataFrame:
    """The columns a contract names, then all further ones."""
    return df.select(*first, *[c for c in df.columns if c not in first])


@query("op9_quality_rules", r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(w.w) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(l.n_lines, 0) AS n_lines, coalesce(l.n_dup, 0) AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters,
         length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) AS n_wide,
         len(list_filter(w.w, lambda x: regexp_matches(x, '[#*$%&|<>]'))) AS n_symbol_words
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN n_words > 1000000 THEN 4 ELSE 0 END
    + CASE WHEN word_chars < 3 * n_words OR word_chars > 20 * n_words THEN 8 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 10 * n_symbol_words > 3 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 2 * n_dup_lines > n_lines THEN 64 ELSE 0 END
    + CASE WHEN 2 * n_upper > n_letters THEN 128 ELSE 0 END
    + CASE WHEN 2 * n_upper > n_letters + n_wide THEN 256 ELSE 0 END
    + CASE WHEN 2 * n_wide <= word_chars AND (word_chars < 3 * n_words OR word_chars > 20 * n_words)
           THEN 512 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 883) = 0 AS kept, fail_bits FROM b""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of every document under the newest policy, beside the base policy."""
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~quality_rules.kept(F.col("fail_bits"), "base")).alias("base_failed"),
                       quality_rules.kept(F.col("fail_bits"), quality_rules.NEWEST).alias("kept"), "fail_bits")


@query("op2_secret_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    s, base = F.col("spans"), ("assign", "access", "hex")
    return found.select(
        "doc_id", *[secret_scan.count(s, k).alias(f"n_{k}") for k in base],
        F.sha2(secret_scan.listed(s, *base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.listed(s, *secret_scan.KINDS).alias("spans"),
        *[secret_scan.count(s, k).alias(f"n_{k}") for k in secret_scan.KINDS if k not in base],
        F.array_max(F.transform(s, lambda x: x["log10_guesses"])).alias("max_log10_guesses"))


@query("op3_source_mix", f"""
WITH s AS (SELECT source, sum(length(coalesce(text, ''))) AS size FROM documents GROUP BY source),
r AS (SELECT source, CASE WHEN size > 0 THEN sqrt(size) / (SELECT sum(sqrt(size)) FROM s)
        * (SELECT sum(size) FROM s) / size ELSE 1.0 END AS rate FROM s),
p AS (SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS pmf
      FROM (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 31) AS BIGINT))) AS k FROM r)),
c AS (SELECT source, k, sum(pmf) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
d AS (SELECT doc_id, source, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT
        / {float(1 << 60)!r} AS u FROM documents),
n AS (SELECT d.doc_id, d.source, count(*) AS n FROM d JOIN c
      ON c.source IS NOT DISTINCT FROM d.source AND c.cdf <= d.u GROUP BY d.doc_id, d.source)
SELECT doc_id, source, copy::INTEGER AS copy, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')
       || ':' || copy), 1, 15))::BIGINT AS shuffle_key
FROM (SELECT *, unnest(range(0, n)) AS copy FROM n)""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every document, at square-root weights of the sources and the size of one epoch."""
    mixed = source_mix.mix(table(spark, sf_dir, "documents"), budget=1.0, temperature=0.5, seed=17,
                           copy="copy", order="shuffle_key")
    return mixed.select("doc_id", "source", "copy", "shuffle_key")


@query("op10_decontamination", r"""
WITH d AS (SELECT DISTINCT doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT item_id, text, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
iq AS (SELECT DISTINCT item_id, text, w, least(len(w), 5) AS q FROM i WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, text, q, array_to_string(w[p:p + q - 1], ' ') AS g
       FROM (SELECT *, unnest(range(1, len(w) - q + 2)) AS p FROM iq)),
im AS (SELECT item_id, text, count(*) AS m FROM ig GROUP BY item_id, text),
dg AS (SELECT DISTINCT doc_id, text, q, array_to_string(w[p:p + q - 1], ' ') AS g
       FROM (SELECT doc_id, text, w, q, unnest(range(1, len(w) - q + 2)) AS p
             FROM d, (SELECT DISTINCT q FROM iq))),
o AS (SELECT dg.doc_id, dg.text AS t, ig.item_id, ig.text, count(*) AS n FROM dg JOIN ig USING (q, g) GROUP BY ALL)
SELECT doc_id, item_id, im.m::INTEGER AS n_item_shingles, max(n)::INTEGER AS n_found, max(n) / im.m AS containment
FROM o JOIN im USING (item_id, text) GROUP BY doc_id, item_id, im.m, text HAVING max(n) >= 0.8 * im.m""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, item) with at least 0.8 of the item's five-word shingles in the document."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def public(name: str) -> str:
    """A vocabulary file of the public tokenizers, installed alike on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def word_ids() -> str:
    return public("word_bpe_49k.json")


@query("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded in key order, and what the files say of it when read back."""
    docs = table(spark, sf_dir, "documents")
    manifest = token_files.write(docs, word_ids(), vocabulary=49_408, end_id=1)
    return token_files.read(manifest, "doc_id", docs.schema["doc_id"].dataType)


@query("op8_ngram_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingle sets have a Jaccard similarity of 0.8 or more."""
    found = ngram_join.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), "copies")


@query("ngram_link_counts")
def op8_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document, and the number of other documents with a Jaccard similarity of 0.8 or more."""
    return ngram_join.link_counts(table(spark, sf_dir, "documents"))


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    model = language_id.fit(docs, ~out)
    return led(language_id.predict(docs, model).withColumn("held_out", out), "doc_id", "held_out", "lang_pred", "score")


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from four fifths of the labelled ones."""
    docs, out = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 5, 0)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~out)
    return (toxicity.score(docs, model).withColumn("held_out", out)
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")).transform(led, *JUDGED))


@query("op4_line_crf")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from two thirds of the labelled ones."""
    docs, out = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 3, 1)
    model = line_crf.fit(docs, table(spark, sf_dir, "labels"), ~out)
    return (line_crf.score(docs, model).withColumn("held_out", out)
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")).transform(led, *JUDGED))


@query("op6_hpy_lm")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document under a model of six sevenths of them."""
    out = held_out(F.col("doc_id"), 7, 2)
    scored, model = hpy_lm.fit_and_score(table(spark, sf_dir, "documents"), ~out)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known",
                         F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
                         F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of the tokens of two vocabularies that cover the same bytes, and the counts of their links."""
    return token_alignment.align(table(spark, sf_dir, "documents"), public("byte_bpe_50k.json"), public("piece_bpe_32k.model"))


@query("op12_vector_search", """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank
  FROM (SELECT DISTINCT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
        FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0))
WHERE rank <= 20""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found of every twentieth vector; the SQL is exact, as the search is on small tables."""
    return vector_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op13_source_audit", r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
                  regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS lang_n FROM c GROUP BY ALL HAVING sum(docs) >= 10),
v AS (SELECT lang, count(*) AS terms, sum(lang_n) AS lang_total FROM k GROUP BY lang),
u AS (SELECT c.lang, c.source, sum(n) AS total FROM c JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT g.lang, g.source, coalesce(total, 0) AS total, terms, lang_total FROM (SELECT DISTINCT lang, source FROM d) g
      LEFT JOIN u USING (lang, source) LEFT JOIN v USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             (1 + (1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT) // (total + 2 * terms))::BIGINT AS p,
             (1 + (1000000000 * (lang_n + 2)::HUGEINT) // (lang_total + 2 * terms))::BIGINT AS q
      FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
pr AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
       FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
al AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
       FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source
       UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM al)
WHERE part = 'pair' OR rank <= 10""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every two sources of a language, and the terms in which a source stands out most."""
    return source_audit.audit(table(spark, sf_dir, "documents"))
