"""A training corpus from ``documents``, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept; its result
is written as Parquet and read again as the documents of the next one. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitscreen.llm import decontaminate, ngram_join, quality_rules, source_mix, token_files
from pitscreen.llm.catalog import word_ids
from pitscreen.llm.frames import settle, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the newest policy of quality rules."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id."""
    return ngram_join.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents at square-root weights of their sources, in the size of one epoch."""
    return source_mix.mix(docs, budget=1.0, temperature=0.5, seed=17)


def token_files_of(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy encoded into files, in the shuffled order it lies in, and what they say when read back."""
    manifest = token_files.write(docs, word_ids(), vocabulary=49_408, end_id=1, order_by=[], remembered=200_000, block=2 << 20)
    return token_files.read(manifest, "doc_id", docs.schema["doc_id"].dataType)


STAGES = [("quality_rules", rules), ("ngram_jaccard_join", near_duplicates),
          ("benchmark_decontamination", decontaminated), ("source_mix", mixed), ("token_files", token_files_of)]

#: The join's components and the vocabulary are not expressible; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
