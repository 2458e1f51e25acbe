"""Stored tables that are refreshed partition by partition, and writes that hold contracts.

A fingerprint of a partition's inputs does not depend on the order of rows or files. It is kept beside
the table; a refresh rebuilds the partitions whose fingerprint has changed and overwrites only these.
Fingerprints are stored after the data, so a refresh that dies in between does its partitions again.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from pitscreen.session import land

MARKS = ["rows", "low", "high", "mixed"]


def fingerprints(df: DataFrame, by: str) -> DataFrame:
    """(by, rows, low, high, mixed): per partition the number of rows and order-free sums of their hashes.

    Sums tell repeated rows apart, which the xor alone would cancel; a null differs from an absent value's
    neighbour, as each column is hashed beside its null mark.
    """
    columns = sorted(c for c in df.columns if c != by)
    h = F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])
    half = F.lit((1 << 32) - 1)
    return df.withColumn("_h", h).groupBy(by).agg(
        F.count("*").alias("rows"), F.sum(F.col("_h").bitwiseAND(half)).alias("low"),
        F.sum(F.shiftrightunsigned("_h", 32)).alias("high"), F.bit_xor("_h").alias("mixed"))


def refresh(spark: SparkSession, path: str, inputs: DataFrame, by: str,
            build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Brings the table at ``path`` up to its inputs; (by, action) per partition: written, kept or removed.

    ``build`` makes the table's rows, ``by`` included, of the inputs of some partitions, each from its own inputs.
    What comes back to the driver is a row per partition, as many as there are formation years.
    """
    now = land(fingerprints(inputs, by), "fingerprints")
    try:
        before = land(spark.read.parquet(f"{path}-marks").select(by, *MARKS), "fingerprints-before")
    except AnalysisException:
        before = now.where(F.lit(False))
    same = F.lit(True)
    for m in MARKS:
        same = same & F.col(f"a.{m}").eqNullSafe(F.col(f"b.{m}"))
    plan = land(now.alias("a").join(before.alias("b"), F.col(f"a.{by}").eqNullSafe(F.col(f"b.{by}")), "full").select(
        F.coalesce(f"a.{by}", f"b.{by}").alias(by), F.when(F.col("a.rows").isNull(), "removed")
        .when(same, "kept").otherwise("written").alias("action")), "refresh-plan")
    stale = [r[0] for r in plan.where("action = 'written'").select(by).collect()]
    if stale:
        mine = F.col(by).isin([x for x in stale if x is not None])
        mine = (mine | F.col(by).isNull()) if None in stale else mine
        (build(inputs.where(mine)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(by).parquet(path))
    now.write.mode("overwrite").parquet(f"{path}-marks")
    return plan


def read_refreshed(spark: SparkSession, path: str, by: str) -> DataFrame:
    """The table, without partitions whose inputs are gone."""
    marks = spark.read.parquet(f"{path}-marks").select(by)
    return spark.read.parquet(path).join(F.broadcast(marks), by, "left_semi")  # a row per partition


class ContractBreach(ValueError):
    """A written table broke its contract and was not published; ``observed`` has the counts."""

    def __init__(self, observed: dict[str, int]):
        super().__init__(f"not published: {({k: v for k, v in observed.items() if v and k != 'rows'})}")
        self.observed = observed


def write_checked(df: DataFrame, path: str, rules: dict[str, Column]) -> dict[str, int]:
    """Writes a version of a table and publishes it if every row keeps every rule.

    The rows that break a rule are counted by the job that writes, without another pass; a
    version with a breach stays unpublished, and readers go on with the one before.
    """
    spark, seen, version = df.sparkSession, Observation(), f"{path}/version-{uuid4().hex}"
    broken = [F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *broken).write.parquet(version)
    observed = {"rows": seen.get["rows"], **{name: seen.get[name] for name in rules}}
    if any(observed[name] for name in rules):
        raise ContractBreach(observed)
    spark.range(1).select(F.lit(version).alias("version")).coalesce(1).write.mode("overwrite").parquet(f"{path}/published")
    return observed


def read_published(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(spark.read.parquet(f"{path}/published").first()["version"])
