"""Tables laid out for the joins they serve: dealt by their keys once, and in folders by year.

A laid-out table is a bucketed one in the shared folder: rows of one key lie in one bucket, so joins, aggregates
and windows by these keys read it without a shuffle, as long as their other side is laid out alike or is itself
shuffled into as many partitions. Where a column is named for folders, a range of its values opens only those folders.
Like other landed tables it is known to the session that wrote it.
"""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from pitscreen.session import shared_folder


@dataclass(frozen=True)
class LaidOut:
    spark: SparkSession
    table: str
    folder_by: str | None
    folder: str | None
    buckets: int

    def read(self, first=None, last=None) -> DataFrame:
        """All rows, or those whose folder column lies between two values, both included."""
        if self.folder is None:
            if first is not None or last is not None:
                raise ValueError("the table has no folders to choose from")
            return self.spark.table(self.table)
        df = self.spark.table(self.table)
        for bound, holds in ((first, lambda c, v: c >= v), (last, lambda c, v: c <= v)):
            if bound is not None:
                df = df.where(holds(F.col(self.folder), F.lit(bound)))
        return df.drop(self.folder)


def lay_out(df: DataFrame, name: str, keys: list[str], sort: tuple[str, ...] = (), folder_by: str | None = None,
            buckets: int | None = None) -> LaidOut:
    """Writes ``df`` dealt by ``keys`` into ``buckets`` (by default as many as a shuffle has partitions).

    Every bucket is written by one task, so a folder holds at most one file a bucket. Tables that
    are joined with each other need the same keys, in the same order, of the same types, and the same buckets. The
    keys should spread: what is dealt here are keys with at most a year of sessions.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    unique = uuid4().hex
    folder = None
    if folder_by:
        folder = f"{folder_by}_folder"
        while folder.lower() in {c.lower() for c in df.columns}:
            folder += "_"
        df = df.withColumn(folder, F.col(folder_by))
    writer = df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys, *sort)
    if folder:
        writer = writer.partitionBy(folder)
    table = f"{name.replace('-', '_')}_{unique}"
    writer.option("path", f"{shared_folder(spark).rstrip('/')}/laid-out/{name}-{unique}").saveAsTable(table)
    return LaidOut(spark, table, folder_by, folder, n)
