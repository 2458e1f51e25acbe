"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitscreen.session import land

#: A table of at most this many keys (16 bytes each) is broadcast; a longer one is shuffled.
BROADCAST_ROWS = 1_000_000
SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_name(df: DataFrame, wanted: str, also: tuple[str, ...] = ()) -> str:
    """``wanted``, lengthened until no column of ``df``, and none of ``also``, bears it in any case."""
    taken = {c.lower() for c in (*df.columns, *also)}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def col(name: str) -> Column:
    """A column by its plain name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_text(df: DataFrame, text: str, measure: Callable[[pa.Array], dict[str, np.ndarray | pa.Array]],
             fields: list[tuple[str, T.DataType]], keep: list[str], into: str) -> DataFrame:
    """``keep`` columns of ``df`` and a struct column ``into`` that ``measure`` makes of the texts.

    One narrow pass: rows stay in their partitions, and only the named columns are read.
    """
    parts = [col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    narrow = df.select(*parts, col(text).cast("string").alias("x"))
    kinds = [f.dataType for f in narrow.schema.fields[:-1]]
    made = T.StructType([T.StructField(n, t) for n, t in fields])
    schema = T.StructType([T.StructField(f"k{i}", t) for i, t in enumerate(kinds)] + [T.StructField("m", made)])
    names = [n for n, _ in fields]
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column(n_keep))
            values = pa.StructArray.from_arrays([pa.array(found[n]) for n in names], names=names)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], values],
                                             names=[f"k{i}" for i in range(n_keep)] + ["m"])

    out = narrow.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("m").alias(into))


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text leaves ``fold`` when divided by ``folds``; false for null keys."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def settle(df: DataFrame, name: str) -> DataFrame:
    """``land``, after which the shuffle files of the job are dropped: the table replaces them."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark = df.sparkSession
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        return land(df, name)
    finally:
        spark.conf.set(setting, before)


def discard(*tables: DataFrame) -> None:
    """Deletes landed tables that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def matched(df: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """Semi or anti join on a landed table of distinct keys, broadcast only if its size allows."""
    small = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(keys) if small else keys, on, how)
