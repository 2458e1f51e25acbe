"""Session helpers: where lineage may be cut, and how."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and hand-over tables.

    It is named by ``spark.checkpoint.dir``. Only a single-machine session that names none
    (tests) gets a temporary folder; on a cluster a local folder would not be shared.
    """
    sc = spark.sparkContext
    named = (spark.conf.get("spark.checkpoint.dir", None)
             or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir())
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="pitscreen-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def land(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and continue from the table.

    Cuts the lineage where a result is read several times. The table outlives lost
    executors, and readers get column pruning and filter pushdown.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/landed/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
