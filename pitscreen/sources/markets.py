"""Which markets run the long-short book, and where it is hypothetical."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values: (name, long-short is run, it could not be traded).
SHORTING = [
    ("us", True, False),
    ("united states", True, False),
    ("japan", True, False),
    ("jp", True, False),
    ("vietnam", True, True),
    ("vn", True, True),
]


def allows_shorting(market: str) -> bool:
    return any(m == str(market).lower() and run for m, run, _ in SHORTING)


def is_hypothetical_short(market: str) -> bool:
    return any(m == str(market).lower() and hyp for m, _, hyp in SHORTING)


def shorting_table(spark: SparkSession) -> DataFrame:
    """The registry as a table to join reports with."""
    return spark.createDataFrame(
        SHORTING, "market string, allows_shorting boolean, hypothetical_short boolean")
