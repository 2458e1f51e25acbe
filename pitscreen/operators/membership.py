"""Index membership as validity intervals, so that any day can be asked, not only formation dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from pitscreen.functions.symbols import member_symbol


def intervals(history: DataFrame) -> DataFrame:
    """(ticker, start, end): spells of membership from snapshots (date, comma list).

    A name is a member from a snapshot that lists it until the first later one that does not; ``end`` is that
    day, or null while the newest snapshot lists the name. A snapshot may be split over several rows.
    Snapshots are numbered (one row each); runs of consecutive numbers of a name are its spells.
    """
    numbered = (history.select("date").distinct()
                .withColumn("place", F.row_number().over(W.orderBy("date")))
                .withColumn("next", F.lead("date").over(W.orderBy("date"))))
    listed = (history.select("date", F.explode(F.split("tickers", ",")).alias("raw")).where(F.trim("raw") != "")
              .select("date", member_symbol(F.col("raw")).alias("ticker")).distinct()
              .join(F.broadcast(numbered), "date"))
    spell = F.col("place") - F.row_number().over(W.partitionBy("ticker").orderBy("place"))
    return (listed.withColumn("spell", spell).groupBy("ticker", "spell")
            .agg(F.min("date").alias("start"), F.max_by("next", "place").alias("end")).drop("spell"))


def members_on(days: DataFrame, spells: DataFrame) -> DataFrame:
    """(date, ticker) for every asked day: an interval join that meets by calendar year.

    A spell is in each year it touches, so a day meets the spells of its own year only.
    """
    asked = days.select("date").distinct().withColumn("year", F.year("date"))
    last = asked.agg(F.max("year")).first()[0]
    to = F.coalesce(F.year("end"), F.greatest(F.lit(last), F.year("start")))
    binned = spells.select("ticker", "start", "end", F.explode(F.sequence(F.year("start"), to)).alias("year"))
    return (asked.join(binned, "year")
            .where((F.col("date") >= F.col("start")) & (F.col("end").isNull() | (F.col("date") < F.col("end"))))
            .select("date", "ticker"))
