"""The derived inputs themselves: every other query rests on these matching."""

from pyspark.sql import functions as F

from pitscreen.catalog.registry import query

query("input_fundamentals", "S2 J6 P9", "SELECT * FROM fundamentals", "fundamentals")(
    lambda t: t.fundamentals)

query("input_prices", "S1 T3", "SELECT * FROM prices", "prices")(lambda t: t.prices)

query("input_sectors", "J5", "SELECT * FROM sectors", "sectors")(lambda t: t.sectors)

query("input_membership", "S14", "SELECT * FROM membership", "membership")(
    lambda t: t.membership)

query("input_benchmarks", "S16", "SELECT ticker, date, round(adj_close, 4) AS adj_close, volume FROM benchmarks",
      "benchmarks")(lambda t: t.benchmarks.withColumn("adj_close", F.round("adj_close", 4)))
