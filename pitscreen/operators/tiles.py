"""Daily returns of many random books as a blocked matrix product.

A book's value moves by the sum over its names of weight times growth step: (books x names) times
(names x sessions). Books and names are cut into blocks; one task multiplies one tile of each, and the
products of a block of books are summed over the name blocks. So a name's steps are shuffled once for each block of
books, and not once for each book that holds it, and what a tile returns has one row a book.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from pitscreen.operators.paths import YEAR

#: Books and names of a tile: 8 bytes * BOOKS * NAMES, and as much again for 260 sessions of the names.
BOOKS, NAMES = 256, 2048


def tiled_moves(positions: DataFrame, steps: DataFrame, sessions: DataFrame, books: int = BOOKS,
                names: int = NAMES) -> DataFrame:
    """(formation_year, book, moves): per book the change of its value on each session of the year, in order.

    ``positions`` is (formation_year, book, ticker, w) with whole numbers as books and weights of one sign;
    ``steps`` and ``sessions`` as in ``paths.book_values``.
    """
    sizes = sessions.groupBy(YEAR).agg(F.max("session").cast("int").alias("last"))
    held = steps.select(YEAR, "ticker").distinct().groupBy(YEAR).agg(F.count("*").alias("n"))
    blocks = max(1, -(-(held.agg(F.max("n")).first()[0] or 1) // names))
    part = F.pmod(F.xxhash64("ticker"), F.lit(blocks)).cast("int")
    left = (positions.select(YEAR, "book", "ticker", "w", F.floor(F.col("book") / books).cast("long").alias("rows"), part.alias("cols"))
            .join(F.broadcast(sizes), YEAR))
    tiles = left.select(F.col(YEAR).alias("year"), F.col("rows").alias("of_rows"), F.col("cols").alias("of_cols")).distinct()
    right = (steps.select(F.col(YEAR).alias("year"), "ticker", "date", "step", part.alias("of_cols"))
             .join(F.broadcast(sessions.select(F.col(YEAR).alias("year"), "date", "session")), ["year", "date"])
             .join(tiles, ["year", "of_cols"]).select("year", "of_rows", "of_cols", "ticker", "session", "step"))

    def multiply(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty:
            return pd.DataFrame({YEAR: [], "book": [], "moves": []})
        tickers, j = np.unique(b["ticker"].to_numpy(dtype=str), return_inverse=True)
        s = np.zeros((len(tickers), int(a["last"].iloc[0])))
        np.add.at(s, (j, b["session"].to_numpy(dtype=int) - 1), b["step"].to_numpy(dtype=float))
        own, i = np.unique(a["book"].to_numpy(), return_inverse=True)
        mine = a["ticker"].to_numpy(dtype=str)
        at = np.minimum(np.searchsorted(tickers, mine), max(len(tickers) - 1, 0))
        known = tickers[at] == mine if len(tickers) else np.zeros(len(mine), bool)
        w = np.zeros((len(own), len(tickers)))
        np.add.at(w, (i[known], at[known]), a["w"].to_numpy(dtype=float)[known])
        return pd.DataFrame({YEAR: int(a[YEAR].iloc[0]), "book": own, "moves": list(w @ s)})

    made = left.groupBy(YEAR, "rows", "cols").cogroup(right.groupBy("year", "of_rows", "of_cols")).applyInPandas(
        multiply, f"{YEAR} int, book {dict(positions.dtypes)['book']}, moves array<double>")
    if blocks == 1:
        return made
    zero = F.transform(F.element_at(F.collect_list("moves"), 1), lambda x: F.lit(0.0))
    return made.groupBy(YEAR, "book").agg(F.aggregate(
        F.collect_list("moves"), zero, lambda total, x: F.zip_with(total, x, lambda p, q: p + q)).alias("moves"))


def tiled_returns(positions: DataFrame, steps: DataFrame, sessions: DataFrame, **tile: int) -> DataFrame:
    """(formation_year, book, date, r), as ``paths.book_returns`` of ``paths.book_values``."""
    w = W.partitionBy(YEAR, "book").orderBy("session")  # sessions of one year
    moves = tiled_moves(positions, steps, sessions, **tile).select(YEAR, "book", F.posexplode("moves").alias("at", "move"))
    values = (moves.withColumn("session", F.col("at") + 1).withColumn("value", 1 + F.sum("move").over(w))
              .join(F.broadcast(sessions.select(YEAR, "date", "session")), [YEAR, "session"])
              .withColumn("prev", F.coalesce(F.lag("value").over(w), F.lit(1.0))))
    return values.select(YEAR, "book", "date", (F.col("value") / F.col("prev") - 1).alias("r"))
