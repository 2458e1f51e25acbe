"""Buy-and-hold value paths from price bars, without a name-by-session grid.

A held name's growth only moves on days it trades, so a book's value is one plus the
running sum of weighted growth steps over real bars. Carrying a name through gaps or after
its last trade is then simply the absence of a step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from pitscreen.functions.dates import (formation_date, formations_covering, holding_formation)

YEAR = "formation_year"
BASE_DAYS = 7


def calendar(prices: DataFrame) -> DataFrame:
    """Market sessions: every date any name has a bar on."""
    return prices.select("date").distinct()


def _holding_years(date) -> F.Column:
    formed = formation_date(F.year(date))
    base = F.when((date < formed) & (date >= F.date_sub(formed, BASE_DAYS)), F.year(date))
    return F.array_compact(F.array(holding_formation(date), base))


def holding_sessions(prices: DataFrame) -> DataFrame:
    """(formation_year, date, session): sessions after formation up to 30 June."""
    days = (calendar(prices)
            .select("date", holding_formation(F.col("date")).alias(YEAR))
            .where(F.col("date") > formation_date(F.col(YEAR))))
    return days.withColumn("session", F.row_number().over(W.partitionBy(YEAR).orderBy("date")))


def bars_by_formation(prices: DataFrame) -> DataFrame:
    """Bars with the formation whose holding year, or the seven days before it, they lie in."""
    return prices.select("ticker", "date", "adj_close",
                         F.explode(_holding_years(F.col("date"))).alias(YEAR))


def holding_bars(prices: DataFrame, names: DataFrame) -> DataFrame:
    """Bars of each name in its holding year and the seven days before it.

    Prices that already bear a formation, such as a laid-out ``bars_by_formation``, are taken as they are.
    """
    tagged = prices if YEAR in prices.columns else bars_by_formation(prices)
    return tagged.join(names.select(YEAR, "ticker").distinct(), [YEAR, "ticker"])


def growth_steps(prices: DataFrame, names: DataFrame, delisting_return: float = 0.0,
                 with_base: bool = False) -> DataFrame:
    """(formation_year, ticker, date, r, step) for every bar after formation.

    ``r`` is the return since the previous bar (carried price), ``step`` the change in the
    value of one unit bought at formation. Prices carry at most one bar per session, so a
    (year, ticker) window is bounded by the calendar. With ``delisting_return`` a one-off
    return is booked on the first session after the last bar.
    """
    key = W.partitionBy(YEAR, "ticker")
    formed = formation_date(F.col(YEAR))
    held = F.when(F.col("date") > formed, F.col("date"))
    before = F.when(F.col("date") <= formed, F.col("date"))
    bars = (holding_bars(prices, names)
            .withColumn("base", F.coalesce(F.max_by("adj_close", before).over(key),
                                           F.min_by("adj_close", held).over(key)))
            .withColumn("prev", F.lag("adj_close").over(key.orderBy("date"))))
    steps = bars.select(
        YEAR, "ticker", "date",
        (F.col("adj_close") / F.col("prev") - 1).alias("r"),
        ((F.col("adj_close") - F.coalesce("prev", "adj_close")) / F.col("base")).alias("step"),
        held.isNotNull().alias("held"))
    if delisting_return:
        last = bars.groupBy(YEAR, "ticker").agg(
            F.max("date").alias("date"),
            F.max_by(F.col("adj_close") / F.col("base"), "date").alias("level"))
        steps = steps.unionByName(
            last.join(F.broadcast(_next_session(prices)), [YEAR, "date"])
            .select(YEAR, "ticker", F.col("next").alias("date"),
                    F.lit(delisting_return).alias("r"),
                    (F.col("level") * delisting_return).alias("step"),
                    F.lit(True).alias("held")))
    return steps if with_base else steps.where("held").drop("held")


def _next_session(prices: DataFrame) -> DataFrame:
    """(formation_year, date, next): first holding session after each calendar date."""
    days = calendar(prices).select("date", F.explode(_holding_years(F.col("date"))).alias(YEAR))
    held = F.when(F.col("date") > formation_date(F.col(YEAR)), F.col("date"))
    after = W.partitionBy(YEAR).orderBy("date").rowsBetween(1, W.unboundedFollowing)
    return days.withColumn("next", F.min(held).over(after)).where(F.col("next").isNotNull())


def last_bars(prices: DataFrame, names: DataFrame) -> DataFrame:
    """(formation_year, ticker, last): the last bar of each name that has one in its holding year or the week before."""
    return holding_bars(prices, names).groupBy(YEAR, "ticker").agg(F.max("date").alias("last"))


def stopped_names(prices: DataFrame, names: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """Per formation: names whose last bar lies before the last session of the window.

    ``last`` may hand over the ``last_bars`` of these names.
    """
    last = last_bars(prices, names) if last is None else last
    end = (calendar(prices).withColumn(YEAR, F.explode(_holding_years(F.col("date"))))
           .groupBy(YEAR).agg(F.max("date").alias("_end")))
    return (last.join(F.broadcast(end), YEAR).groupBy(YEAR)
            .agg(F.count_if(F.col("last") < F.col("_end")).alias("delisted_in_holding_year")))


def book_values(positions: DataFrame, steps: DataFrame, sessions: DataFrame) -> DataFrame:
    """(formation_year, book, leg, date, value): each leg normalised to start at one.

    ``positions`` is (formation_year, book, ticker, w) with legs of opposite sign each
    summing to plus or minus one. Steps are summed per book and day before the running sum.
    """
    signed = _legs(positions)
    moves = signed.join(steps, [YEAR, "ticker"]).select(
        YEAR, "book", "leg", "date", (F.col("w") * F.col("step")).alias("move"))
    # sessions of a year per book of that year: the size of the result itself
    grid = (signed.select(YEAR, "book", "leg").distinct()
            .join(F.broadcast(sessions.select(YEAR, "date")), YEAR)
            .withColumn("move", F.lit(0.0)))
    w = W.partitionBy(YEAR, "book", "leg").orderBy("date")
    return (moves.unionByName(grid)
            .groupBy(YEAR, "book", "leg", "date").agg(F.sum("move").alias("move"))
            .withColumn("value", 1 + F.sum("move").over(w)).drop("move"))


def _legs(positions: DataFrame) -> DataFrame:
    return positions.select(YEAR, "book", "ticker", F.abs("w").alias("w"),
                            F.when(F.col("w") < 0, -1).otherwise(1).alias("leg"))


def book_returns(values: DataFrame) -> DataFrame:
    """(formation_year, book, date, r): long-leg return less short-leg return."""
    w = W.partitionBy(YEAR, "book", "leg").orderBy("date")
    prev = F.coalesce(F.lag("value").over(w), F.lit(1.0))
    daily = values.withColumn("r", F.col("value") / prev - 1)
    return (daily.groupBy(YEAR, "book", "date")
            .agg(F.sum(F.col("leg") * F.col("r")).alias("r")))


def end_weights(positions: DataFrame, steps: DataFrame) -> DataFrame:
    """Weights a book has drifted to by the end of its holding year."""
    return drifted(positions, growth_at_end(steps))


def growth_at_end(steps: DataFrame) -> DataFrame:
    """(formation_year, ticker, growth): what one unit has become by the end of the holding year."""
    return steps.groupBy(YEAR, "ticker").agg((1 + F.sum("step")).alias("growth"))


def drifted(positions: DataFrame, growth: DataFrame) -> DataFrame:
    """``end_weights`` by the growth of each name."""
    grown = (_legs(positions).join(growth, [YEAR, "ticker"], "left")
             .withColumn("grown", F.col("w") * F.coalesce("growth", F.lit(1.0))))
    total = grown.groupBy(YEAR, "book", "leg").agg(F.sum("grown").alias("total"))
    return (grown.join(total, [YEAR, "book", "leg"])
            .select(YEAR, "book", "ticker",
                    (F.col("leg") * F.col("grown") / F.col("total")).alias("w")))


def returns_panel(prices: DataFrame, names: DataFrame,
                  delisting_return: float = 0.0) -> DataFrame:
    """(formation_year, ticker, date, r) on every session from a name's first price on.

    Each bar is spread over the sessions up to the next bar (zero return after the first),
    so the table is built from the bars themselves.
    """
    steps = growth_steps(prices, names, delisting_return, with_base=True)
    sessions = holding_sessions(prices)
    numbered = steps.join(F.broadcast(sessions), [YEAR, "date"], "left")
    count = sessions.groupBy(YEAR).agg(F.max("session").alias("_last"))
    key = W.partitionBy(YEAR, "ticker").orderBy("date")
    spans = (numbered.withColumn("session", F.coalesce("session", F.lit(0)))
             .withColumn("_next", F.lead("session").over(key))
             .join(F.broadcast(count), YEAR)
             .withColumn("_to", F.coalesce(F.col("_next") - 1, F.col("_last")))
             .where(F.col("_to") >= F.col("session")))
    spread = spans.withColumn("s", F.explode(F.sequence("session", "_to")))
    value = F.when(F.col("s") == F.col("session"), F.col("r")).otherwise(F.lit(0.0))
    return (spread.where((F.col("s") > 0) & value.isNotNull())
            .select(YEAR, "ticker", F.col("s").alias("session"), value.alias("r"))
            .join(F.broadcast(sessions), [YEAR, "session"])
            .select(YEAR, "ticker", "date", "r"))


def fixed_weight_returns(prices: DataFrame, positions: DataFrame, start, end) -> DataFrame:
    """(formation_year, book, date, r): daily-rebalanced returns of fixed weights, only consecutive quotes count.

    ``start`` and ``end`` are dates, or columns of the positions such as a date of each formation; they lie
    in the holding year of the formation, so a bar only meets the books of its own year that hold the name.
    A book's sessions are the days on which any of its names has a bar.
    """
    start, end = (F.to_date(F.lit(x)) if isinstance(x, str) else x for x in (start, end))
    bars = prices.select("ticker", "date", "adj_close", F.explode(_holding_years(F.col("date"))).alias(YEAR))
    held = (bars.join(positions.select(YEAR, "book", "ticker", "w", start.alias("start"), end.alias("end")), [YEAR, "ticker"])
            .where(F.col("date").between(F.col("start"), F.col("end"))))
    days = (held.select(YEAR, "book", "date").distinct()
            .withColumn("s", F.row_number().over(W.partitionBy(YEAR, "book").orderBy("date"))))
    w = W.partitionBy(YEAR, "book", "ticker").orderBy("s")
    next_to = F.col("s") - F.lag("s").over(w) == 1
    r = held.join(days, [YEAR, "book", "date"]).withColumn(
        "r", F.when(next_to, F.col("adj_close") / F.lag("adj_close").over(w) - 1))
    return (r.groupBy(YEAR, "book", "date").agg(F.sum(F.col("w") * F.col("r")).alias("r"))
            .where(F.col("r").isNotNull()))


def calendar_of(prices: DataFrame, positions: DataFrame) -> DataFrame:
    return prices.join(positions.select("ticker").distinct(), "ticker").select("date").distinct()


# ---- estimation window ----

def estimation_sessions(prices: DataFrame, months: int = 36) -> DataFrame:
    """(formation_year, date, session, sessions): sessions strictly inside the window.

    Days of the base week before the window carry session 0.
    """
    days = (calendar(prices)
            .withColumn(YEAR, F.explode(formations_covering(F.col("date"), months, BASE_DAYS))))
    start = F.add_months(formation_date(F.col(YEAR)), -months)
    inside = (F.col("date") > start).cast("int")
    by = W.partitionBy(YEAR)  # sessions of a window of fixed length
    return (days.withColumn("session", F.sum(inside).over(by.orderBy("date")))
            .withColumn("sessions", F.sum(inside).over(by)))


def estimation_series(prices: DataFrame, names: DataFrame, months: int = 36) -> DataFrame:
    """Per (formation_year, ticker): sparse daily returns of the estimation window.

    ``first`` is the session of the first price (0 = already priced when the window opens),
    ``at`` / ``r`` list the sessions with a bar and the carried return on them; every other
    session after ``first`` has a zero return.
    """
    sessions = estimation_sessions(prices, months)
    wanted = names.groupBy("ticker").agg(F.collect_set(F.col(YEAR).cast("int")).alias("_years"))
    # bars are dealt by name before they are repeated for each window they lie in
    tagged = (prices.select("ticker", "date", "adj_close").repartition("ticker").join(wanted, "ticker")
              .select("ticker", "date", "adj_close", F.explode(F.array_intersect(
                  formations_covering(F.col("date"), months, BASE_DAYS), "_years")).alias(YEAR))
              .join(F.broadcast(sessions), [YEAR, "date"]))
    w = W.partitionBy(YEAR, "ticker").orderBy("date")
    moved = tagged.withColumn("r", F.col("adj_close") / F.lag("adj_close").over(w) - 1)
    bar = F.when((F.col("session") > 0) & F.col("r").isNotNull(), F.struct("session", "r"))
    out = moved.groupBy(YEAR, "ticker").agg(
        F.min("session").alias("first"), F.first("sessions").alias("sessions"),
        F.sort_array(F.collect_list(bar)).alias("_b"))
    return out.select(YEAR, "ticker", "first", "sessions",
                      F.col("_b.session").alias("at"), F.col("_b.r").alias("r"),
                      (F.col("sessions") - F.col("first")).alias("n_returns"))
