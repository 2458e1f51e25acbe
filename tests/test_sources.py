"""File sources, facts, identifiers, merges and checks on hand-made inputs."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pitscreen.functions import numeric as N, symbols as Y
from pitscreen.functions.dates import fiscal_label, formations_covering
from pitscreen.operators import asof as A, checks as V, shares as H, tables as O
from pitscreen.sources import facts as X, line_items as L, tables as T
from pitscreen.sources.schemas import COMPANY_FACTS, PRICES

D = dt.date


def test_missing_market_file_is_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="us_fundamentals"):
        T.load_market(spark, "us", str(tmp_path))
    with pytest.raises(NotImplementedError):
        T.load_prices(spark, "atlantis", str(tmp_path))


def test_csv_round_trip_turns_nan_into_null(spark, tmp_path):
    p = str(tmp_path / "p.csv.gz")
    df = spark.createDataFrame([("A", D(2024, 1, 2), float("nan"), 1.0, 5.0), ("B", D(2024, 1, 2), 2.0, 1.0, 5.0)], PRICES)
    T.write_table(df, p, "csv.gz")
    back = T.read_gzip_csv(spark, p, PRICES, "ticker")
    assert {r.ticker: r.adj_close for r in back.collect()} == {"A": None, "B": 2.0}
    assert back.schema == PRICES


def test_yearly_folder_gives_the_year_and_prunes(spark, tmp_path):
    p = str(tmp_path / "y")
    a = spark.createDataFrame([("A", 1.0)], "t string, x double").withColumn("year", F.lit(2020))
    b = spark.createDataFrame([("B", 2.0, 3.0)], "t string, x double, z double").withColumn("year", F.lit(2021))
    a.write.partitionBy("year").parquet(p)
    b.write.mode("append").partitionBy("year").parquet(p)
    got = {(r.t, r.year, r.z) for r in T.read_yearly(spark, p).collect()}
    assert got == {("A", 2020, None), ("B", 2021, 3.0)}
    stacked = T.stack_years({2020: a.drop("year"), 2021: b.drop("year")}, "sheet")
    assert {(r.t, r.sheet) for r in stacked.collect()} == {("A", 2020), ("B", 2021)}


def test_delivered_panel_is_never_rebuilt(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="vendor chain"):
        T.panel_or_build(spark, "vietnam", str(tmp_path / "no"), lambda: None)


def facts(spark, rows):
    """rows: (taxonomy, tag, unit, start, end, val, filed, form)"""
    nested = {}
    for tax, tag, unit, start, end, val, filed, form in rows:
        nested.setdefault(tax, {}).setdefault(tag, {"units": {}})["units"].setdefault(unit, []).append(
            {"start": start, "end": end, "val": val, "filed": filed, "form": form})
    from pyspark.sql import types as PT
    schema = PT.StructType([PT.StructField("ticker", PT.StringType()), PT.StructField("facts", COMPANY_FACTS)])
    return X.explode_facts(spark.createDataFrame([("A", nested)], schema))


def usd(tag, end, val, filed, start=None, form="10-K"):
    return ("us-gaap", tag, "USD", start, end, float(val), filed, form)


def test_first_print_wins_then_tag_order(spark):
    f = facts(spark, [
        usd("Assets", "2020-12-31", 100, "2021-02-20"), usd("Assets", "2020-12-31", 110, "2022-02-20"),
        usd("ProfitLoss", "2020-12-31", 9, "2021-02-20", "2020-01-01"),
        usd("NetIncomeLoss", "2020-12-31", 8, "2021-02-20", "2020-01-01"),
        usd("NetIncomeLoss", "2020-12-31", 2, "2021-01-20", "2020-10-01"),   # a quarter
        usd("Revenues", "2020-12-31", 7, "2021-01-20", "2020-01-01", form="10-Q")])
    got = {r.field: r.val for r in X.first_reported(f).collect()}
    assert got == {"total_assets": 100.0, "net_income": 8.0}


def test_share_classes_are_summed_and_late_values_dropped(spark):
    f = facts(spark, [
        usd("Assets", "2020-12-31", 100, "2021-02-20"),
        usd("Revenues", "2020-12-31", 50, "2021-02-25", "2020-01-01"),
        usd("GrossProfit", "2020-12-31", 20, "2021-02-25", "2020-01-01"),
        usd("LongTermDebt", "2020-12-31", 30, "2021-06-30"),
        ("us-gaap", "CommonStockSharesOutstanding", "shares", None, "2020-12-28", 60.0, "2021-02-20", "10-K"),
        ("us-gaap", "CommonStockSharesOutstanding", "shares", None, "2020-12-28", 40.0, "2021-02-20", "10-K"),
        ("dei", "EntityCommonStockSharesOutstanding", "shares", None, "2021-02-01", 99.0, "2021-02-20", "10-K")])
    r = X.canonical_rows(f).first()
    assert r.shares_outstanding == 100.0 and r.report_date == D(2021, 2, 25)
    assert r.cogs == 30.0 and r.long_term_debt == 0.0 and r.fiscal_year == 2020


def test_membership_reads_the_last_snapshot(spark):
    h = spark.createDataFrame([(D(2019, 1, 5), "a, brk.b ,"), (D(2020, 6, 30), "C"), (D(2020, 7, 2), "Z")], "date date, tickers string")
    got = {(r.date.year, r.ticker) for r in O.members_at(h, 2018, 2020).collect()}
    assert got == {(2019, "A"), (2019, "BRK-B"), (2020, "C")}


@pytest.mark.parametrize("vendor, japan, us", [
    ("7203 JT Equity", "7203.T", "7203"), ("AAPL UW Equity", "AAPL.T", "AAPL"),
    ("0203524D UN Equity", None, None), ("ALONE", None, None)])
def test_vendor_symbols(spark, vendor, japan, us):
    d = spark.createDataFrame([(vendor,)], "v string")
    r = d.select(Y.price_symbol(F.col("v"), "japan"), Y.price_symbol(F.col("v"), "us")).first()
    assert (r[0], r[1]) == (japan, us)


def test_market_cap_takes_the_last_close_within_two_weeks(spark):
    f = spark.createDataFrame([("A", 2023, D(2023, 12, 31), 10.0), ("B", 2023, D(2023, 12, 31), 10.0)],
                              "ticker string, fiscal_year int, report_date date, shares_outstanding double")
    p = spark.createDataFrame([("A", D(2023, 12, 18), 4.0, 8.0), ("A", D(2023, 12, 29), 5.0, 10.0), ("A", D(2024, 1, 2), 6.0, 12.0),
                               ("B", D(2023, 12, 16), 5.0, 9.0)], "ticker string, date date, adj_close double, close_raw double")
    got = {r.ticker: r.market_cap for r in A.market_cap_at_period_end(f, p).collect()}
    assert got == {"A": 100.0, "B": None}


def test_windows_of_a_date(spark):
    d = spark.createDataFrame([(D(1999, 6, 30),), (D(1999, 7, 1),), (D(1996, 6, 24),)], "d date")
    got = [r[0] for r in d.select(formations_covering(F.col("d"), 36, 7)).collect()]
    assert got == [[1999, 2000, 2001, 2002], [2000, 2001, 2002], [1996, 1997, 1998, 1999]]
    assert [r[0] for r in d.select(fiscal_label(F.col("d"))).collect()] == [1999, 1999, 1996]


def test_upsert_keeps_other_markets(spark):
    prev = spark.createDataFrame([("us", "k=20", -0.10), ("us", "k=30", -0.08), ("japan", "k=20", -0.21), ("vietnam", "k=20", 0.23)],
                                 "market string, spec string, D double")
    fresh = spark.createDataFrame([("us", "k=20", -0.99)], "market string, spec string, D double")
    merged, kept = O.upsert(prev, fresh, "market")
    assert {r.market for r in kept.collect()} == {"japan", "vietnam"}
    assert {(r.market, r.D) for r in merged.collect()} == {("us", -0.99), ("japan", -0.21), ("vietnam", 0.23)}


LONG = "symbol string, period string, statement string, name string, value double"


def test_wide_panel_and_duplicate_lines(spark):
    label = L.LABELS["balance_sheet"]["total_assets"]
    rows = [("A", "2020", "balance_sheet", label, 1.0), ("A", "2020", "cash_flow", label, 9.0),
            ("A", "2020", "balance_sheet", "no such label", 3.0), ("B", "2021", "balance_sheet", label, None)]
    got = {r.symbol: r for r in L.wide(spark.createDataFrame(rows, LONG), ["total_assets", "cfo"]).collect()}
    assert (got["A"].total_assets, got["A"].cfo) == (1.0, None) and got["B"].total_assets is None
    with pytest.raises(PySparkException):
        L.wide(spark.createDataFrame([*rows, rows[0]], LONG), ["total_assets"]).collect()


def test_wide_panel_is_one_scan_and_one_shuffle(spark):
    long = spark.createDataFrame([("A", "2020", "balance_sheet", "x", 1.0)], LONG)
    plan = L.wide(long, L.panel_keys())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_mapping_covers_what_is_needed(spark):
    have, need = L.mapping(spark), L.needs(spark)
    assert L.missing_lines(have, need).count() == 0
    some = have.where("key <> 'total_assets'")
    lost = {r.purpose for r in L.missing_lines(some, need).collect()}
    assert {"roa", "cfoa", "d_turn"} <= lost and "d_liquid" not in lost
    supported = {r.purpose: r.supported for r in L.support(some, need).collect()}
    assert not supported["roa"] and supported["d_liquid"] and supported["value"]
    seen = spark.createDataFrame([("A", "1", "cash_flow", "?", 1.0), ("A", "2", "cash_flow", "?", 1.0)], LONG)
    assert [tuple(r) for r in L.unknown_lines(seen, have).collect()] == [("cash_flow", "?", 2)]


def test_share_guards(spark):
    df = spark.createDataFrame([(1e6, 100.0), (1e6, 100.4), (1e6, 101.0), (1e6, 75.0), (1e6, 60.0), (1e6, None), (0.0, 5.0)],
                               "paid_in_capital double, share_at_period_end double")
    got = [(r.shares_source, r.shares) for r in H.share_count(df).collect()]
    assert got == [("outstanding", 100.0), ("outstanding", 100.0), ("par_implied", 100.0), ("outstanding", 75.0),
                   ("par_implied", 100.0), ("par_implied", 100.0), ("par_implied", 0.0)]


def test_checks_have_three_outcomes(spark):
    base = "symbol string, period string, total_liabilities double, equity_section double, total_assets double, stock_issuance_proceeds double"
    df = spark.createDataFrame([("A", "2020", 40.0, 60.0, 100.0, 0.0), ("B", "2020", 41.0, 60.0, 100.0, -1.0), ("C", "2020", None, 60.0, 100.0, None)], base)
    res = V.run_checks(df)
    got = {r.symbol: (r.balance_identity, r.issuance_nonneg, r.cf_sums_to_net) for r in res.collect()}
    assert got == {"A": (True, True, None), "B": (False, False, None), "C": (None, None, None)}
    ok = {r.symbol for r in res.where(V.clean(res)).collect()}
    assert ok == {"A", "C"} and res.where(V.clean(res, untestable_passes=False)).count() == 0
    assert [r["check"] for r in V.summary(res).collect()][-1] in {x.name for x in V.RULES}
    assert V.rules_table(spark).count() == 7 and len(V.rules_for(severity="soft")) == 0


def test_cross_period_rule_needs_the_year_before(spark):
    rule = V.Rule("grows", "soft", "universal", ("x", "x_lag"), lambda: F.col("x") > F.col("x_lag"), "", cross_period=True)
    df = spark.createDataFrame([("A", "2020", 1.0), ("A", "2021", 2.0), ("A", "2023", 1.0)], "symbol string, period string, x double")
    res = V.run_checks(V.with_lags(df, ["x"]), [rule])
    assert {r.period: r.grows for r in res.collect()} == {"2020": None, "2021": True, "2023": None}


def test_comparators_and_scalars(spark):
    d = spark.createDataFrame([(1.0, 1.0 + 1e-8, 0.0), (5.0, 4.0, 10.0)], "a double, b double, s double")
    a, b, s = F.col("a"), F.col("b"), F.col("s")
    r = d.select(N.eq_tol(a, b), N.le_tol(a, b), N.eq_scaled(a, b, s), N.between_na(a, 0, 2), N.safe_div(a, s),
                 N.bm_from_cap(a, s), N.book_to_market(b, s), N.positive_or_null(s)).collect()
    assert tuple(r[0]) == (True, True, False, True, None, None, None, None)
    assert tuple(r[1]) == (False, False, False, False, 0.5, 0.5, 0.4, 10.0)


def test_sorted_and_referential_clauses(spark):
    df = spark.createDataFrame([("A", 0, 1), ("A", 1, 3), ("A", 2, 2)], "k string, position int, v int")
    assert V.sorted_within(df, "k", "v").count() == 1
    other = spark.createDataFrame([("B",)], "k string")
    assert [r.k for r in V.unmatched_keys(df, other, ["k"]).collect()] == ["A"]


def test_local_factors_price_their_own_sorts(spark):
    import numpy as np
    from pitscreen.operators import benchmarks as M, paths as P
    rng = np.random.default_rng(5)
    days = [D(2023, 7, 1) + dt.timedelta(days=i) for i in range(0, 120)]
    value, size = rng.normal(0, 0.01, len(days)), rng.normal(0, 0.01, len(days))
    fund, px = [], []
    for j in range(120):
        cap, bm = float(np.exp(rng.normal(5, 1))), float(np.exp(rng.normal(0, 0.7)))
        fund.append((f"T{j}", 2022, D(2022, 12, 31), cap * bm, cap))
        ret = 0.5 * np.log(bm) * value - 0.3 * (np.log(cap) - 5) * size + rng.normal(0, 0.004, len(days))
        px += [(f"T{j}", d, float(v)) for d, v in zip(days, 100 * np.cumprod(1 + ret))]
    f = spark.createDataFrame(fund, "ticker string, fiscal_year int, report_date date, book_value double, market_cap double")
    p = spark.createDataFrame(px, "ticker string, date date, adj_close double")
    ff = M.local_factors(f, p, 2023, 2023, min_names=20).cache()
    pdf = ff.toPandas()
    assert len(pdf) > 60 and (pdf.rf == 0).all()
    assert pdf[["mkt_rf", "smb", "hml"]].corr().abs().to_numpy()[np.triu_indices(3, 1)].max() < 0.99
    legs = M.factor_members(f, p, 2023, 2023, min_names=20)
    high = legs.where(F.col("leg").isin("SH", "BH")).withColumn("book", F.lit("high")).withColumn("w", F.lit(1.0))
    n = high.count()
    daily = P.book_returns(P.book_values(high.withColumn("w", F.lit(1.0 / n)), P.growth_steps(p, legs), P.holding_sessions(p)))
    reg = M.factor_regression(daily, ff).first()
    x = np.column_stack([np.ones(len(pdf)), pdf.sort_values("date")[["mkt_rf", "smb", "hml"]].to_numpy()])
    y = daily.orderBy("date").toPandas().r.to_numpy()
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    xe = x * e[:, None]
    s = xe.T @ xe + sum((1 - q / 6) * (xe[q:].T @ xe[:-q] + xe[:-q].T @ xe[q:]) for q in range(1, 6))
    inv = np.linalg.inv(x.T @ x)
    se = np.sqrt((inv @ s @ inv)[0, 0])
    assert reg.beta_hml > 0
    assert [reg.alpha_daily, reg.beta_mkt, reg.beta_smb, reg.beta_hml] == pytest.approx(list(beta), rel=1e-6, abs=1e-10)
    assert reg.alpha_tstat == pytest.approx(beta[0] / se, rel=1e-6)
    from math import erfc, sqrt
    assert reg.alpha_pvalue == pytest.approx(erfc(abs(beta[0] / se) / sqrt(2)), rel=1e-6)


def test_last_bar_before_any_day(spark):
    from pitscreen.operators.asof import last_on_or_before

    bars = spark.createDataFrame([("A", "2020-01-10", 1.0), ("A", "2020-01-25", 2.0), ("A", "2020-03-02", 3.0)],
                                 "k string, d string, v double").withColumn("d", F.to_date("d"))
    days = ["2020-01-09", "2020-01-10", "2020-01-15", "2020-01-31", "2020-03-01", "2020-03-02", "2021-07-01"]
    t = spark.createDataFrame([("A", x) for x in days] + [("B", days[0])], "k string, t string").withColumn("t", F.to_date("t"))
    got = {(r.k, str(r.t)): r.v for r in last_on_or_before(t, bars, "k", "t", "d", {"v": "v"}).collect()}
    assert [got["A", x] for x in days] == [None, 1.0, 1.0, 2.0, 2.0, 3.0, 3.0] and got["B", days[0]] is None


def test_two_sided_normal_against_the_error_function(spark):
    import math

    from pitscreen.operators.benchmarks import two_sided_normal

    df = spark.createDataFrame([(x / 10,) for x in range(-60, 61)] + [(None,)], "t double")
    for r in df.select("t", two_sided_normal(F.col("t")).alias("p")).collect():
        assert r.p is None if r.t is None else abs(r.p - math.erfc(abs(r.t) / math.sqrt(2))) < 2e-7


def test_rows_by_outcome_and_unguarded_lags(spark):
    df = spark.createDataFrame([("A", "2020", 1.0), ("B", "2020", -1.0), ("C", "2020", None)],
                               "symbol string, period string, stock_issuance_proceeds double")
    res = V.run_checks(df)
    for outcome, symbol in ((True, "A"), (False, "B"), (None, "C")):
        assert [r.symbol for r in V.rows_where(res, df, "issuance_nonneg", outcome).collect()] == [symbol]
    rule = V.Rule("grows", "soft", "universal", ("x",), lambda: F.col("x") > F.col("x_lag"), "", cross_period=True)
    with pytest.raises(ValueError):
        V.run_checks(df.withColumn("x", F.lit(1.0)), [rule])
