"""Nine signals on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitscreen.operators import scoring as S, universe as U
from pitscreen.sources.schemas import FLAGS

LINE = dict(total_assets=1000.0, net_income=50.0, cfo=80.0, long_term_debt=100.0, current_assets=400.0,
            current_liabilities=200.0, shares_outstanding=100.0, revenue=900.0, cogs=500.0)


def rows(spark, data, drop=()):
    full = [dict(LINE, book_value=600.0, market_cap=900.0, equity_issued=None,
                 report_date=dt.date(r["fiscal_year"], 12, 31)) | r for r in data]
    cols = [c for c in full[0] if c not in drop]
    types = {"ticker": "string", "fiscal_year": "int", "report_date": "date"}
    schema = ", ".join(f"{c} {types.get(c, 'double')}" for c in cols)
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in full], schema)


def issuance_case(spark, drop=()):
    return rows(spark, [
        dict(ticker="BUYBACK", fiscal_year=2022, equity_issued=0.0),
        dict(ticker="CLEAN", fiscal_year=2022, equity_issued=0.0),
        dict(ticker="BUYBACK", fiscal_year=2023, shares_outstanding=95.0, equity_issued=40.0),
        dict(ticker="CLEAN", fiscal_year=2023, shares_outstanding=95.0, equity_issued=0.0)], drop)


def test_issuance_reads_the_cash_line(spark):
    f = issuance_case(spark)
    got = {r.ticker: r.f_eq_offer for r in S.nine_signals(f).where("score_year = 2023").collect()}
    assert got == {"BUYBACK": 0, "CLEAN": 1}
    led = S.scoring_ledger(f).where("score_year = 2023").first()
    assert (led.eq_offer_from_cashflow, led.eq_offer_from_shares) == (2, 0)


def test_issuance_falls_back_to_share_counts(spark):
    f = issuance_case(spark, drop=("equity_issued",))
    led = S.scoring_ledger(f).where("score_year = 2023").first()
    assert (led.eq_offer_from_cashflow, led.eq_offer_from_shares) == (0, led.scored)
    assert {r.f_eq_offer for r in S.nine_signals(f).where("score_year = 2023").collect()} == {1}


def test_changes_scale_both_sides_by_beginning_assets(spark):
    f = rows(spark, [dict(ticker="GROW", fiscal_year=y, total_assets=a, net_income=10.0, revenue=90.0)
                     for y, a in ((2021, 100.0), (2022, 200.0), (2023, 400.0))])
    r = S.nine_signals(f).where("score_year = 2023").first()
    assert (r.f_droa, r.f_dturn) == (0, 0)
    assert S.scoring_ledger(f).where("score_year = 2023").first().no_tm2_assets == 0


def test_missing_second_prior_year_still_scores(spark):
    f = rows(spark, [dict(ticker="NEW", fiscal_year=y) for y in (2022, 2023)])
    assert S.nine_signals(f).where("score_year = 2023").count() == 1
    assert S.scoring_ledger(f).where("score_year = 2023").first().no_tm2_assets == 1


def test_incomplete_inputs_are_dropped_and_counted(spark):
    f = rows(spark, [dict(ticker="A", fiscal_year=2022, cogs=None), dict(ticker="A", fiscal_year=2023)])
    assert S.nine_signals(f).count() == 0
    assert S.scoring_ledger(f).where("score_year = 2023").first().dropped_incomplete_signals == 1


def test_zero_denominators_follow_ieee(spark):
    f = rows(spark, [dict(ticker="Z", fiscal_year=2022), dict(ticker="Z", fiscal_year=2023, current_liabilities=0.0)])
    assert S.nine_signals(f).where("score_year = 2023").first().f_dliquid == 1  # x/0 beats 2.0


def test_scores_lie_in_bounds(spark):
    r = S.nine_signals(issuance_case(spark)).collect()
    assert all(0 <= x.fscore <= 9 and all(x[f] in (0, 1) for f in FLAGS) for x in r)


def test_late_filer_is_not_usable(spark):
    f = spark.createDataFrame([
        ("A", 2023, dt.date(2024, 1, 31)), ("A", 2024, dt.date(2025, 1, 31)),
        ("B", 2023, dt.date(2024, 5, 31)), ("B", 2024, dt.date(2025, 5, 31))],
        "ticker string, fiscal_year int, report_date date")
    s = U.snapshot(f, 5).where("formation_year = 2025")
    assert {(r.ticker, r.fiscal_year) for r in s.collect()} == {("A", 2024), ("A", 2023)}


def test_ledger_sits_beside_the_panel(spark):
    f = rows(spark, [dict(ticker=t, fiscal_year=y, total_assets=100.0 + y) for t in "ABC" for y in range(2018, 2022)])
    assert S.score_panel(f).where("score_year in (2020, 2021)").count() == 6
    assert S.scoring_ledger(f).where("score_year = 2021").first().scored == 3


def test_panel_keeps_members_of_the_using_formation(spark):
    f = rows(spark, [dict(ticker=t, fiscal_year=y) for t in "AB" for y in (2019, 2020)])
    m = spark.createDataFrame([(dt.date(2021, 7, 1), "A")], "date date, ticker string")
    assert [r.ticker for r in S.score_panel(f, membership=m).where("score_year = 2020").collect()] == ["A"]


def test_universe_needs_value_columns(spark):
    with pytest.raises(KeyError):
        U.complete_rows(spark.createDataFrame([("A", 1.0)], "ticker string, revenue double"))


def test_monthly_lag_clamps_to_month_end(spark):
    from pitscreen.functions.dates import available_date
    d = spark.createDataFrame([(dt.date(2023, 8, 31),)], "d date")
    assert d.select(available_date(F.col("d"), 6)).first()[0] == dt.date(2024, 2, 29)
