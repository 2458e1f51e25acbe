"""Scalar rules shared by the scorers, the checks and the share count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType

# Fixed values of the accounting rules.
REL_TOL = 1e-6
BOUND_TOL = 1e-9
PAR_VALUE = 10_000
SHARE_GAP_TOL = 0.005
MAX_TREASURY_FRAC = 0.30


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers arrive as NaN from text sources; everything downstream expects NULL."""
    cols = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


def safe_div(num: Column, den: Column) -> Column:
    """Missing when the denominator is zero or missing."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio_or_inf(num: Column, den: Column) -> Column:
    """IEEE division: x/0 is signed infinity and 0/0 is missing.

    The nine-signal score compares such ratios, and `current_assets / 0` has to beat
    any finite ratio there.
    """
    return (F.when(den != 0, F.try_divide(num, den))
            .when(num > 0, F.lit(float("inf")))
            .when(num < 0, F.lit(float("-inf"))))


def adjusted_close(price: Column, unit: Column, adj_ratio: Column) -> Column:
    return safe_div(price * unit, adj_ratio)


def book_equity(owner_equity: Column, minority_interest: Column) -> Column:
    return owner_equity - F.coalesce(minority_interest, F.lit(0.0))


def issued_shares(paid_in_capital: Column, unit: float = 1.0, par: float = PAR_VALUE) -> Column:
    return paid_in_capital * F.lit(unit) / F.lit(float(par))


def book_to_market(equity: Column, market_equity: Column) -> Column:
    """Null unless book equity is positive."""
    return F.when(equity > 0, safe_div(equity, market_equity))


def bm_from_cap(book_value: Column, market_cap: Column) -> Column:
    """Null unless market value is positive."""
    return F.when(market_cap > 0, safe_div(book_value, market_cap))


def positive_or_null(value: Column) -> Column:
    return F.when(value > 0, value)


def cogs_from_gross_profit(cogs: Column, revenue: Column, gross_profit: Column) -> Column:
    return F.coalesce(cogs, revenue - gross_profit)


def first_present(df: DataFrame, names: list[str]) -> Column:
    """First non-null among the names the frame carries; null if it carries none."""
    have = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("double")


# ---- tolerance comparators: TRUE / FALSE / NULL (untestable) ----

def le_tol(a: Column, b: Column, tol: float = BOUND_TOL) -> Column:
    return a <= b + F.lit(tol) * F.greatest(F.abs(a), F.abs(b))


def eq_tol(a: Column, b: Column, tol: float = REL_TOL) -> Column:
    scale = F.greatest(F.abs(a), F.abs(b))
    scale = F.when(scale == 0, F.lit(1.0)).otherwise(scale)
    return safe_div(F.abs(a - b), scale) <= tol


def eq_scaled(a: Column, b: Column, scale: Column, tol: float = REL_TOL) -> Column:
    """Judged against an outside scale; a zero scale never passes."""
    return F.coalesce(safe_div(F.abs(a - b), F.abs(scale)) <= tol, F.lit(False))


def between_na(x: Column, lo: float, hi: float) -> Column:
    return (x >= lo) & (x <= hi)
