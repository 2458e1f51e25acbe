"""Accounting identities and output contracts as nullable boolean columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from pitscreen.functions.numeric import REL_TOL, eq_scaled, eq_tol, safe_div


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    framework: str
    inputs: tuple[str, ...]
    holds: Callable[[], Column]
    note: str
    cross_period: bool = False


def _c(name: str) -> Column:
    return F.col(name)


def _scaled(left: Callable[[], Column], right: Callable[[], Column]) -> Callable[[], Column]:
    return lambda: eq_scaled(left(), right(), _c("total_assets"))


RULES = [
    Rule("balance_identity", "hard", "universal",
         ("total_liabilities", "equity_section", "total_assets"),
         lambda: eq_tol(_c("total_liabilities") + _c("equity_section"), _c("total_assets")),
         "liabilities + equity = assets"),
    Rule("gross_profit_decomposes", "hard", "universal",
         ("gross_profit", "net_sales", "cogs", "total_assets"),
         _scaled(lambda: _c("gross_profit"), lambda: _c("net_sales") - _c("cogs")),
         "gross profit = net sales - cost of sales"),
    Rule("cf_sums_to_net", "hard", "universal",
         ("cfo", "cfi", "cff", "net_cash_flow", "total_assets"),
         _scaled(lambda: _c("cfo") + _c("cfi") + _c("cff"), lambda: _c("net_cash_flow")),
         "three activity sections = net cash flow, before currency effects"),
    Rule("cf_internal_roll", "hard", "universal",
         ("cash_begin", "cfo", "cfi", "cff", "fx_effect", "cash_end", "total_assets"),
         _scaled(lambda: _c("cash_begin") + _c("cfo") + _c("cfi") + _c("cff")
                 + F.coalesce(_c("fx_effect"), F.lit(0.0)), lambda: _c("cash_end")),
         "opening cash + flows + currency effect = closing cash"),
    Rule("total_liabilities_identity", "hard", "universal",
         ("total_liabilities", "long_term_liabilities", "current_liabilities", "total_assets"),
         _scaled(lambda: _c("total_liabilities"),
                 lambda: _c("long_term_liabilities") + _c("current_liabilities")),
         "liabilities = long term + current"),
    Rule("net_income_parent_identity", "hard", "universal",
         ("net_income_parent", "net_income_total", "net_income_minority", "total_assets"),
         _scaled(lambda: _c("net_income_parent"),
                 lambda: _c("net_income_total") - _c("net_income_minority")),
         "parent income = total income - minority income"),
    Rule("issuance_nonneg", "hard", "universal", ("stock_issuance_proceeds",),
         lambda: _c("stock_issuance_proceeds") >= 0,
         "proceeds from issuing shares are not negative"),
]

SEVERITY_ORDER = ["hard", "soft", "info"]


def rules_for(framework: str | None = None, severity: str | None = None,
              rules: list[Rule] = RULES) -> list[Rule]:
    return [r for r in rules if framework in (None, r.framework)
            and severity in (None, r.severity)]


def with_lags(panel: DataFrame, cols: list[str], year: Column | None = None) -> DataFrame:
    """Adds ``<col>_lag`` from the previous row of the symbol and ``lag_contiguous``."""
    y = F.substring("period", 1, 4).cast("int") if year is None else year
    w = W.partitionBy("symbol").orderBy("period")  # one row a year
    return (panel.withColumns({f"{c}_lag": F.lag(c).over(w) for c in cols})
            .withColumn("lag_contiguous", F.coalesce(y - F.lag(y).over(w) == 1, F.lit(False))))


def run_checks(panel: DataFrame, rules: list[Rule] = RULES,
               keys: tuple[str, ...] = ("symbol", "period")) -> DataFrame:
    """One nullable boolean per rule: true, false, or null where it cannot be tested."""
    out = []
    for r in rules:
        if any(c not in panel.columns for c in r.inputs):
            out.append(F.lit(None).cast("boolean").alias(r.name))
            continue
        present = F.lit(True)
        for c in r.inputs:
            present = present & F.col(c).isNotNull()
        if r.cross_period:
            if "lag_contiguous" not in panel.columns:
                raise ValueError(f"{r.name} compares years: add them with with_lags first")
            present = present & F.coalesce("lag_contiguous", F.lit(False))
        out.append(F.when(present, F.coalesce(r.holds(), F.lit(False))).alias(r.name))
    return panel.select(*keys, *out)


def _long(results: DataFrame, rules: list[Rule], *keys: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(r.name).alias("check"), F.lit(r.severity).alias("severity"),
                               F.lit(r.framework).alias("framework"),
                               F.col(r.name).alias("ok"))
                      for r in rules if r.name in results.columns])
    return results.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*")


def summary(results: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Tested, failed and untestable per rule, worst first."""
    failed, tested = F.count_if(~F.col("ok")), F.count("ok")
    t = _long(results, rules).groupBy("check", "severity", "framework").agg(
        tested.alias("tested"), failed.alias("failed"),
        F.round(100 * safe_div(failed, tested), 3).alias("fail_pct"),
        F.count_if(F.col("ok").isNull()).alias("not_applicable"))
    level = F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), F.col("severity"))
    return t.orderBy(level, F.desc("fail_pct"), "check")


def rows_where(results: DataFrame, panel: DataFrame, check: str, outcome: bool | None,
               keys: tuple[str, ...] = ("symbol", "period")) -> DataFrame:
    """Rows that passed a rule (true), failed it (false) or could not be tested (null), with the lines it reads."""
    rule = next((r for r in RULES if r.name == check), None)
    cols = [c for c in (rule.inputs if rule else ()) if c in panel.columns]
    hit = results.where(F.col(check).eqNullSafe(F.lit(outcome).cast("boolean"))).select(*keys)
    return panel.join(hit, list(keys), "left_semi").select(*keys, *cols)


def failures_by_year(results: DataFrame, check: str) -> DataFrame:
    return results.groupBy(F.substring("period", 1, 4).alias("year")).agg(
        safe_div(F.count_if(~F.col(check)), F.count(check)).alias("fail_rate"))


def clean(results: DataFrame, severity: str = "hard", untestable_passes: bool = True,
          rules: list[Rule] = RULES) -> Column:
    """True for rows that pass every rule at or above ``severity``.

    With ``untestable_passes=False`` a rule that could not be tested rejects the row.
    """
    keep = SEVERITY_ORDER[:SEVERITY_ORDER.index(severity) + 1][:2]
    ok = F.lit(True)
    for r in rules:
        if r.severity in keep and r.name in results.columns:
            ok = ok & F.coalesce(F.col(r.name), F.lit(untestable_passes))
    return ok


def infer_currency_effect(panel: DataFrame) -> DataFrame:
    """A missing currency effect is zero where the three sections already give net flow."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    total = zero("cfo") + zero("cff") + zero("cfi")
    known = F.col("fx_effect").isNull() & (total == F.col("net_cash_flow"))
    return panel.withColumn("fx_effect", F.when(known, 0.0).otherwise(F.col("fx_effect")))


def minority_placement(panel: DataFrame, tol: float = REL_TOL) -> DataFrame:
    """inside / outside / unexplained / untestable: where minority interest sits."""
    need = ("total_assets", "total_liabilities", "equity_section", "minority_interest")
    if any(c not in panel.columns for c in need):
        return panel.withColumn("placement", F.lit("untestable"))
    rest = _c("total_assets") - _c("total_liabilities") - _c("equity_section")
    scale = F.abs(_c("total_assets"))
    inside = safe_div(F.abs(rest), scale) <= tol
    outside = safe_div(F.abs(rest - _c("minority_interest")), scale) <= tol
    return panel.withColumn(
        "placement", F.when(rest.isNull(), "untestable")
        .when(F.coalesce(inside, F.lit(False)), "inside")
        .when(F.coalesce(outside, F.lit(False)), "outside").otherwise("unexplained"))


def rules_table(spark, rules: list[Rule] = RULES) -> DataFrame:
    return spark.createDataFrame(
        [(r.name, r.severity, r.framework, r.cross_period, ", ".join(r.inputs), r.note)
         for r in rules],
        "check string, severity string, framework string, cross_period boolean, "
        "inputs string, note string")


# ---- contracts on finished tables ----

def contract(df: DataFrame, not_null: list[str], unique: list[str],
             rules: dict[str, Column]) -> DataFrame:
    """(check, failing): rows breaking each clause, from one pass over the table.

    Uniqueness is counted from per-key sizes, which combine before the shuffle.
    """
    flags = {f"{c} present": F.col(c).isNull() for c in not_null}
    flags |= {name: ~F.coalesce(ok, F.lit(False)) for name, ok in rules.items()}
    per_key = df.groupBy(*unique).agg(
        F.count("*").alias("_n"),
        *[F.sum(bad.cast("bigint")).alias(f"_{i}") for i, bad in enumerate(flags.values())])
    names = [f"unique on ({', '.join(unique)})", *flags]
    sums = [F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)),
            *[F.sum(f"_{i}") for i in range(len(flags))]]
    one = per_key.agg(*[F.coalesce(s, F.lit(0)).cast("bigint").alias(f"c{i}")
                        for i, s in enumerate(sums)])
    cells = F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"c{i}").alias("failing"))
                      for i, n in enumerate(names)])
    return one.select(F.explode(cells).alias("c")).select("c.*")


def unmatched_keys(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Keys of ``df`` absent from ``other`` (referential clause)."""
    return df.select(*on).distinct().join(other.select(*on).distinct(), on, "left_anti")


def sorted_within(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose ``order`` value does not grow within ``key`` in the row's own sequence."""
    w = W.partitionBy(key).orderBy("position")
    before = df.withColumn("_before", F.lag(order).over(w))
    return before.where(F.col(order) <= F.col("_before")).drop("_before")


def compare_large(old: DataFrame, new: DataFrame, key: list[str], tol: float = 1e-9, buckets: int = 4096) -> DataFrame:
    """``compare_tables`` of two tables that mostly agree: only buckets of keys that differ are joined.

    Each side is digested first: per bucket of keys the number of rows and sums of row hashes, a few
    numbers a bucket whatever the size of the tables. Rows of buckets with equal digests never leave their files.
    Values are compared exactly by the digests, so a difference within the tolerance only costs the join of its bucket.
    """
    values = [c for c in old.columns if c not in key]
    bucket = F.pmod(F.xxhash64(*[F.col(k) for k in key]), F.lit(buckets)).alias("_bucket")

    def digest(df: DataFrame, name: str) -> DataFrame:
        shared = [F.col(c) if c in df.columns else F.lit(None) for c in (*key, *values)]
        h = F.xxhash64(*[x for c in shared for x in (c.isNull(), c)])
        return df.select(bucket, h.alias("h")).groupBy("_bucket").agg(F.struct(
            F.count("*").alias("n"), F.sum(F.col("h").bitwiseAND(F.lit((1 << 32) - 1))).alias("low"),
            F.sum(F.shiftrightunsigned("h", 32)).alias("high"), F.bit_xor("h").alias("x")).alias(name))

    open_ = (digest(old, "a").join(digest(new, "b"), "_bucket", "full").where(~F.col("a").eqNullSafe(F.col("b")))
             .select("_bucket"))  # at most one row a bucket
    rest = lambda df: df.withColumn("_bucket", bucket).join(F.broadcast(open_), "_bucket", "left_semi").drop("_bucket")
    return compare_tables(rest(old), rest(new), key, tol)


def compare_tables(old: DataFrame, new: DataFrame, key: list[str],
                   tol: float = 1e-9) -> DataFrame:
    """Cells that differ between two result tables, and keys on one side only."""
    values = [c for c in old.columns if c not in key]
    a = old.select(*key, F.struct(*values).alias("a"))
    b = new.select(*key, F.struct(*[c for c in values if c in new.columns]).alias("b"))
    types = dict(old.dtypes)
    cells = []
    for v in values:
        x = F.col(f"a.{v}")
        y = F.col(f"b.{v}") if v in new.columns else F.lit(None).cast(types[v])
        if types[v] in ("double", "float", "int", "bigint"):
            close = F.abs(x - y) <= F.lit(tol) * F.greatest(F.lit(1.0), F.abs(x))
            same = x.eqNullSafe(y) | F.coalesce(close, F.lit(False))
        else:
            same = x.eqNullSafe(y)
        cells.append(F.when(~same, F.struct(F.lit(v).alias("column"),
                                            x.cast("string").alias("old"),
                                            y.cast("string").alias("new"))))
    both = a.join(b, key, "full_outer")
    status = (F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "new")
              .otherwise("compared"))
    judged = both.withColumn("status", status).withColumn(
        "_cells", F.when(F.col("status") == "compared", F.array_compact(F.array(*cells)))
        .otherwise(F.array(F.struct(F.lit(None).cast("string").alias("column"),
                                    F.lit(None).cast("string").alias("old"),
                                    F.lit(None).cast("string").alias("new")))))
    return (judged.select(*key, "status", F.explode("_cells").alias("c"))
            .select(*key, F.when(F.col("status") == "compared", "changed")
                    .otherwise(F.col("status")).alias("status"), "c.*"))
