"""Refresh by fingerprints, writes under a contract, facts from JSON text."""
import json

import pytest
from pyspark.sql import functions as F

from pitscreen.sources import facts as X, refresh as R


def table(spark, rows):
    return spark.createDataFrame(rows, "y int, k string, v double")


def test_fingerprints_see_rows_and_not_their_order(spark):
    rows = [(1, "a", 1.0), (1, "b", None), (2, None, 3.0), (2, "b", 3.0), (2, "b", 3.0), (None, "x", 0.0)]
    mark = lambda rs, n=1: {r.y: tuple(r)[1:] for r in R.fingerprints(table(spark, rs).repartition(n), "y").collect()}
    assert mark(rows) == mark(rows[::-1], 3) and mark(rows)[2][0] == 3
    for other in ([*rows[:4], rows[5]], [*rows, rows[3], rows[3]], [(1, "a", None), (1, "b", 1.0), *rows[2:]],
                  [rows[0], rows[1], (2, "b", 3.0), (2, None, 3.0), (2, "b", 3.1), rows[5]]):
        assert mark(other) != mark(rows)


def test_only_stale_partitions_are_written(spark, tmp_path):
    path, rows = str(tmp_path / "t"), [(y, k, float(y)) for y in (1, 2, 3) for k in "ab"]
    build = lambda df: df.withColumn("double", F.col("v") * 2)
    go = lambda rs: {r.y: r.action for r in R.refresh(spark, path, table(spark, rs), "y", build).collect()}
    files = lambda: {r.y: r.f for r in spark.read.parquet(path).groupBy("y").agg(F.sort_array(F.collect_set("_metadata.file_path")).alias("f")).collect()}
    assert go(rows) == {1: "written", 2: "written", 3: "written"}
    first = files()
    assert go(rows[::-1]) == {1: "kept", 2: "kept", 3: "kept"} and files() == first
    assert go([*rows[2:4], (3, "a", 9.0), (4, "z", 1.0)]) == {1: "removed", 2: "kept", 3: "written", 4: "written"}
    got = sorted((r.y, r.k, r.double) for r in R.read_refreshed(spark, path, "y").collect())
    assert got == [(2, "a", 4.0), (2, "b", 4.0), (3, "a", 18.0), (4, "z", 2.0)]
    assert files()[2] == first[2] and files()[3] != first[3]


def test_a_breach_is_not_published(spark, tmp_path):
    path, rules = str(tmp_path / "t"), {"positive": F.col("v") > 0, "named": F.col("k").isNotNull()}
    assert R.write_checked(table(spark, [(1, "a", 1.0)]), path, rules) == {"rows": 1, "positive": 0, "named": 0}
    with pytest.raises(R.ContractBreach) as e:
        R.write_checked(table(spark, [(1, "a", -1.0), (2, None, None), (3, "c", 2.0)]), path, rules)
    assert e.value.observed == {"rows": 3, "positive": 2, "named": 1}
    assert R.read_published(spark, path).count() == 1
    R.write_checked(table(spark, [(1, "a", 1.0), (2, "b", 2.0)]), path, rules)
    assert R.read_published(spark, path).count() == 2


def test_facts_from_json_text(spark):
    entry = {"start": "2001-01-01", "end": "2001-12-31", "val": 12.5, "filed": "2002-02-03", "form": "10-K"}
    company = {"ticker": "A", "facts": {"us-gaap": {
        "Assets": {"units": {"USD": [{"end": "2001-12-31", "val": 7, "filed": "2002-02-03", "form": "10-K"}, entry, 3]}},
        "NotRead": {"units": {"USD": [entry]}}, "Revenues": {"label": "no units"}, "GrossProfit": {"units": [1]}},
        "dei": {"EntityCommonStockSharesOutstanding": {"units": {"shares": [entry | {"val": "many"}]}}}}}
    lines = spark.createDataFrame([(x,) for x in (json.dumps(company), "no json", "", "{}", "[]", '{"ticker": "B"}', '{"ticker": "C", "facts": []}', None)],
                                  "value string")
    got = sorted((r.ticker, r.taxonomy, r.tag, r.unit, r.pos, str(r.start), str(r.end), r.val, r.form) for r in
                 X.facts_from_json(lines).collect() if r.end)
    assert got == [("A", "dei", "EntityCommonStockSharesOutstanding", "shares", 0, "2001-01-01", "2001-12-31", None, "10-K"),
                   ("A", "us-gaap", "Assets", "USD", 0, "None", "2001-12-31", 7.0, "10-K"),
                   ("A", "us-gaap", "Assets", "USD", 1, "2001-01-01", "2001-12-31", 12.5, "10-K")]
    assert tuple(X.malformed(lines).first()) == (8, 3)
