"""Workbooks: written and read back, by hand-made XML, and sheet by sheet."""

import datetime as dt
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pitscreen.sources import workbooks as W

MAIN = W.MAIN[1:-1]
KINDS = "year string, s string, d double, n bigint, b boolean, day date"
ROWS = [("2001", " a <&> b ", 1.5, 7, True, dt.date(2001, 2, 28)), ("2001", "_x0041_\r\x01é", -0.1, 2 ** 53 + 1, False, None),
        ("2002", None, None, None, None, dt.date(1970, 1, 1)), ("2002", "x", float("nan"), -3, None, dt.date(9999, 12, 31))]


def book(path, sheets, shared=(), late=False):
    """A workbook as another program would write it."""
    with zipfile.ZipFile(path, "w") as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{W.LINK[1:-3]}"><workbookPr date1904="{int(late)}"/>'
                                      f'<sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Target="/xl/worksheets/w{i}.xml"/>' for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/w{i}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{"".join(shared)}</sst>')


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, KINDS)
    W.write_workbooks(df, str(tmp_path / "w"), "year")
    got = W.read_workbooks(spark, str(tmp_path / "w"), KINDS, tag="year")
    want = sorted(((*r[:2], None if r[2] != r[2] else r[2], *r[3:]) for r in ROWS), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert got.where("year = '2001'").count() == 2
    assert W.read_workbooks(spark, str(tmp_path / "w"), KINDS, "2002", "year").count() == 2
    texts = W.read_workbooks(spark, str(tmp_path / "w"), tag="year")
    assert set(texts.columns) == {"year", "s", "d", "n", "b", "day"} and texts.columns[-1] == "year"
    assert {r.n for r in texts.collect()} == {"7", "9007199254740993", "-3", None}


def test_modes_and_full_sheets(spark, tmp_path):
    path = str(tmp_path / "w")
    df = spark.range(1000).select(F.lit("2000").alias("year"), F.col("id").cast("double").alias("v"))
    W.write_workbooks(df, path, "year", sheet_rows=101)
    assert len(W.workbook_paths(path)) >= 10
    read = lambda: W.read_workbooks(spark, path, "year int, v double", r"\d{4}", "year")
    assert read().agg(F.sum("v"), F.count("*"), F.max("year")).first() == (499500.0, 1000, 2000)
    W.write_workbooks(df.limit(3), path, "year")
    assert read().count() == 1003
    W.write_workbooks(df.limit(3), path, "year", mode="overwrite")
    assert read().count() == 3
    before = W.workbook_paths(path)
    for name in (None, "a/b", "x" * 32):
        with pytest.raises(PySparkException):
            W.write_workbooks(df.withColumn("year", F.lit(name).cast("string")), path, "year")
    assert W.workbook_paths(path) == before


def test_foreign_workbook(spark, tmp_path):
    """Shared and rich texts, cells without references, gaps, errors, dates from 1904, columns that differ."""
    shared = ["<si><t>ticker</t></si>", "<si><r><t>A</t></r><r><t>B</t></r><rPh><t>no</t></rPh></si>", "<si><t>value</t></si>"]
    one = ('<row r="1"/><row><c t="s"><v>0</v></c><c t="s"><v>2</v></c><c t="str"><v>day</v></c><c t="s"><v>2</v></c></row>'
           '<row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3"><v>1.5</v></c><c r="D3"><v>99</v></c></row>'
           '<row r="4"><c r="B4" t="e"><v>#N/A</v></c></row>'
           '<row r="5"><c r="B5"><v>2.5</v></c><c r="C5" t="d"><v>2020-01-02</v></c></row>')
    two = '<row><c t="s"><v>0</v></c></row><row><c t="inlineStr"><is><t>C</t></is></c></row>'
    book(tmp_path / "a.xlsx", {"2001": one, "notes": two, "2002": two, "2003": ""}, shared, late=True)
    book(tmp_path / "~$a.xlsx", {"2001": one}, shared)
    got = W.read_workbooks(spark, str(tmp_path), "ticker string, value double, day date, absent int, sheet int", r"\d{4}", "sheet")
    assert got.rdd.getNumPartitions() == 3
    assert {tuple(r) for r in got.collect()} == {("AB", None, dt.date(1904, 1, 2), None, 2001),
                                                 (None, 2.5, dt.date(2020, 1, 2), None, 2001), ("C", None, None, None, 2002)}
    assert W.read_workbooks(spark, str(tmp_path / "a.xlsx")).columns == ["ticker", "value", "day"]
    assert W.read_workbooks(spark, str(tmp_path), "ticker string", "none").count() == 0
    with pytest.raises(PySparkException):
        W.read_workbooks(spark, str(tmp_path / "nowhere"), "ticker string").count()


def test_values_that_do_not_fit():
    kind = lambda t: {"int": W.T.IntegerType(), "date": W.T.DateType(), "bool": W.T.BooleanType()}[t]
    assert W.convert("x", kind("int"), False) is None and W.convert(1.5, kind("int"), False) is None
    assert W.convert(2.0 ** 40, kind("int"), False) is None and W.convert("12", kind("int"), False) == 12
    assert W.convert("no date", kind("date"), False) is None and W.convert(1e12, kind("date"), False) is None
    assert W.convert(1.0, kind("bool"), False) is True and W.convert("maybe", kind("bool"), False) is None
