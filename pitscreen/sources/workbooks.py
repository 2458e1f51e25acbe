"""Workbooks (.xlsx) as a Spark source and sink: one partition a sheet, rows streamed from the zipped XML.

    read_workbooks(spark, folder, "ticker string, revenue double", sheets=r"\\d{4}", tag="year")
    write_workbooks(df, folder, sheet_by="year")

A sheet's first row that is not empty names its columns. Columns are matched by name, so sheets may
differ: what a sheet lacks is null, what the schema does not name is never converted. Rows without any
value are skipped; error cells and values that do not fit their type are null. Of two columns of one name
the first counts. A folder stands for all workbooks in it, sheets of one name are stacked.

The driver reads a workbook's list of sheets (and their first rows where no schema is given), tasks read the rest.
A task holds one batch of rows and, where a workbook keeps its texts apart, that workbook's shared texts.
"""

from __future__ import annotations

import datetime as dt
import re
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from uuid import uuid4
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
import pyarrow.fs as pf
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)
from pyspark.sql.pandas.types import to_arrow_schema

BATCH = 8192

# Fixed values of the file format: namespaces, the most rows of a sheet, day 0 of both calendars.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
SHEET_ROWS = 1_048_576
DAY_ZERO = {False: dt.datetime(1899, 12, 30), True: dt.datetime(1904, 1, 1)}

ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")
TO_ESCAPE = re.compile("[\x00-\x08\x0b-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
SHEET_NAME = re.compile(r"[^\[\]:*?/\\]{1,31}")
EXACT = 2 ** 53


def _open(path: str) -> tuple[pf.FileSystem, str]:
    return pf.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pf.LocalFileSystem(), path)


def workbook_paths(path: str) -> list[str]:
    """The workbook itself, or all workbooks below a folder but hidden ones and lock files."""
    fs, at = _open(path)
    info = fs.get_file_info(at)
    if info.type == pf.FileType.NotFound:
        raise FileNotFoundError(f"{path} is missing")
    if info.type == pf.FileType.File:
        return [path]
    found = [f.path for f in fs.get_file_info(pf.FileSelector(at, recursive=True)) if f.type == pf.FileType.File]
    inside = [(f, f[len(at.rstrip("/")) + 1:]) for f in sorted(found) if f.lower().endswith(".xlsx")]
    return [path.rstrip("/") + "/" + rest for _, rest in inside
            if not any(p.startswith(("_", ".", "~$")) for p in rest.split("/"))]


@contextmanager
def opened(path: str) -> Iterator[zipfile.ZipFile]:
    fs, at = _open(path)
    with fs.open_input_file(at) as f, zipfile.ZipFile(f) as z:
        yield z


def sheets_of(path: str) -> list[tuple[str, str, bool]]:
    """(name, part, whether days count from 1904) of every sheet, in the workbook's order."""
    with opened(path) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        late = any(p.get("date1904") in ("1", "true") for p in book.iter(MAIN + "workbookPr"))
        part = lambda t: t[1:] if t.startswith("/") else "xl/" + t
        found = [(s.get("name"), part(targets[s.get(LINK)]), late) for s in book.iter(MAIN + "sheet")]
        return [s for s in found if s[1].startswith("xl/worksheets/")]


def _plain(text: str) -> str:
    return ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)


def _joined(element: ElementTree.Element) -> str:
    """The text of a cell or shared text: its runs without the phonetic ones."""
    runs = [t for child in element for t in ([child] if child.tag == MAIN + "t" else
                                            child.findall(MAIN + "t") if child.tag == MAIN + "r" else [])]
    return _plain("".join(t.text or "" for t in runs))


def _elements(stream, tag: str) -> Iterator[ElementTree.Element]:
    """Each element of a name once it is whole; what was read before is let go."""
    events = ElementTree.iterparse(stream, events=("start", "end"))
    open_now = []
    for event, e in events:
        if event == "start":
            open_now.append(e)
            continue
        open_now.pop()
        if e.tag == tag:
            yield e
            if open_now:
                open_now[-1].clear()


def shared_texts(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    with z.open("xl/sharedStrings.xml") as stream:
        return [_joined(e) for e in _elements(stream, MAIN + "si")]


def _column(reference: str) -> int:
    at = 0
    for c in reference:
        if not c.isalpha():
            break
        at = 26 * at + ord(c.upper()) - 64
    return at - 1


def _letters(at: int) -> str:
    out = ""
    at += 1
    while at:
        at, rest = divmod(at - 1, 26)
        out = chr(65 + rest) + out
    return out


def _value(cell: ElementTree.Element, texts: list[str]) -> str | float | bool | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        held = cell.find(MAIN + "is")
        return None if held is None else _joined(held)
    raw = cell.findtext(MAIN + "v")
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return texts[int(raw)]
    if kind == "b":
        return raw == "1"
    return float(raw) if kind == "n" else _plain(raw)


def rows_of(z: zipfile.ZipFile, part: str, texts: list[str]) -> Iterator[dict[int, object]]:
    """The rows of a sheet that are not empty, as values by column position."""
    with z.open(part) as stream:
        for row in _elements(stream, MAIN + "row"):
            out, at = {}, -1
            for cell in row.iter(MAIN + "c"):
                at = _column(cell.get("r")) if cell.get("r") else at + 1
                value = _value(cell, texts)
                if value is not None and value != "":
                    out[at] = value
            if out:
                yield out


def _headed(rows: Iterator[dict[int, object]]) -> dict[str, int]:
    """Where each column stands, by the first row."""
    places: dict[str, int] = {}
    for at, name in sorted(next(rows, {}).items()):
        places.setdefault(_text(name).strip(), at)
    return places


def _text(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < EXACT else repr(value)
    return value


def convert(value: object, kind: T.DataType, late: bool) -> object:
    """A cell as a value of a column's type; null if it is none."""
    if value is None:
        return None
    try:
        if isinstance(kind, T.StringType):
            return _text(value)
        if isinstance(kind, T.BooleanType):
            return value if isinstance(value, bool) else {"true": True, "false": False, "1": True, "0": False}[_text(value).lower()]
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            if isinstance(value, str):
                moment = dt.datetime.fromisoformat(value.strip())
            else:
                days, part = divmod(float(value), 1)
                moment = DAY_ZERO[late] + dt.timedelta(days=days, milliseconds=round(part * 86_400_000))
            return moment.date() if isinstance(kind, T.DateType) else moment
        if isinstance(kind, T.IntegralType):
            number = int(value) if isinstance(value, str) else float(value)
            bits = 8 * {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8}[kind.simpleString()]
            return int(number) if number == int(number) and -2 ** (bits - 1) <= number < 2 ** (bits - 1) else None
        return float(value)
    except (ValueError, KeyError, OverflowError):
        return None


@dataclass
class Sheet(InputPartition):
    path: str
    name: str
    part: str
    late: bool


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.tag = schema, options.get("tag", "")
        self.path, self.wanted = options["path"], options.get("sheets", r".*")

    def partitions(self) -> list[Sheet]:
        return chosen(self.path, self.wanted)

    def read(self, sheet: Sheet) -> Iterator[pa.RecordBatch]:
        if sheet is None:  # what Spark hands over where there is no sheet
            return
        arrow = to_arrow_schema(self.schema)
        with opened(sheet.path) as z:
            rows = rows_of(z, sheet.part, shared_texts(z))
            places = _headed(rows)
            at = [places.get(f.name) for f in self.schema]
            kinds = [f.dataType for f in self.schema]
            tagged = [convert(sheet.name, f.dataType, False) if f.name == self.tag else None for f in self.schema]

            def batch(held: list[dict[int, object]]) -> pa.RecordBatch:
                columns = []
                for f, kind, place, name in zip(arrow, kinds, at, tagged, strict=True):
                    values = ([name] * len(held) if f.name == self.tag else [None] * len(held) if place is None
                              else [convert(r.get(place), kind, sheet.late) for r in held])
                    columns.append(pa.array(values, type=f.type))
                return pa.RecordBatch.from_arrays(columns, schema=arrow)

            held: list[dict[int, object]] = []
            for row in rows:
                held.append(row)
                if len(held) == BATCH:
                    yield batch(held)
                    held = []
            if held:
                yield batch(held)


def chosen(path: str, wanted: str) -> list[Sheet]:
    """The sheets below a path whose whole name matches a pattern."""
    paths = workbook_paths(path)
    with ThreadPoolExecutor(16) as pool:
        listed = zip(paths, pool.map(sheets_of, paths), strict=True)
        return [Sheet(p, *s) for p, sheets in listed for s in sheets if re.fullmatch(wanted, s[0])]


def _first_row(sheet: Sheet) -> list[str]:
    with opened(sheet.path) as z:
        return list(_headed(rows_of(z, sheet.part, shared_texts(z))))


class _Book:
    """One workbook that is being written, a sheet after the other."""

    def __init__(self, sink, header: list[str]):
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED)
        self.header, self.names, self.sheet, self.rows = header, [], None, 0

    def begin(self, name: str) -> None:
        self.end()
        self.names.append(name)
        self.sheet = self.zip.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w", force_zip64=True)
        self.sheet.write(f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())
        self.rows = 0
        self.add([_cell(h) for h in self.header])

    def add(self, cells: list[str]) -> None:
        self.rows += 1
        held = "".join(c.replace("<c", f'<c r="{_letters(i)}{self.rows}"', 1) for i, c in enumerate(cells) if c)
        self.sheet.write(f'<row r="{self.rows}">{held}</row>'.encode())

    def end(self) -> None:
        if self.sheet:
            self.sheet.write(b"</sheetData></worksheet>")
            self.sheet.close()
            self.sheet = None

    def close(self) -> None:
        self.end()
        office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006"
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml."
        ids = range(1, len(self.names) + 1)
        sheets = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="r{i}"/>' for i, n in zip(ids, self.names, strict=True))
        self.zip.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{office}"><sheets>{sheets}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in ids)
        self.zip.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">{links}'
                          f'<Relationship Id="style" Type="{office}/styles" Target="styles.xml"/></Relationships>')
        self.zip.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN[1:-1]}"><fonts><font/></fonts><fills><fill/></fills><borders><border/>'
                          '</borders><cellStyleXfs><xf/></cellStyleXfs><cellXfs><xf/><xf numFmtId="14" applyNumberFormat="1"/></cellXfs></styleSheet>')
        self.zip.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" '
                          f'Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}worksheet+xml"/>' for i in ids)
        self.zip.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" '
                          'ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                          f'<Override PartName="/xl/workbook.xml" ContentType="{kind}sheet.main+xml"/>'
                          f'<Override PartName="/xl/styles.xml" ContentType="{kind}styles+xml"/>{parts}</Types>')
        self.zip.close()


def _cell(value: object) -> str:
    """A value as a cell; nulls and numbers that are none have no cell, whole numbers beyond 2^53 are texts."""
    if value is None or isinstance(value, float) and value - value != 0:
        return ""
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, float) or isinstance(value, int) and abs(value) <= EXACT:
        return f"<c><v>{value!r}</v></c>"
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        return f'<c s="1"><v>{(value - DAY_ZERO[False].date()).days}</v></c>'
    held = escape(TO_ESCAPE.sub(lambda m: f"_x{ord(m[0]):04X}_", str(value)))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{held}</t></is></c>'


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WorkbookWriter(DataSourceArrowWriter):
    """Every task writes workbooks of its own under hidden names; the commit publishes those of tasks that succeeded."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.by, self.overwrite = options["path"].rstrip("/"), options["sheetby"], overwrite
        self.most = int(options.get("sheetrows", SHEET_ROWS))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, at = _open(self.path)
        names, book, sink, sheet = [], None, None, None
        fs.create_dir(f"{at}/_unpublished", recursive=True)
        for batch in batches:
            header = [n for n in batch.schema.names if n != self.by]
            tags = batch.column(self.by).cast(pa.string()).to_pylist()
            columns = [batch.column(n).to_pylist() for n in header]
            for i, tag in enumerate(tags):
                if tag is None or not SHEET_NAME.fullmatch(tag):
                    raise ValueError(f"{self.by} {tag!r} cannot name a sheet")
                full = book is not None and tag == sheet and book.rows == self.most
                if book is None or full or tag != sheet and tag in book.names:
                    if book is not None:
                        book.close()
                        sink.close()
                    names.append(f"book-{uuid4().hex}.xlsx")
                    sink = fs.open_output_stream(f"{at}/_unpublished/{names[-1]}")
                    book, sheet = _Book(sink, header), None
                if tag != sheet:
                    book.begin(tag)
                    sheet = tag
                book.add([_cell(c[i]) for c in columns])
        if book is not None:
            book.close()
            sink.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = _open(self.path)
        if self.overwrite:
            for old in workbook_paths(self.path):
                fs.delete_file(_open(old)[1])
        for m in messages:
            for name in m.names if m else ():
                fs.move(f"{at}/_unpublished/{name}", f"{at}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = _open(self.path)
        for m in messages:
            for name in m.names if m else ():
                fs.delete_file(f"{at}/_unpublished/{name}")


class Workbooks(DataSource):
    """``format("workbooks")``. Options: ``path``, ``sheets`` (pattern), ``tag`` (column for the sheet's name), ``sheetBy``."""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def schema(self) -> T.StructType:
        """All columns of all sheets as texts, in the order in which they first occur."""
        sheets = chosen(self.options["path"], self.options.get("sheets", ".*"))
        with ThreadPoolExecutor(16) as pool:
            names = list(dict.fromkeys(n for row in pool.map(_first_row, sheets) for n in row))
        tag = self.options.get("tag", "")
        names = [n for n in names if n != tag] + ([tag] if tag else [])
        return T.StructType([T.StructField(n, T.StringType()) for n in names])

    def reader(self, schema: T.StructType) -> WorkbookReader:
        return WorkbookReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options, overwrite)


def read_workbooks(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sheets: str = ".*",
                   tag: str | None = None) -> DataFrame:
    """Rows of the sheets whose whole name matches ``sheets``; ``tag`` names a column for the sheet's name.

    Only columns of ``schema`` are converted and sheets that do not match are never opened. Without a schema all
    columns of all sheets are read as texts.
    """
    spark.dataSource.register(Workbooks)
    r = spark.read.format("workbooks").option("sheets", sheets)
    if schema is not None:
        r = r.schema(schema)
    return (r.option("tag", tag) if tag else r).load(path)


def write_workbooks(df: DataFrame, path: str, sheet_by: str, mode: str = "append", sheet_rows: int = SHEET_ROWS) -> None:
    """A sheet for each value of a column; a large one is dealt to several workbooks, each within the format's rows.

    Values that cannot name a sheet, nulls included, stop the write; nothing is published then.
    """
    df.sparkSession.dataSource.register(Workbooks)
    col = lambda name: F.col("`" + name.replace("`", "``") + "`")
    by = col(sheet_by)
    dealt = df.repartitionByRange(by, F.xxhash64(*map(col, df.columns))).sortWithinPartitions(by)
    (dealt.write.format("workbooks").option("sheetBy", sheet_by).option("sheetRows", sheet_rows).mode(mode).save(path))
