"""Spreadsheets (.xlsx) as a Spark data source, read from the file's own zip entries.

    spark.dataSource.register(Spreadsheet)
    spark.read.format("lexspark_xlsx").option("path", files).option("sheet", name).load()

A path may be a glob; every file is a part of its own.  The first row is the header; names that repeat get ``.1``, ``.2`` …, columns without a
name ``Unnamed: k``.  A sheet's XML is read as a stream, so memory is in proportion to the shared strings.  Types without a schema come from all cells of
the first file: double, timestamp or boolean where all cells of a column are such, string otherwise.

Defined results: missing cells and error values are null; empty rows inside the data are rows of nulls, those after it are left out; formulas give the values that
were saved; rich text is joined; dates are told by their number format, in the 1900 or 1904 system of the file.
"""

from __future__ import annotations

import datetime
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
#: Number formats that the standard defines as dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out = []
    with z.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag == _MAIN + "si":
                out.append(_text(e))
                e.clear()
    return out


def _text(e: ElementTree.Element) -> str:
    """Text of a string item: its own or its runs', without phonetic guides."""
    parts = []
    for child in e:
        if child.tag == _MAIN + "t":
            parts.append(child.text or "")
        elif child.tag == _MAIN + "r":
            parts += [t.text or "" for t in child.findall(_MAIN + "t")]
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), "".join(parts))


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """The cell styles whose number format shows a date or time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    dates = set(DATE_FORMATS)
    for f in root.iter(_MAIN + "numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.|\*.', "", f.get("formatCode", ""))
        if re.search("[ymdhs]", code, re.IGNORECASE) and "general" not in code.lower():
            dates.add(int(f.get("numFmtId")))
    return {i for i, x in enumerate(root.iterfind(f"{_MAIN}cellXfs/{_MAIN}xf")) if int(x.get("numFmtId", "0")) in dates}


def _sheet_entry(z: zipfile.ZipFile, sheet: str | None) -> tuple[str, bool]:
    """(zip entry of the sheet by name or by number from 0, the first by default; whether dates count from 1904)."""
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(_PACKAGE)}
    sheets = [(s.get("name"), links[s.get(_LINK)]) for s in book.iter(_MAIN + "sheet")]
    names = [n for n, _ in sheets]
    if sheet in names:
        target = sheets[names.index(sheet)][1]
    elif sheet is None or sheet.isdigit() and int(sheet) < len(sheets):
        target = sheets[int(sheet or 0)][1]
    else:
        raise ValueError(f"no such sheet: {sheet}")
    setup = book.find(_MAIN + "workbookPr")
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}", setup is not None and setup.get("date1904") in ("1", "true")


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _moment(days: float, from_1904: bool) -> datetime.datetime:
    """A serial date; day 60 of the 1900 system, 29 February 1900, did not exist, so earlier days are one further on."""
    base = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 30) if days >= 60 else datetime.datetime(1899, 12, 31)
    return base + datetime.timedelta(milliseconds=round(days * 86_400_000))


def rows_of(path: str, sheet: str | None = None) -> Iterator[list]:
    """Cells of each row from the first one on: None, bool, float, datetime or str."""
    with zipfile.ZipFile(path) as z:
        entry, from_1904 = _sheet_entry(z, sheet)
        strings, dates = _strings(z), _date_styles(z)
        with z.open(entry) as f:
            seen, waiting, parent = 0, 0, None
            for event, e in ElementTree.iterparse(f, events=("start", "end")):
                if event == "start":
                    parent = e if e.tag == _MAIN + "sheetData" else parent
                    continue
                if e.tag != _MAIN + "row":
                    continue
                number = int(e.get("r", seen + 1))
                waiting += number - seen - 1
                seen, cells = number, []
                for c in e.iterfind(_MAIN + "c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = _cell(c, strings, dates, from_1904)
                if parent is not None:
                    parent.clear()
                if all(v is None for v in cells):
                    waiting += 1
                    continue
                yield from ([] for _ in range(waiting))
                waiting = 0
                yield cells


def _cell(c: ElementTree.Element, strings: list[str], dates: set[int], from_1904: bool) -> object:
    kind, value = c.get("t", "n"), c.find(_MAIN + "v")
    if kind == "inlineStr":
        inline = c.find(_MAIN + "is")
        return None if inline is None else _text(inline)
    if value is None or value.text is None or kind == "e":
        return None
    if kind == "s":
        return strings[int(value.text)]
    if kind == "b":
        return value.text == "1"
    if kind == "d":
        return datetime.datetime.fromisoformat(value.text.rstrip("Z"))
    if kind == "str":
        return value.text
    number = float(value.text)
    return _moment(number, from_1904) if int(c.get("s", "0")) in dates else number


def header_names(cells: list) -> list[str]:
    names, seen = [], {}
    for i, c in enumerate(cells):
        name = _shown(c) if c not in (None, "") else f"Unnamed: {i}"
        k = seen[name] = seen.get(name, -1) + 1
        names.append(f"{name}.{k}" if k else name)
    return names


def _shown(v: object) -> str | None:
    """A cell as text: whole numbers without a point, dates in ISO form."""
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, datetime.datetime):
        return v.isoformat(" ") if v.time() != datetime.time() else v.date().isoformat()
    return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)


def _typed(v: object, kind: T.DataType, name: str) -> object:
    if v is None:
        return None
    if isinstance(kind, T.StringType):
        return _shown(v)
    if isinstance(kind, T.BooleanType) and isinstance(v, bool):
        return v
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) and isinstance(v, datetime.datetime):
        return v
    if isinstance(kind, T.DateType) and isinstance(v, datetime.datetime):
        return v.date()
    if isinstance(kind, (T.IntegerType, T.LongType)) and isinstance(v, float) and v == int(v):
        return int(v)
    if isinstance(kind, T.DoubleType) and isinstance(v, (float, bool)):
        return float(v)
    raise ValueError(f"column {name} holds {v!r}, not {kind.simpleString()}")


@dataclass
class File(ds.InputPartition):
    path: str


class Spreadsheet(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "lexspark_xlsx"

    def _files(self) -> list[str]:
        import glob

        found = sorted(glob.glob(self.options["path"].removeprefix("file://")))
        if not found:
            raise FileNotFoundError(self.options["path"])
        return found

    def schema(self) -> T.StructType:
        rows = rows_of(self._files()[0], self.options.get("sheet"))
        names = header_names(next(rows, []))
        kinds: list[set] = [set() for _ in names]
        for cells in rows:
            for k, v in zip(kinds, cells, strict=False):
                if v is not None:
                    k.add(type(v))
        types = {float: T.DoubleType(), bool: T.BooleanType(), datetime.datetime: T.TimestampNTZType()}
        return T.StructType([T.StructField(n, types.get(next(iter(k)), T.StringType()) if len(k) == 1 else T.StringType()) for n, k in zip(names, kinds, strict=True)])

    def reader(self, schema: T.StructType) -> SpreadsheetReader:
        return SpreadsheetReader(self._files(), self.options.get("sheet"), schema)


class SpreadsheetReader(ds.DataSourceReader):
    def __init__(self, files: list[str], sheet: str | None, schema: T.StructType) -> None:
        self.files, self.sheet, self.fields = files, sheet, schema

    def partitions(self) -> list[File]:
        return [File(f) for f in self.files]

    def read(self, partition: File) -> Iterator[tuple]:
        rows = rows_of(partition.path, self.sheet)
        names = header_names(next(rows, []))
        missing = [f.name for f in self.fields if f.name not in names]
        if missing:
            raise ValueError(f"{partition.path} lacks the columns {', '.join(missing)}")
        wanted = [(names.index(f.name), f.dataType, f.name) for f in self.fields]
        for cells in rows:
            yield tuple(_typed(cells[i] if i < len(cells) else None, kind, name) for i, kind, name in wanted)


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None, schema: str | None = None) -> DataFrame:
    spark.dataSource.register(Spreadsheet)
    reader = spark.read.format("lexspark_xlsx").option("path", path)
    reader = reader.option("sheet", sheet) if sheet is not None else reader
    return (reader.schema(schema) if schema else reader).load()
