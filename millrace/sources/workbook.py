"""Workbooks (zipped XML sheets) as a Spark data source: `spark.read.format("workbook")`.

A file is split where its sheet is large: a partition has the rows whose tags begin in its range of the unzipped sheet. A reader
unzips and tokenises from the start (a zip stream has no other way in) and ends with its range; it builds no row outside it, and none
that a pushed filter rules out. A file that can't be read gives one row with `_error`, beside whatever rows came before the fault.

Options: `sheet` (a name; else the first sheet), `header` (the row of the headers, 1 by default; 0 takes the columns' letters), `split`
(bytes of a range), `push` (false keeps filters from the reader). Columns of the schema are found by header; `_file`, `_row` and `_error` are the reader's own. Without a schema
all headers of the first file become strings. A header that a file lacks is an error of that file; of two equal headers the first counts.

Writing gives each task's rows as workbooks of their own, moved to their names on commit."""

from __future__ import annotations

import datetime
import io
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from xml.etree import ElementTree
from xml.parsers import expat
from xml.sax.saxutils import escape

import pyarrow.fs as fs
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

OWN = {"_file": T.StringType(), "_row": T.IntegerType(), "_error": T.StringType()}
SPLIT, MOST_ROWS = 32 << 20, 1_000_000
#: Built-in number formats of dates and times (fixed values).
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 45, 46, 47, 50, 51, 52, 53, 54, 55, 56, 57, 58}
_EPOCH = {False: datetime.datetime(1899, 12, 30), True: datetime.datetime(1904, 1, 1)}


class WorkbookError(ValueError):
    """What is wrong with a file."""


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].rpartition(":")[2]


def _tree(archive: zipfile.ZipFile, path: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(archive.read(path)) if path in archive.namelist() else None


def sheet_path(archive: zipfile.ZipFile, sheet: str | None) -> tuple[str, bool]:
    """Where the sheet is in the archive, and whether dates count from 1904."""
    book, links = _tree(archive, "xl/workbook.xml"), _tree(archive, "xl/_rels/workbook.xml.rels")
    if book is None or links is None:
        raise WorkbookError("no workbook")
    target = {x.get("Id"): x.get("Target", "") for x in links}
    sheets = [x for x in book.iter() if _local(x.tag) == "sheet"]
    found = next((x for x in sheets if sheet is None or x.get("name") == sheet), None)
    if found is None:
        raise WorkbookError(f"no sheet {sheet}")
    where = target.get(next((v for k, v in found.items() if _local(k) == "id"), None), "")
    path = where.lstrip("/") if where.startswith("/") else f"xl/{where}"
    if path not in archive.namelist():
        raise WorkbookError(f"sheet {sheet} has no part")
    since_1904 = any(_local(x.tag) == "workbookPr" and x.get("date1904") in ("1", "true") for x in book.iter())
    return path, since_1904


def _shared(archive: zipfile.ZipFile) -> list[str]:
    root = _tree(archive, "xl/sharedStrings.xml")
    if root is None:
        return []
    spoken = lambda item: "".join(t.text or "" for p in item for t in ([p] if _local(p.tag) == "t" else p if _local(p.tag) == "r" else []) if _local(t.tag) == "t")
    return [spoken(item) for item in root]


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    root = _tree(archive, "xl/styles.xml")
    if root is None:
        return set()
    own = {int(x.get("numFmtId", 0)): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", x.get("formatCode", "")) for x in root.iter() if _local(x.tag) == "numFmt"}
    formats = [int(x.get("numFmtId", 0)) for group in root if _local(group.tag) == "cellXfs" for x in group]
    return {n for n, f in enumerate(formats) if (re.search("[ymdhs]", own[f], re.I) if f in own else f in DATE_FORMATS)}


def column_number(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Z]*", reference.upper())[0]:
        n = n * 26 + ord(letter) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


class Cells:
    """Streams (row number, {column number: value}) of a sheet's rows that begin in [start, end) of its bytes; values are text, float,
    bool or datetime."""

    def __init__(self, archive: zipfile.ZipFile, path: str, since_1904: bool = False):
        self.archive, self.path, self.epoch = archive, path, _EPOCH[since_1904]
        self.strings, self.dates = _shared(archive), _date_styles(archive)

    def _value(self, kind: str, style: str | None, text: str):
        try:
            return self.value(kind, style, text)
        except (ValueError, IndexError, OverflowError):  # no number, no such string, no such day
            return None

    def value(self, kind: str, style: str | None, text: str):
        if kind == "s":
            return self.strings[int(text)]
        if kind == "b":
            return text.strip() == "1"
        if kind in ("str", "inlineStr", "d"):
            return text
        if kind == "e" or not text.strip():
            return None
        number = float(text)
        if style and int(style) in self.dates:
            return self.epoch + datetime.timedelta(days=number)
        return number

    def rows(self, start: int = 0, end: float = float("inf")) -> Iterator[tuple[int, dict[int, object]]]:
        """What fails has `at`, the byte reached."""
        parser = expat.ParserCreate()
        try:
            yield from self._rows(parser, start, end)
        except Exception as error:
            error.at = max(0, parser.ErrorByteIndex if isinstance(error, expat.ExpatError) else parser.CurrentByteIndex)
            raise

    def _rows(self, parser, start: int, end: float) -> Iterator[tuple[int, dict[int, object]]]:
        done, out = [], []
        number, column, wanted, cell, text = 0, 0, False, None, None

        def opens(tag, attrs):
            nonlocal number, column, wanted, cell, text
            tag = tag.rpartition(":")[2]
            if tag == "row":
                number = int(attrs.get("r", number + 1))
                column, wanted = 0, start <= parser.CurrentByteIndex < end
                if parser.CurrentByteIndex >= end:
                    done.append(True)
                if wanted:
                    out.append((number, {}))
            elif wanted and tag == "c":
                column = column_number(attrs["r"]) if "r" in attrs else column + 1
                cell, text = (attrs.get("t", "n"), attrs.get("s")), None
            elif wanted and cell and tag in ("v", "t"):
                text = [] if text is None or tag == "v" else text
                parser.CharacterDataHandler = text.append

        def closes(tag):
            nonlocal cell, text
            tag = tag.rpartition(":")[2]
            if tag in ("v", "t"):
                parser.CharacterDataHandler = None
            elif wanted and tag == "c" and cell:
                value = self._value(*cell, "".join(text)) if text is not None else None
                if value is not None:
                    out[-1][1][column] = value
                cell = None

        parser.StartElementHandler, parser.EndElementHandler = opens, closes
        with self.archive.open(self.path) as stream:
            while not done and (chunk := stream.read(1 << 16)):
                parser.Parse(chunk)
                yield from out[:-1]
                del out[:-1]
            if not done:
                parser.Parse(b"", True)
        yield from out


def cast(value, kind: T.DataType):
    """A cell's value as the column's type; null where it isn't one. Whole numbers have no decimal point as text."""
    if value is None:
        return None
    try:
        if isinstance(kind, T.StringType):
            if isinstance(value, datetime.datetime):
                return value.date().isoformat() if value.time() == datetime.time() else value.isoformat(sep=" ", timespec="seconds")
            if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
                return str(int(value))
            return str(value).lower() if isinstance(value, bool) else str(value)
        if isinstance(kind, T.BooleanType):
            return value if isinstance(value, bool) else {"true": True, "false": False}.get(str(value).strip().lower())
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            moment = value if isinstance(value, datetime.datetime) else datetime.datetime.fromisoformat(str(value).strip())
            return moment.date() if isinstance(kind, T.DateType) else moment
        if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType)):
            number = Decimal(str(value).strip())
            return int(number) if number == number.to_integral_value() else None
        return float(value)
    except (ValueError, ArithmeticError, TypeError):
        return None


def holds(test, value) -> bool:
    """A pushed filter on the cast value, as SQL would have it."""
    if isinstance(test, IsNull):
        return value is None
    if isinstance(test, IsNotNull):
        return value is not None
    if value is None:
        return False
    if isinstance(test, EqualTo):
        return value == test.value
    if isinstance(test, In):
        return value in test.value
    return value.startswith(test.value)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: float

    def __init__(self, path: str, start: int, end: float):
        self.path, self.start, self.end = path, start, end


def _found(path: str) -> tuple[fs.FileSystem, list[str]]:
    """The files of a path: one file, or all workbooks of a folder."""
    system, where = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = system.get_file_info(where)
    if info.type == fs.FileType.Directory:
        files = sorted(x.path for x in system.get_file_info(fs.FileSelector(where, recursive=True)) if x.type == fs.FileType.File)
        return system, [f for f in files if f.lower().endswith((".xlsx", ".xlsm")) and not f.rpartition("/")[2].startswith(("_", "."))]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return system, [where]


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.schema, self.tests = options, schema, []

    def partitions(self):
        system, files = _found(self.options["path"])
        size, out = int(self.options.get("split", SPLIT)), []
        for file in files:
            whole = 1
            try:
                with system.open_input_file(file) as f, zipfile.ZipFile(f) as archive:
                    whole = archive.getinfo(sheet_path(archive, self.options.get("sheet"))[0]).file_size
            except Exception:  # noqa: BLE001  told by the reader, as a row
                pass
            cuts = [*range(0, max(1, whole), size)]
            out += [Range(file, a, b) for a, b in zip(cuts, [*cuts[1:], float("inf")], strict=True)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range):
        if not partition.path:
            return
        system, _ = _found(self.options["path"])
        try:
            with system.open_input_file(partition.path) as f, zipfile.ZipFile(f) as archive:
                yield from self._rows(archive, partition)
        except (WorkbookError, zipfile.BadZipFile, zlib.error, expat.ExpatError, ElementTree.ParseError, KeyError, ValueError, EOFError, OSError) as error:
            if partition.start <= getattr(error, "at", 0) < partition.end:  # told once: by the range that holds the fault
                own = {"_file": partition.path, "_error": f"{type(error).__name__}: {error}"}
                yield tuple(own.get(n) for n in self.schema.names)

    def _rows(self, archive: zipfile.ZipFile, partition: Range):
        path, since_1904 = sheet_path(archive, self.options.get("sheet"))
        cells, header = Cells(archive, path, since_1904), int(self.options.get("header", 1))
        places = _places(cells, header)
        wanted = [(f.name, f.dataType, places.get(f.name)) for f in self.schema if f.name not in OWN]
        missing = [name for name, _, place in wanted if place is None]
        if missing:
            raise WorkbookError(f"no header {', '.join(missing)}")
        kinds = {name: (kind, place) for name, kind, place in wanted}
        tests = [(t, *kinds[t.attribute[0]]) for t in self.tests]
        for number, row in cells.rows(partition.start, partition.end):
            if number > header and row and all(holds(test, cast(row.get(place), kind)) for test, kind, place in tests):
                own = {"_file": partition.path, "_row": number}
                yield tuple(own.get(f.name) if f.name in OWN else cast(row.get(kinds[f.name][1]), f.dataType) for f in self.schema)


class FilteringReader(WorkbookReader):
    """Takes filters on cells: rows that can't pass are never built."""

    TESTS = (EqualTo, In, IsNull, IsNotNull, StringStartsWith)

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, self.TESTS) and len(f.attribute) == 1 and f.attribute[0] in self.schema.names and f.attribute[0] not in OWN:
                self.tests.append(f)
            yield f  # Spark tests again: rows of errors go or stay as they would without pushed filters


def _places(cells: Cells, header: int) -> dict[str, int]:
    if header < 1:
        return {column_letters(n): n for n in range(1, 703)}
    for number, row in cells.rows():
        if number == header:
            named: dict[str, int] = {}
            for column, value in sorted(row.items()):
                named.setdefault(cast(value, T.StringType()).strip(), column)
            return named
        if number > header:
            break
    raise WorkbookError(f"no row {header}")


class WorkbookWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.options, self.schema, self.overwrite, self.job = options, schema, overwrite, uuid.uuid4().hex
        self.system, self.path = fs.FileSystem.from_uri(options["path"]) if "://" in options["path"] or options["path"].startswith("file:") else (fs.LocalFileSystem(), options["path"])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "system"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        path = state["options"]["path"]
        self.system = fs.FileSystem.from_uri(path)[0] if "://" in path or path.startswith("file:") else fs.LocalFileSystem()

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        folder, names, rows = f"{self.path}/_{self.job}", [], []
        self.system.create_dir(folder, recursive=True)

        def flush():
            name = f"{folder}/{uuid.uuid4().hex}.xlsx"
            with self.system.open_output_stream(name) as out:
                out.write(packed(rows, self.schema.names, self.options.get("sheet", "Sheet1"), int(self.options.get("header", 1))))
            names.append(name)
            rows.clear()

        for row in iterator:
            rows.append(tuple(row))
            if len(rows) == MOST_ROWS:
                flush()
        if rows:
            flush()
        return Written(names)

    def commit(self, messages):
        if self.overwrite:
            for info in self.system.get_file_info(fs.FileSelector(self.path, allow_not_found=True)):
                if info.type == fs.FileType.File and info.path.endswith(".xlsx"):
                    self.system.delete_file(info.path)
        for k, name in enumerate(n for m in messages if m is not None for n in m.names):
            self.system.move(name, f"{self.path}/part-{k:05d}-{self.job}.xlsx")
        self.abort(messages)

    def abort(self, messages):
        if self.system.get_file_info(f"{self.path}/_{self.job}").type == fs.FileType.Directory:
            self.system.delete_dir(f"{self.path}/_{self.job}")


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


def packed(rows: list[tuple], names: list[str], sheet: str, header: int) -> bytes:
    """A workbook of one sheet: headers, if any, in their row, then the rows."""

    def cell(n: int, at: int, value) -> str:
        where = f"{column_letters(n)}{at}"
        if value is None:
            return ""
        if isinstance(value, bool):
            return f'<c r="{where}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float, Decimal)):
            return f'<c r="{where}"><v>{value!r}</v></c>' if not isinstance(value, Decimal) else f'<c r="{where}"><v>{value}</v></c>'
        text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", str(value))  # XML has no way to say these
        return f'<c r="{where}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    def line(at: int, values) -> str:
        return f'<row r="{at}">' + "".join(cell(n, at, v) for n, v in enumerate(values, 1)) + "</row>"

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    top = '<?xml version="1.0" encoding="UTF-8"?>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("[Content_Types].xml", f'{top}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>')
        archive.writestr("_rels/.rels", f'{top}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        archive.writestr("xl/workbook.xml", f'{top}<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="{escape(sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        archive.writestr("xl/_rels/workbook.xml.rels", f'{top}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with archive.open("xl/worksheets/sheet1.xml", "w") as part:
            part.write(f'{top}<worksheet xmlns="{main}"><sheetData>'.encode())
            if header:
                part.write(line(header, names).encode())
            for at, row in enumerate(rows, header + 1):
                part.write(line(at, row).encode())
            part.write(b"</sheetData></worksheet>")
    return out.getvalue()


class Workbooks(DataSource):
    @classmethod
    def name(cls):
        return "workbook"

    def schema(self):
        system, files = _found(self.options["path"])
        if not files:
            raise WorkbookError("no workbook there")
        with system.open_input_file(files[0]) as f, zipfile.ZipFile(f) as archive:
            names = _places(Cells(archive, *sheet_path(archive, self.options.get("sheet"))), int(self.options.get("header", 1)))
        return T.StructType([T.StructField(n, t) for n, t in OWN.items()] + [T.StructField(n, T.StringType()) for n in names])

    def reader(self, schema):
        return (WorkbookReader if self.options.get("push") == "false" else FilteringReader)(dict(self.options), schema)

    def writer(self, schema, overwrite):
        return WorkbookWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets filters reach Python sources; without that setting read with push=false."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Workbooks)
