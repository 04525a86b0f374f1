"""The workbook source: ranges, cell kinds, pushed filters, malformed files, and files written by it."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.sources import readers, workbook

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
SHEET = f'<worksheet xmlns="{MAIN}"><dimension ref="A1"/><sheetData>{{}}</sheetData></worksheet>'


def book(path, rows, sheet="Data", strings=None, styles=None, workbook_pr="", cut=None):
    """A file with the sheet's rows as given XML; its declared dimension is wrong on purpose."""
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{office}">{workbook_pr}<sheets><sheet name="Other" r:id="r2"/><sheet name="{sheet}" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="/xl/worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", SHEET.format(rows)[:cut])
        z.writestr("xl/worksheets/s2.xml", SHEET.format(""))
        if strings:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{strings}</sst>')
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}">{styles}</styleSheet>')
    path.write_bytes(data.getvalue())


def line(n, *texts):
    return f'<row r="{n}">' + "".join(f'<c r="{workbook.column_letters(k)}{n}" t="inlineStr"><is><t>{t}</t></is></c>' for k, t in enumerate(texts, 1)) + "</row>"


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    workbook.register(spark)


def test_kinds_of_cells(spark, tmp_path):
    rows = (
        line(1, "title") + line(2, "text", "number", "day", "flag", "text") +
        '<row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3"><v>12.0</v></c><c r="C3" s="1"><v>45000</v></c><c r="D3" t="b"><v>1</v></c></row>'
        '<row><c t="s"><v>1</v></c><c><v>1.5</v></c><c s="2"><v>45000.25</v></c></row><row r="6"/>'
        '<row r="7"><c r="A7" t="str"><f>A1</f><v>formula</v></c><c r="B7" t="e"><v>#N/A</v></c><c r="C7" s="1"><v>x</v></c></row>'
        '<row r="8"><c r="A8" t="s"><v>99</v></c><c r="E8" t="inlineStr"><is><t>second</t></is></c></row>'
    )
    book(tmp_path / "a.xlsx", rows, strings="<si><t>plain</t></si><si><r><t>rich </t></r><r><t>text</t></r><rPh><t>no</t></rPh></si>",
         styles='<numFmts><numFmt numFmtId="200" formatCode="yyyy&quot;x&quot;mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="200"/></cellXfs>')
    read = lambda: spark.read.format("workbook").option("sheet", "Data").option("header", 2)
    out = read().schema("_row int, text string, number double, day date, flag boolean").load(str(tmp_path / "a.xlsx"))
    day = datetime.date(2023, 3, 15)
    assert [tuple(r) for r in out.orderBy("_row").collect()] == [(3, "plain", 12.0, day, True), (4, "rich text", 1.5, day, None), (7, "formula", None, None, None), (8, None, None, None, None)]
    texts = read().load(f"file://{tmp_path}")
    assert texts.columns == ["_file", "_row", "_error", "text", "number", "day", "flag"]
    assert [tuple(r)[3:] for r in texts.orderBy("_row").limit(2).collect()] == [("plain", "12", "2023-03-15", "true"), ("rich text", "1.5", "2023-03-15 06:00:00", None)]


def test_ranges_give_each_row_once(spark, tmp_path):
    book(tmp_path / "a.xlsx", line(1, "n", "t") + "".join(line(n, n, f"t{n % 7}") for n in range(2, 3000)))
    for split in (1 << 20, 20_000):
        out = spark.read.format("workbook").option("sheet", "Data").option("split", split).schema("_row int, n long, t string").load(str(tmp_path))
        assert split > 300_000 or out.rdd.getNumPartitions() > 10
        assert [tuple(r) for r in out.orderBy("_row").collect()] == [(n, n, f"t{n % 7}") for n in range(2, 3000)]


def test_pushed_filters(spark, tmp_path):
    book(tmp_path / "a.xlsx", line(1, "n", "t") + "".join(line(n, n, f"t{n % 7}") for n in range(2, 500)) + line(500, "x"))
    read = spark.read.format("workbook").option("sheet", "Data").schema("n long, t string")
    tests = ["t = 't3'", "t IN ('t1', 't2') AND n = 8", "n IS NULL", "t LIKE 't4%' AND n > 100", "t IS NOT NULL AND NOT t = 't1'"]
    rows = lambda push, t: sorted(map(tuple, read.option("push", push).load(str(tmp_path)).where(t).collect()), key=str)
    assert all(rows("true", t) == rows("false", t) != [] for t in tests)
    from pyspark.sql import types as T
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = workbook.FilteringReader({"path": str(tmp_path), "sheet": "Data"}, T.StructType([T.StructField("n", T.LongType()), T.StructField("t", T.StringType())]))
    asked = [EqualTo(("t",), "t3"), GreaterThan(("n",), 5)]
    assert list(reader.pushFilters(asked)) == asked and reader.tests == asked[:1]
    assert len(list(reader.read(reader.partitions()[0]))) == 71  # no other row is built


def test_malformed_files_give_rows_of_errors(spark, tmp_path):
    rows = line(1, "n") + "".join(line(n, n) for n in range(2, 400))
    book(tmp_path / "good.xlsx", rows)
    book(tmp_path / "cut.xlsx", rows, cut=-9000)
    book(tmp_path / "sheet.xlsx", rows, sheet="Else")
    book(tmp_path / "header.xlsx", line(1, "m"))
    book(tmp_path / "none.xlsx", "")
    (tmp_path / "bytes.xlsx").write_bytes(b"no zip")
    (tmp_path / "empty.xlsx").write_bytes(b"")
    (tmp_path / "other.txt").write_text("not read")
    for split in (1 << 20, 2000):
        out = spark.read.format("workbook").option("sheet", "Data").option("split", split).schema("_file string, n int, _error string").load(str(tmp_path))
        by = {r["f"].rpartition("/")[2]: (r["rows"], r["errors"]) for r in out.groupBy(F.col("_file").alias("f")).agg(F.count("n").alias("rows"), F.count("_error").alias("errors")).collect()}
        assert by.pop("good.xlsx") == (398, 0)
        some, errors = by.pop("cut.xlsx")
        assert 0 < some < 398 and errors == 1
        assert by == {n: (0, 1) for n in ("sheet.xlsx", "header.xlsx", "none.xlsx", "bytes.xlsx", "empty.xlsx")}
        assert out.where("_error LIKE '%no sheet Data%'").count() == 1


def test_written_files_are_read_back(spark, tmp_path):
    rows = [(1, 'a & <b> "c"', True, 1.5), (2, "", False, None), (3, None, None, -2e-7), (4, "  wide\tü\n", True, 1e300)]
    df = spark.createDataFrame(rows, "n long, t string, f boolean, x double")
    for header in (1, 4):
        path = str(tmp_path / f"out{header}")
        for _ in range(2):
            df.repartition(3).write.format("workbook").option("header", header).option("sheet", "S & T").mode("overwrite").save(path)
        back = spark.read.format("workbook").option("header", header).option("sheet", "S & T").schema(df.schema).load(path)
        assert sorted(map(tuple, back.collect())) == rows[:1] + [(2, "", False, None)] + rows[2:]
    assert not [p for p in (tmp_path / "out1").iterdir() if p.is_dir()]


def test_eligible_candidates(spark):
    rows = [(3, " Acme ", "open", "C1", "90", None), (4, "acme", "open", "C2", "80", "x"), (5, "Beta", "shut", "C3", "70", "x"), (6, "Gamma", "live", " ", "60", "x"), (7, "Delta", "live", "C5", "high", "x"), (8, "Eps", "live", "C6", "55", " y ")]
    df = spark.createDataFrame(rows, "_row int, name string, status string, code string, score string, city string")
    got = readers.eligible(df, "_row", "name", "status", ["open", "live"], "code", "score", ["city"], "unknown").orderBy("_row").collect()
    assert [(r["_row"], r["name"].strip(), r["score"], r["city"].strip()) for r in got] == [(3, "Acme", 90, "unknown"), (8, "Eps", 55, "y")]
    assert "code" not in got[0].asDict() and len(got[0]["identity_hash"]) == 64


def test_cohort_is_whole_or_nothing(spark):
    rows = [("a", n, f"name {n}") for n in range(3, 24)] + [("b", n, "x" if n != 9 else " ") for n in range(3, 23)] + [("c", 1, "title")]
    names, verdict = readers.cohort(spark.createDataFrame(rows, "_file string, _row int, name string"), "_row", "name")
    assert {(r["_file"], r["failed"]) for r in verdict.collect()} == {("a", False), ("b", True), ("c", True)}
    assert names.count() == 20 and names.select("_file").distinct().count() == 1
