"""Persons: later mentions, several given names, compound names, neutral titles; IBANs; columns; the whole table by kind."""

import re

import duckdb
import regex

from millrace.llm import surrogates as S


def mod97(iban):
    t = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97


def rewritten(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    return [r["text"] for r in sorted(S.replaced(df, key="k", **options).collect(), key=lambda r: r["doc_id"])]


def test_persons_and_ibans(spark):
    texts = [
        "Mr John Doe called. John Doe and Doe left, and DOE's friend: (Doe).", "Mr John Ronald Tolkien", "Dr. Alice Brown and CEO Bob Stone, MR FOX", "Mrs Anne-Marie O'Brien-Smith", "Mr Ludwig van Beethoven, later Beethoven",
        "Brown bread and Stone", "IBAN GB29NWBK60161331926819 or GB29 NWBK 6016 1331 9268 19 or GB30NWBK60161331926819", 'Mrs Fay Wray, password=Hunter and token = "Sunflower"', "Mr " + "X" * 200000 + " " + "A-" * 50000, "miss you, Sir",
    ]
    got = rewritten(spark, texts)
    john, doe, again, doe2, doe3, upper, doe4 = re.match(r"Mr (\w+) (\w+) called\. (\w+) (\w+) and (\w+) left, and ([A-Z]+)'s friend: \((\w+)\)\.$", got[0]).groups()
    assert john == again != "John" and doe == doe2 == doe3 == doe4 != "Doe" and upper == doe.upper()
    first, second, last = re.match(r"Mr (\w+) (\w+) (\w+)$", got[1]).groups()
    assert first == john and second != "Ronald" and last != "Tolkien" and last[0].isupper()
    assert not re.search("Alice|Brown|Bob|Stone|FOX", got[2]) and re.match(r"Dr\. \w+ \w+ and CEO \w+ \w+, MR [A-Z]+$", got[2])
    assert re.match(r"Mrs [A-Z][a-z]+-[A-Z][a-z]+ [A-Z]'[A-Z][a-z]+-[A-Z][a-z]+$", got[3]) and not re.search("Anne|Marie|Brien|Smith", got[3])
    beethoven, later = re.match(r"Mr \w+ van (\w+), later (\w+)$", got[4]).groups()
    assert beethoven == later != "Beethoven" and got[5] == texts[5] and got[9] == texts[9]
    good, spaced, bad = re.findall(r"GB[0-9A-Z ]+(?= or|$)", got[6])
    assert mod97(good) == mod97(spaced) == 1 != mod97(bad) and good not in texts[6] and re.fullmatch(r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d", spaced)
    assert not re.search("Fay|Wray|Hunter|Sunflower", got[7]) and "X" * 50 not in got[8]


def test_columns_and_keys(spark):
    names = ["doc_id", "text", "_parts", "a.b", "k0", "n", "_n_values"]
    df = spark.createDataFrame([(i, "mail x.y@host.example.com", "kept", "p", i, i, "v") for i in range(3)], names)
    out = S.replaced(df, key="one")
    assert out.columns == [*names, "__n_values"]
    rows = [tuple(r) for r in out.collect()]
    assert {r[2:4] + r[6:] for r in rows} == {("kept", "p", "v", 2)} and len({r[1] for r in rows}) == 1 and "x.y@host" not in rows[0][1]
    other = S.replaced(df, key="two").first()["text"]
    assert other != rows[0][1] and S.replaced(df.where("false")).count() == 0
    assert S.replaced(df).first()["text"] == S.replaced(df).first()["text"]
    assert [r[0] for r in S.replaced(spark.createDataFrame([(None,), ("",)], "text string")).select("text").collect()] == [None, ""]


def test_whole_table_by_kind(spark):
    """Every value that the patterns find, found here anew, is replaced: one surrogate a value, none twice, none that occurs."""
    d = "/root/testdata/sf0.01"
    before = dict(duckdb.sql(f"SELECT doc_id, text FROM '{d}/documents.parquet'").fetchall())
    patterns = {k: regex.compile(p) for k, p in S.PARTS.items()}
    whole = regex.compile(S.PATTERN)
    tables: dict = {k: {} for k in patterns}
    occurring: dict = {k: set() for k in patterns}
    for r in S.op2_surrogates(spark, d).collect():
        old, new = before[r["doc_id"]] or "", r["text"] or ""
        found = [m.span() for m in whole.finditer(old)]
        rest, at = [], 0
        for a, b in found:
            rest.append(old[at:a])
            at = b
        rest.append(old[at:])
        values = regex.fullmatch("(.*?)".join(map(regex.escape, rest)), new, regex.DOTALL)
        assert values, r["doc_id"]
        for (a, b), value in zip(found, values.groups(), strict=True):
            kind = next(k for k, p in patterns.items() if (m := p.match(old, a)) and m.end() == b)
            own = old[a:b].lower() if kind == "email" else old[a:b]
            occurring[kind].add(own)
            assert value != own and tables[kind].setdefault(own, value) == value
    assert sum(map(len, tables.values())) > 50
    for kind, table in tables.items():
        assert len(set(table.values())) == len(table) and not set(table.values()) & occurring[kind]
