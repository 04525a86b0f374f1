"""Nulls, ties, repeated rows, empty tables and clashing column names, for operators and pipeline stages."""

import pytest

import corpus_pipeline as P
from millrace.llm import langid, lines, packing, repair

from .oracle import same
from .test_tokens import check_pieces, crc, ids_of, library  # noqa: F401

SF = "/root/testdata/sf0.001"
NAMES = ["doc_id", "text", "lang", "source", "n_chars", "key", "row", "c0", "a.b", "_gone", "component_id", "n_hit", "starts", "place", "label", "name"]
PASSAGE = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))


def table(spark, rows):
    kinds = ["long", "string", "string", "string", "long", *["string"] * (len(NAMES) - 5)]
    schema = ", ".join(f"`{n}` {k}" for n, k in zip(NAMES, kinds, strict=True))
    return spark.createDataFrame([(d, t, lang, None, None, *[f"{n}{d}" for n in NAMES[5:]]) for d, t, lang in rows], schema)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (None, "a text without any id at all", "en"), (None, None, None), (1, PASSAGE, "en"), (2, PASSAGE, "en"), (2, PASSAGE, "en"), (3, "", None), (4, None, "en"),
        (5, "123", "de"), (6, "der Hund und die Katze schlafen im Haus", "de"), (6, "ein anderer Text mit derselben Nummer wie der erste", "de"), (7, "x" * 300_000, "en"), (8, "one\ntwo\nthree\nfour", "en"), (9, "one\ntwo\nthree\nfive", "en"),
    ]
    return table(spark, rows).repartition(3)


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES[:-1]])
def test_stages_keep_columns_and_take_empty_tables(spark, odd, name):
    stage = dict(P.STAGES)[name]
    out = stage(spark, odd, SF)
    assert out.columns == NAMES
    rows, there = [tuple(r) for r in out.collect()], {tuple(r)[2:] for r in odd.collect()}
    assert rows and all(r[2:] in there for r in rows)  # all columns but the text, of the same row
    none = stage(spark, odd.where("false"), SF)
    assert none.columns == NAMES and none.count() == 0


def test_language_stage(spark, odd):
    left = [tuple(r)[:2] for r in P.language(spark, odd, SF).collect()]
    assert sorted(map(str, left)) == sorted(str(tuple(r)[:2]) for r in odd.collect() if r["text"] not in (None, "", "123"))


def test_near_duplicates_stage(spark, odd):
    left = [(r["doc_id"], r["text"]) for r in P.near_duplicates(spark, odd, SF).collect()]
    assert (1, PASSAGE) in left and 2 not in {d for d, _ in left}
    assert {(None, None), (None, "a text without any id at all"), (3, ""), (4, None)} <= set(left)


def test_line_dedup_stage(spark, odd):
    left = {(r["doc_id"], r["text"]) for r in P.line_dedup(spark, odd, SF).collect()}
    assert {(8, "one\ntwo\nthree\nfour"), (9, "five"), (3, ""), (4, None), (None, None)} <= left


def test_packed_stage(spark, odd, library):  # noqa: F811
    got = [tuple(r) for r in P.packed(spark, odd.where("doc_id NOT IN (2, 6)"), SF).collect()]
    check_pieces(got, {r["doc_id"]: ids_of(library, r["text"], 1) for r in odd.where("doc_id NOT IN (2, 6)").collect()}, 2048)
    assert P.packed(spark, odd.where("false"), SF).count() == 0


def test_pack_null_and_repeated_ids(spark, odd, library):  # noqa: F811
    got = [tuple(r) for r in packing.pack(odd.where("doc_id IS NULL OR doc_id IN (2, 6)"), window=64).collect()]
    texts = [(r["doc_id"], r["text"]) for r in odd.where("doc_id IS NULL OR doc_id IN (2, 6)").collect()]
    want = sum(len(ids_of(library, t, 1)) for _, t in texts)
    assert sum(r[2] for r in got) == want and {r[0] for r in got} == {None, 2, 6}
    for d in (None, 2, 6):
        assert sum(r[2] for r in got if r[0] == d) == sum(len(ids_of(library, t, 1)) for x, t in texts if x == d)


def test_repair_null_and_repeated_ids(spark, odd, library, tmp_path):  # noqa: F811
    path = f"file://{tmp_path}/ids"
    repair.write(odd, path)
    got = sorted((tuple(r) for r in repair.read(spark, path).collect()), key=lambda r: r[1])
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    start, want = 0, []
    for d, t in sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=order):
        ids = ids_of(library, t, 0)
        want.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want


def test_language_ties_and_repeated_rows(spark):
    rows = [(i, "same words here", lang) for i in range(40) for lang in ("bb", "aa")] + [(50, "same words", None), (50, "same words", None), (None, "same words", None)]
    df = table(spark, rows).repartition(4)
    got = [tuple(r) for r in langid.identify(df, langid.fit(df)).collect()]
    assert len(got) == len(rows) and {r[2] for r in got} == {"aa"} and all(0.49 <= r[3] <= 0.51 for r in got)
    assert [r for r in got if r[0] is None] == [(None, False, "aa", got[0][3])]


@pytest.mark.parametrize("size, rows", [("0.001", 200), ("0.01", 1000)])
def test_passages_equal_sql(spark, size, rows):
    d = f"/root/testdata/sf{size}"
    assert same(lines.op10_passages(spark, d), lines.PASSAGES_SQL, d) == rows
