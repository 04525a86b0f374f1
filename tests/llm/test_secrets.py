import re

import duckdb

from millrace.llm import surrogates as S

from .test_surrogates import shape

LONG = "k9Xz" * 500


def test_upper_case_and_long_values(spark):
    texts = [
        'TOKEN = "9999A9BC12EF"', "PASSWORD=abcdEFgh and Password=qrstuvwx", f'token = "{LONG}" end', f"password={LONG}, end", f"to {'ab' * 60}@mail.example.com now",
        "a.b@" + "x1." * 12 + "example.com", "Mr " + "A" + "b" * 80 + " left", 'Token = "qqqqqqqqrrrr"',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r for r in S.replaced(df).collect()}
    secret = [["9999A9BC12EF"], ["abcdEFgh", "qrstuvwx"], [LONG], [LONG], ["ab" * 60], ["x1.x1"], ["b" * 20], ["qqqqqqqqrrrr"]]
    for i, t in enumerate(texts):
        text = got[i]["text"]
        assert got[i]["_n_values"] >= 1 and not any(s in text for s in secret[i]), (t, text)
        if i not in (5, 6):
            assert shape(text) == shape(t) and "k9Xz" * 2 not in text
    assert got[2]["text"].endswith('" end') and got[3]["text"].endswith(", end") and got[6]["text"].endswith(" left")


def test_no_secret_stays_in_the_table(spark):
    d = "/root/testdata/sf0.01"
    values = {m for (t,) in duckdb.sql(f"SELECT text FROM '{d}/documents.parquet'").fetchall() for m in re.findall(r'(?i:token) = "([0-9A-Za-z_.-]{8,})|(?i:password)=([^\\s"\',;]{4,})', t or "")}
    values = {a or b for a, b in values}
    assert values
    after = "\n".join(r["text"] or "" for r in S.op2_surrogates(spark, d).collect())
    assert not [v for v in values if v in after]


def test_long_texts_without_a_match(spark):
    texts = ["x" * 300000, "x1." * 100000, 'token = "' * 30000, "a@" * 100000, "a@" + "b." * 100000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in S.replaced(df).collect()} == dict(enumerate(texts))
