"""Strict lists and rounds: what the queries' tables don't show."""

from pyspark.sql import functions as F

from millrace.operators import rounds
from millrace.sources import readers


def test_strict_list(spark):
    texts = {
        "ok": '[{"id": 1, "state": "a"}, {"id": 2}]', "empty": " [ ] ", "null": None, "object": '{"id": 1}', "text": "nonsense", "cut": '[{"id": 1}', "field": '[{"id": 1, "x": null}]',
        "type": '[{"id": "one"}]', "real": '[{"id": 1.5}]', "twice": '[{"id": 1}, {"id": 1}]', "nokey": '[{"state": "a"}]', "hole": '[{"id": 1}, null]', "long": '[{"id": 1, "state": "' + "é" * 60 + '"}]',
    }
    df = spark.createDataFrame(list(texts.items()), "name string, body string")
    items, verdict = readers.strict_list(df, "body", "id long, state string", "id", 100)
    got = {r["name"]: (r["n"], r["reason"]) for r in verdict.collect()}
    assert got == {
        "ok": (2, None), "empty": (0, None), "null": (None, "missing"), "object": (None, "no_list"), "text": (None, "no_list"), "cut": (None, "no_list"), "field": (None, "unknown_field"),
        "type": (None, "wrong_type"), "real": (None, "wrong_type"), "twice": (None, "key_twice"), "nokey": (None, "no_key"), "hole": (None, "unknown_field"), "long": (None, "too_large"),
    }
    assert sorted(tuple(r) for r in items.collect()) == [("ok", 0, 1, "a"), ("ok", 1, 2, None)]


def test_evidence_round(spark):
    members = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 4), ("c", 5)], "s string, k int")
    seen = spark.createDataFrame([(1,), (1,), (9,)], "k int")
    audits = spark.createDataFrame([("b", "bad"), ("b", "good"), ("a", "bad"), ("a", "good"), ("a", "good"), ("a", None)], "s string, v string")
    out = {r["s"]: (r["members"], r["observed"], r["paused"], r["pending"]) for r in rounds.evidence_round(members, seen, audits, "s", "k", F.col("v") == "bad", "0.4").collect()}
    assert out == {"a": (2, 1, False, 1), "b": (2, 0, True, 0), "c": (1, 0, False, 1)}
