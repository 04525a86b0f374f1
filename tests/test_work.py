"""Work items: the rules one by one, and the stream against the replay of the same commands."""

import pytest

from millrace.operators import work
from millrace.plans.base import Tables
from millrace.streaming import work as live
from millrace.streaming.lifecycle import drained

SCHEMA = "item long, id long, at double, kind string, token string, outcome string"


def run(spark, *commands):
    df = spark.createDataFrame([(1, k, float(at), kind, token, outcome) for k, (at, kind, token, outcome) in enumerate(commands)], SCHEMA)
    return [(r["at"], r["kind"], r["applied"], r["status"], r["token"], r["retries"]) for r in work.replayed(df).collect()]


def test_claims_and_finish(spark):
    rows = run(spark, (0, "claim", "a", None), (0, "submit", None, None), (1, "submit", None, None), (2, "claim", "a", None), (3, "claim", "b", None), (4, "finish", "b", "succeeded"), (5, "finish", "a", "odd"), (6, "finish", "a", "partial"), (7, "finish", "a", "failed"), (8, "submit", None, None), (9, "drop", None, None), (10, "drop", None, None))
    assert [r[2] for r in rows] == [False, True, False, True, False, False, False, True, False, True, True, False]
    assert [r[3] for r in rows][-3:] == ["queued", "failed", "failed"] and rows[7][3] == "partial"


def test_retries_run_out(spark):
    again = [c for n in range(4) for c in ((10 * n + 1, "claim", "a", None), (10 * n + 2, "retry", "a", None))]
    rows = run(spark, (0, "submit", None, None), *again)
    assert [r[5] for r in rows if r[1] == "retry"] == [1, 2, 3, 3] and rows[-1][3] == "failed"


def test_timers(spark):
    rows = run(spark, (0, "submit", None, None), (299, "claim", "a", None), (2098, "retry", "x", None), (2099, "finish", "a", "succeeded"), (9000, "drop", None, None))
    assert [(r[0], r[1], r[2]) for r in rows] == [(0, "submit", True), (299, "claim", True), (2098, "retry", False), (2099, "requeued", True), (2099, "finish", False), (2399, "handed out", True), (9000, "drop", False)]
    rows = run(spark, (0, "submit", None, None), (100, "claim", "a", None))
    assert [(r[0], r[1]) for r in rows[2:]] == [(1900, "requeued"), (2200, "handed out")]


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def test_stream_equals_replay(spark, rocks, tmp_path):
    """Commands arrive out of order within the lag, some twice; the last one closes the books."""
    log = work.commands(Tables(spark, "/root/testdata/sf0.001").events).orderBy("at", "id").collect()
    end = max(r["at"] for r in log)
    rows = [tuple(r) for r in log] + [(99, 10**6, end + 10**6, "drop", None, None)]
    body, parts = rows[:-1], 4
    for p in range(parts):
        part = body[p * len(body) // parts : (p + 1) * len(body) // parts]
        part = part[::-1] + part[:20] + (rows[-1:] if p == parts - 1 else [])
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    span = max(b["at"] - a["at"] for a, b in zip(log, log[len(log) // parts :], strict=False))
    out = drained(live.work_items(stream, f"{int(span) + 10} seconds"), f"file://{tmp_path}/state", f"file://{tmp_path}/out").collect()
    plain = lambda rs: sorted((r["item"], r["at"], r["id"] or -1, r["kind"], r["applied"], r["status"], r["token"], r["retries"]) for r in rs if r["item"] != 99)
    want = plain(work.replayed(spark.createDataFrame(body, SCHEMA)).collect())
    got = plain(out)
    assert len(want) > 1000 and any(r[3] == "requeued" for r in want)
    assert got == want


def test_late_commands_are_told(spark, rocks, tmp_path):
    for part in ([(1, 1, 100.0, "submit", None, None)], [(1, 2, 5000.0, "claim", "a", None)], [(1, 3, 50.0, "submit", None, None), (1, 4, 9000.0, "drop", None, None)], [(2, 5, 90000.0, "submit", None, None)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    out = drained(live.work_items(stream, "10 seconds"), f"file://{tmp_path}/state", f"file://{tmp_path}/out").collect()
    kinds = [(r["item"], r["kind"]) for r in out]
    assert (1, "submit") in kinds and (1, "claim") in kinds and (1, "requeued") in kinds
