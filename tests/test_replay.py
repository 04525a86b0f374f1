"""Commands with compare-and-set against one pass in Python, whatever the ranges."""

import random

import pytest

from millrace.operators import replay


def brute(log, initial):
    states, out = {}, []
    for key, pos, expected, new in sorted(log, key=lambda r: (str(r[0]), r[1])):
        now = states.get(key, initial)
        fits = expected is not None and new is not None and expected == now
        states[key] = new if fits else now
        out.append((key, pos, fits, states[key]))
    return sorted(out, key=str)


@pytest.mark.parametrize("ranges", [1, 4, 23])
def test_replay(spark, ranges):
    rng = random.Random(7)
    names = ["queued", "running:a", "running:b", "over", None]
    log = [(0 if k % 2 else rng.randrange(1, 30), k, rng.choice(names), rng.choice(names)) for k in range(1500)]  # key 0 has half of it
    log += [(77, k, str(k - k % 3), str(k + 1)) for k in range(200)]
    df = spark.createDataFrame(log, "key int, pos int, expected string, new string").repartition(5)
    assert sorted((tuple(r) for r in replay.replayed(df, "queued", ranges).collect()), key=str) == brute(log, "queued")


def test_chain_over_all_ranges(spark):
    """Every command of one key is accepted, so the last range's state depends on all before it."""
    log = [("k", k, str(k), str(k + 1)) for k in range(900)]
    df = spark.createDataFrame(log, "key string, pos int, expected string, new string")
    rows = replay.replayed(df, "0", 12).collect()
    assert len(rows) == 900 and all(r["accepted"] for r in rows) and max(int(r["state"]) for r in rows) == 900
    assert replay.replayed(df.where("false"), "0", 3).count() == 0


def test_work_is_spread(spark):
    """The key's ranges are tasks of their own: its maps come from all of them."""
    log = spark.range(2000).selectExpr("0 AS key", "id AS pos", "cast(id % 7 AS string) AS expected", "cast((id + 1) % 7 AS string) AS new")
    seen, inner = [], replay.entry_states

    def kept(maps, segments, initial):
        out = inner(maps, segments, initial)
        seen.append((segments.count(), out.count(), maps.groupBy("seg").count().count()))
        return out

    replay.entry_states = kept
    try:
        assert replay.replayed(log, "0", 8).count() == 2000
    finally:
        replay.entry_states = inner
    n, states, mapped = seen[0]
    assert n >= 6 and states == n and mapped == n
