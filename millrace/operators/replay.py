"""Compare-and-set commands replayed from a log, for keys with logs of any length.

A command (key, pos, expected, new) is accepted if its key is in the state `expected` when its turn comes, and leaves it in
`new`; else it is rejected and changes nothing. A version counter is expected = v, new = v + 1; a claim is expected = `queued`,
new = `running:<token>`, and only the holder of the token can name the state that it ends.

What a stretch of the log does to a key is a map from the state on entry to the state on exit, in which every state that no
command names stays. Such maps compose associatively, and composing two is a join of exits with entries. So the log is
cut into ranges; each range of a key that spans several is summed up to its map (read backwards, a command is one
assignment); maps are composed pairwise up a tree and entry states handed down it; then all ranges run forward at the same time,
each from its own entry state. A key that holds half the log is as many tasks as its share of it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged


def _maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, seg, entry, exit) of each range; rows come by range and key, the last first."""
    here, exits = None, {}

    def told() -> pd.DataFrame:
        return pd.DataFrame({"key": here[1], "seg": here[0], "entry": list(exits), "exit": list(exits.values())}).astype({"seg": "int32", "entry": str, "exit": str})

    for rows in batches:
        for key, seg, expected, new in zip(rows["key"], rows["seg"], rows["expected"], rows["new"], strict=True):
            if here != (seg, key):
                if exits:
                    yield told()
                here, exits = (seg, key), {}
            if expected is not None and new is not None:
                exits[expected] = exits.get(new, new)
    if exits:
        yield told()


def _forward(initial: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, state = None, initial
        for rows in batches:
            accepted, after = [], []
            for part, key, expected, new, entry in zip(rows["_part"], rows["key"], rows["expected"], rows["new"], rows["_entry"], strict=True):
                if here != (part, key):
                    here, state = (part, key), entry if isinstance(entry, str) else initial
                fits = expected is not None and new is not None and expected == state
                state = new if fits else state
                accepted.append(fits)
                after.append(state)
            yield pd.DataFrame({"key": rows["key"], "pos": rows["pos"], "accepted": accepted, "state": after})

    return run


def _composed(maps: DataFrame) -> DataFrame:
    """The maps of ranges 2 p and 2 p + 1 as the map of p."""
    pairs = maps.withColumn("p", F.floor(F.col("seg") / 2).cast("int"))
    first, second = pairs.where("seg % 2 = 0").drop("seg"), pairs.where("seg % 2 = 1").drop("seg")
    then = second.select("key", "p", F.col("entry").alias("exit"), F.col("exit").alias("far"))
    through = first.join(then, ["key", "p", "exit"], "left").select("key", F.col("p").alias("seg"), "entry", F.coalesce("far", "exit").alias("exit"))
    rest = second.join(first.select("key", "p", "entry"), ["key", "p", "entry"], "left_anti").select("key", F.col("p").alias("seg"), "entry", "exit")
    return through.unionByName(rest)


def entry_states(maps: DataFrame, segments: DataFrame, initial: str) -> DataFrame:
    """(key, seg, state): the state in which each range of segments (key, seg) begins. maps: (key, seg, entry, exit)."""
    levels, top = [maps], segments.agg(F.max("seg")).first()[0] or 0
    while top >> (len(levels) - 1):
        levels.append(staged(_composed(levels[-1]), "maps"))
    states = segments.select("key").distinct().select("key", F.lit(0).alias("seg"), F.lit(initial).alias("state"))
    for below in reversed(range(len(levels) - 1)):
        left = states.select("key", (F.col("seg") * 2).alias("seg"), "state")
        step = levels[below].select("key", "seg", F.col("entry").alias("state"), "exit")
        right = left.join(step, ["key", "seg", "state"], "left").select("key", (F.col("seg") + 1).alias("seg"), F.coalesce("exit", "state").alias("state"))
        there = segments.select("key", F.shiftright("seg", below).alias("seg")).distinct()
        states = staged(left.unionByName(right).join(there, ["key", "seg"], "left_semi"), "states")
    return states


def replayed(log: DataFrame, initial: str, ranges: int | None = None) -> DataFrame:
    """(key, pos, accepted, state after) of every command of log (key, pos, expected, new). pos is unique in a key; a null expected or
    new state is never met. `ranges` is how many ranges the log is cut into, else what the session takes for a shuffle."""
    log = log.select("key", "pos", F.col("expected").cast("string"), F.col("new").cast("string"))
    cut = log.repartitionByRange(*([ranges] if ranges else []), "key", "pos").withColumn("_part", F.spark_partition_id())
    placed = staged(cut, "log")
    parts = placed.select("key", "_part").distinct()
    seg = F.row_number().over(Window.partitionBy("key").orderBy("_part")) - 1
    several = staged(parts.withColumn("seg", seg.cast("int")).withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1").drop("n"), "ranges")
    kind = log.schema["key"].dataType.simpleString()
    spanning = placed.join(F.broadcast(several), ["key", "_part"])  # at most two keys of a range go on beyond it
    backward = spanning.repartition("_part").sortWithinPartitions("seg", "key", F.desc("pos")).select("key", "seg", "expected", "new")
    maps = staged(backward.mapInPandas(_maps, f"key {kind}, seg int, entry string, exit string"), "maps")
    entries = entry_states(maps, several.select("key", "seg"), initial).join(several, ["key", "seg"]).select("key", "_part", F.col("state").alias("_entry"))
    ready = placed.join(F.broadcast(entries), ["key", "_part"], "left").repartition("_part").sortWithinPartitions("_part", "key", "pos")
    return ready.mapInPandas(_forward(initial), f"key {kind}, pos {log.schema['pos'].dataType.simpleString()}, accepted boolean, state string")
