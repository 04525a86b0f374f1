"""Latest rows, percentiles, buckets, apportionment, sampling and streaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import broadcast_if_few, staged


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is last by `order`."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])))
    return ranked.where("_rank = 1").drop("_rank")


def latest_before(rows: DataFrame, rounds: DataFrame, key: str, at: str, tie: str, started: str) -> DataFrame:
    """For each round and key, the last row strictly before the round's start. Each row learns by one ordered count over rows and
    rounds which round is the first to see it; the last row of a key for that round holds until the key's next one. So rows meet
    only the rounds in whose result they stand."""
    numbered = dense_positions(rounds, [started, *[c for c in rounds.columns if c != started]], "_round")
    names = [f"r{i}" for i in range(len(rows.columns))]
    plain = rows.toDF(*names)
    by = dict(zip(rows.columns, names, strict=True))
    moments = plain.select(F.col(by[at]).alias("_at"), F.lit(1).alias("_kind"), F.lit(0).alias("_one"), F.struct(*names).alias("_row"))
    starts = rounds.select(F.col(started).alias("_at"), F.lit(0).alias("_kind"), F.lit(1).alias("_one"), F.lit(None).cast(moments.schema["_row"].dataType).alias("_row"))
    seen = running(moments.unionByName(starts), ["_at", "_kind"], "_one", "_round").where("_kind = 1").select("_round", "_row.*")
    last = seen.groupBy("_round", by[key]).agg(F.max_by(F.struct(*names), F.struct(by[at], by[tie])).alias("_row"))
    until = F.lead("_round").over(Window.partitionBy(by[key]).orderBy("_round"))
    n = rounds.count()
    held = last.withColumn("_until", F.coalesce(until, F.lit(n))).where(F.col("_round") < F.col("_until"))
    each = held.select(F.explode(F.sequence("_round", F.col("_until") - 1)).alias("_round"), "_row")
    out = each.join(numbered, "_round").select(*[F.col(c) for c in rounds.columns], *[F.col(f"_row.{by[c]}").alias(c) for c in [key, *[c for c in rows.columns if c != key]]])
    return out


def running(rows: DataFrame, order: Sequence[str], weight: str, name: str, within: Sequence[str] = ()) -> DataFrame:
    """`name`: the sum of `weight` over all earlier rows of the same `within`, in order, without a window over a whole table or group:
    rows are range-partitioned and written once, summed in their partition, and offset by the sums of the partitions before."""
    placed = staged(rows.repartitionByRange(*within, *order).withColumn("_part", F.spark_partition_id()), "placed")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.coalesce(F.sum(weight).over(before.partitionBy("_part", *within).orderBy(*order)), F.lit(0)))
    sizes = placed.groupBy("_part", *within).agg(F.sum(weight).alias("_n"))
    groups = list(within) or [F.lit(0)]
    offsets = sizes.select("_part", *within, F.coalesce(F.sum("_n").over(before.partitionBy(*groups).orderBy("_part")), F.lit(0)).alias("_before"))
    return local.join(offsets, ["_part", *within]).withColumn(name, F.col("_local") + F.col("_before")).drop("_part", "_local", "_before")


def dense_positions(rows: DataFrame, order: Sequence[str], name: str, within: Sequence[str] = ()) -> DataFrame:
    """0, 1, ... over all rows (of the same `within`), in order."""
    return running(rows.withColumn("_one", F.lit(1)), order, "_one", name, within).drop("_one")


def midranks(rows: DataFrame, value: str, group: Sequence[str], name: str) -> DataFrame:
    """(group, value, name): (rows below + half of the equal ones) / rows, per group, a row per distinct value that is there; 1 in a group of
    one, 0 for values that are not positive. Groups may have any size: equal values are counted first, and only distinct ones are put in order."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_equal"))
    below = running(counts, [value], "_equal", "_below", group)
    sizes = below.groupBy(*group).agg(F.sum("_equal").alias("_rows"))
    mid = F.when(F.col(value) <= 0, 0.0).when(F.col("_rows") == 1, 1.0).otherwise((F.col("_below") + F.col("_equal") / 2) / F.col("_rows"))
    return below.join(sizes, list(group)).select(*group, value, mid.alias(name))


def with_midrank(rows: DataFrame, value: str, group: Sequence[str], name: str) -> DataFrame:
    """The rows and their mid-rank percentile; 0 for a null value."""
    joined = rows.join(midranks(rows, value, group, name), [*group, value], "left")
    return joined.withColumn(name, F.coalesce(name, F.lit(0.0)))


def with_bucket(rows: DataFrame, buckets: int, order: Sequence[str], name: str, group: Sequence[str] = ()) -> DataFrame:
    """floor(index * buckets / rows) in sorted order, for groups of any size. Unlike ntile, remainders are spread."""
    placed = dense_positions(rows, order, "_place", group)
    if group:
        sized = placed.join(rows.groupBy(*group).agg(F.count("*").alias("_rows")), list(group))
    else:
        sized = placed.withColumn("_rows", F.lit(rows.count()))
    return sized.withColumn(name, F.floor(F.col("_place") * buckets / F.col("_rows")).cast("int")).drop("_place", "_rows")


def hash_rank(identity: Column, seed: str) -> Column:
    return F.sha2(F.concat_ws(":", identity.cast("string"), F.lit(seed)), 256)


def largest_remainder(strata: DataFrame, count: str, seats: int, order: Sequence[str]) -> DataFrame:
    """`seats` of each stratum: the floor of its share, and one more for the largest remainders (ties by `order`). Strata are few."""
    every = Window.partitionBy(F.lit(0))
    share = strata.withColumn("_all", F.sum(count).over(every)).withColumn("_base", F.expr(f"{count} * {seats} div _all")).withColumn("_rest", F.expr(f"{count} * {seats} % _all"))
    placed = share.withColumn("_place", F.row_number().over(every.orderBy(F.desc("_rest"), *order))).withColumn("_left", F.lit(seats) - F.sum("_base").over(every))
    return placed.withColumn("seats", F.col("_base") + (F.col("_place") <= F.col("_left")).cast("long")).drop("_all", "_base", "_rest", "_place", "_left")


#: Ranges of hashes that are counted per stratum: the first four hex digits.
HASH_DIGITS = 4


def _edges(hashed: DataFrame, strata: Sequence[str], seats: DataFrame) -> DataFrame:
    """(strata, _edge, _rest): a stratum's sample has all rows whose hash begins below _edge, and the first _rest of those that begin
    with it. seats: (strata, _seats). Rows are counted by the beginning of their hash, so no stratum meets in a task."""
    counts = hashed.groupBy(*strata, "_head").agg(F.count("*").alias("_n")).join(seats, list(strata))
    so_far = Window.partitionBy(*strata).orderBy("_head").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = counts.withColumn("_upto", F.sum("_n").over(so_far)).where(F.col("_upto") >= F.col("_seats"))
    first = reached.groupBy(*strata).agg(F.min(F.struct("_head", (F.col("_seats") - F.col("_upto") + F.col("_n")).alias("_rest"))).alias("_e"))
    return first.select(*strata, F.col("_e._head").alias("_edge"), F.col("_e._rest").alias("_rest"))


def bottom_by_hash(rows: DataFrame, strata: Sequence[str], identity: str, seed: str, seats: DataFrame) -> DataFrame:
    """The first _seats rows of each stratum by hash, ties by identity; all, if it has fewer. Only rows whose hash begins like the last
    one taken are put in order: one in 65536 of a stratum."""
    hashed = rows.withColumn("_hash", hash_rank(F.col(identity), seed)).withColumn("_head", F.substr("_hash", F.lit(1), F.lit(HASH_DIGITS)))
    limits = staged(seats.join(_edges(hashed, strata, seats), list(strata), "left"), "limits")
    judged = hashed.join(broadcast_if_few(limits)(limits), list(strata))
    whole = judged.where((F.col("_seats") > 0) & (F.col("_edge").isNull() | (F.col("_head") < F.col("_edge"))))
    edge = judged.where(F.col("_head") == F.col("_edge")).withColumn("_rank", F.row_number().over(Window.partitionBy(*strata).orderBy("_hash", identity)))
    return whole.select(rows.columns).unionByName(edge.where(F.col("_rank") <= F.col("_rest")).select(rows.columns))


def stratified_sample(rows: DataFrame, stratum: Column, identity: str, seats: int, seed: str) -> DataFrame:
    """A proportional sample that is the same for the same seed: seats by largest remainder, rows by the rank of a hash."""
    named = rows.withColumn("stratum", stratum)
    quota = largest_remainder(named.groupBy("stratum").agg(F.count("*").alias("n")), "n", seats, ["stratum"])
    return bottom_by_hash(named, ["stratum"], identity, seed, quota.select("stratum", F.col("seats").alias("_seats")))


def share_sample(rows: DataFrame, strata: Sequence[str], identity: str, share: str, seed: str) -> DataFrame:
    """ceil(share) of each stratum and at least one row, by the rank of a hash. The share is a decimal, as text."""
    take = F.greatest(F.lit(1), F.ceil(F.count("*") * F.lit(share).cast("decimal(10,6)"))).cast("long")
    return bottom_by_hash(rows, strata, identity, seed, rows.groupBy(*strata).agg(take.alias("_seats")))


def floor_and_share(strata: DataFrame, count: str, seats: int, floor_percent: int = 40) -> DataFrame:
    """Seats in two parts: floor_percent of them split equally (extra ones to the largest strata), the rest by largest remainder over what is left
    of each stratum's count. `feasible` is whether every stratum can give its seats."""
    every = Window.partitionBy(F.lit(0))
    equal = seats * floor_percent // 100
    k = F.count("*").over(every)
    place = F.row_number().over(every.orderBy(F.desc(count), "stratum"))
    floors = strata.withColumn("_k", k).withColumn("_place", place).withColumn("floor_seats", F.expr(f"{equal} div _k") + (F.col("_place") <= F.expr(f"{equal} % _k")).cast("long"))
    rest = floors.withColumn("_left", F.col(count) - F.col("floor_seats")).drop("_k", "_place")
    done = largest_remainder(rest, "_left", seats - equal, ["stratum"]).withColumnRenamed("seats", "share_seats")
    return done.withColumn("seats", F.col("floor_seats") + F.col("share_seats")).withColumn("feasible", F.col("seats") <= F.col(count)).drop("_left")


def round_robin(rows: DataFrame, buckets: Sequence[str], order: Sequence[str], position: str = "position") -> DataFrame:
    """The k-th row of every bucket, buckets in order, before the k+1-th of any; `position` from 1."""
    turned = dense_positions(rows, order, "_turn", buckets)
    return dense_positions(turned, ["_turn", *buckets], position).withColumn(position, F.col(position) + 1).drop("_turn")


def streaks(rows: DataFrame, key: str, order: Sequence[str], hit: Column, name: str = "streak") -> DataFrame:
    """How many rows in a row, up to each row, have `hit`; others reset."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("_hit", F.coalesce(hit, F.lit(False))).withColumn("_island", F.sum((~F.col("_hit")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.sum(F.col("_hit").cast("long")).over(Window.partitionBy(key, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn(name, run).drop("_hit", "_island")


def last_state(rows: DataFrame, key: str, state: str, order: Sequence[str]) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias(state))
