"""Near-duplicate classes by MinHash with tensored banding.

A table's key pairs a half key of a left collection with one of a right collection. Each collection has `HALVES` half keys of
two minhashes, so HALVES * HALVES tables of four minhashes each come from 4 * HALVES minhash functions, the square root of
what separate tables would need. A pair of similarity 0.75 shares no table with probability below 4e-6 (16 half keys).

1. Documents of equal shingle sets form a class, represented by the smallest doc_id; only representatives go on.
2. Half keys that one representative alone has rule out their tables; the others are paired into table keys.
3. In each bucket every member is compared with the smallest one: candidates grow with the rows, not with their square.
   Confirmed links give first components.
4. Buckets of left half keys (a pair of similarity 0.75 shares none with probability below 2e-6) whose members lie in
   several components are searched whole, in blocks of bounded size, for pairs between different components. What rules
   a pair out is exact (shingles that no other member of these buckets has can't be common; shingles folded to 16 bits
   bound what is) or a signature of 4 * HALVES bytes (less than half of them equal; below 2e-6 again). Pairs within a
   component need no search: they can't change it.
5. All links are confirmed on full shingle sets; components of all links are the result.

Texts of documents that share a table key are written once and read by steps 3 to 5; joins with texts are merge joins
whatever the size, so that plans are alike on small and large tables.

Defined cases: a text without words (null and empty too) has an empty set and is linked with nothing; rows with equal
doc_id are one document; a null doc_id is linked with nothing and is its own (null) component; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HEAVY, Rolling, Scratch, documents, lowered, mix, paired, runs, salted_join, small_batches, steps, utf8, written
from .components import components

SHINGLE, PERCENT, HALVES = 5, 75, 16
#: Rows that meet one leader at a time, and one another.
BLOCK, GROUP = 64, 512
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_FEATURES = "doc_id long, n_shingles long, d1 long, d2 long, signature binary, lefts array<long>, rights array<long>"


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, row by row, and the rows' offsets; a row of fewer words has one."""
    low = lowered(data)
    starts, ends = runs(~_GAP[low], offsets)
    words = Rolling(low).of(starts, ends)
    first = np.searchsorted(starts, offsets)
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(at[-1]), np.uint64)
    full = len(words) - size + 1
    if full > 0:
        every = words[:full].copy()
        for i in range(1, size):
            every = paired(every, words[i : i + full])
        row = np.repeat(np.arange(len(n)), count)
        place = first[row] + np.arange(len(out)) - at[row]
        whole = (n >= size)[row]
        out[whole] = every[place[whole]]
    for r in np.flatnonzero((n > 0) & (n < size)).tolist():
        own = words[first[r] : first[r] + 1].copy()
        for i in range(1, int(n[r])):
            own = paired(own, words[first[r] + i : first[r] + i + 1])
        out[at[r]] = own[0]
    return out, at


def sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    names, at = shingles(data, offsets, size)
    return [np.unique(names[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _features(size: int, halves: int):
    factors = mix(np.arange(1, 4 * halves + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in steps(offsets):
                names, at = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                rows = j - i
                distinct = [np.unique(names[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                counts = np.array([len(x) for x in distinct], np.int64)
                flat = np.concatenate(distinct) if distinct else np.zeros(0, np.uint64)
                some = np.flatnonzero(counts)
                begin = (np.cumsum(counts) - counts)[some]
                digest = np.zeros((2, rows), np.uint64)
                least = np.zeros((4 * halves, rows), np.uint64)
                if len(some):
                    for k, salt in enumerate((0x51, 0xA7)):
                        digest[k, some] = np.add.reduceat(mix(flat + np.uint64(salt)), begin)
                    for k, factor in enumerate(factors):
                        x = flat * factor
                        x ^= x >> np.uint64(29)
                        least[k, some] = np.minimum.reduceat(x, begin)
                half = paired(least[0::2], least[1::2])
                signature = np.ascontiguousarray((mix(least.copy()) & np.uint64(255)).astype(np.uint8).T)
                lists = [pa.array(np.ascontiguousarray(x.T).view(np.int64).tolist(), pa.list_(pa.int64())) for x in (half[:halves], half[halves:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, rows), pa.array(counts), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), pa.array([s.tobytes() for s in signature], pa.binary()), *lists],
                    ["doc_id", "n_shingles", "d1", "d2", "signature", "lefts", "rights"],
                )

    return run


def _confirm(size: int, percent: int):
    """Rows of one leader and block stand together, the leader's text (role 0) first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            data, offsets = utf8(batch.column(3))
            found = [x for i, j in steps(offsets) for x in sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)]
            out: tuple[list, list] = ([], [])
            for a, role, b, other in zip(*(batch.column(k).to_pylist() for k in range(3)), found, strict=True):
                if role == 0:
                    leader, own = a, other
                elif a == leader:
                    common = len(np.intersect1d(own, other, assume_unique=True))
                    if common and 100 * common >= percent * (len(own) + len(other) - common):
                        out[0].append(a)
                        out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])

    return run


def confirmed(tmp: Scratch, texts: DataFrame, pairs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough. a's text goes once to every block of BLOCK partners."""
    # written, so that the join below shuffles both sides afresh and a leader with very many partners can be split
    counts = tmp.written(pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    members = pairs.join(counts.hint("merge"), "a").select(F.col("b").alias("doc_id"), "a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("role"))
    leaders = counts.select(F.col("a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"))
    wanted = tmp.written(members.unionByName(leaders), "wanted")
    rows = texts.join(wanted.hint("merge"), "doc_id").repartition("a", "block").sortWithinPartitions("a", "block", "role", "doc_id")
    return tmp.written(rows.select("a", "role", F.col("doc_id").alias("b"), "text").mapInArrow(_confirm(size, percent), "a long, b long").distinct(), "links")


def _compare(percent: int):
    """Pairs of different components in a group that could be similar enough: sizes and shared shingles allow it, half of the signature
    agrees, and so do shingles folded to 16 bits. A pair is looked at in the first table in which its half keys meet."""

    def flush(table: int, ids: list, parts: list, sizes: list, shared: list, signatures: list, lefts: list, folded: list):
        own, half = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(ids), -1), np.array(lefts)
        part, number, n, s = np.array(parts), np.array(ids), np.array(sizes), np.array(shared)
        sets16 = [np.frombuffer(x, np.uint16) for x in folded]
        lost = n - np.array([len(x) for x in sets16])  # shingles folded onto others
        for k in range(len(ids)):
            most = np.minimum(s[k + 1 :], s[k])
            near = np.flatnonzero((part[k + 1 :] != part[k]) & (100 * most >= percent * (n[k + 1 :] + n[k] - most))) + k + 1
            near = near[(own[near] == own[k]).sum(1) >= own.shape[1] // 2]
            near = near[((half[near] == half[k]).argmax(1) == table) & (number[near] != number[k])]
            for x in near.tolist():
                common = len(np.intersect1d(sets16[k], sets16[x], assume_unique=True)) + min(lost[k], lost[x])
                if 100 * common >= percent * (n[k] + n[x] - common):
                    yield min(ids[k], ids[x]), max(ids[k], ids[x])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, [[] for _ in range(7)]
        for batch in batches:
            found = []
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for i, half, x, y, *row in zip(*columns, strict=True):
                if (i, half, x, y) != group:
                    if held[0]:
                        found += flush(group[0], *held)
                    group, held = (i, half, x, y), [[] for _ in range(7)]
                for column, value in zip(held, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])
        if held[0]:
            found = list(flush(group[0], *held))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def table_keys(reps: DataFrame) -> DataFrame:
    """(key, rep): for each table in which it may meet another, a representative's key."""
    sided = [reps.select("rep", F.posexplode(side).alias("i", "half")).select("rep", F.lit(k).alias("side"), "i", "half") for k, side in enumerate(("lefts", "rights"))]
    every = sided[0].unionByName(sided[1])
    shared = every.groupBy("side", "i", "half").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    useful = every.join(shared, ["side", "i", "half"], "left_semi")
    entry = F.struct("i", "half")
    own = useful.groupBy("rep").agg(F.collect_list(F.when(F.col("side") == 0, entry)).alias("l"), F.collect_list(F.when(F.col("side") == 1, entry)).alias("r"))
    pairs = own.select("rep", F.explode("l").alias("l"), "r").select("rep", "l", F.explode("r").alias("r"))
    return pairs.select("rep", F.xxhash64("l.i", "l.half", "r.i", "r.half").alias("key"))


def _shingle_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in steps(offsets):
                found = sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                rep = np.repeat(batch.column(0).to_numpy()[i:j], [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(np.concatenate(found).view(np.int64))], ["rep", "shingle"])

    return run


def _folded(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            found = [x for i, j in steps(offsets) for x in sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique((x >> np.uint64(48)).astype(np.uint16)).tobytes() for x in found], pa.binary())], ["rep", "folded"])

    return run


_LEFT = ["i", "half"]


def _mixed(tmp: Scratch, named: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components. Buckets with more than a share of 1 / HEAVY of the rows, so fewer than HEAVY,
    are picked by name where they are; only the rows of other buckets are dealt by bucket."""
    share, name = F.lit(named.count()) / HEAVY, F.concat_ws(":", *_LEFT)
    kinds = named.groupBy(*_LEFT).agg((F.min("part") != F.max("part")).alias("several"), F.count("*").alias("n"))
    kinds = tmp.written(kinds.where(F.col("several") | (F.col("n") > share)), "kinds")
    heavy = kinds.where(F.col("n") > share).select(name.alias("name"), "several").collect()
    large, wanted = [r["name"] for r in heavy], [r["name"] for r in heavy if r["several"]]
    dealt = named.where(~name.isin(large)).join(kinds.where("several").select(*_LEFT), _LEFT, "left_semi")
    return dealt.unionByName(named.where(name.isin(wanted)))


def cross_component_pairs(tmp: Scratch, keys: DataFrame, labels: DataFrame, reps: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Candidates between different components, from buckets of the left collection that have several. Shingles that one of their members
    alone has bound what it can share with any other: who can't reach the similarity goes."""
    met = keys.select("rep").distinct()
    named = reps.join(met, "rep", "left_semi").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    halves = tmp.written(named.select("rep", F.coalesce("component", "rep").alias("part"), F.posexplode("lefts").alias("i", "half")), "halves")
    several = tmp.written(_mixed(tmp, halves), "several")
    own = several.select(F.col("rep").alias("doc_id")).distinct()
    rows = texts.join(own.hint("merge"), "doc_id").select("doc_id", "text").mapInArrow(_shingle_rows(size), "rep long, shingle long")
    alone = rows.groupBy("shingle").agg(F.min("rep").alias("rep"), F.max("rep").alias("last")).where("rep = last").groupBy("rep").agg(F.count("*").alias("alone"))
    reach = reps.join(tmp.written(alone, "alone"), "rep", "left").withColumn("shared", F.col("n_shingles") - F.coalesce("alone", F.lit(0)))
    able = reach.where(100 * F.col("shared") >= percent * F.col("n_shingles")).select("rep", "n_shingles", "shared", "signature", "lefts")
    open_ = tmp.written(_mixed(tmp, tmp.written(several.join(able.select("rep"), "rep", "left_semi"), "reaching")), "open")
    shape = open_.groupBy(*_LEFT, "part").agg(F.count("*").alias("n")).groupBy(*_LEFT).agg(F.max(F.struct("n", "part")).alias("most"), F.sum("n").alias("all"))
    shape = shape.select(*_LEFT, F.col("most.part").alias("big"), F.ceil(F.col("most.n") / GROUP).cast("int").alias("n_big"), F.ceil((F.col("all") - F.col("most.n")) / GROUP).cast("int").alias("n_small"), F.col("all").alias("n"))
    rows = salted_join(open_, shape, _LEFT, ["rep"], open_.count()).withColumn("h", F.xxhash64("rep")).withColumn("is_big", F.col("part") == F.col("big"))
    rows = rows.withColumn("own", F.pmod("h", F.when(F.col("is_big"), F.col("n_big")).otherwise(F.col("n_small"))).cast("int"))
    smalls, bigs = F.sequence(F.lit(0), F.col("n_small") - 1), F.sequence(F.lit(0), F.col("n_big") - 1)
    with_small = F.transform(smalls, lambda t: F.struct(F.least(t, F.col("own")).alias("x"), F.greatest(t, F.col("own")).alias("y")))
    with_big = F.transform(bigs, lambda t: F.struct(F.col("own").alias("x"), (F.col("n_small") + t).alias("y")))
    of_big = F.transform(smalls, lambda t: F.struct(t.alias("x"), (F.col("n_small") + F.col("own")).alias("y")))
    groups = F.when(F.col("is_big"), of_big).otherwise(F.concat(with_small, with_big))
    dealt = rows.select(*_LEFT, "rep", "part", F.explode(groups).alias("g")).select(*_LEFT, "g.x", "g.y", "rep", "part")
    wanted = open_.select(F.col("rep").alias("doc_id")).distinct()
    folded = tmp.written(texts.join(wanted.hint("merge"), "doc_id").select("doc_id", "text").mapInArrow(_folded(size), "rep long, folded binary"), "folded")
    placed = dealt.join(able.join(folded, "rep"), "rep").repartition(*_LEFT, "x", "y").sortWithinPartitions(*_LEFT, "x", "y")
    row = placed.select(*_LEFT, "x", "y", "rep", "part", "n_shingles", "shared", "signature", "lefts", "folded")
    return tmp.written(row.mapInArrow(_compare(percent), "a long, b long").distinct(), "pairs")


def _same_document(member: DataFrame) -> DataFrame:
    """(a, b): classes that texts of one doc_id link, each with the smallest of them."""
    several = member.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a <> last").select("doc_id", "a")
    return member.join(several, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, halves: int = HALVES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row per document: the size of its shingle set, the smallest doc_id that links reach, and whether it is that."""
    small_batches(docs.sparkSession)
    with Scratch(docs.sparkSession, "neardup") as tmp:
        texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        features = tmp.written(texts.mapInArrow(_features(size, halves), _FEATURES), "features")
        full = features.where("n_shingles > 0 AND doc_id IS NOT NULL")
        digest = ["n_shingles", "d1", "d2"]
        classes = full.groupBy(*digest).agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("lefts").alias("lefts"), F.first("rights").alias("rights"))
        reps = tmp.written(classes, "classes")
        member = tmp.written(features.select("doc_id", *digest).join(reps.select(*digest, "rep"), digest, "left").select("doc_id", "n_shingles", "rep"), "members")
        keys = tmp.written(table_keys(reps), "keys")
        leaders = keys.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
        first = tmp.written(keys.join(leaders, "key").where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "first")
        met = keys.select(F.col("rep").alias("doc_id")).distinct()
        near = tmp.written(texts.where("text IS NOT NULL").join(met.hint("merge"), "doc_id").select("doc_id", "text"), "near")
        links = confirmed(tmp, near, first, size, percent).unionByName(tmp.written(_same_document(member), "same"))
        labels = components(links)
        more = confirmed(tmp, near, cross_component_pairs(tmp, keys, labels, reps, near, size, percent), size, percent)
        links = links.unionByName(more)
        if not more.isEmpty():
            labels = components(links)
        named = member.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
        component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
        out = named.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
        return written(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "neardup")


def representatives(docs: DataFrame, **options) -> DataFrame:
    """The documents, with all their columns, that are the first of their component."""
    doc_id = options.get("doc_id", "doc_id")
    gone = near_duplicates(docs, **options).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[doc_id] == gone["_gone"], "left_anti")


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
