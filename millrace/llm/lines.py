"""Line dedup by winnowing over line hashes, in DataFrame functions only.

The lines of a text that are not blank have hashes; of every `window` consecutive ones the smallest hash (the last of equal
ones) is selected. Only selected places are stored, as fingerprints: two equal runs of at least `window` lines always have one
in common, at the same place of the run. Fingerprints are joined on their hash, and those that occur once are ruled out with
all windows that selected them. A match at a fingerprint is extended in both directions, by the lines before and behind it
in each window that selected it: its extensions are named by all their lines, and the first occurrence of a name in order of
(doc_id, line) is kept. Later ones chain, adjoining or overlapping, into maximal runs, and those lines go.

So exactly those lines go that lie in a run of at least `window` consecutive lines (blank ones aside) that also occurs
earlier, in a document of smaller doc_id or before in the same one. Line names have 128 bits. A fingerprint or window that
holds a good part of all rows is spread over tasks (`salted_join`).

With `chars`, runs of fewer than `window` lines go too once their lines hold that many characters together (blanks at the ends of
a line aside), in documents of any number of lines: so a repeated paragraph of 51 words or more, at least 101 characters, never
stays. `op10_passages` asks for that; `op10_lines` and the pipeline don't, as their SQL and tests fix the plain rule.

Defined cases: null text has no lines and stays null; blank lines are never deleted; rows equal in doc_id and text are one
document; a null doc_id comes first; an empty table gives one; other columns are kept as they are, whatever their names. Where a
column of that name is there already, the counts' names get a further underscore in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, fresh_names, salted_join, written

WINDOW = 3
#: Characters from which on a passage of fewer lines is a run (in op10_passages).
CHARS = 100
COUNTS = ["_n_lines", "_n_removed", "_n_runs"]


def _key(doc_id: str, text: str) -> Column:
    return F.struct(F.col(doc_id).alias("d"), F.xxhash64(F.lit(1), F.col(text)).alias("a"), F.xxhash64(F.lit(2), F.col(text)).alias("b"))


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _content(lines: Column) -> Column:
    """Positions of the lines that are not blank."""
    places = F.transform(lines, lambda x, i: F.when(F.trim(x) != "", i))
    return F.array_compact(places)


def fingerprints(docs: DataFrame, window: int, text: str, doc_id: str, chars: int | None = None) -> DataFrame:
    """A row per selected place: key of its document, the hash there (mark), the place, the size of the windows, and those windows
    that selected it, each with its first line and its name."""
    lines = docs.select(_key(doc_id, text).alias("key"), F.filter(_lines(text), lambda x: F.trim(x) != "").alias("lines"))
    least = window if chars is None else 1
    hashed = lines.where(F.size("lines") >= least).select(
        "key", F.transform("lines", lambda x: F.xxhash64(F.lit(1), x)).alias("a"), F.transform("lines", lambda x: F.xxhash64(F.lit(2), x)).alias("b"),
        F.transform("lines", lambda x: F.length(F.trim(x))).alias("n"),
    )

    def held(i: Column, size: int) -> Column:
        return sum((F.element_at("n", (i + k + 1).cast("int")) for k in range(size)), F.lit(0)) >= chars

    def selected(size: int) -> Column:
        """For each window its selected place, null where it is no run by itself or other windows hold all of its lines."""

        def place(i: Column) -> Column:
            part = F.slice("a", i + 1, size)
            return i + F.lit(size) - F.array_position(F.reverse(part), F.array_min(part)).cast("int")

        def of(i: Column) -> Column:
            wanted = F.lit(True)
            if size < window:
                wanted = wanted & held(i, size)
            if size > least:  # where both smaller windows are runs, they repeat with this one
                wanted = wanted & ~(held(i, size - 1) & held(i + 1, size - 1))
            return F.when(wanted, place(i))

        return F.transform(F.when(F.size("a") >= size, F.sequence(F.lit(0), F.size("a") - size)).otherwise(F.array().cast("array<int>")), of)

    def name(side: str, i: Column, size: int) -> Column:
        return F.xxhash64(*[F.element_at(side, (i + k + 1).cast("int")) for k in range(size)])

    def prints(size: int) -> Column:
        places = f"places{size}"

        def extended(p: Column) -> Column:
            near = F.sequence(F.greatest(F.lit(0), p - size + 1), F.least(p, F.size(places) - 1))
            own = F.filter(near, lambda i: F.element_at(places, i + 1) == p)
            return F.struct(
                F.element_at("a", p + 1).alias("mark"), p.alias("place"), F.lit(size).alias("size"),
                F.transform(own, lambda i: F.struct(i.alias("line"), name("a", i, size).alias("a"), name("b", i, size).alias("b"))).alias("windows"),
            )

        return F.transform(F.array_distinct(F.array_compact(places)), extended)

    sizes = range(least, window + 1)
    placed = hashed.select("key", "a", "b", *[selected(size).alias(f"places{size}") for size in sizes])
    return placed.select("key", F.explode(F.concat(*[prints(size) for size in sizes])).alias("f")).select("key", "f.*")


def matches(prints: DataFrame) -> DataFrame:
    """(key, size, line, a, b): the extensions of the fingerprints of which there are several."""
    several = prints.groupBy("mark", "size").agg(F.count("*").alias("n")).where("n > 1")
    common = salted_join(prints, several, ["mark", "size"], ["key", "place"], prints.count(), "left_semi")
    return common.select("key", "size", F.explode("windows").alias("w")).select("key", "size", "w.*")


def repeated(docs: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id", chars: int | None = None) -> DataFrame:
    """(key, starts): for each document, the first lines and sizes of its windows that occur earlier."""
    with Scratch(docs.sparkSession, "lines") as tmp:
        found = tmp.written(matches(tmp.written(fingerprints(docs, window, text, doc_id, chars), "fingerprints")), "matches")
        order = F.struct("key", "line")
        kinds = found.groupBy("size", "a", "b").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
        later = salted_join(found, kinds, ["size", "a", "b"], ["key", "line"], found.count()).where(order != F.col("first"))
        return written(later.groupBy("key").agg(F.collect_set(F.struct("line", "size")).alias("starts")), "starts")


def _rewritten(docs: DataFrame, window: int, text: str, doc_id: str, chars: int | None) -> DataFrame:
    """docs' columns as c0, c1, ..., then n_lines, n_removed, n_runs."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text, doc_id = (f"c{docs.columns.index(c)}" for c in (text, doc_id))
    starts = repeated(plain, window, text, doc_id, chars)
    joined = plain.withColumn("key", _key(doc_id, text)).join(starts.hint("merge"), "key", "left")  # alike at every size
    gone = F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s["line"], s["line"] + s["size"] - 1)))))
    removed = F.when(F.col("starts").isNull(), F.array().cast("array<int>")).otherwise(gone)
    cut = joined.withColumn("lines", _lines(text)).withColumn("gone", removed).withColumn("content", _content(F.col("lines")))
    places = F.transform("gone", lambda g: F.element_at("content", g + 1))
    keep = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), places)
    rebuilt = F.array_join(F.transform(keep, lambda p: F.element_at("lines", p + 1)), "\n")
    runs = F.size(F.filter("gone", lambda g, i: (i == 0) | (F.element_at("gone", F.when(i == 0, F.lit(1)).otherwise(i).cast("int")) != g - 1)))
    named = [F.when(F.size("gone") > 0, rebuilt).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in plain.columns]
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size("content"))
    return cut.select(*named, n_lines.cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), runs.cast("long").alias("n_runs"))


def deduplicated(docs: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id", chars: int | None = None) -> DataFrame:
    """All columns of docs, the text without its later repeated runs, and the COUNTS (names as said above)."""
    return _rewritten(docs, window, text, doc_id, chars).toDF(*docs.columns, *fresh_names(COUNTS, docs.columns))


def without_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id", chars: int | None = None) -> DataFrame:
    """The documents, without later repeated runs; a document of which nothing is left goes."""
    done = _rewritten(docs, window, text, doc_id, chars).where("n_removed = 0 OR n_removed < n_lines")
    return done.drop("n_lines", "n_removed", "n_runs").toDF(*docs.columns)


def _digests(done: DataFrame) -> DataFrame:
    names = dict(zip(["n_lines", "n_removed", "n_runs"], COUNTS, strict=True))
    return done.select("doc_id", *[F.col(own).alias(n) for n, own in names.items()], F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(deduplicated(documents(spark, sf_dir).select("doc_id", "text")))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op10_lines, and repeated passages of one or two lines from CHARS characters on."""
    return _digests(deduplicated(documents(spark, sf_dir).select("doc_id", "text"), chars=CHARS))


_CONTENT = """
WITH line AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL
), content AS (
  SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k FROM line WHERE trim(line, ' ') <> ''
)"""
_LATER = f""", win AS (
  SELECT doc_id, k, {" || chr(10) || ".join(f"lead(line, {i}) OVER w" for i in range(WINDOW))} AS name FROM content WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), later AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY name ORDER BY doc_id, k) AS n FROM win WHERE name IS NOT NULL) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, k + i AS k FROM later, (SELECT unnest(range({WINDOW})) AS i)
)"""
_RESULT = """, head AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE before IS NULL OR before <> k - 1) AS n_runs
  FROM (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM gone) GROUP BY doc_id
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text
  FROM line l LEFT JOIN content c ON l.doc_id = c.doc_id AND l.pos = c.pos LEFT JOIN gone g ON c.doc_id = g.doc_id AND c.k = g.k
  WHERE g.k IS NULL GROUP BY l.doc_id
), counted AS (SELECT doc_id, count(*) AS n_lines FROM content GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n_lines, 0)::BIGINT AS n_lines, coalesce(h.n_removed, 0)::BIGINT AS n_removed, coalesce(h.n_runs, 0)::BIGINT AS n_runs, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN counted n USING (doc_id) LEFT JOIN head h USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
SQL = _CONTENT + _LATER + _RESULT


def _windows(size: int) -> str:
    name = " || chr(10) || ".join(f"lead(line, {i}) OVER w" for i in range(size))
    held = " + ".join(f"length(trim(lead(line, {i}) OVER w, ' '))" for i in range(size))
    return f"SELECT doc_id, k, {size} AS size, {name} AS name, {held} AS held FROM content WINDOW w AS (PARTITION BY doc_id ORDER BY k)"


_LATER_PASSAGES = f""", win AS (
  {" UNION ALL ".join(map(_windows, range(1, WINDOW + 1)))}
), later AS (
  SELECT doc_id, k, size FROM (SELECT *, row_number() OVER (PARTITION BY size, name ORDER BY doc_id, k) AS n FROM win WHERE name IS NOT NULL AND (size = {WINDOW} OR held >= {CHARS})) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, k + i AS k FROM later, (SELECT unnest(range({WINDOW})) AS i) WHERE i < size
)"""
PASSAGES_SQL = _CONTENT + _LATER_PASSAGES + _RESULT
