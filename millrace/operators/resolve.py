"""Entity resolution: trigram neighbours, similar titles, decisions and an audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity
from ..staging import dealt, staged
from .nearest import nearest_sets


def trigrams(name: Column) -> Column:
    """Distinct trigrams of each word, padded by two blanks before and one behind."""
    words = F.filter(F.split(F.lower(name), r"\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3))))))


def trigram_neighbours(left: DataFrame, right: DataFrame, k: int = 20) -> DataFrame:
    """The k nearest names of `right` (id, name) for each of `left` (id, name), by 1 - common / all trigrams, ties by id. Only names
    that share a trigram are neighbours."""
    grams = lambda names: staged(dealt(names.select("id", "name"), "id").select("id", trigrams(F.col("name")).alias("tokens")), "grams")
    asking = grams(left)
    return nearest_sets(asking, asking if right is left else grams(right), k)


def rescored(pairs: DataFrame, left: DataFrame, right: DataFrame, at_least: float) -> DataFrame:
    """Pairs whose edit ratio reaches a limit; the ratio runs on the few neighbours only."""
    named = pairs.join(left.select(F.col("id").alias("a"), F.col("name").alias("a_name")), "a").join(right.select(F.col("id").alias("b"), F.col("name").alias("b_name")), "b")
    return named.withColumn("score", similarity.ratio("a_name", "b_name")).where(F.col("score") >= at_least)


def resolved_titles(new: DataFrame, known: DataFrame, at_least: float = 75) -> DataFrame:
    """For each new row (id, owner, city, title) the best known one (id, owner, city, title) of the same owner and city, ties by the larger id.

    Rows of one owner, city and title are one: the known one is that of the largest id. Two titles are compared once, wherever they
    meet, and only if their lengths can reach the limit."""
    group = ["owner", "city"]
    tasks = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work
    asked = new.select(*group, "title").where("title IS NOT NULL").distinct()
    other = known.where("title IS NOT NULL").groupBy(*group, F.col("title").alias("known_title")).agg(F.max("id").alias("known"))
    asked, other = staged(asked, "asked"), staged(other, "known")
    shorter, both = F.least(F.length("title"), F.length("known_title")), F.length("title") + F.length("known_title")
    met = asked.repartition(tasks, *group, "title").join(other, group).where(200 * shorter + 1e-6 >= F.lit(at_least) * both)
    titles = met.select("title", "known_title").distinct().repartition(tasks)
    alike = staged(titles.withColumn("score", similarity.title_ratio("title", "known_title", at_least)).where(F.col("score") >= at_least), "alike")
    best = asked.join(alike, "title").join(other, [*group, "known_title"]).groupBy(*group, "title").agg(F.max(F.struct("score", "known")).alias("best"))
    own = new.join(best, [*group, "title"]).groupBy("id").agg(F.max("best").alias("best"))
    return new.select("id").join(own, "id", "left").select("id", F.col("best.known").alias("known"), F.col("best.score").alias("score"))


def decision(owners: Column, conflicts: Column, backend: Column, neighbours: Column, short: Column) -> tuple[Column, Column]:
    """(kind, reasons) for a candidate: several exact owners are ambiguous; one without conflict is it; else a person decides, unless
    nothing is near."""
    kind = F.when(owners > 1, "review").when((owners == 1) & ~conflicts, "existing").when(owners == 1, "review").when(~backend | (neighbours > 0), "review").otherwise("new")
    fuzzy = (owners == 0) & backend & (neighbours > 0)
    reasons = F.array_sort(F.array_compact(F.array(F.when(owners > 1, "ambiguous_owner"), F.when((owners == 1) & conflicts, "conflicting_evidence"), F.when((owners == 0) & ~backend, "similarity_unavailable"), F.when(fuzzy, "similar_name"), F.when(fuzzy & short, "short_name"))))
    return kind, reasons


def findings(*kinds: tuple[str, str, DataFrame]) -> DataFrame:
    """(code, severity, subject, finding_id) of all kinds of findings; each table has a `subject`."""
    out = None
    for code, severity, rows in kinds:
        own = rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col("subject").cast("string").alias("subject"))
        out = own if out is None else out.unionByName(own)
    return out.withColumn("finding_id", F.sha2(F.concat_ws("|", "code", "subject"), 256))
