"""Similar titles against all pairs, and how many of them are compared."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from millrace.operators import resolve
from millrace.operators.resolve import similarity


def test_repeated_titles_are_compared_once(spark, monkeypatch):
    rng = random.Random(7)
    titles = ["blue ring", "blue ring mark one", "blue ring mark two", "hot bolt", "hot bolts large", "", "x", None]
    rows = [(n, rng.choice(["o", "p", None]), rng.choice(["c", "d"]), rng.choice(titles)) for n in range(600)]
    new, known = [r for r in rows if r[0] % 2], [r for r in rows if not r[0] % 2]

    def best(row):
        found = [(SequenceMatcher(None, row[3], k[3], autojunk=False).ratio() * 100, k[0]) for k in known if None not in (*row, *k) and k[1:3] == row[1:3]]
        return max((f for f in found if f[0] >= 75), default=(None, None))

    compared = spark.sparkContext.accumulator(0)

    def counted(a, b, at_least=0):
        def one(x, y):
            compared.add(1)
            return similarity.title_score(x, y, at_least)

        return F.udf(one, "double")(a, b).cast("double")

    schema = "id long, owner string, city string, title string"
    left, right = spark.createDataFrame(new, schema), spark.createDataFrame(known, schema)
    want = sorted((r[0], *best(r)[::-1]) for r in new)
    assert sorted(map(tuple, resolve.resolved_titles(left, right).collect())) == want
    monkeypatch.setattr(similarity, "title_ratio", counted)
    assert sorted(map(tuple, resolve.resolved_titles(left, right).collect())) == want
    assert 0 < compared.value <= 2 * len(titles) ** 2  # a filter may evaluate it twice
