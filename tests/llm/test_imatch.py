import hashlib
import re
from collections import Counter
from statistics import mean

from millrace.llm import imatch as I


def edited(rows):
    """(doc_id, edited text, next text) in descending order of doc_id."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for k, (d, t) in enumerate(order):
        t, follower = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 3
        out.append((d, t[: len(t) - m] + follower[:m], follower))
    return out


def test_edits_and_likeness(spark):
    word = lambda i: f"w{i * i % 97}"
    rows = [(i, " ".join(word(i * 7 + k) for k in range(5 + i % 40)) + " é漢") for i in range(0, 400, 3)]
    rows += [(1, None), (2, ""), (4, "ab"), (2001, "the same text here"), (2002, "the same text here"), (None, "last of all"), (1000, "x y z " * 4000)]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, fingerprint string").repartition(5)
    got = {r["doc_id"]: r for r in I.fingerprint_edits(df, low=0.01, high=0.9).collect()}
    assert len(got) == len(rows)
    texts = dict(rows)
    prints = {}
    for d, t, follower in edited(rows):
        r = got[d]
        assert r["n_chars"] == len(texts[d] or "") and r["edited_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        prints.setdefault(texts[d] or "", set()).add(r["fingerprint"])
        prints.setdefault(t, set()).add(r["edited_fingerprint"])
        assert abs(r["near_edited"] - I.likeness(r["fingerprint"], r["edited_fingerprint"])) < 1e-9 and 0 <= r["near_edited"] <= 1
        if follower == (texts[d] or ""):
            assert r["near_next"] == 1
    assert all(len(p) == 1 for p in prints.values())
    assert got[2002]["near_next"] == 1.0


def test_lexicon_is_the_band(spark):
    rows = [(i, f"common mid{i % 10} rare{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    book = I.lexicon(df, low=0.02, high=0.5)
    assert len(book.terms) == 10
    frequency = Counter(w for _, t in rows for w in set(re.findall("[a-z0-9]+", t)))
    assert sum(4 <= n <= 100 for n in frequency.values()) == 10


def test_small_tables(spark):
    assert I.fingerprint_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = I.fingerprint_edits(spark.createDataFrame([(3, "a b c d e f")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"a b c d a b").hexdigest()
    twice = I.fingerprint_edits(spark.createDataFrame([(3, "a b c"), (3, "a b c"), (2, "x")], "doc_id long, text string")).collect()
    assert len(twice) == 3


def test_whole_table_separates(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in I.op6_imatch(spark, d).collect()}
    texts = dict(rows)
    for i, t, _ in edited(rows):
        assert got[i]["edited_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    near, after = [r["near_edited"] for r in got.values()], [r["near_next"] for r in got.values()]
    digests = sum(r["fingerprint"][0] == "d" for r in got.values())
    better = mean(float(a > b) + 0.5 * (a == b) for a, b in zip(near, after, strict=True))
    print("near", mean(near), "next", mean(after), "digests", digests, "better", better, len(texts))
    assert mean(near) > mean(after) + 0.2 and better > 0.9


M = (1 << 64) - 1


def mixed(x):
    """The finaliser of splitmix64, in plain integers."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def fingerprint(text, band, subsets):
    """As the docstring tells it: terms in the band, levels by their number, a sum of hashes for each subset at two levels."""
    import numpy as np

    terms = {}
    for w in set(re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))):
        data = np.frombuffer(w.encode(), np.uint8)
        terms[w] = int(I.term_sets(data, np.array([0, len(data)]))[0][0])
    inside = sorted(h for w, h in terms.items() if w in band)
    if not inside:
        return "d" + hashlib.sha256(text.encode()).hexdigest()
    level = (len(inside) - 1).bit_length()
    out = [[], []]
    for k in range(1, subsets + 1):
        salt = mixed(k * 0x9E3779B97F4A7C15 & M)
        for finer in (0, 1):
            held = [d for h in inside if (d := mixed(h ^ salt)) <= M >> level >> finer]
            total = sum(mixed(d + salt & M) for d in held) & M
            out[finer].append(max(1, total >> 32) if held else 0)
    return f"{level:02d}" + "".join(f"{x:08x}" for x in out[0] + out[1])


def test_fingerprints_against_plain_integers(spark):
    rows = [(i, " ".join(f"W{(i * k + k * k) % 61}" for k in range(1, 4 + i % 30)) + ("" if i % 3 else " Äpfel é9")) for i in range(90)] + [(200, ""), (201, "only1here"), (202, "W1 w1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    low, high, subsets = 0.03, 0.6, 7
    frequency = Counter(w for _, t in rows for w in set(re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))))
    band = {w for w, n in frequency.items() if max(2, low * len(rows)) <= n <= max(2, high * len(rows))}
    got = {r["doc_id"]: r for r in I.fingerprint_edits(df, low=low, high=high, subsets=subsets).collect()}
    assert len(band) > 20
    for d, t, follower in edited(rows):
        own, other, after = (fingerprint(x, band, subsets) for x in (dict(rows)[d], t, follower))
        assert (got[d]["fingerprint"], got[d]["edited_fingerprint"]) == (own, other)
        assert abs(got[d]["near_next"] - I.likeness(own, after)) < 1e-9
