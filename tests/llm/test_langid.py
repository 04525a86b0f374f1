import math
import zlib

import numpy as np

from millrace.llm import langid as L


def parse(text, sample):
    """Greedy longest phrases by plain search."""
    phrases, i = 0, 0
    while i < len(text):
        n = 1
        while i + n < len(text) and text[i : i + n + 1] in sample:
            n += 1
        phrases += 1
        i += n
    return phrases


def arrays(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def test_phrases_against_plain_search():
    samples = {"xx": ["banana bandana ananas"], "yy": ["the cat sat on the mat the end"]}
    model = L.Model(samples)
    texts = ["banana", "the ban on cats", "zzz qq", "ab" * 40, "x", "Ñandú the"]
    bits, letters = model.entropies(*arrays(texts))
    for k, name in enumerate(model.languages):
        own = samples[name][0] + " "
        for i, t in enumerate(texts):
            t = t.lower()
            assert math.isclose(bits[k][i], parse(t, own) * math.log2(len(own)) / len(t))
    assert letters.tolist() == [6, 12, 5, 80, 1, 8]


def test_cases(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", "en"), (4, "the cat sat on the mat", "en"), (5, "le chat est sur la table", "fr"), (6, "le chat", None), (7, "x", "fr"), (8, "the the", "en"), (8, "the the", "en"), (9, "chat " * 2000, "fr")]
    df = spark.createDataFrame([(*r, "s", 0.5) for r in rows], "doc_id long, text string, lang string, source string, score double")
    model = L.fit(df)
    got = {r[0]: (r[1], r[2], r[3]) for r in L.identify(df, model).collect()}
    for i, t, _ in rows:
        assert got[i][0] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert (got[i][1] == "und") == (t is None or not any(c.isalpha() for c in t))
        assert 0 <= got[i][2] <= 1
    assert got[9][1] == "fr"
    kept = L.in_known_language(df, model)
    assert kept.columns == df.columns and {r[0] for r in kept.collect()} == {4, 5, 6, 7, 8, 9}
    none = L.fit(df.where("doc_id < 0"))
    assert {r[2] for r in L.identify(df, none).collect()} == {"und"} and L.identify(df.where("false"), none).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in L.op8_langid(spark, d).collect() if r["held_out"]]
    right = sum(truth[r["doc_id"]] == r["lang_pred"] for r in rows)
    print(right, len(rows), [(r["doc_id"], r["lang_pred"], truth[r["doc_id"]], r["score"]) for r in rows if truth[r["doc_id"]] != r["lang_pred"]][:20])
    assert right >= 0.97 * len(rows)


def test_scripts_and_long_samples():
    """Languages of the same many-lettered script are told apart, and texts beyond the budget don't crowd out others."""
    rng = np.random.default_rng(4)
    chars = [[chr(0x4E00 + int(x)) for x in rng.integers(0, 6000, 3000)] for _ in range(2)]
    text = lambda k, n: "".join(chars[k][int(i)] for i in rng.zipf(1.3, n) % 3000)
    model = L.Model({"a": [text(0, 900) for _ in range(20)], "b": [text(1, 900) for _ in range(20)], "en": ["z" * 60000, *(" ".join(rng.choice("the cat sat on a mat and dog ran by".split(), 250)) for _ in range(20))]})
    names, _ = model.predict(*arrays([text(0, 80), text(1, 80), "the cat and the dog"]))
    assert names == ["a", "b", "en"] and all(len(x) <= L.SAMPLE_SYMBOLS for x in model.texts.values())
    assert L.Model({"x": ["y" * 60000]}).texts["x"] == [ord("y")] * (L.SAMPLE_SYMBOLS - 1) + [0]
    tied = L.Model({"q": ["abc"], "p": ["abc"]})
    assert tied.predict(*arrays(["abc", "xyz"]))[0] == ["p", "p"]
