from millrace.llm import decontaminate as D


def test_rows_are_judged_by_their_text(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    names = ["id", "text", "n_hit", "a.b", "k0", "c0"]
    rows = [(None, passage), (None, "clean one"), (7, passage), (7, "clean two"), (8, ""), (9, None), (9, passage), (9, passage)]
    docs = spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], "id long, text string, n_hit int, `a.b` string, k0 string, c0 string").repartition(3)
    items = spark.createDataFrame([(1, passage), (2, "other " + passage)], "item_id long, text string")
    for block in (D.BLOCK_BYTES, 1):
        left = D.clean(docs, items, block_bytes=block)
        assert left.columns == names
        assert sorted(map(str, left.collect())) == sorted(str(r) for r in docs.collect() if "w1" not in (r["text"] or ""))
    assert D.clean(docs.where("false"), items).count() == 0
    assert D.scan(docs, items, doc_id="id").where("contaminated").count() == 4


def test_no_items(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None), (None, "")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert D.clean(docs, items).count() == 3 and D.scan(docs, items).where("contaminated").count() == 0
