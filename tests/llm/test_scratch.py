from pathlib import Path

from millrace.llm import common, neardup, packing


def test_written_tables_go_with_their_block(spark):
    where = Path(common.shared_dir(spark).removeprefix("file://").removeprefix("file:"))
    docs = spark.createDataFrame([(i, f"some words of text number {i % 3} that are packed") for i in range(9)], "doc_id long, text string")
    before = {p.name for p in where.iterdir()} if where.exists() else set()
    with common.temporary(spark):
        assert len(neardup.near_duplicates(docs).collect()) == 9 and packing.pack(docs).count() >= 9
        assert {p.name for p in where.iterdir()} > before
    assert {p.name for p in where.iterdir()} == before
    with common.Scratch(spark, "kept") as tmp:
        first, second = tmp.written(spark.range(3), "a"), tmp.written(spark.range(4), "b")
        tmp.drop(first)
        assert second.count() == 4 and len(list(where.glob("kept-*/*"))) == 1
    assert not list(where.glob("kept-*"))
