import zlib

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import packing, repair
from millrace.llm.common import utf8
from millrace.llm.tokens import encoder, tokenizer_path

TEXTS = [
    "", "a", "  a", "a  b", "a \n b", "it's", "'s", "''s", " 's", "\n's", "don't've 'lls 'll 're're'd", "x<|endoftext|>y", "<|endoftext|>", "  ", "\n\n", "é'é",
    "12 345", " !!'s", "\t\tx", "'r", "'", "日本 語", "a　 b", "x's1", "x'st 're1", "😀 😀😀", "<|endoftext", "|>b", "the the the " * 900, None, "the the the " * 900,
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def ids_of(library, text, end):
    return [*library.encode(text or "", add_special_tokens=False).ids, end]


def test_encoder_equals_library(library):
    data, offsets = utf8(pa.array(TEXTS))
    ids, at = encoder(tokenizer_path("byte_bpe_50k.json")).encode(data, offsets)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [ids_of(library, t, 0)[:-1] for t in TEXTS]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_pieces(rows, ids, window):
    by_doc, by_sequence = {}, {}
    for doc, start, length, checksum, total, sequence, offset in rows:
        assert length > 0 and total == len(ids[doc]) and checksum == crc(ids[doc][start : start + length])
        by_doc.setdefault(doc, []).append((start, length))
        by_sequence.setdefault(sequence, []).append((offset, length))
    for doc, want in ids.items():
        at = 0
        for start, length in sorted(by_doc[doc]):
            assert start == at
            at += length
        assert at == len(want)
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0


def test_pack(spark, library):
    docs = [(i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, n long").repartition(3)
    for window in (64, 2048):
        check_pieces([tuple(r) for r in packing.pack(df, window=window).collect()], {i: ids_of(library, t, 1) for i, t in docs}, window)
    assert packing.pack(df.where("doc_id < 0")).count() == 0


def test_pack_whole_table(spark, library):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in packing.op1_pack(spark, "/root/testdata/sf0.001").collect()]
    check_pieces(got, {r[0]: ids_of(library, r[1], 1) for r in rows}, 2048)


def test_plan_prefers_whole_pieces():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 2048, 30_000)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    p = packing.plan(histogram)
    assert p.stretch < 0.2 * lengths.sum()
    x = packing.non_negative_least_squares(c := packing.combinations(np.array([512, 1024, 1536]), 2048), np.bincount([512] * 30 + [1024] * 40 + [1536] * 10, minlength=2049))
    assert (x >= 0).all() and abs(np.bincount(c.ravel(), np.repeat(x, 3), minlength=2049)[[512, 1024, 1536]] - [30, 40, 10]).max() < 3


def test_grammar_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 5000):
        ids = rng.integers(0, 6, n).astype(np.uint32)
        at = np.unique(np.concatenate([[0, n], rng.integers(0, n + 1, 20)]))
        base, rules, expansions, symbols, where = repair.compress(ids, at)
        assert (repair.expand(symbols, base, rules) == ids).all()
        for i in range(len(at) - 1):
            assert (repair.expand(symbols[where[i] : where[i + 1]], base, rules) == ids[at[i] : at[i + 1]]).all()
        if n == 5000:
            assert len(symbols) < 0.55 * n and expansions.max() >= 2


def test_repair_files(spark, library, tmp_path):
    docs = list(enumerate(TEXTS))
    df = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, shard long").repartition(4)
    repair.write(df, f"file://{tmp_path}/ids")
    got, start = {r[0]: tuple(r)[1:] for r in repair.read(spark, f"file://{tmp_path}/ids").collect()}, 0
    for i, t in docs:
        ids = ids_of(library, t, 0)
        assert got[i] == (start, len(ids), crc(ids))
        start += len(ids)
    for row in spark.read.parquet(f"file://{tmp_path}/ids").collect():
        for k, doc in enumerate(row["doc_ids"]):
            ids = ids_of(library, TEXTS[doc], 0)
            for a, b in ((0, len(ids)), (len(ids) // 3, len(ids) // 2), (len(ids) - 1, len(ids))):
                assert repair.stretch(row.asDict(), k, a, b).tolist() == ids[a:b]


def test_repair_empty(spark, tmp_path):
    repair.write(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/none")
    assert repair.read(spark, f"file://{tmp_path}/none").count() == 0
