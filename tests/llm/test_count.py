import random
import re

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import count as C
from millrace.llm.common import utf8
from millrace.llm.tokens import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
TEXTS = [
    "", None, "a", "  A  b", "it's", "'s", "''s", " 's", "\n's", "don't've 'lls 'll 're're'd 'r 'l 'v", "x<|endoftext|>y", "<|startoftext|><|endoftext|> z", "  ", "12 345a6", "!!'s 'S '!s", "İstanbul ΣΑΣ ß",
    "été ́x", "日本 語テスト", "😀 😀😀", "<|endoftext", "|>b", "thththwhwhinging" * 200, "hello world, this's a (test)... of 3.14 things", "ñandú ÇA Éèê", "a'", "b'r", "'l", "a b c d", "naïve—dash…'tis",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_counts_equal_library(library):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("aetinhs'  .é1漢\n") for _ in range(rng.randint(0, 80))) for _ in range(500)] + ["".join(rng.choice(["th", "e", "ing", "an", "'re", " ", "we", "'s"]) for _ in range(60)) for _ in range(200)]
    data, offsets = utf8(pa.array(texts))
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    got = C.compiled(PATH).tokens(data, offsets).tolist()
    assert [(t, w, g) for t, w, g in zip(texts, want, got, strict=True) if w != g] == []


def test_splitter_against_pattern():
    rng, pattern = random.Random(7), re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
    for _ in range(300):
        t = "".join(rng.choice("strevmld'' a!1") for _ in range(rng.randint(1, 400)))
        want = [m.start() for m in pattern.finditer(t)]
        got = C.Splitter().starts(np.append(C.symbols()[np.frombuffer(t.encode(), np.uint8)], np.uint8(0))).tolist()
        assert got == want, t


def test_query(spark, library):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: tuple(r)[1:] for r in C.op7_count(spark, d).collect()}
    for i, t in docs:
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert got[i] == (len(t.encode()), n, n > 2048)
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens long")
    assert {r[0]: r[2] for r in C.token_counts(df).collect()} == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}
    assert C.token_counts(df.where("false")).count() == 0


def test_long_pieces_of_one_polynomial_hash():
    """Thue-Morse words and their complements have equal hashes for every base modulo 2^64; their counts differ."""
    from tokenizers import Tokenizer

    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("as", "sa"))
        if len(word) >= 1024:
            pair = [word, word.translate(str.maketrans("as", "sa"))]
            data = np.frombuffer("".join(pair).encode(), np.uint8)
            got = C.Compiled(PATH).tokens(data, np.array([0, len(word), 2 * len(word)]))
            assert got.tolist() == [len(Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids) for t in pair]
