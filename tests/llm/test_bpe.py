import hashlib
import random

import pytest
from cases import corpus
from tokenizers import Tokenizer

from lectern.llm import bpe

EXTRA = [
    "Hello's we'll DON'T 'sx ''s 123 4½ a_b-c!!??", "<|endoftext|>x <|startoftext|><|endoftext|> <|endof", "ΣΑΣ İstanbul ǅ ß ﬁ Å é", "emoji 😀👍🏽 mixed", "a" * 5000, "abc" * 3000, "\x00\x01\x7f\xa0\xad",
    "the\x1cof\x85and or", "ÿĀāłŉ", "Straße éèç ñ ü", "x" * 17 + "ing" * 40,
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.word_bpe())
    t.no_truncation()
    t.no_padding()
    return t


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def test_same_as_library(spark, library):
    rng = random.Random(5)
    noise = ["".join(rng.choice("abcdefghiklmnoprstuyéß .,'\n") for _ in range(200)) for _ in range(150)]
    rows = corpus() + list(enumerate(EXTRA + noise, 1000))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as n_tokens", "1 as `odd.name`")
    got = sorted(bpe.encode(docs, bpe.word_bpe(), decoded=True).collect(), key=str)
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((d, t, 1, len(ids), sha(" ".join(map(str, ids))), sha(text), ids, text))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_decode_round_trip(spark, library):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    coded = bpe.decode(bpe.encode(docs, bpe.word_bpe(), decoded=True).withColumnRenamed("decoded", "direct"), bpe.word_bpe())
    assert coded.where("not (direct <=> decoded)").count() == 0


def test_pair_test_agrees_with_exact_merging():
    with open(bpe.word_bpe(), "rb") as f:
        c = bpe.Codec(f.read())
    rng = random.Random(3)
    inner = [t for t in c.ids if not t.endswith(bpe.END)]
    import numpy as np

    names = [(rng.choice(inner), rng.choice(list(c.ids))) for _ in range(4000)]
    a, b = (np.array([c.ids[p[k]] for p in names]) for k in (0, 1))
    ok = c.compatible(a, b)
    for (x, y), good in zip(names, ok, strict=True):
        if y.endswith(bpe.END):
            assert (c.exact(x + y) == [c.ids[x], c.ids[y]]) == bool(good)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, bpe.word_bpe()).count() == 0
