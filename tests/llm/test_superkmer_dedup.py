import hashlib
import re

import pytest
from cases import corpus

from lectern.llm import superkmer_dedup as D

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, window):
    docs = [(d, t or "", WORD.findall(t or "")) for d, t in rows]
    first: dict = {}
    for k, (_, _, w) in enumerate(docs):
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), []).append((k, i))
    out = []
    for k, (d, text, w) in enumerate(docs):
        gone = [False] * len(w)

        def earlier(j, i, own):
            other = docs[j]
            if other[0] == d and other[1] == text:
                return i < own
            if other[0] == d:
                return None  # two texts under one id: order by hash, not tested here
            return d is None or other[0] is not None and other[0] < d

        for i in range(len(w) - window + 1):
            if any(earlier(j, p, i) for j, p in first[tuple(w[i : i + window])]):
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [3, 20_000])
def test_same_as_brute_force(spark, hot):
    rows = [r for r in corpus(1) if r[0] != 5]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as th", "2 as key", "3 as s0")
    got = D.strip_repeated_words(docs, window=10, unit=3, hot=hot).drop("removed").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 10)


def test_two_texts_under_one_id(spark):
    text = " ".join(map(str, range(15)))
    docs = spark.createDataFrame([(1, text), (1, text + " x")], "doc_id long, text string")
    got = D.strip_repeated_words(docs, window=10, unit=3).collect()
    assert sorted(r.n_removed for r in got) == [0, 15]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert D.strip_repeated_words(docs).count() == 0
