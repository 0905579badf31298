"""What is computed over whole Arrow batches gives what the rows alone would."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.tokens import TOPIC_STOPWORDS
from lectern.operators import phrases as P
from lectern.operators import similarity as S


def test_signatures_are_the_least_rehashes(spark):
    sets = [(1, list(range(-300, 700))), (2, []), (3, None), (4, [5]), (5, list(range(9)))]
    df = spark.createDataFrame(sets, "id long, s array<long>").repartition(1)
    seeds = np.random.default_rng(7).integers(1, 2**63, (2, 8), dtype=np.int64).view(np.uint64)

    def want(s):
        if not s:
            return None
        h = np.array(s, np.int64).view(np.uint64)[:, None] * (seeds[0] | np.uint64(1)) + seeds[1]
        return (h ^ (h >> np.uint64(29))).min(axis=0).view(np.int64).tolist()

    got = {r.id: r.m for r in df.select("id", S.minhash(F.col("s"), 8).alias("m")).collect()}
    assert got == {k: want(s) for k, s in sets}


def _top(rows, top):
    n = Counter((g, " ".join(w[i : i + k])) for g, w in rows for k in (2, 3, 4) for i in range(len(w) - k + 1) if w[i] not in TOPIC_STOPWORDS and w[i + k - 1] not in TOPIC_STOPWORDS)
    out = set()
    for g in {g for g, _ in n}:
        own = sorted((-c, p) for (x, p), c in n.items() if x == g and c >= 2)
        out |= {(g, p, -c, k) for k, (c, p) in enumerate(own[:top], 1)}
    return out


def test_phrases_of_texts_and_of_words_are_exact(spark, monkeypatch):
    """Also where few cells are counted first, and where many phrases are as common as the last one named."""
    rng = random.Random(3)
    vocabulary = ["Árbol", "the", "zorro", "Große", "of", "İstanbul", "nai​ve", "ab", "x1", "extraordinarily", "№", "año…luz", "que"]
    texts = [(rng.choice(["en", "es", None]), rng.choice([" ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for _ in range(80)] + [("en", None), ("fr", ""), ("de", "solo zorro solo")]
    df = spark.createDataFrame(texts, "g string, t string").select("g", F.lower("t").alias("t"), F.filter(F.split(F.trim(F.regexp_replace(T.normalise(F.col("t")), "[^a-z]+", " ")), " "), lambda x: F.length(x) >= 3).alias("w"))
    want = _top([(r.g, r.w) for r in df.collect() if r.w is not None], 12)
    assert len(want) > 30
    monkeypatch.setattr(P, "FULLEST", 2)
    for column in ("t", "w"):
        assert {(r.g, r.phrase, r.n, r["rank"]) for r in P.phrases(df, "g", column, 12).collect()} == want


def test_phrases_deal_no_row_per_occurrence(spark):
    df = spark.createDataFrame([("g", "red fox ran home " * 2000)], "g string, w string")
    found = P.phrases(df, "g", "w", 5)
    rows = [r for b in [df.select("g", "w").toArrow().to_batches()] for out in P._cells(iter(b)) for r in out.to_pylist()]
    assert len(rows) <= 12 and sum(r["n"] for r in rows) == 7999 + 7998 + 7997
    assert found.count() == 5
