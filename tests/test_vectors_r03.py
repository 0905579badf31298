"""Vectors stay in one row per document: findings F1 to F5 of round 3."""

import math
from collections import Counter

from pyspark.sql import functions as F

from lectern.functions.arrays import bound, counted
from lectern.functions.tokens import features
from lectern.operators import similarity


def _tfidf(docs, share=0.85):
    counts = {k: Counter(t) for k, t in docs.items()}
    df = Counter(t for c in counts.values() for t in c)
    out = {}
    for k, c in counts.items():
        c = {t: n for t, n in c.items() if df[t] / len(docs) <= share}
        raw = {t: (0.5 + 0.5 * n / max(c.values())) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, n in c.items()}
        out[k] = {t: round(x / math.sqrt(sum(y * y for y in raw.values())), 9) for t, x in raw.items()}
    return {k: v for k, v in out.items() if v}


def test_tfidf_keeps_a_document_in_one_row_and_copies_once(spark):
    docs = {1: "every red fox red", 2: "every fox ran", 3: "every red fox red", 4: "every", 5: "every owl", 7: "red every fox red"}
    docs = {k: t.split() for k, t in docs.items()}
    df = spark.createDataFrame([*docs.items(), (6, [])], "id long, t array<string>")
    vectors, members = similarity.tfidf(df, "id", F.col("t"), 6)
    rows = {r.id: r.v for r in vectors.where(F.size("v") > 0).collect()}
    want = _tfidf(docs)
    assert {k: {x.term: round(x.w, 9) for x in v} for k, v in rows.items()} == {k: want[k] for k in (1, 2, 5)}
    assert {r.id: r.rep for r in members.collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 7: 1}
    assert {(x.term, x.df, x.shared) for v in rows.values() for x in v} == {("red", 3, False), ("fox", 4, True), ("ran", 1, False), ("owl", 1, False)}


def test_terms_are_counted_in_their_row(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],), (["x"],)], "t array<string>")
    got = [[(x.term, x.c) for x in r.v] for r in df.select(counted(F.col("t")).alias("v")).collect()]
    assert got == [[("a", 1), ("b", 2)], [], [("x", 1)]]
    assert [r.f for r in df.select(features(F.transform("t", lambda x: F.concat(x, F.lit("xx")))).alias("f")).collect()] == [["bxx", "axx", "bxx", "bxx_axx", "axx_bxx"], [], ["xxx"]]


def test_a_bound_value_is_computed_once(spark):
    plan = spark.range(1).select(bound(F.sha2(F.col("id").cast("string"), 256), lambda x: F.concat(x, x, F.reverse(x))).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2") == 1
