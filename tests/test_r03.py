"""Cases behind the findings of round 3."""

import duckdb
import numpy as np
from oracle import compare
from pyspark.sql import functions as F

from lectern.functions.arrays import rounded
from lectern.operators import cluster, numbers, scoring
from lectern.plans import registry


def same_as_sql(spark, name, folder):
    return compare(spark, registry.QUERIES[name], registry.ORACLE[name], str(folder))


def conversations(spark, folder, rows):
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{folder}/conversations.parquet_dir")
    part = next((folder / "conversations.parquet_dir").glob("*.parquet"))
    part.rename(folder / "conversations.parquet")


def test_claim_history_at_accented_letters(spark, tmp_path):
    conversations(spark, tmp_path, [(1, 0, "user", "levy cut éno levy"), (1, 1, "assistant", "levy cut stays"), (1, 2, "user", "levy cut, not now")])
    assert same_as_sql(spark, "j11_claim_history", tmp_path) == ""


def test_blind_claims_at_accented_letters(spark, tmp_path):
    conversations(spark, tmp_path, [(1, 0, "user", "They say éund and Mr. Und's"), (1, 1, "assistant", "une éthe"), (1, 2, "assistant", "nichté")])
    assert same_as_sql(spark, "v26_blind_claims", tmp_path) == ""


def test_rounding_as_in_sql(spark):
    x = [16.0675, 0.15, 1.005, 2.5, -2.5, 50.1115]
    df = spark.createDataFrame([(v,) for v in x], "x double").select(*[rounded(F.col("x"), n).alias(f"r{n}") for n in (0, 1, 2, 3)])
    con = duckdb.connect()
    want = [con.execute("SELECT " + ", ".join(f"round(CAST({v} AS DOUBLE), {n})" for n in (0, 1, 2, 3))).fetchone() for v in x]
    assert [tuple(r) for r in df.collect()] == want


def test_affinities_are_decimals(spark):
    parts = {"affinity": 0.03, "topical": 0.123457, "specificity": 0.5, "quantitative": 0.35, "recency": 0.1, "corroboration": 0.333333}
    df = spark.createDataFrame([(1, 1, *parts.values())], "g long, ev long, " + ", ".join(f"{k} double" for k in parts))
    points = 0.9 + 22 * 0.123457 + 12 * 0.5 + 10 * 0.35 + 10 * 0.1 + 16 * 0.333333
    got = scoring.rank_evidence(df, "g", {k: F.col(k) for k in parts}, F.lit(False), F.lit(False), "ev").first().score
    assert got == round(points * 1e4) / 1e4


def test_numbers_only_where_digits_are(spark):
    df = spark.createDataFrame([("no figure",), ("12 per cent",), (None,)], "t string").select(numbers.claim_numbers(F.col("t")).alias("n"))
    rows = [r.n for r in df.collect()]
    assert rows[0] == [] and rows[1][0].value == 12.0 and rows[2] is None
    assert "RLIKE" in df._jdf.queryExecution().optimizedPlan().toString()


def test_cosine_search_in_cells(spark, monkeypatch):
    monkeypatch.setattr(cluster, "SEARCH_BLOCK", 40)
    monkeypatch.setattr(cluster, "BLOCK", 3)
    v = np.random.default_rng(5).normal(size=(300, 6)).round(3)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = cluster.cosine_search(df, "vec_id", "embedding", F.col("vec_id") % 25 == 0, top=4)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    c = np.round(v @ v.T / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1)), 5)
    want = {(q, r + 1, i) for q in range(0, 300, 25) for r, i in enumerate(sorted((i for i in range(300) if i != q), key=lambda i: (-c[q, i], i))[:4])}
    assert {(r.query_id, r["rank"], r.vec_id) for r in found.collect()} == want


def test_near_pairs_name_every_copy(spark, tmp_path):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(7, text), (23, text), (39, text), (55, text + " more"), (71, "short"), (87, "short")]
    docs = spark.createDataFrame([(i, "s", "en", len(t), t) for i, t in rows], "doc_id long, source string, lang string, n_chars long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/d")
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    assert same_as_sql(spark, "j02_m01_m02_near_pairs", tmp_path) == ""
    found = registry.QUERIES["j02_m01_m02_near_pairs"](spark, str(tmp_path)).collect()
    assert {(r.l, r.r, r.n_l, r.n_r) for r in found} == {(7, 23, 3, 3), (7, 39, 3, 3), (7, 55, 3, 1)}
