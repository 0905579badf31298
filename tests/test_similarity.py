"""Joins, sketches and clusters against brute force; nothing is lost in large groups."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import blocks, census, cluster, evidence, reports, segment, similarity


def _vectors(n, seed, terms=30):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        v = {f"t{rng.randrange(terms)}": rng.random() + 0.1 for _ in range(rng.randint(1, 6))} | {"common": 0.3}
        if i % 5 == 4:
            v = out[-1]
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append({t: x / norm for t, x in v.items()})
    return out


def _frame(spark, vs):
    return spark.createDataFrame([(i, t, w) for i, v in enumerate(vs) for t, w in v.items()], "id long, term string, w double")


@pytest.mark.parametrize("least", [0.2, 0.6])
def test_sparse_cosine_finds_all_pairs(spark, least):
    vs = _vectors(60, 1)
    dot = lambda a, b: sum(w * b.get(t, 0) for t, w in a.items())
    want = {(i, j): round(dot(vs[i], vs[j]), 9) for i, j in itertools.combinations(range(60), 2) if dot(vs[i], vs[j]) >= least}
    got = {(r.l, r.r): round(r.cosine, 9) for r in similarity.sparse_cosine(_frame(spark, vs), "id", "term", least).collect()}
    assert got.keys() - want.keys() <= {k for k in got if abs(got[k] - least) < 1e-9} and want.keys() <= got.keys()


def _greedy(vs, threshold):
    """The best pair alone, round by round."""
    groups = [[i] for i in range(len(vs))]
    dot = [[sum(w * b.get(t, 0) for t, w in a.items()) for b in vs] for a in vs]
    while True:
        best = max(((round(sum(dot[x][y] for x in a for y in b) / (len(a) * len(b)), 9), -min(a), -min(b), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(groups), 2)), default=(0,))
        if best[0] < threshold:
            return sorted(sorted(g) for g in groups)
        i, j = best[3:]
        groups[i] = sorted(groups[i] + groups.pop(j))
        groups.sort(key=min)


@pytest.mark.parametrize("local", [cluster.LOCAL, 3])
@pytest.mark.parametrize("threshold", [0.3, 0.45])
def test_clusters_are_those_of_the_greedy_order(spark, local, threshold):
    vs = _vectors(40, 3)
    got: dict = {}
    for r in cluster.cluster_vectors(_frame(spark, vs), "id", "term", threshold, local).collect():
        got.setdefault(r.cluster, []).append(r.id)
    assert sorted(sorted(g) for g in got.values()) == _greedy(vs, threshold)


def test_dots_of_pairs_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(similarity, "CELL_VECTORS", 5)
    rng = random.Random(8)
    vs = [{t: rng.random() for t in rng.sample(range(40), rng.randint(0, 12))} for _ in range(30)]
    rows = spark.createDataFrame([(i, list(v), list(v.values())) for i, v in enumerate(vs)], "id long, terms array<long>, ws array<double>")
    asked = [(i, j) for i in range(30) for j in range(30) if i < j and (i + j) % 3]
    got = {(r.l, r.r): r.dot for r in similarity.pair_dots(spark.createDataFrame(asked, "l long, r long"), rows).collect()}
    assert got.keys() == set(asked)
    for (i, j), dot in got.items():
        assert dot == pytest.approx(sum(w * vs[j].get(t, 0) for t, w in vs[i].items()))


def test_overlaps_and_terms(spark):
    sets = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c", "d"]), (3, ["z"])], "id long, s array<string>")
    assert [(r.l, r.r, r.overlap, round(r.coverage, 3)) for r in similarity.overlaps(sets, "id", "s").collect()] == [(1, 2, 0.5, 0.5)]


def test_minhash_estimates_jaccard(spark):
    a, b = list(range(300)), list(range(100, 400))
    r = spark.createDataFrame([(a, b)], "a array<long>, b array<long>").select(similarity.minhash(F.transform("a", lambda x: F.xxhash64(x))).alias("x"), similarity.minhash(F.transform("b", lambda x: F.xxhash64(x))).alias("y"), similarity.minhash(F.array().cast("array<long>")).alias("none"))
    got = r.select(similarity.minhash_estimate(F.col("x"), F.col("y")).alias("e"), "none").first()
    assert abs(got.e - 0.5) < 0.15 and got.none is None


def test_crowded_bands_are_handed_on(spark):
    sig = spark.createDataFrame([(i, [1, 2, 3, 4, i, i, i, i]) for i in range(12)] + [(50, [90] * 8), (51, [90] * 8)], "id long, sig array<long>")
    pairs, crowded = similarity.lsh_pairs(sig, 4, most=10)
    assert {(r.l, r.r) for r in pairs.collect()} == {(50, 51)} and {r.id for r in crowded.collect()} == set(range(12))


def test_simhash_is_the_sign_of_summed_bits(spark):
    tokens = "a b c a b c d e".split()
    r = spark.createDataFrame([(tokens,), (["x"],), ([],)], "t array<string>").select(similarity.token_runs(F.col("t")).alias("runs"), similarity.simhash(F.col("t")).alias("s")).collect()
    want = 0
    for bit in range(64):
        total = sum(1 if (h >> bit) & 1 else -1 for h in r[0].runs)
        want |= (total > 0) << bit
    assert len(r[0].runs) == 6 and r[0].s == (want - 2**64 if want >= 2**63 else want)
    assert len(r[1].runs) == 1 and r[2].s == 0


def test_cohesion_and_separation_are_those_of_the_pairs(spark):
    rng = random.Random(4)
    rows = [(k % 3, [rng.gauss(k % 3, 1) for _ in range(5)]) for k in range(30)] + [(9, [1.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "label long, v array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    inside = {r.label: r.cohesion for r in cluster.cohesion(df, "label", "v").collect()}
    outside = {r.label: r.separation for r in cluster.separation(df, "label", "v", block=7).collect()}
    for k in (0, 1, 2, 9):
        own, rest = [v for x, v in rows if x == k], [v for x, v in rows if x != k]
        pairs = [cos(a, b) for a, b in itertools.combinations(own, 2)]
        assert inside[k] == pytest.approx(sum(pairs) / len(pairs) if pairs else 1.0, abs=2e-5)
        assert outside[k] == pytest.approx(max(cos(a, b) for a in own for b in rest), abs=2e-5)


def test_ranks_over_all_rows(spark):
    rows = spark.createDataFrame([(i, (i * 7) % 13) for i in range(300)], "id long, n long").repartition(5)
    got = {r.id: r["rank"] for r in cluster.global_rank(rows, F.desc("n"), F.asc("id")).collect()}
    want = sorted(range(300), key=lambda i: (-((i * 7) % 13), i))
    assert got == {i: k for k, i in enumerate(want, 1)} and cluster.global_rank(rows.limit(0), F.desc("n"), F.asc("id")).count() == 0


def test_all_needles_are_located(spark):
    needles = spark.range(10_050).select(F.concat(F.lit("n"), F.col("id").cast("string"), F.lit("x")).alias("needle"))
    docs = needles.groupBy().agg(F.array_join(F.collect_list("needle"), "  ").alias("t")).withColumn("id", F.lit(1))
    assert segment.locate(docs, "id", "t", needles).count() == 10_050


def test_blocks_hold_all_rows(spark):
    df = spark.range(1000).selectExpr("id", "repeat('x', 100) as s")
    parts = list(blocks.broadcast_blocks(df, rows=300, size=20_000))
    assert len(parts) > 3 and sorted(r.id for p in parts for r in p.collect()) == list(range(1000))


def test_phrases_count_and_rank(spark):
    df = spark.createDataFrame([("g", "red fox ran home red fox".split()), ("g", "the red fox ran away".split()), ("h", [])], "g string, w array<string>")
    got = {(r.phrase, r.n, r["rank"]) for r in segment.phrases(df, "g", "w", top=2).collect()}
    assert got == {("red fox", 3, 1), ("fox ran", 2, 2)}


@pytest.mark.parametrize(("mention", "want"), [("Loreto Cravajal", "Loreto Carvajal"), ("Dr. Ana Ruiz", "Ana Ruiz"), ("Ruiz", "Ana Ruiz"), ("Soto", "Soto"), ("Ana Ruis Vega", "Ana Ruis Vega"), ("Pedro Carvajal", "Pedro Carvajal")])
def test_canonical_names(spark, mention, want):
    known = spark.createDataFrame([("Loreto Carvajal",), ("Ana Ruiz",), ("Luis Soto",), ("Eva Soto",)], "n string")
    m = spark.createDataFrame([(mention,)], "m string")
    assert census.canonical_names(m, "m", known, "n").first().canonical == want


def test_corroboration_counts_other_sources(spark):
    rows = [(1, 1, "a", False, False), (2, 1, "a", False, False), (3, 1, "b", False, False), (4, 1, "c", False, True), (5, 2, "a", True, False)]
    e = spark.createDataFrame(rows, "ev long, claim_id long, source string, derived boolean, restating boolean")
    assert {r.ev: r.sources for r in evidence.corroboration(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 2, 5: 0}


def test_matrix_and_axis_confidence(spark):
    m = evidence.tier_table(spark)
    assert evidence.matrix_faults(m, m.select("tier").distinct()).count() == 0
    bad = m.withColumn("affinity", F.when(F.col("incapable"), 0.9).otherwise(F.col("affinity")))
    assert evidence.matrix_faults(bad, m.select("tier").distinct()).count() > 0
    points = spark.createDataFrame([(1, "a", 10, 1, True, True), (1, "a", 11, -1, False, True), (1, "b", 10, 1, False, False)], "document long, axis string, provision long, sign int, corroborated boolean, structural boolean")
    grid = spark.createDataFrame([(1, x) for x in "abc"], "document long, axis string")
    got = {r.axis: (r.confidence, r.limiting) for r in reports.axis_confidence(points, grid).collect()}
    assert got == {"a": (0.42, "signs_disagree"), "b": (0.15, "wording_alone"), "c": (0.0, "not_engaged")}


def test_unknown_ages_and_gaps_are_a_half(spark):
    none = F.lit(None).cast("double")
    r = spark.range(1).select(similarity.recency(none, F.lit("legal")).alias("r"), similarity.recency(F.lit(-3.0), F.lit("legal")).alias("young"), similarity.recency(F.lit(1825.0), F.lit("legal")).alias("half"), similarity.temporal(none).alias("t")).first()
    assert (r.r, r.young, round(r.half, 9), r.t) == (0.5, 1.0, 0.5, 0.5)
