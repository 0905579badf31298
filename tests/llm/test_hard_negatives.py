import math
import random

import numpy as np
import pytest

from lectern.llm import hard_negatives as H


def brute(rows, every=7, positives=5, negatives=10):
    """rows: (vec_id, vector, label)."""
    usable = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, va, ya in usable:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, y) for i, v, y in usable if i != a)
        for s, p, _ in [x for x in scored if x[2] == ya][:positives]:
            fit = [(n, i) for n, i, y in scored if y != ya and 30 * -s <= 100 * -n <= 90 * -s][:negatives]
            out += [(a, p, k, i, -s, -n) for k, (n, i) in enumerate(fit, 1)]
    return sorted(out)


def vectors(seed, n, dim=12, labels=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [x + rng.gauss(0, 0.5) for x in c] if i % 5 else list(c), rng.randrange(labels) if i % 3 else 0))
    return rows


ODD = [
    (7_000, None, 1), (7_007, [0.0] * 12, None), (None, [1.0] * 12, 1), (7_014, [float("nan")] + [0.0] * 11, 1), (7_021, [None] + [0.0] * 11, 1),
    (7_028, [float("inf")] + [0.0] * 11, 1), (7_035, [], 1), (7_042, [1.0, 2.0], 1), (7_049, [0.5] * 20, 2), (-7, [0.25] * 12, 3), (7_056, [1.0] * 12, -4),
]


def found(spark, rows, **how):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as part", "2 as w", "3 as `odd.name`")
    out = H.mine(H.usable(table), 7, **how)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def test_same_as_brute_force(spark):
    rows = vectors(1, 400) + ODD
    assert found(spark, rows) == brute(rows)


def test_many_parts_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "PART", 40)
    monkeypatch.setattr(H, "ANCHORS", 20)
    monkeypatch.setattr(H, "PILOT", 3)
    rows = vectors(2, 500) + ODD
    assert found(spark, rows) == brute(rows)


def test_one_vector_and_one_label_everywhere(spark):
    rows = [(i, [1.0, 0.5], 1) for i in range(60)]
    assert found(spark, rows) == []
    rows += [(100 + i, [0.5, 0.5], 2) for i in range(30)]
    assert found(spark, rows) == brute(rows) != []


def test_scores_beyond_a_double(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, 1]) * rng.uniform(1e6, 3e6) for _ in range(3)], i % 3) for i in range(90)]
    assert found(spark, rows) == brute(rows)
    assert max(r[4] for r in brute(rows)) > 2**58
    held = found(spark, [(i, [1e30 + i], i % 2) for i in range(20)])  # beyond a long
    assert held == [] and found(spark, [(i, [1e30 if i < 15 else 1e-25], i % 2) for i in range(20)]) == []


def test_repeated_rows_count_one_by_one(spark):
    rows = vectors(5, 60)
    more = rows + [r for r in rows if r[0] % 7]
    want = brute(more)
    assert found(spark, more) == want


def test_empty_table(spark):
    assert found(spark, []) == [] and found(spark, ODD[:1]) == []


@pytest.mark.parametrize("same", [True, False])
def test_nodes_bound_their_products_and_prune(same):
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 40, (8, 16)).round()
    own = rng.integers(0, 8, 2000)
    vec = centres[own] + rng.normal(0, 3, (2000, 16)).round()
    label = own % 3
    a, c = H.build_tree(vec[:200], label[:200], 16), H.build_tree(vec, label, 64)
    least, most = H.intervals(a, c)
    for i in range(len(a.lo)):
        for j in range(len(c.lo)):
            p = vec[:200][a.order[a.lo[i] : a.hi[i]]] @ vec[c.order[c.lo[j] : c.hi[j]]].T
            assert least[i, j] <= p.min() and p.max() <= most[i, j]
    windows = H.Windows(np.arange(200), np.zeros(200, np.int64), np.full(200, -H.LONGEST), np.full(200, H.LONGEST), 5)
    scored, pairs = H.dual_search(vec[:200], label[:200], np.arange(200), vec, label, np.arange(2000), windows, same)
    assert scored < pairs / 2


def test_shares_round_inwards(spark):
    scores = [0, 1, 9, 10, 11, -1, -9, -10, 101, 2**63 - 1, -(2**63) + 1]
    got = spark.createDataFrame([(x,) for x in scores], "s long").select("s", H.share("s", 30, 100, H.F.ceil).alias("lo"), H.share("s", 90, 100, H.F.floor).alias("hi")).collect()
    assert [(r.lo, r.hi) for r in got] == [(-(-30 * s // 100), 90 * s // 100) for s in scores]
