import random
import re

import numpy as np
import pytest
from cases import corpus

from lectern.llm import minhash_dedup as M
from lectern.llm._stages import Stages
from lectern.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, n):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    ids = [d for d, _ in rows]
    root = {d: d for d in ids if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if ids[i] is not None and ids[j] is not None and a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(ids[i]), find(ids[j])
                root[max(x, y)] = min(x, y)
    out = []
    for d, s in zip(ids, sets, strict=True):
        comp = None if d is None else find(d) if s else d
        out.append((d, len(s), comp, d is None or comp == d))
    return sorted(out, key=str)


def family(rng, base, count, lo, hi):
    """Copies of a text with some words changed."""
    out = []
    for _ in range(count):
        w = base.split()
        for _ in range(rng.randint(lo, hi)):
            w[rng.randrange(len(w))] = f"w{rng.random():.6f}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("n", "num"), [(3, 85), (5, 80)])
def test_same_as_brute_force(spark, n, num):
    rng = random.Random(n)
    base = " ".join(f"{rng.choice('abcd')}{rng.randint(0, 60)}" for _ in range(120))
    long = " ".join(f"v{rng.randint(0, 900)}" for _ in range(3000))
    texts = family(rng, base, 120, 0, 4) + family(rng, long, 6, 0, 3) + [base.upper(), long]
    rows = [r for r in corpus(3) if r[0] != 5] + list(enumerate(texts, 500))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as rep", "2 as n_shingles")
    got = M.near_duplicates(docs, shingle=n, num=num).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, n, num, 100)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 1000).astype(np.uint64)
    for share in (0.5, 0.8, 0.95):
        k = int(1000 * 2 * share / (1 + share))
        other = np.concatenate([base[:k], rng.integers(0, 2**63, 1000 - k).astype(np.uint64)])
        a, b = M.signature(base, 400), M.signature(other, 400)
        assert abs((a == b).mean() - k / (2000 - k)) < 0.08


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901)], "a long, b long")
    got = {r.id: r.comp for r in components(links, Stages(spark, "test"), "t").collect()}
    assert got == {**{i: 0 for i in range(201)}, 900: 900, 901: 900}


def test_components_in_any_order(spark):
    shuffled = random.Random(1).sample(range(300), 300)
    for order in (list(range(200, 0, -1)), [*range(2, 130), 1], shuffled):
        links = spark.createDataFrame([*zip(order, order[1:]), (900, 901)], "a long, b long")
        got = {r.id: r.comp for r in components(links, Stages(spark, "test"), "t").collect()}
        assert got == {**dict.fromkeys(order, min(order)), 900: 900, 901: 900}


def test_empty_table(spark):
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
