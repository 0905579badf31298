import random
import re

import numpy as np
import pytest
import xxhash
from cases import ODD, corpus

from lectern.llm import simhash_dedup as S

WORD = re.compile("[^\x20\x09-\x0d]+")


def fingerprint(text, n=3):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [w[i : i + n] for i in range(len(w) - n + 1)] if len(w) >= n else [w] * bool(w)
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=2):
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted([(d, f"{p:016x}", None if d is None else least[find(i)]) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))], key=str)


def near_copies(seed, count, words=300):
    rng = random.Random(seed)
    base = [f"v{rng.randint(0, 900)}" for _ in range(words)]
    out = []
    for _ in range(count):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(words)] = f"w{rng.random():.6f}"
        out.append(" ".join(own))
    return out


def test_same_as_brute_force(spark):
    rows = corpus(4) + list(enumerate(near_copies(1, 90), 500)) + [(800, "A B\tC  d"), (801, "a b c d"), (802, "a b c d a b c d"), (-3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as print", "2 as mask", "3 as `odd.name`")
    got = sorted((tuple(r) for r in S.near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)


def test_crowded_buckets_are_split_again(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 8)
    rows = list(enumerate(near_copies(2, 160), 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in S.near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 7])
def test_bit_sliced_pairs(radius):
    rng = np.random.default_rng(radius)
    centers = rng.integers(0, 2**63, 30).astype(np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (700, 3)).astype(np.uint64), axis=1)
    prints = centers[rng.integers(0, 30, 700)] ^ np.where(rng.random(700) < 0.8, flips, np.uint64(0))
    group = np.sort(rng.integers(0, 9, 700))
    got = set(zip(*(x.tolist() for x in S.close_pairs(prints, group, radius)), strict=True))
    want = {(i, j) for i in range(700) for j in range(i + 1, 700) if group[i] == group[j] and int(prints[i] ^ prints[j]).bit_count() <= radius}
    assert got == want


def test_long_text():
    text = ("one two three four " * 40_000 + "x" * 200_000 + " Five").encode()
    got = S.fingerprints(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 3)
    assert int(got[0]) == fingerprint(text.decode())


def test_masks_cover_all_bits():
    for mask in (0, 0xFF00FF):
        got = S.parts(mask, 3)
        assert sum(got) == (1 << 64) - 1 - mask
        assert all(a & b == 0 for a in got for b in got if a is not b)


def test_empty_table_and_odd_texts(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = list(enumerate(ODD))
    got = sorted((tuple(r) for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)
