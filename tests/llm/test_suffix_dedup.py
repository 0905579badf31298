import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from cases import corpus

from lectern.llm import suffix_dedup as D


def brute(rows, hashes, window, passage):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + window] for r in raw for i in range(len(r) - window + 1))
    places = [(d is None, d or 0, hashes[t or ""]) for d, t in rows]
    earliest: dict = {}
    for place, r in zip(places, raw, strict=True):
        for i in range(len(r) - passage + 1):
            s = r[i : i + passage]
            earliest[s] = min(earliest.get(s, (*place, i)), (*place, i))
    out = []
    for (doc, _), place, r in zip(rows, places, raw, strict=True):
        gone, late = [False] * len(r), [False] * len(r)
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        for i in range(len(r) - passage + 1):
            if earliest[r[i : i + passage]] < (*place, i):
                late[i : i + passage] = [True] * passage
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((doc, len(r), sum(gone), spans, sum(late), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [3, 20_000])
def test_same_as_brute_force(spark, hot):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as th", "2 as key", "3 as parts")
    hashes = {r.t: r.h for r in docs.selectExpr("coalesce(text, '') as t", "xxhash64(coalesce(text, '')) as h").collect()}
    got = D.strip_repeated_bytes(docs, window=40, passage=25, unit=8, hot=hot).drop("removed").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, hashes, 40, 25)


def test_arrays_decide_copies():
    # two equal segments and one that differs in its last byte, after the shorter string
    rng = random.Random(3)
    one = bytes(rng.choice(b"abcdefgh") for _ in range(40))
    (again, lead), (more, earliest) = D.repeated_windows([one, one, one[:-1] + b"!"], np.array([2, 2, 2]), np.array([6, 6, 6]), 39, 25, 8)
    assert again[:, :2].tolist() == [[True, True], [True, True], [True, False]]
    assert more[:, :2].all() and earliest[0, :2].all() and not earliest[1:, :2].any()
    assert lead[0, :2].all() and not lead[1].any() and lead[2].tolist()[1]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert D.strip_repeated_bytes(docs).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = random.Random(1)
    strings = [[rng.randint(0, 2) for _ in range(rng.randint(1, 30))] for _ in range(40)] + [[1] * 20, [1] * 20]
    symbols = np.array([x for s in strings for x in s])
    ends = np.cumsum([len(s) for s in strings])
    starts = ends - [len(s) for s in strings]
    sa, slots = D.suffix_array(symbols, np.repeat(ends, ends - starts))
    suffix = {int(p): tuple(symbols[p:e]) for a, e in zip(starts, ends, strict=True) for p in range(a, e)}
    assert [suffix[int(p)] for p in sa] == sorted(suffix.values())
    lcp = D.kasai(symbols, starts, ends, sa, slots)
    for k in range(1, len(sa)):
        a, b = suffix[int(sa[k - 1])], suffix[int(sa[k])]
        assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
