import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import corpus

from lectern.llm import decontaminate as D

WORD = re.compile("[a-z0-9\x80-\U0010ffff]+")


def bag(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def similarity(a, b):
    weight = lambda s: sum(len(x.encode()) for x in s)
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) * weight(k) for k in keys), sum(max(a[k], b[k]) * weight(k) for k in keys)


def brute(docs, items):
    out = {}
    for d, text in docs:
        w = WORD.findall((text or "").lower())
        for i, t in items:
            q = WORD.findall((t or "").lower())
            if len(q) < 5:
                continue
            best = None
            for s in range(max(1, len(w) - len(q) + 1)):
                low, high = similarity(bag(w[s : s + len(q)]), bag(q))
                if low and 100 * low >= 80 * high:
                    best = max(best or (0, 0), (low / high, -s))
            if best:
                out[d, i] = round(best[0], 9)
    return out


@pytest.mark.parametrize("block", [1 << 20, 600])
def test_same_as_brute_force(spark, block):
    rng = random.Random(8)
    word = lambda: f"{rng.choice('abcdeé')}{rng.randint(0, 99)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 60)))) for i in range(25)] + [(90, "too short"), (91, None), (92, "x x x x x x x x")]
    docs = []
    for k in range(150):
        w = [word() for _ in range(rng.randint(0, 80))]
        q = rng.choice(items[:25])[1].split()
        for _ in range(rng.randint(0, 3)):
            q[rng.randrange(len(q))] = word()
        if k % 4 == 0:
            q = q[: rng.randint(1, len(q))]
        at = rng.randint(0, len(w))
        text = (" ".join(w[:at] + q + w[at:]) if k % 3 else " ".join(w)).upper() + "."
        docs.append((k, text.replace(" ", rng.choice([" ", ", ", "\n"]))))
    docs += [(1000 + (d or 0), t) for d, t in corpus(4, 12)] + [(2000, "x " * 500), (2001, " ".join(items[3][1].split()[:4]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'q' as item_id", "1 as `a.b`")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.mark_contaminated(frame, bench, block_bytes=block).collect()
    assert len(got) == len(docs)
    assert {(r.doc_id, m.item_id): round(m.similarity, 9) for r in got for m in r.matches} == brute(docs, items)


@pytest.mark.parametrize("count", [300, 3000])
def test_index_finds_all_within_radius(count):
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 2**64, count, dtype=np.uint64)
    index = D.HammingIndex(prints, 14, 4)
    for k in range(100):
        q = prints[k] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 18), replace=False)))
        assert index.search(q).tolist() == np.flatnonzero(np.bitwise_count(prints ^ q) <= 14).tolist()


def test_many_blocks_hold_one_table_a_worker(spark):
    """Fifty blocks find what one does; each worker's cache has the items of one block, and broadcasts are gone."""
    rng = random.Random(5)
    items = [(i, " ".join(f"w{rng.randint(0, 9999)}" for _ in range(30))) for i in range(50)]
    docs = [(k, "start " + items[k % 50][1] + " end" if k % 3 else "nothing here at all to see") for k in range(200)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + items[:3], "item_id long, text string")
    assert len(list(D.item_blocks(bench.selectExpr("item_id as id", "text"), 200))) == 50
    found = lambda **k: sorted((r.doc_id, m.item_id, m.start, round(m.similarity, 6)) for r in D.mark_contaminated(frame, bench, **k).collect() for m in r.matches)
    assert found(block_bytes=200) == found() and len(found()) == 133

    def sizes(batches):
        import sys

        held = getattr(sys.modules.get("_lectern_cache"), "entries", {})
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(type(v).__name__ == "Items" for v in held.values())] * b.num_rows, pa.int64())], names=["n"])

    assert max(r.n for r in frame.mapInArrow(sizes, "n long").collect()) <= 1


def test_very_long_text(spark):
    item = " ".join(f"q{k}" for k in range(40))
    long = " ".join(str(k % 7919) for k in range(400_000)) + " " + item
    r = D.mark_contaminated(spark.createDataFrame([(1, long)], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert [(m.item_id, m.start) for m in r.matches] == [(7, 400_000)]


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.mark_contaminated(docs, bench).count() == 0
    one = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert [r.matches for r in D.mark_contaminated(one, bench).collect()] == [[]]
