import itertools
import re
from math import factorial

import numpy as np
import pytest
from cases import ODD, corpus

from lectern.llm import filter_audit as A

WORD = re.compile("[^\x20\x09-\x0d]+")


def fails(rows):
    """The set of letters that each row fails."""
    out = []
    for d, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        copy = d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in rows)
        checks = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), copy]
        out.append({x for x, bad in zip("ABCDE", checks, strict=True) if bad})
    return out


def brute(rows, labels):
    good, toxic = ({d for d, *own in labels if own[k] == 1} for k in (0, 1))
    docs = [(s or "", f, d in good, d in toxic) for (d, _, s), f in zip(rows, fails(rows), strict=True)]
    out = []
    for part in {p for p, *_ in docs}:
        here = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = here
            for k, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                again = sum(x in d[1] for d in here) - len(gone)
                shapley[x] += len(gone)
                steps.append((x, [part, "".join(order), k, len(left), len(gone), again, sum(d[1] == {x} for d in here), sum(d[2] for d in gone), sum(d[3] for d in gone)]))
        out += [(*row, shapley[x]) for x, row in steps]
    return sorted(out)


def test_same_as_brute_force(spark):
    texts = corpus(6, 90) + [(400, "SHOUT " * 60), (401, "one two " * 40 + "#"), (402, " ".join(map(str, range(70)))), (403, " ".join(map(str, range(70)))), (404, "x" * 300_000)]
    rows = [(d, t, [None, "", "web", "b|k"][k % 4]) for k, (d, t) in enumerate(texts)]
    labels = [(d, k % 3 if k % 3 < 2 else None, (k // 2) % 2) for k, (d, _, _) in enumerate(rows)] + [(7, 1, 1), (7, 0, 0), (10_000, 1, 1), (402, 1, 0), (403, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as part", "2 as mask", "'x' as good", "3 as `odd.name`")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'y' as text")
    got = A.audit_documents(docs, known)
    assert got.columns == ["part", "filter_order", "step", *A.COUNTS]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, [x for x in labels if x[0] is not None])


def test_odd_texts_and_empty_tables(spark):
    rows = [(k, t, "s") for k, t in enumerate(ODD + ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(tuple(r) for r in A.audit_documents(docs, none).collect()) == brute(rows, [])
    assert A.audit_documents(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("k", [1, 2, 3, 5, 6])
def test_walk_swaps_neighbours_through_all_orders(k):
    order, seen = list(range(k)), {tuple(range(k))}
    for i in A.neighbour_swaps(k):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.add(tuple(order))
    assert len(seen) == factorial(k) == 1 + sum(1 for _ in A.neighbour_swaps(k))


def test_only_two_steps_are_computed_for_an_order():
    cells = np.random.default_rng(3).integers(0, 50, (3, 4, 32))
    orders, counts = A.walk(cells, 5)
    for before, after, one, two in zip(orders, orders[1:], counts, counts[1:]):
        moved = [i for i in range(5) if before[i] != after[i]]
        assert len(moved) == 2 and moved[1] == moved[0] + 1
        rest = [i for i in range(5) if i not in moved]
        assert (one[rest][:, :6] == two[rest][:, :6]).all()
    removed = counts[:, :, 1].sum(axis=1)
    assert (removed == (cells[0].sum(axis=1) - cells[0][:, 0])).all()


def test_letters_are_checked(spark):
    failed = spark.createDataFrame([], "part string, mask int, good boolean, toxic boolean")
    for letters in ("", "AA", "ABCDEFGHI"):
        with pytest.raises(ValueError):
            A.interaction_audit(failed, letters)
