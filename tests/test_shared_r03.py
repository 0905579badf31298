"""What articles share: elements of one set go no further than their count, texts are searched only where a sign stands."""

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import tokens as G
from lectern.operators import independence as I
from lectern.operators.extract import CREDITS, wire_agency
from lectern.operators.graph import cut_lineage
from lectern.operators.setlinks import set_classes, shared_elements


def test_only_shared_elements_go_on_with_their_place(spark):
    sets = spark.createDataFrame([(1, [10, 11, 12, 90]), (2, [20, 90, 91]), (3, [90, 91])], "id long, s array<long>")
    got = {(r.id, r.h): (r.n, r.b, r.k) for r in shared_elements(sets, "id").collect()}
    assert got == {(1, 90): (4, 3, 4), (2, 91): (3, 2, 2), (2, 90): (3, 3, 3), (3, 91): (2, 2, 1), (3, 90): (2, 3, 2)}


def test_pairs_that_can_share_too_little_are_not_met(spark):
    common = list(range(8))
    # the small set shares its rarest element with a large one, and could share no more than that
    sets = [(1, [100, *common]), (2, [100]), (3, [100, *range(200, 206)]), (4, [300, *common]), (5, [300, *range(400, 440)])]
    met = {(r.l, r.r) for r in I.candidate_pairs(spark.createDataFrame(sets, "id long, s array<long>")).collect()}
    assert {(1, 2), (2, 3), (1, 4)} <= met
    assert (1, 3) not in met and (4, 5) not in met


def test_sets_of_one_class_are_equal_in_any_order(spark):
    sets = spark.createDataFrame([(1, [3, 1, 2]), (2, [2, 3, 1]), (3, [1, 2]), (4, []), (5, [])], "id long, s array<long>")
    assert {r.id: r.rep for r in set_classes(sets).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_signs_spare_no_credit(spark):
    rows = [(c, f"Prices rose.  {w.replace(' ', chr(10))}\t Coastal Desk. More.") for c in CREDITS for w in (c, c.upper() if c.isascii() else c.capitalize())]
    rows += [("desk", "Budget – AGENCIA Norte. "), ("dateline", "Lima, 4 May (Harbour Wire) x"), ("bracket", "(Harbour Wire) - x"), ("none", "said the house")]
    df = spark.createDataFrame(rows, "c string, text string").withColumn("plain", T.normalise(F.col("text")))
    for r in df.select("c", wire_agency(F.col("text")).alias("a"), wire_agency(F.col("text"), F.col("plain")).alias("b")).collect():
        assert r.a == r.b and (r.a is None) == (r.c == "none"), r


def test_white_space_and_shingles_as_before(spark):
    odd = ["a  b", " a\tb \n\n c ", "a\x0b\fb", "a b", "", "\n", "a \r\n b  ", "x\x1cy"]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    assert all(r.a == r.b for r in df.select(T.collapse(F.col("t")).alias("a"), F.trim(F.regexp_replace("t", r"\s+", " ")).alias("b")).collect())
    words = spark.createDataFrame([(["a", "b", "a", "b", "a", "b", "a"],), (["a", "b"],), ([],)], "w array<string>")
    for r in words.select(G.shingle_hashes(F.col("w"), 5).alias("a"), F.transform(G.shingles(F.col("w"), 5), lambda s: F.xxhash64(s)).alias("b")).collect():
        assert r.a == r.b


def test_elements_of_one_set_are_dealt_once_and_then_left(spark):
    """One exchange of the elements serves their counts and the rows; only shared ones reach the sets' places."""
    sets = spark.createDataFrame([(k, [k * 100 + i for i in range(50)] + [7]) for k in range(1, 41)], "id long, s array<long>")
    found = shared_elements(cut_lineage(sets), "id")
    assert found.count() == 40
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan, plan


def test_signals_of_copies_and_of_slim_sets(spark):
    words = [f"w{i}" for i in range(60)]
    near = [*words[:55], "x1", "x2", "x3", "x4", "x5"]
    rows = [(1, "p", 0, " ".join(words)), (2, "q", 1, " ".join(words)), (3, "r", 2, " ".join(near)), (4, "s", 3, " ".join(reversed(words)))]
    got = {(r.l, r.r): round(r.jaccard, 6) for r in I.pair_signals(spark.createDataFrame(rows, "id long, publisher string, published_min int, text string")).collect()}
    # 56 shingles each, 51 of them shared
    assert got == {(1, 2): 1.0, (1, 3): round(51 / 61, 6)}
