"""The automaton and what stands on it, against plain searches."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import framing, lexicon, matcher, propositions, segment


def _plain(text, patterns, bounded):
    out = set()
    for p in patterns:
        for m in re.finditer(f"(?={re.escape(p)})", text):
            s, e = m.start(), m.start() + len(p)
            if not bounded or not (s and re.match(r"\w", text[s - 1]) or e < len(text) and re.match(r"\w", text[e])):
                out.add((p, s, e))
    return out


@pytest.mark.parametrize("bounded", [False, True])
def test_all_occurrences(spark, bounded):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab é.-") for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(90, None), (91, "")]
    patterns = list({"".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) for _ in range(25)}) + ["a b", "a.b", ""]
    docs = spark.createDataFrame(rows, "id long, t string").withColumn("start", F.lit(1))
    table = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    found = matcher.matches(docs.drop("start").withColumn("odd.name", F.lit(2)), "t", table, bounded)
    assert found.columns == ["id", "odd.name", "pattern", "start", "end"]
    got = {(r.id, r.pattern, r.start, r.end) for r in found.collect()}
    assert got == {(i, *x) for i, t in rows for x in _plain(t or "", [p for p in patterns if p], bounded)}
    first = {(r.id, r.pattern): r.start for r in matcher.matches(docs.select("id", "t"), "t", table, bounded, "first").collect()}
    assert first == {(i, p): min(s for j, q, s, _ in got if (j, q) == (i, p)) for i, p, _, _ in got}


def test_tiles_take_their_characters(spark):
    docs = spark.createDataFrame([(1, "cash grab grab cash")], "id long, t string")
    table = spark.createDataFrame([("grab",), ("cash grab",), ("cash",), ("cash",)], "pattern string")
    got = [(r.pattern, r.start, r.end) for r in matcher.matches(docs, "t", table, True, "tiles").orderBy("start").collect()]
    assert got == [("cash grab", 0, 9), ("grab", 10, 14), ("cash", 15, 19)]
    with pytest.raises(ValueError):
        matcher.matches(docs, "t", table, keep="some")


def test_many_blocks_of_patterns(spark, monkeypatch):
    monkeypatch.setattr(matcher, "broadcast_blocks", lambda df: [df.where(F.pmod(F.xxhash64("pattern"), F.lit(3)) == k) for k in range(3)])
    table = spark.createDataFrame([(f"w{i}",) for i in range(40)], "pattern string")
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)))], "id long, t string")
    assert matcher.matches(docs, "t", table, bounded=True).count() == 40
    with pytest.raises(ValueError):
        matcher.matches(docs, "t", table, keep="tiles")


def test_redaction_protects_and_survives_odd_names(spark):
    names = spark.createDataFrame([("Ann",), ("Ann Lee",), ("A.B. (North)",), ("Green",), ("C++",)], "pattern string")
    texts = ["Dr. Ann Lee's plan; Annex by ANN", "The Green Paper of Green.", "a.b. (north)! AxB", "Mr Ann, Mann", "C++ and Ms. C++", "İstanbul Ann", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("hits", F.lit("x")).drop("hits")
    got = {r.id: (r.red, r.hits) for r in matcher.redacted(docs, "text", names, "red", ["Green Paper"], ["Dr", "Mr", "Ms"]).collect()}
    want = ["[ACTOR]'s plan; Annex by [ACTOR]", "The Green Paper of [ACTOR].", "[ACTOR]! AxB", "[ACTOR], Mann", "[ACTOR] and [ACTOR]", "İstanbul [ACTOR]", None, ""]
    assert [got[k][0] for k in range(8)] == want and [got[k][1] for k in range(8)] == [2, 1, 1, 1, 2, 1, None, 0]
    assert spark.range(1).select(propositions.redact(F.lit("a C++ (x) b"), ["C++ (x)"]).alias("r")).first().r == "a [ACTOR] b"


def test_leaks_without_accents(spark):
    docs = spark.createDataFrame([(1, "José met Ann", "anna"), (2, "nothing", None)], "id long, a string, b string")
    assert {(r.id, r.field, r.name) for r in propositions.leaks(docs, "id", ["a", "b"], ["Jose", "Ann", "an"]).collect()} == {(1, "a", "Jose"), (1, "a", "Ann")}


def test_search_scores_are_shares_of_the_query(spark):
    docs = spark.createDataFrame([(1, "budget tax"), (2, "budget"), (3, "other words")], "id long, t string")
    queries = spark.createDataFrame([(7, "Budget TAX levy"), (8, "budget")], "q long, t string")
    got = {(r.q, r.id): r.score for r in segment.lexical_search(docs, "id", "t", queries.withColumnRenamed("t", "qt"), "q", "qt").collect()}
    b, t = 1 / (1 + 2 / 3), 1 / (1 + 1 / 3)
    assert got == {(7, 1): round((b + t) / 3, 4), (7, 2): round(b / 3, 4), (8, 1): round(b, 4), (8, 2): round(b, 4)}


def test_loaded_language_weighs_zones_quotations_and_repeats(spark):
    text = 'A historic cash grab\nCritics fear it.\n"It is a brutal raid. All know it." The raid, the raid, the raid and the raid, an éraid too.'
    r = framing.loaded_language(spark.createDataFrame([(1, text), (2, None), (3, "Budget day")], "id long, text string"), "id", "text").collect()
    got = {x.id: x for x in r}
    # headline 1.5; a quoted sentence 0.35; cash grab and raid are one term, whose fourth occurrence and later weigh 0.4
    want = 0.7 * 1.5 + 1.0 * 1.5 + 0.85 * 0.35 + 1.0 * 0.35 + 1.0 + 0.4 * 3
    assert got[1].loaded == pytest.approx(want) and (got[1].n_terms, got[1].n_quoted) == (3, 2)
    assert got[1].rate == pytest.approx(want / got[1].words * 100) and got[1].score == round(100 * (1 - 2 ** (-got[1].rate / 3)))
    assert (got[2].words, got[2].score, got[3].words, got[3].score) == (0, 0, 2, 0)
    assert all(f == f.lower() and f.isascii() and 0 < v <= 1 for f, _, v in lexicon.forms())
