"""Claims from text to verdict, on sentences whose outcome is plain to a reader."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import claims as C
from lectern.operators import numbers as N

EVIDENCE = "ev long, claim_id long, statement string, source string, tier int, derived boolean, restating boolean, strength string, published_at int"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("rose 12,5 % to 1.2 billion", [("percentage", 12.5, False), ("count", 1.2e9, False)]),
        ("by 3 percentage points in 2024", [("percentage_point", 3.0, False)]),
        ("US$ 1,200 million and 5 EUR", [("money", 1.2e9, True), ("money", 5.0, False)]),
        ("1.234.567 people, 1,234.5 tons", [("count", 1234567.0, False), ("count", 1234.5, False)]),
        ("host 1.2.3.4", [("count", 0.0, True)]),
        ("", []),
        (None, None),
    ],
)
def test_claim_numbers(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(N.claim_numbers(F.col("t")).alias("n")).first().n
    assert (r if r is None else [tuple(x) for x in r]) == want


def test_quantities_skip_identifiers(spark):
    t = "Article 12 of 1998: it grew 3.5 % within 2 years, file 12-34, to 7 or 0.25"
    r = spark.createDataFrame([(t,)], "t string").select(N.quantities(F.col("t")).alias("q")).first().q
    assert [tuple(x) for x in r] == [("calendar_year", 1998.0), ("percentage", 3.5), ("duration", 2.0), ("count", 7.0), ("ratio", 0.25)]


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("The ministry reported 40 accidents.", "fact"), ("The tax will raise prices over the next year.", "forecast"), ("I think the plan is terrible.", "opinion"), ("The council should repeal the levy.", "normative"), ("This suggests the law implies a ban because of costs.", "interpretation"),
        ("", "fact"), (None, "fact"),
    ],
)
def test_kinds(spark, text, kind):
    assert C.classify(spark.createDataFrame([(1, text)], "claim_id long, text string")).first().kind == kind


def test_assumptions_and_horizon(spark):
    t = "If growth holds, exports will rise over the next five years, assuming that demand stays."
    r = C.classify(spark.createDataFrame([(1, t)], "claim_id long, text string")).first()
    assert r.horizon == "medium_term" and r.falsifiable
    assert r.assumptions == ["if growth holds", "assuming that demand stays", "implied:implementation", "implied:external_condition", "implied:macroeconomic", "implied:behavioural"]


def _one(spark, text, *items, made_at=5):
    claims = spark.createDataFrame([(1, text, made_at)], "claim_id long, text string, made_at int")
    rows = [(k, 1, s, f"src{k}" if len(more) < 1 else more[0], 1, False, False, "high", 3) for k, (s, *more) in enumerate(items)]
    return C.evaluate(claims, spark.createDataFrame(rows, EVIDENCE)).first()


def test_supported_claim(spark):
    r = _one(spark, "Unemployment measured in 2020 reached 8 percent of workers.", ("unemployment measured in 2020 reached 8 percent of workers overall",), ("office: unemployment reached 8 percent of workers in 2020, measured monthly",))
    assert (r.direct_textual_evidence, r.quantity_recheck, r.independent_corroboration, r.verdict) == ("pass", "pass", "pass", "supported")


def test_arithmetic_of_the_claim_itself(spark):
    same = ("exports grew from 100 to 150, an increase of 50 percent since 2010",)
    good = _one(spark, "Exports grew from 100 to 150, an increase of 50 percent since 2010.", same, same)
    wrong = _one(spark, "Exports grew from 100 to 150, an increase of 80 percent since 2010.", same, same)
    down = _one(spark, "Exports went from 100 to 150, a decline of 50 percent since 2010.", same, same)
    assert (good.quantity_recheck, wrong.quantity_recheck, down.quantity_recheck) == ("pass", "fail", "fail")
    assert wrong.verdict in ("unsupported", "contradicted")


def test_contradiction_needs_more_weight(spark):
    text = "The bridge budget covers safety inspections every winter."
    against = ("the bridge budget never covers safety inspections every winter",)
    assert _one(spark, text, against).verdict == "contradicted"
    assert _one(spark, text, against, ("the bridge budget covers safety inspections every winter",)).contradiction == "pass"


def test_no_evidence_and_repeated_source(spark):
    text = "The harbour authority published minutes for every meeting."
    empty = _one(spark, text)
    assert (empty.n, empty.direct_textual_evidence, empty.contradiction, empty.verdict) == (0, "fail", "na", "unverifiable")
    twice = _one(spark, text, ("the harbour authority published minutes for every meeting", "same"), ("harbour authority published minutes for every meeting", "same"))
    assert (twice.independent, twice.independent_corroboration) == (1, "fail")


def test_rhetoric_and_guard(spark):
    claims = spark.createDataFrame([(1, "Experts agree this is the only way before it is too late.", None), (2, "Rain fell.", None)], "claim_id long, text string, made_at int")
    e = C.evaluate(claims, spark.createDataFrame([], EVIDENCE))
    r = {x.claim_id: x.patterns for x in C.rhetoric(e).collect()}
    assert r == {1: ["appeal_to_authority", "false_dilemma", "urgency"], 2: ["none_detected"]}
    assert C.changed_verdicts(e, C.rhetoric(e)).count() == 0
    assert C.changed_verdicts(e, e.withColumn("verdict", F.lit("supported"))).count() == 2


def test_blind_claims_leak_nothing(spark):
    claims = spark.createDataFrame([(1, "Mr. Vega's levy raised 40 million.", 1), (2, "Did Vega say so?", 1)], "claim_id long, text string, made_at int")
    evidence = spark.createDataFrame([(1, 1, "VEGA signed the levy", "Gazette", 1, False, False, "high", 3)], EVIDENCE)
    c, e, leaks = C.blind(claims, evidence, ["Vega"], F.contains("text", F.lit("?")))
    assert {r.claim_id: r.text for r in c.collect()} == {1: "[ACTOR] levy raised 40 million.", 2: "Did Vega say so?"}
    assert e.first().statement == "[ACTOR] signed the levy" and e.first().source != "Gazette" and leaks.count() == 0
