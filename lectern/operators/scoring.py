"""Scores with their parts: evidence ranking, claims, impact, framing, neutrality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.arrays import rounded

# Weights of the six ranking components, and what incapable and restating evidence keeps.
RANK_WEIGHTS = {"affinity": 30.0, "topical": 22.0, "specificity": 12.0, "quantitative": 10.0, "recency": 10.0, "corroboration": 16.0}
INCAPABLE, RESTATING = 0.2, 0.65
STRENGTH = {"high": 1.0, "medium": 0.65, "low": 0.35, "insufficient": 0.1}
# The ten checks of a claim, in order.
CHECKS = (
    "direct_textual_evidence", "quantity_recheck", "data_consistency", "logical_validity", "causal_support", "context_completeness", "temporal_correctness",
    "independent_corroboration", "uncertainty_handling", "contradiction",
)


def specificity(n_figures: Column, n_scope: Column, n_words: Column) -> Column:
    return 0.4 * F.least(n_figures / 8, F.lit(1.0)) + 0.25 * F.least(n_scope, F.lit(1)) + 0.35 * F.least(n_words / 120, F.lit(1.0))


def rank_evidence(views: DataFrame, group: str, parts: dict[str, Column], incapable: Column, restating: Column, tie: str) -> DataFrame:
    """Weighted score out of 100; a component that is null doesn't apply, and its weight goes to the others."""
    weight = reduce(lambda a, b: a + b, [F.when(parts[k].isNotNull(), F.lit(w)).otherwise(0.0) for k, w in RANK_WEIGHTS.items()])
    # affinities are decimals: 30 * 0.03 is 0.9
    weighted = {k: F.round(parts[k] * w, 9) if k == "affinity" else parts[k] * w for k, w in RANK_WEIGHTS.items()}
    points = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in weighted.values()])
    score = points * 100 / F.when(weight > 0, weight).otherwise(1.0) * F.when(incapable, INCAPABLE).otherwise(1.0) * F.when(restating, RESTATING).otherwise(1.0)
    out = views.withColumn("score", rounded(score, 4)).where(~((parts["topical"] < 0.02) & (parts["affinity"] < 0.3)))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), tie)).cast("long"))


def evidence_strength(best: Column, capable: Column, sources: Column) -> Column:
    return F.when((best >= 55) & capable & (sources >= 2), "high").when((best >= 35) & (sources >= 1), "medium").when(best >= 20, "low").otherwise("insufficient")


def strength_by_group(ranked: DataFrame, group: str) -> DataFrame:
    """Strength and confidence of each group's ranked evidence, from its best item and its sources."""
    b = ranked.groupBy(group).agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best"), F.bool_or((F.col("rank") == 1) & ~F.col("incapable")).alias("capable"), F.countDistinct("source").alias("sources"))
    return b.select(group, evidence_strength(F.col("best"), F.col("capable"), F.col("sources")).alias("strength"), F.round(F.least(F.lit(0.9), 0.3 + 0.25 * F.col("sources")), 3).alias("confidence"))


def without_identity(evidence: DataFrame, *columns: str) -> DataFrame:
    """The view that scoring may see: identities as hashes."""
    return evidence.withColumns({c: F.sha2(F.col(c).cast("string"), 256) for c in columns})


def same_order(ranked: DataFrame, again: DataFrame, group: str, id_col: str) -> DataFrame:
    """Each group's order of ids, and whether a second ranking has the same."""
    ids = lambda df: df.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", id_col))), lambda x: x[id_col].cast("string")), ",").alias("o"))
    a, b = ids(ranked).withColumnRenamed("o", "order_plain"), ids(again)
    return a.join(b, group).select(group, "order_plain", (F.col("order_plain") == F.col("o")).alias("invariant"))


def evidential_weight(strength: Column, relevance: Column, coverage: Column, derived: Column, restating: Column) -> Column:
    s = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STRENGTH.items() for x in kv]), strength), F.lit(STRENGTH["medium"]))
    return F.round(s * (0.35 + 0.4 * relevance + 0.25 * coverage) * F.when(derived, 0.6).when(restating, 0.7).otherwise(1.0), 4)


def verdict(kind: Column, outcome: dict[str, Column], n_evidence: Column) -> Column:
    """First rule that holds; outcomes are pass, fail or na."""
    is_ = lambda c, v: outcome[c] == v
    core = ("direct_textual_evidence", "quantity_recheck", "data_consistency", "logical_validity")
    failed = reduce(lambda a, b: a + b, [is_(c, "fail").cast("int") for c in core])
    other = reduce(lambda a, b: a | b, [is_(c, "fail") for c in CHECKS if c not in core and c != "contradiction"])
    nothing = reduce(lambda a, b: a & b, [outcome[c] == "na" for c in CHECKS])
    return (
        F.when(kind.isin("opinion", "normative"), "not_a_factual_claim")
        .when(kind == "forecast", "forecast_conditional")
        .when(is_("contradiction", "fail"), "contradicted")
        .when((n_evidence == 0) | nothing, "unverifiable")
        .when(is_("direct_textual_evidence", "fail") & ~is_("independent_corroboration", "pass") & ~is_("quantity_recheck", "fail"), "unverifiable")
        .when(is_("quantity_recheck", "fail") | (failed >= 2), "unsupported")
        .when((failed == 1) | other, "partially_supported")
        .otherwise("supported")
    )


def claim_confidence(deltas: list[tuple[str, Column]], independent: Column) -> tuple[Column, Column]:
    """Confidence from a base of 0.35, under a ceiling set by independent sources; and the part that limits it most."""
    raw = reduce(lambda a, b: a + b, [d for _, d in deltas], F.lit(0.35))
    ceiling = 0.35 + 0.15 * F.least(independent, F.lit(4))
    limiting = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(n).alias("n")) for n, d in deltas])).n
    return F.round(F.least(F.lit(0.97), F.greatest(F.lit(0.02), F.least(raw, ceiling))), 4), limiting


def apportion(df: DataFrame, group: list[str], weight: str, score: Column, key: str, out: str, places: int = 3) -> DataFrame:
    """Shares of a score by weight; what rounding leaves goes to the heaviest."""
    own = Window.partitionBy(*group)
    first = F.row_number().over(own.orderBy(F.desc(F.abs(F.col(weight))), key)) == 1
    share = F.round(score * F.col(weight) / F.sum(weight).over(own), places)
    df = df.withColumn("__share", share)
    return df.withColumn(out, F.when(first, F.round(F.col("__share") + score - F.sum("__share").over(own), places)).otherwise(F.col("__share"))).drop("__share")


# Axis, sign, base weight and the mechanism that a provision must have.
AXIS_RULES = [
    ("economic", "stimulus", 1, 14.0, "1-URGENT"), ("economic", "burden", -1, 10.0, "5-LOW"), ("fiscal", "outlay", -1, 12.0, "2-HIGH"), ("fiscal", "saving", 1, 9.0, "4-NOT SPECIFIED"),
    ("social", "benefit", 1, 8.0, "3-MEDIUM"), ("legal", "duty", -1, 6.0, "2-HIGH"),
]
AXES = ("economic", "social", "fiscal", "legal", "environmental", "institutional", "regional")


def impact_points(provisions: DataFrame, rules: DataFrame, scale: Column, corroborated: Column) -> DataFrame:
    """A row per rule that a provision meets: sign times base times (1 + 0.4 scale), a fifth more if corroborated."""
    points = F.col("sign") * F.col("base") * (1 + 0.4 * scale) * F.when(corroborated, 1.2).otherwise(1.0)
    return provisions.join(F.broadcast(rules), "mechanism").withColumn("points", points)


def axis_scores(points: DataFrame, documents: DataFrame, axes: DataFrame) -> DataFrame:
    """Clamped rounded sums for every document and axis, with a flag for axes that nothing touched."""
    total = points.groupBy("document", "axis").agg(F.sum("points").alias("raw"), F.count("*").alias("n_parts"))
    grid = documents.crossJoin(F.broadcast(axes))
    raw = F.coalesce("raw", F.lit(0.0))
    return grid.join(total, ["document", "axis"], "left").select("document", "axis", F.greatest(F.lit(-100), F.least(F.lit(100), F.round(raw / 10))).cast("int").alias("score"), F.coalesce("n_parts", F.lit(0)).cast("long").alias("n_parts"), F.col("raw").isNull().alias("unengaged"))


# Families of substitutions.
FAMILIES = ("speaker_swap", "source_swap", "party_swap", "authority_removal", "paraphrase", "evidence_order")


def perturbation_rollup(runs: DataFrame, families: DataFrame, examples: int = 3) -> DataFrame:
    """Applied runs, flips and rate per family, families without runs too; examples list flips first."""
    order = F.row_number().over(Window.partitionBy("family").orderBy(F.desc("flipped"), "run"))
    top = runs.where("applied").withColumn("k", order).where(F.col("k") <= examples).groupBy("family").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "run"))), lambda x: x.run.cast("string")), ",").alias("examples"))
    n = runs.groupBy("family").agg(F.count_if(F.col("applied")).alias("runs"), F.count_if(F.col("applied") & F.col("flipped")).alias("flips"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return families.join(n, "family", "left").join(top, "family", "left").select("family", zero("runs").alias("runs"), zero("flips").alias("flips"), F.when(F.col("runs") > 0, F.round(F.col("flips") / F.col("runs"), 6)).alias("flip_rate"), F.coalesce("examples", F.lit("")).alias("examples"))


def neutrality_metrics(runs: DataFrame, group: list[str]) -> DataFrame:
    """Means of absolute changes over applied runs; an unknown framing change is left out."""
    clamp = lambda c, hi: F.round(F.least(F.lit(float(hi)), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0)))), 6)
    a = runs.where("applied").groupBy(*group).agg(
        F.count("*").alias("n"), F.avg(F.col("flipped").cast("double")).alias("f"), F.avg(F.abs("confidence_delta")).alias("c"), F.avg(F.abs("framing_delta")).alias("fr"), F.avg("explanation_delta").alias("e")
    )
    return a.select(*group, "n", clamp(F.col("f"), 1).alias("flip_rate"), clamp(F.col("c"), 1).alias("confidence_delta"), clamp(F.col("fr"), 100).alias("framing_delta"), clamp(F.col("e"), 1).alias("explanation_delta"))


def health(f: Column, c: Column, fr: Column, e: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(100 - 55 * f - 20 * c - 15 * (fr / 100) - 10 * e, 100 * (1 - f))), 4)


def publish_reasons(f: Column, c: Column, runs: Column, claims: Column, untested: Column) -> Column:
    """What stands against publishing; none if it may."""
    rules = [(f > 0.05, "flip_rate"), (c > 0.15, "confidence_delta"), (runs < 12, "runs"), (claims < 3, "claims"), (untested > 0, "families")]
    return F.array_compact(F.array(*[F.when(bad, name) for bad, name in rules]))


def mean_of_known(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean over the parts that are there; null without any."""
    weight = reduce(lambda a, b: a + b, [F.when(p.isNotNull(), F.lit(w)).otherwise(0.0) for p, w in parts])
    total = reduce(lambda a, b: a + b, [F.coalesce(p * F.lit(w), F.lit(0.0)) for p, w in parts])
    return F.when(weight > 0, total / weight)


def certainty_inflation(pairs: DataFrame, group: str) -> DataFrame:
    """Mean excess over the best source's certainty, of the sentences that exceed it; hedged ones don't dilute it."""
    excess = F.greatest(F.col("stated") - F.col("sourced"), F.lit(0.0))
    return pairs.groupBy(group).agg(F.coalesce(F.round(F.sum(F.when(excess > 0, excess * F.col("weight"))) / F.sum(F.when(excess > 0, F.col("weight"))), 6), F.lit(0.0)).alias("inflation"))
