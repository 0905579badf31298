"""Plans, comparisons and reports: perturbation runs, confidence, readiness, axis confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators import scoring as S

# Samples from which a neutrality report is worth full confidence, and the price of an untested family.
FULL_RUNS, FULL_CLAIMS, MISSING_FAMILY = 120, 20, 0.12
CLAIM_PART, RUN_PART = 0.65, 0.35


def perturbation_plan(claims: DataFrame, id_col: str, families: tuple[str, ...] = S.FAMILIES, variants: int = 2, pool: int = 5) -> DataFrame:
    """Every family times every variant for each claim, in fixed order, with the alternative that a hash of claim, family and variant picks."""
    grid = F.array(*[F.struct(F.lit(k).alias("no"), F.lit(f).alias("family"), F.lit(v).alias("variant")) for k, (f, v) in enumerate((f, v) for f in families for v in range(variants))])
    g = claims.select(id_col, F.explode(grid).alias("g")).select(id_col, "g.no", "g.family", "g.variant")
    key = F.concat_ws(":", F.col(id_col).cast("string"), "family", F.col("variant").cast("string"))
    return g.withColumn("pick", F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long"), F.lit(pool)))


def compare_runs(baseline: DataFrame, perturbed: DataFrame) -> DataFrame:
    """Perturbed runs (claim_id, family, variant, verdict, confidence, applied) against their claim's baseline (claim_id, verdict, confidence)."""
    b = baseline.select("claim_id", F.col("verdict").alias("base"), F.col("confidence").alias("base_confidence"))
    r = perturbed.where("applied").join(b, "claim_id")
    return r.select("claim_id", "family", "variant", (F.col("verdict") != F.col("base")).alias("flipped"), F.round(F.col("confidence") - F.col("base_confidence"), 6).alias("confidence_delta"))


def neutrality_confidence(claims: Column, runs: Column, missing: Column) -> Column:
    """Coverage of claims and runs, less for each family that was never exercised."""
    part = lambda n, full: F.least(F.lit(1.0), n / full)
    raw = CLAIM_PART * part(runs, FULL_RUNS) + RUN_PART * part(claims, FULL_CLAIMS) - MISSING_FAMILY * missing
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), 6)


def neutrality_report(runs: DataFrame, group: str, families: int = len(S.FAMILIES), examples: int = 3) -> DataFrame:
    """One row per group: sample, metrics, health, confidence, reasons against publishing, limitations and the first failures."""
    a = runs.groupBy(group).agg(
        F.count_if("applied").alias("n_runs"), F.count_if(~F.col("applied")).alias("n_skipped"), F.countDistinct(F.when(F.col("applied"), F.col("claim_id"))).alias("n_claims"), F.countDistinct(F.when(F.col("applied"), F.col("family"))).alias("exercised"),
        F.avg(F.when(F.col("applied"), F.col("flipped").cast("double"))).alias("f"), F.avg(F.when(F.col("applied"), F.abs("confidence_delta"))).alias("c"), F.coalesce(F.avg(F.when(F.col("applied"), F.abs("framing_delta"))), F.lit(0.0)).alias("fr"), F.avg(F.when(F.col("applied"), F.col("explanation_delta"))).alias("e"),
    ).where("n_runs > 0")
    failed = _first_failures(runs, group, examples)
    missing = F.lit(families) - F.col("exercised")
    reasons = S.publish_reasons(F.col("f"), F.col("c"), F.col("n_runs"), F.col("n_claims"), missing)
    limits = F.array_compact(F.array(F.when(missing > 0, F.concat(F.lit("families_not_exercised:"), missing.cast("string"))), F.when(F.col("n_skipped") > 0, F.concat(F.lit("runs_skipped:"), F.col("n_skipped").cast("string"))), F.when(F.size(reasons) > 0, "not_publishable")))
    return a.join(failed, group, "left").select(
        group, "n_claims", "n_runs", F.round("f", 6).alias("flip_rate"), F.round("c", 6).alias("confidence_delta"), S.health(F.col("f"), F.col("c"), F.col("fr"), F.col("e")).alias("health"), neutrality_confidence(F.col("n_claims"), F.col("n_runs"), missing).alias("confidence"),
        (F.size(reasons) == 0).alias("publishable"), F.array_join(reasons, "|").alias("reasons"), F.array_join(limits, "|").alias("limitations"), F.coalesce("failures", F.lit("")).alias("failures"),
    )


def _first_failures(runs: DataFrame, group: str, examples: int) -> DataFrame:
    """The first flipped runs of each group by claim, family and run; ranked before they are gathered."""
    k = F.row_number().over(Window.partitionBy(group).orderBy("claim_id", "family", "run"))
    top = runs.where("applied and flipped").withColumn("k", k).where(F.col("k") <= examples)
    return top.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "run"))), lambda x: x.run.cast("string")), ",").alias("failures"))


def readiness(components: DataFrame, blocking_below: float = 20.0) -> DataFrame:
    """(document, readiness, blocking, n): rounded weighted sum of component scores (document, component, score, weight), and the components too low to go on.

    Weights are brought to a sum of one.
    """
    g = components.groupBy("document").agg(F.sum(F.col("score") * F.col("weight")).alias("s"), F.sum("weight").alias("w"), F.array_sort(F.collect_list(F.when(F.col("score") < blocking_below, F.col("component")))).alias("b"), F.count("*").alias("n"))
    return g.select("document", F.round(F.col("s") / F.col("w")).cast("long").alias("readiness"), F.array_join("b", "|").alias("blocking"), "n")


def axis_confidence(points: DataFrame, grid: DataFrame) -> DataFrame:
    """(document, axis, confidence, limiting) from impact points with provision, sign, corroborated and structural (a declared type or role, not wording alone, matched)."""
    h = points.groupBy("document", "axis").agg(
        F.count("*").alias("n"), F.countDistinct("provision").alias("provisions"), F.count_if("corroborated").alias("corroborated"), F.count_if(~F.col("structural")).alias("lexical"), F.count_if(F.col("sign") < 0).alias("negative")
    )
    n, c, lex, neg = F.col("n"), F.col("corroborated"), F.col("lexical"), F.col("negative")
    mixed = (neg > 0) & (neg < n)
    value = 0.25 + F.least(F.lit(0.2), 0.05 * n) + F.least(F.lit(0.2), 0.07 * c) + F.when(lex == n, -0.15).when(lex == 0, 0.1).otherwise(0.0) - F.when(mixed, 0.1).otherwise(0.0)
    limiting = F.when(n.isNull(), "not_engaged").when(lex == n, "wording_alone").when(c == 0, "not_corroborated").when(mixed, "signs_disagree")
    return grid.join(h, ["document", "axis"], "left").select("document", "axis", F.when(n.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.85), F.round(value, 3)))).alias("confidence"), limiting.alias("limiting"))
