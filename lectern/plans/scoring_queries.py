"""Queries of the ranking, claim, framing, impact and neutrality operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import tokens as G
from lectern.functions.arrays import spread
from lectern.operators import evidence as E
from lectern.operators import framing as N
from lectern.operators import scoring as S
from lectern.plans._query import query, table
from lectern.plans.evidence_queries import QUESTIONS, _kind, _questions
from lectern.plans.views import sql_view, view

EVI = sql_view("evidence")
RUNS = sql_view("runs")


@query(f"SELECT claim_id, {_kind} AS kind FROM {QUESTIONS}")
def r01_question_kind(spark, d):
    return _questions(spark, d).select("claim_id", E.question_kind(F.col("question")).alias("kind"))


@query("""SELECT l_orderkey, l_linenumber, round(s, 3) AS share FROM (SELECT l_orderkey, l_linenumber, CASE WHEN k = 1 THEN r + 10 - sum(r) OVER (PARTITION BY l_orderkey) ELSE r END AS s FROM (
SELECT l_orderkey, l_linenumber, round(10 * l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 3) AS r, row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(l_quantity) DESC, l_linenumber) AS k FROM lineitem))""")
def w06_w07_apportion(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"))
    return S.apportion(li, ["l_orderkey"], "q", F.lit(10.0), "l_linenumber", "share").select("l_orderkey", "l_linenumber", "share")


@query(f"""WITH f AS (SELECT unnest(range(7))::INT AS family), k AS (SELECT family, run, row_number() OVER (PARTITION BY family ORDER BY flipped DESC, run) AS k FROM {RUNS} WHERE applied)
SELECT f.family, coalesce(runs, 0) AS runs, coalesce(flips, 0) AS flips, CASE WHEN runs > 0 THEN round(flips::DOUBLE / runs, 6) END AS flip_rate, coalesce(examples, '') AS examples FROM f
LEFT JOIN (SELECT family, count(*) FILTER (WHERE applied) AS runs, count(*) FILTER (WHERE applied AND flipped) AS flips FROM {RUNS} GROUP BY family) n ON f.family = n.family
LEFT JOIN (SELECT family, string_agg(run, ',' ORDER BY k) AS examples FROM k WHERE k <= 3 GROUP BY family) e ON f.family = e.family""")
def a19_perturbation_rollup(spark, d):
    families = spark.range(7).select(F.col("id").cast("int").alias("family"))
    return S.perturbation_rollup(view(spark, d, "runs"), families)


@query(f"""SELECT claim_id, count(*) AS n, round(avg(flipped::INT), 6) AS flip_rate, round(least(1, avg(abs(confidence_delta))), 6) AS confidence_delta, round(least(100, coalesce(avg(abs(framing_delta)), 0)), 6) AS framing_delta, round(least(1, avg(explanation_delta)), 6) AS explanation_delta
FROM {RUNS} WHERE applied GROUP BY claim_id""")
def a20_neutrality_metrics(spark, d):
    return S.neutrality_metrics(view(spark, d, "runs"), ["claim_id"])


@query(f"""WITH m AS (SELECT claim_id, count(*) AS n, avg(flipped::INT) AS f, avg(abs(confidence_delta)) AS c, coalesce(avg(abs(framing_delta)), 0) AS fr, avg(explanation_delta) AS e FROM {RUNS} WHERE applied GROUP BY claim_id)
SELECT claim_id, round(greatest(0, least(100 - 55 * f - 20 * c - 15 * (fr / 100) - 10 * e, 100 * (1 - f))), 4) AS health,
array_to_string(list_filter([CASE WHEN f > 0.05 THEN 'flip_rate' END, CASE WHEN c > 0.15 THEN 'confidence_delta' END, CASE WHEN n < 12 THEN 'runs' END, CASE WHEN claim_id % 5 < 3 THEN 'claims' END], lambda x: x IS NOT NULL), '|') AS reasons FROM m""")
def u07_u09_health_gate(spark, d):
    a = view(spark, d, "runs").where("applied").groupBy("claim_id").agg(F.count("*").alias("n"), F.avg(F.col("flipped").cast("int")).alias("f"), F.avg(F.abs("confidence_delta")).alias("c"), F.coalesce(F.avg(F.abs("framing_delta")), F.lit(0.0)).alias("fr"), F.avg("explanation_delta").alias("e"))
    f, c = F.col("f"), F.col("c")
    return a.select("claim_id", S.health(f, c, F.col("fr"), F.col("e")).alias("health"), F.array_join(S.publish_reasons(f, c, F.col("n"), F.col("claim_id") % 5, F.lit(0)), "|").alias("reasons"))


CHARGED = f"(SELECT id, replace(text, '|', chr(10)) AS text FROM {sql_view('charged')})"


@query(f"WITH {N.sql_loaded_language(CHARGED)} SELECT id, words, n_terms, n_quoted, round(loaded, 8) AS loaded, round(rate, 8) AS rate, CAST(round(100 * (1 - power(2, -rate / 3.0))) AS BIGINT) AS score FROM loaded")
def n01_w04_loaded_language(spark, d):
    charged = view(spark, d, "charged").withColumn("text", F.replace("text", F.lit("|"), F.lit("\n")))
    return N.loaded_language(charged, "id", "text").withColumns({c: F.round(c, 8) for c in ("loaded", "rate")})


@query("""SELECT l_orderkey, coalesce(round(sum(CASE WHEN x > 0 THEN x * l_quantity END) / sum(CASE WHEN x > 0 THEN l_quantity END), 6), 0) AS inflation FROM (SELECT *, greatest(l_tax - l_discount, 0) AS x FROM lineitem) GROUP BY l_orderkey""")
def n02_certainty_inflation(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_tax").alias("stated"), F.col("l_discount").alias("sourced"), F.col("l_quantity").alias("weight"))
    return S.certainty_inflation(li, "l_orderkey")


@query(f"""WITH m AS (SELECT source, avg(CASE WHEN tier < 3 THEN 1.0 ELSE 0 END) AS a, CASE WHEN count(*) % 2 = 0 THEN avg(CASE WHEN derived THEN 1.0 ELSE 0 END) END AS b, avg(known_age) / 2000 AS c FROM {EVI} GROUP BY source)
SELECT source, round((0.3 * a + coalesce(0.45 * b, 0) + coalesce(0.25 * c, 0)) / (0.3 + CASE WHEN b IS NULL THEN 0 ELSE 0.45 END + CASE WHEN c IS NULL THEN 0 ELSE 0.25 END), 6) AS score FROM m""")
def n06_n08_known_parts(spark, d):
    m = view(spark, d, "evidence").groupBy("source").agg(F.avg((F.col("tier") < 3).cast("double")).alias("a"), F.when(F.count("*") % 2 == 0, F.avg(F.col("derived").cast("double"))).alias("b"), (F.avg("known_age") / 2000).alias("c"))
    return m.select("source", F.round(S.mean_of_known([(F.col("a"), 0.3), (F.col("b"), 0.45), (F.col("c"), 0.25)]), 6).alias("score"))
