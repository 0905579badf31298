"""Queries of the evidence operators: documents are evidence on the questions that the benchmark's items ask."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.arrays import rounded
from lectern.operators import evidence as E
from lectern.operators import scoring as S
from lectern.operators import segment as G
from lectern.plans._query import query, table
from lectern.plans.claim_queries import q, sql_claim_words, sql_numbers
from lectern.plans.views import sql_view, view

_TIER = "[" + ", ".join(f"'{t}'" for t in E.TIERS) + "]"
# Questions begin with a word of their kind, since the items are invented prose.
_HEADS = ["What does the article say of ", "How many saw ", "What effect had ", "Who said ", "What will become of ", "Tell of "]
QUESTIONS = f"(SELECT item_id AS claim_id, {_HEADS}[length(text) % 6 + 1] || text AS question FROM benchmark)"
EVI = f"(SELECT ev, claim_id, text AS statement, source, {_TIER}[tier + 1] AS tier, derived, restating, known_age AS age_days FROM {sql_view('evidence')})"


def _questions(spark, d):
    head = F.element_at(F.array(*[F.lit(h) for h in _HEADS]), (F.length("text") % 6 + 1).cast("int"))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("claim_id"), F.concat(head, "text").alias("question"))


def _evidence(spark, d):
    tier = F.element_at(F.array(*[F.lit(t) for t in E.TIERS]), F.col("tier") + 1)
    return view(spark, d, "evidence").select("ev", "claim_id", F.col("text").alias("statement"), "source", tier.alias("tier"), "derived", "restating", F.col("known_age").alias("age_days"))


_w = lambda x: f"list_distinct(regexp_extract_all({T.sql_fold(x)}, '[a-z]{{3,}}'))"
_kind = "CASE " + " ".join(f"WHEN regexp_matches({T.sql_fold('question')}, {q(p)}) THEN '{k}'" for k, p in E.QUESTION_WORDS) + " ELSE 'unknown' END"
_aff = "CASE WHEN kind = 'unknown' THEN 0.5 ELSE coalesce(CASE tier || '/' || kind " + " ".join(f"WHEN '{t}/{k}' THEN {v}" for t, row in E.AFFINITY.items() for k, v in zip(E.KINDS, row, strict=True)) + " END, 0.4) END"
_inc = "tier || '/' || kind IN (" + ", ".join(f"'{t}/{k}'" for t, ks in E.INCAPABLE.items() for k in ks) + ")"
_factor = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in E.QUANTITATIVENESS.items()) + " ELSE 0 END"
_life = "CASE kind WHEN 'causal_effect' THEN 1460 WHEN 'measured_quantity' THEN 365 WHEN 'legal_interpretation' THEN 1825 WHEN 'implementation_status' THEN 730 ELSE 540 END"
TOPICAL = f"""qs AS (SELECT claim_id, question, {_w('question')} AS qw, {_kind} AS kind FROM {QUESTIONS}), es AS (SELECT *, {_w('statement')} AS w FROM {EVI}),
nn AS (SELECT claim_id, count(*) AS n FROM es GROUP BY claim_id), hit AS (SELECT ev, es.claim_id, unnest(list_intersect(w, qw)) AS t FROM es JOIN qs ON es.claim_id = qs.claim_id), dfs AS (SELECT claim_id, t, count(*) AS df FROM hit GROUP BY ALL),
rare AS (SELECT x.claim_id, x.t, ln((1 + n)::DOUBLE / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT claim_id, unnest(qw) AS t FROM qs) x JOIN nn ON x.claim_id = nn.claim_id LEFT JOIN dfs ON x.claim_id = dfs.claim_id AND x.t = dfs.t),
tot AS (SELECT claim_id, sum(idf) AS total FROM rare GROUP BY claim_id), got AS (SELECT ev, hit.claim_id, sum(idf) AS got FROM hit JOIN rare ON hit.claim_id = rare.claim_id AND hit.t = rare.t GROUP BY ALL),
top AS (SELECT es.ev, es.claim_id, round(coalesce(got, 0) / total, 6) AS topical FROM es JOIN tot ON es.claim_id = tot.claim_id LEFT JOIN got ON es.ev = got.ev AND es.claim_id = got.claim_id)"""
_fs = T.sql_fold("statement")
FEATURES = f"""ft AS (SELECT ev, n_figures, n_scope, n_words, round(0.4 * least(n_figures / 8.0, 1) + 0.25 * least(n_scope, 1) + 0.35 * least(n_words / 120.0, 1), 6) AS specificity FROM (SELECT ev, len({sql_numbers(_fs)}) AS n_figures, len(regexp_extract_all({_fs}, {q(E.SCOPE)})) AS n_scope, len(list_filter(string_split_regex({_fs}, '\\s+'), lambda x: x <> '')) AS n_words FROM {EVI}))"""
CORROBORATION = """ca AS (SELECT claim_id, count(DISTINCT source) FILTER (WHERE NOT derived AND NOT restating) AS alls FROM es GROUP BY claim_id), co AS (SELECT claim_id, source, bool_or(NOT derived AND NOT restating)::INT AS counted FROM es GROUP BY ALL),
cor AS (SELECT ev, alls - counted AS sources FROM es JOIN ca ON es.claim_id = ca.claim_id JOIN co ON es.claim_id = co.claim_id AND es.source = co.source)"""
RANKED = f"""{TOPICAL}, {FEATURES}, {CORROBORATION},
pa AS (SELECT es.ev, es.claim_id, es.source, tier, kind, restating, topical, specificity, n_figures, age_days, sources, {_aff} AS affinity, {_inc} AS incapable FROM es JOIN qs ON es.claim_id = qs.claim_id JOIN top ON es.ev = top.ev JOIN ft ON es.ev = ft.ev JOIN cor ON es.ev = cor.ev),
pb AS (SELECT *, CASE WHEN {_factor} > 0 THEN round(least(1, n_figures / 3.0) * {_factor}, 6) END AS quantitative, round(CASE WHEN age_days IS NULL THEN 0.5 ELSE exp(-0.6931471805599453 * greatest(age_days, 0) / {_life}) END, 6) AS recency, round(least(1, sources / 3.0), 6) AS corroboration FROM pa),
pc AS (SELECT *, 90 + CASE WHEN quantitative IS NULL THEN 0 ELSE 10 END AS weight, 30 * affinity + 22 * topical + 12 * specificity + coalesce(10 * quantitative, 0) + 10 * recency + 16 * corroboration AS points FROM pb WHERE NOT (topical < 0.02 AND affinity < 0.3)),
pd AS (SELECT *, round(points * 100 / weight * CASE WHEN incapable THEN 0.2 ELSE 1 END * CASE WHEN restating THEN 0.65 ELSE 1 END, 4) AS score FROM pc),
k AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, ev) AS rank FROM pd)"""


@query("SELECT tier, kind, affinity, incapable FROM (VALUES " + ", ".join(f"('{t}', '{k}', {v}::DOUBLE, {str(k in E.INCAPABLE.get(t, ())).lower()})" for t, row in E.AFFINITY.items() for k, v in zip(E.KINDS, row, strict=True)) + ") AS v(tier, kind, affinity, incapable)")
def r02_tier_matrix(spark, d):
    return E.tier_table(spark)


@query(f"""WITH m(tier, kind, affinity, incapable) AS (VALUES {", ".join(f"('{t}', '{k}', {v}::DOUBLE, {str(k in E.INCAPABLE.get(t, ())).lower()})" for t, row in E.AFFINITY.items() for k, v in zip(E.KINDS, row, strict=True))})
SELECT e.tier, count(*) AS n, any_value(can) AS can, any_value(cannot) AS cannot FROM {EVI} e JOIN (SELECT tier, coalesce(string_agg(kind, ',' ORDER BY kind) FILTER (WHERE affinity >= 0.6), '') AS can, coalesce(string_agg(kind, ',' ORDER BY kind) FILTER (WHERE incapable), '') AS cannot FROM m GROUP BY tier) c ON e.tier = c.tier GROUP BY e.tier""")
def r02_capabilities_in_use(spark, d):
    """What the classes of the stored evidence can and can't establish."""
    n = _evidence(spark, d).groupBy("tier").agg(F.count("*").alias("n"))
    return n.join(E.capabilities(E.tier_table(spark)), "tier").select("tier", "n", "can", "cannot")


@query(f"SELECT DISTINCT tier || '_new' AS tier, 'missing' AS fault FROM {EVI} WHERE derived AND restating")
def r14_matrix_faults(spark, d):
    """The stored classes against the matrix; those of derived restatements are renamed, and so missing from it."""
    e = _evidence(spark, d)
    tiers = e.select(F.when(F.col("derived") & F.col("restating"), F.concat("tier", F.lit("_new"))).otherwise(F.col("tier")).alias("tier")).distinct()
    return E.matrix_faults(E.tier_table(spark), tiers)


@query(f"WITH {TOPICAL} SELECT ev, claim_id, topical FROM top")
def a03_r03_topical_relevance(spark, d):
    return E.topical_relevance(_questions(spark, d), _evidence(spark, d))


@query(f"WITH {FEATURES}, {TOPICAL} SELECT es.ev, kind, n_figures, specificity, CASE WHEN {_factor} > 0 THEN round(least(1, n_figures / 3.0) * {_factor}, 6) END AS quantitative FROM es JOIN qs ON es.claim_id = qs.claim_id JOIN ft ON es.ev = ft.ev")
def r05_quantitative_content(spark, d):
    kinds = _questions(spark, d).select("claim_id", E.question_kind(F.col("question")).alias("kind"))
    e = E.text_features(_evidence(spark, d)).join(kinds, "claim_id")
    return e.select("ev", "kind", "n_figures", "specificity", E.quantitative_content(F.col("n_figures"), F.col("kind")).alias("quantitative"))


@query(f"WITH es AS (SELECT * FROM {EVI}), {CORROBORATION} SELECT ev, sources FROM cor")
def r06_corroboration(spark, d):
    return E.corroboration(_evidence(spark, d))


@query(f"WITH {RANKED} SELECT claim_id, ev, round(score, 3) AS score, rank FROM k")
def r04_r07_w01_rank_evidence(spark, d):
    return E.rank(_questions(spark, d), _evidence(spark, d)).select("claim_id", "ev", rounded(F.col("score"), 3).alias("score"), "rank")


@query(f"""WITH {RANKED}, b AS (SELECT claim_id, max(CASE WHEN rank = 1 THEN score END) AS best, bool_or(rank = 1 AND NOT incapable) AS capable, count(DISTINCT source) AS sources FROM k GROUP BY claim_id)
SELECT claim_id, CASE WHEN best >= 55 AND capable AND sources >= 2 THEN 'high' WHEN best >= 35 AND sources >= 1 THEN 'medium' WHEN best >= 20 THEN 'low' ELSE 'insufficient' END AS strength, round(least(0.9, 0.3 + 0.25 * sources), 3) AS confidence FROM b""")
def r08_r09_strength(spark, d):
    return S.strength_by_group(E.rank(_questions(spark, d), _evidence(spark, d)), "claim_id")


@query(f"""WITH {RANKED}, g AS (SELECT claim_id, kind FROM qs), s AS (SELECT claim_id, count(*) AS kept, count(*) FILTER (WHERE NOT incapable) AS capable, count(DISTINCT source) AS sources FROM k GROUP BY claim_id)
SELECT g.claim_id, g.kind, array_to_string(list_filter([CASE WHEN kept IS NULL THEN 'nothing_bears_on_it' END, CASE WHEN kept > 0 AND capable = 0 THEN 'no_capable_source:' || CASE g.kind {" ".join(f"WHEN '{kk}' THEN '{','.join(sorted(t for t, row in E.AFFINITY.items() if row[i] >= 0.6))}'" for i, kk in enumerate(E.KINDS))} ELSE '' END END,
CASE WHEN kept > 0 AND sources < 2 THEN 'one_source' END, CASE WHEN kept > 0 AND coalesce(nn.n, 0) > kept THEN 'off_target:' || (nn.n - kept) END], lambda x: x IS NOT NULL), '|') AS gaps FROM g LEFT JOIN s ON g.claim_id = s.claim_id LEFT JOIN nn ON g.claim_id = nn.claim_id""")
def r10_named_gaps(spark, d):
    qs, ev = _questions(spark, d), _evidence(spark, d)
    g = E.named_gaps(qs, ev, E.rank(qs, ev))
    return g.select("claim_id", "kind", F.array_join("gaps", "|").alias("gaps"))


@query(f"WITH {RANKED} SELECT claim_id, array_to_string(list(ev ORDER BY rank), ',') AS order_plain, true AS invariant FROM k GROUP BY claim_id")
def r12_r13_authority_invariance(spark, d):
    """Ranks again with the publishers hashed; the order must be the same."""
    qs = _questions(spark, d)
    ev = E.read(qs, _evidence(spark, d))
    return S.same_order(E.rank_read(qs, ev), E.rank_read(qs, S.without_identity(ev, "source")), "claim_id", "ev")


@query(f"""WITH e AS (SELECT ev, tier, statement, {_w('statement')} AS w, sha256(statement) AS sha FROM {EVI} WHERE tier IN ('journalism', 'peer_reviewed')), s AS (SELECT *, round(len(list_intersect(w, ['license', 'version', 'the', 'public'])) / 4.0, 6) AS score FROM e)
SELECT ev, tier, score FROM s WHERE score > 0 ORDER BY score DESC, sha, ev LIMIT 40""")
def k02_search_evidence(spark, d):
    return E.search(_evidence(spark, d), "license version, the public", ["journalism", "peer_reviewed"], 40).select("ev", "tier", "score")


_yr = "list_distinct(regexp_extract_all({x}, '\\b(1[89][0-9]{{2}}|2[01][0-9]{{2}})\\b', 1))"
_vals = lambda x: f"list_transform(list_filter({sql_numbers(T.sql_fold(x))}, lambda n: NOT n.ambiguous), lambda n: n.value)"
_TURN = "text || ' ' || (length(text) % 97 + 100) || ' in ' || (1990 + length(text) % 30)"


@query(f"""WITH t AS (SELECT conv_id, turn, role, {_TURN} AS text FROM conversations), s AS (SELECT conv_id, turn AS no, {sql_claim_words('text')} AS sw, {_vals('text')} AS sn, {_yr.format(x='text')} AS sy FROM t WHERE role = 'user'),
o AS (SELECT conv_id, turn AS ref, turn % 3 AS certainty, {sql_claim_words('text')} AS tw, {_vals('text')} AS tn, {_yr.format(x='text')} AS ty FROM t WHERE role <> 'user'),
m AS (SELECT s.conv_id, no, ref, certainty, sn, tn, sy, ty, round(CASE WHEN least(len(sw), len(tw)) > 0 THEN len(list_intersect(sw, tw))::DOUBLE / least(len(sw), len(tw)) ELSE 0 END, 6) AS overlap FROM s JOIN o ON s.conv_id = o.conv_id),
x AS (SELECT *, round(CASE WHEN len(list_intersect(sn, tn)) > 0 THEN 0.65 + 0.35 * overlap WHEN len(list_intersect(sy, ty)) > 0 THEN 0.35 + 0.45 * overlap WHEN overlap >= 0.3 THEN overlap END, 6) AS strength FROM m),
b AS (SELECT *, max(strength) OVER (PARTITION BY conv_id, no) AS best FROM x WHERE strength IS NOT NULL)
SELECT conv_id, no, ref, strength FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, no ORDER BY certainty DESC, strength DESC, ref) AS k FROM b WHERE strength >= best - 0.05 - 1e-9) WHERE k = 1""")
def j05_best_source(spark, d):
    """What users say against what assistants say in the same conversation; a figure and a year stand at the end of each."""
    n = F.length("text")
    t = table(spark, d, "conversations").withColumn("text", F.concat("text", F.lit(" "), (n % 97 + 100).cast("string"), F.lit(" in "), (n % 30 + 1990).cast("string")))
    said = t.where("role = 'user'").select(F.col("conv_id").alias("group"), F.col("turn").alias("no"), F.col("text").alias("sentence"))
    sources = t.where("role <> 'user'").select(F.col("conv_id").alias("group"), F.col("turn").alias("ref"), F.col("text").alias("statement"), (F.col("turn") % 3).alias("certainty"))
    return E.best_source(said, sources).withColumnRenamed("group", "conv_id")


@query(f"""WITH e AS (SELECT ev, tier, list_distinct(regexp_extract_all({T.sql_words('lower(statement)')}, '(?:^|[^\\p{{L}}\\p{{N}}_])(license|version|public|apache|mit|gnu)(?:$|[^\\p{{L}}\\p{{N}}_])', 1)) AS supports FROM {EVI}), s AS (SELECT ev, tier, unnest(supports) AS provision FROM e)
SELECT p.provision, count(s.ev) AS n, min(tier) AS best_tier, min(ev) AS first FROM (VALUES ('license'), ('version'), ('public'), ('apache'), ('mit'), ('gnu'), ('none')) AS p(provision) LEFT JOIN s ON p.provision = s.provision GROUP BY p.provision""".replace("\\\\", "\\"))
def j12_support_index(spark, d):
    """Provisions are terms, and a text supports those that it names."""
    named = ["license", "version", "public", "apache", "mit", "gnu"]
    e = _evidence(spark, d).withColumn("supports", F.array_distinct(F.regexp_extract_all(F.lower("statement"), F.lit(T.edges(rf"\b({'|'.join(named)})\b")), F.lit(1))))
    return E.support_index(e, "supports", spark.createDataFrame([(p,) for p in [*named, "none"]], "provision string"))


_TOK = f"regexp_extract_all({T.sql_normalise('text')}, '[0-9a-z]+(?:[.,][0-9]+)*')"


@query(f"""WITH d AS (SELECT doc_id, list_distinct({_TOK}) AS w FROM documents), q AS (SELECT item_id, unnest(list_distinct({_TOK})) AS t FROM benchmark WHERE item_id % 50 = 0),
f AS (SELECT doc_id, unnest(w) AS t FROM d), n AS (SELECT count(*) AS n FROM documents), df AS (SELECT t, count(*) AS df FROM f WHERE t IN (SELECT t FROM q) GROUP BY t), z AS (SELECT item_id, count(*) AS size FROM q GROUP BY item_id)
SELECT item_id, doc_id, round(sum(1 / (1 + df.df::DOUBLE / n.n)) / any_value(size), 4) AS score FROM q JOIN f USING (t) JOIN df USING (t) JOIN z USING (item_id), n GROUP BY item_id, doc_id""")
def r11_lexical_search(spark, d):
    """The queries are the items whose id is divisible by 50, against all documents."""
    return G.lexical_search(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark").where("item_id % 50 = 0"), "item_id", "text")
