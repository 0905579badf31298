"""Queries of the similarity, independence, clustering and graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import tokens as G
from lectern.operators import cluster as C
from lectern.operators import graph as R
from lectern.operators import independence as I
from lectern.operators import similarity as S
from lectern.operators.extract import sql_wire_agency
from lectern.operators.graph import cut_lineage, drop_tables
from lectern.operators.segment import QUOTES
from lectern.operators.setlinks import set_classes
from lectern.plans._query import query, table
from lectern.plans.views import sql_view, view

NORM = T.sql_normalise("text")
TOKENS = f"regexp_extract_all({NORM}, '{G.WORD}')"
NORM_Q = T.sql_normalise("q")
ERRORS = ("4512 per mille",)
_Q = " || ".join(f"regexp_extract_all(text, '{q}', 1)" for q in QUOTES)
# features, and similarities of all pairs that share a shingle
FEATURE_SQL = f"""
t AS (SELECT *, {TOKENS} AS t FROM {sql_view('dispatches')}),
q AS (SELECT *, {_Q} AS q FROM t),
f AS MATERIALIZED (SELECT id, publisher, lang, published_min, kind, derived_from,
  CASE WHEN len(t) >= 40 THEN list_distinct([array_to_string(t[i:i+4], ' ') for i in range(1, len(t) - 3)]) ELSE []::VARCHAR[] END AS s,
  list_distinct(list_filter(list_transform(list_filter(q, lambda q: len(list_filter(string_split_regex(trim(q), '\\s+'), lambda w: w <> '')) >= 6),
    lambda q: trim(regexp_replace(regexp_replace(regexp_replace({NORM_Q}, '^[ .,;:''"-]+|[ .,;:''"-]+$', '', 'g'), '\\.{{3,}}', ' ', 'g'), '\\s+', ' ', 'g'))), lambda q: q <> '')) AS quotes,
  list_distinct(list_filter(list_transform(regexp_extract_all(text, '{I.URL.replace("'", "''")}'),
    lambda u: lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, '[.,;:)’"'']+$', ''), '^(?i)https?://', ''), '^(?i)www\\.', ''), '#.*$', ''), '[?&](utm_[^=]+|fbclid|gclid|mc_cid|mc_eid)=[^&]*', '', 'g'), '[?&/]+$', ''))), lambda u: u <> '')) AS urls,
  {T.sql_normalise(sql_wire_agency('text'))} AS w, list_filter({list(ERRORS)}, lambda e: contains({NORM}, e)) AS errors FROM q),
h AS (SELECT id, unnest(s) AS h FROM f),
o AS (SELECT a.id AS l, b.id AS r, count(*) AS n_both FROM h a JOIN h b ON a.h = b.h AND a.id < b.id GROUP BY ALL),
rep AS (SELECT min(id) AS rep, count(*) AS n, list(id) AS ids FROM f WHERE len(s) > 0 GROUP BY list_sort(s)),
k AS (SELECT id, published_min, 'w' AS kind, w AS key FROM f WHERE w IS NOT NULL UNION ALL SELECT id, published_min, 'q', unnest(quotes) FROM f
  UNION ALL SELECT id, published_min, 'u', unnest(urls) FROM f UNION ALL SELECT id, published_min, 'e', unnest(errors) FROM f
  UNION ALL SELECT f.id, f.published_min, 'c', CAST(rep AS VARCHAR) FROM rep, unnest(ids) AS u(i) JOIN f ON f.id = u.i)
"""
NEAR_SQL = """n AS (SELECT o.l, o.r, x.n AS n_l, y.n AS n_r, n_both::DOUBLE / (len(a.s) + len(b.s) - n_both) AS jaccard, n_both::DOUBLE / least(len(a.s), len(b.s)) AS containment
  FROM o JOIN rep x ON x.rep = o.l JOIN rep y ON y.rep = o.r JOIN f a ON a.id = o.l JOIN f b ON b.id = o.r)"""
# what two articles l < r of a table `p` share, and their signals
EXPLAIN_SQL = """e AS (SELECT p.l, p.r, a.publisher <> b.publisher AS other, coalesce(a.kind = 0 OR b.kind = 0, false) AS press, abs(a.published_min - b.published_min) AS gap_min,
    coalesce(n_both, 0)::DOUBLE / greatest(1, len(a.s) + len(b.s) - coalesce(n_both, 0)) AS jaccard, coalesce(n_both, 0)::DOUBLE / greatest(1, least(len(a.s), len(b.s))) AS containment,
    len(list_intersect(a.quotes, b.quotes)) AS nq, len(a.quotes) + len(b.quotes) - len(list_intersect(a.quotes, b.quotes)) AS uq, len(list_intersect(a.urls, b.urls)) AS nu,
    coalesce(a.w = b.w, false) AS wire, len(list_intersect(a.errors, b.errors)) AS ne FROM p JOIN f a ON a.id = p.l JOIN f b ON b.id = p.r LEFT JOIN o ON o.l = p.l AND o.r = p.r),
  g AS (SELECT *, jaccard >= 0.55 OR containment >= 0.75 AS phrasing, nq >= 2 AND nq::DOUBLE / uq >= 0.6 AS quoted, press AND nq > 0 AND other AS released FROM e),
  x AS (SELECT *, list_filter([CASE WHEN phrasing THEN 'identical_phrasing' END, CASE WHEN quoted THEN 'identical_quotes' END, CASE WHEN wire THEN 'same_wire' END, CASE WHEN released THEN 'same_press_release' END,
    CASE WHEN ne > 0 THEN 'shared_error' END, CASE WHEN nu > 0 AND gap_min <= 2880 AND NOT phrasing THEN 'same_release' END], lambda z: z IS NOT NULL) AS fired FROM g)"""


def _r(c, n=6):
    return F.round(c, n)


@query(f"WITH {FEATURE_SQL}, {NEAR_SQL} SELECT l, r, n_l, n_r, round(jaccard, 6) AS jaccard, round(containment, 6) AS containment FROM n WHERE jaccard >= 0.55 OR containment >= 0.75 UNION ALL SELECT rep, u.i, n, n, 1.0::DOUBLE, 1.0::DOUBLE FROM rep, unnest(ids) AS u(i) WHERE u.i <> rep")
def j02_m01_m02_near_pairs(spark, d):
    """Pairs of different similar texts, each with the number of its copies, and each copy with the text that stands for it."""
    m = I.near_pairs(I.fingerprints(view(spark, d, "dispatches")), members=True)
    return m.select("l", "r", "n_l", "n_r", _r(F.col("jaccard")).alias("jaccard"), _r(F.col("containment")).alias("containment"))


@query(f"""WITH {FEATURE_SQL}, {NEAR_SQL},
y AS (SELECT id, kind, published_min AS t, lag(id) OVER w AS before, lag(published_min) OVER w AS earlier, first_value(id) OVER w AS head, first_value(published_min) OVER w AS head_t FROM k WINDOW w AS (PARTITION BY kind, key ORDER BY published_min NULLS FIRST, id)),
z AS (SELECT before AS l, id AS r FROM y WHERE before IS NOT NULL AND (kind IN ('e', 'c') OR coalesce(t - earlier <= CASE kind WHEN 'u' THEN 2880 ELSE 180 END, false))
  UNION SELECT head, id FROM y WHERE head_t IS NULL AND head <> id UNION SELECT l, r FROM n WHERE jaccard >= 0.55 OR containment >= 0.75),
p AS (SELECT DISTINCT least(l, r) AS l, greatest(l, r) AS r FROM z), {EXPLAIN_SQL},
v AS (SELECT *, list_concat(fired, CASE WHEN other AND gap_min <= 1.5 AND (len(fired) > 0 OR nq > 0) THEN ['same_moment'] ELSE [] END) AS signals FROM x)
SELECT l, r, array_to_string(signals, '|') AS signals, round(jaccard, 6) AS jaccard, nq AS n_quotes, nu AS n_urls, ne AS n_errors, gap_min FROM v WHERE len(signals) > 0""")
def m19_pair_signals(spark, d):
    """Seven signals of the pairs that the index of typed keys and the similarity of texts propose."""
    m = I.pair_signals(view(spark, d, "dispatches"), ERRORS)
    n = lambda c: F.col(c).cast("long").alias(c)
    return m.select("l", "r", F.array_join("signals", "|").alias("signals"), _r(F.col("jaccard")).alias("jaccard"), n("n_quotes"), n("n_urls"), n("n_errors"), "gap_min")


# every pair that shares anything, and the closure of those that merge
ORIGIN_SQL = f"""WITH RECURSIVE {FEATURE_SQL},
p AS (SELECT l, r FROM o UNION SELECT a.id, b.id FROM k a JOIN k b ON a.kind = b.kind AND a.key = b.key AND a.id < b.id), {EXPLAIN_SQL},
ed AS (SELECT l, r FROM x WHERE (phrasing OR quoted OR wire OR released OR ne > 0) AND (gap_min IS NULL OR gap_min <= 180 OR ne > 0)
  UNION SELECT least(a.id, a.derived_from), greatest(a.id, a.derived_from) FROM f a JOIN f b ON a.derived_from = b.id),
bo AS MATERIALIZED (SELECT l AS x, r AS y FROM ed UNION SELECT r, l FROM ed),
wa AS (SELECT x AS id, x AS reach FROM bo UNION SELECT wa.id, bo.y FROM wa JOIN bo ON wa.reach = bo.x),
gr AS (SELECT id, min(reach) AS origin FROM wa GROUP BY id)
"""


@query(ORIGIN_SQL + "SELECT f.id, coalesce(origin, f.id) AS origin FROM f LEFT JOIN gr ON f.id = gr.id")
def c05_origin_groups(spark, d):
    return I.origin_groups(view(spark, d, "dispatches"), ERRORS)


@query(ORIGIN_SQL + """SELECT f.lang, count(*) AS n_articles, count(DISTINCT coalesce(origin, f.id)) AS n_origins, count(DISTINCT publisher) AS n_publishers FROM f LEFT JOIN gr ON f.id = gr.id GROUP BY f.lang""")
def a09_distinct_origins(spark, d):
    """The flagship: how many original sources stand behind the articles of each language."""
    a = view(spark, d, "dispatches")
    origins = I.origin_groups(a, ERRORS)
    return a.select("id", "lang", "publisher").join(origins, "id").groupBy("lang").agg(F.count("*").alias("n_articles"), F.countDistinct("origin").alias("n_origins"), F.countDistinct("publisher").alias("n_publishers"))


@query(f"""WITH a AS {sql_view('articles')}, r AS (SELECT *, row_number() OVER (PARTITION BY publisher ORDER BY published_min IS NULL, published_min, kind, independence, id) AS k, count(*) OVER (PARTITION BY publisher) AS n FROM a)
SELECT publisher, id AS origin, n FROM r WHERE k = 1""")
def w02_choose_origin(spark, d):
    return I.choose_origin(view(spark, d, "articles"), "publisher")


@query(f"""SELECT publisher, id, published_min - min(published_min) OVER (PARTITION BY publisher) AS lead_min,
row_number() OVER (PARTITION BY publisher ORDER BY published_min NULLS LAST, id) AS rank FROM {sql_view('articles')}""")
def w03_cascade(spark, d):
    return I.cascade(view(spark, d, "articles"), "publisher")


@query("""SELECT source, lang, CASE WHEN count(*) % 5 = 0 THEN 'wire' WHEN count(*) % 3 = 0 THEN 'press_release' WHEN count(*) % 2 = 0 THEN 'translation' ELSE 'verbatim' END AS kind,
round(least(0.98, greatest(0.05, 0.5 + CASE WHEN count(*) % 2 = 0 THEN 0.2 ELSE 0 END + CASE WHEN count(*) % 3 = 0 THEN 0.15 ELSE 0 END + CASE WHEN count(*) % 5 = 0 THEN 0.25 ELSE 0 END
  + CASE WHEN count(*) % 7 = 0 THEN 0.05 ELSE -0.1 END)), 6) AS confidence FROM documents GROUP BY source, lang""")
def c06_c07_chains(spark, d):
    g = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    n = F.col("n")
    return g.select("source", "lang", I.chain_kind(n, n % 2 == 0, n % 5 == 0, n % 3 == 0).alias("kind"), I.chain_confidence(n % 2 == 0, n % 3 == 0, n % 5 == 0, n % 7 == 0).alias("confidence"))


def _vectors(spark, d):
    t = table(spark, d, "documents")
    return S.tfidf(t, "doc_id", G.features(G.comparison_tokens(F.col("text"))), t.count())


TFIDF_SQL = f"""
w AS (SELECT doc_id, list_filter({TOKENS}, lambda w: length(w) >= 3 AND NOT regexp_matches(w, '^[0-9]{{1,2}}$')) AS w FROM documents),
o AS (SELECT doc_id, unnest(list_concat(w, [w[i] || '_' || w[i + 1] for i in range(1, len(w))])) AS term FROM w),
n AS (SELECT count(*) AS n FROM documents),
c AS (SELECT doc_id, term, count(*) AS c FROM o GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM c GROUP BY term),
k AS (SELECT c.*, df.df FROM c JOIN df USING (term), n WHERE df.df::DOUBLE / n.n <= 0.85),
x AS (SELECT doc_id, term, (0.5 + 0.5 * c / max(c) OVER (PARTITION BY doc_id)) * (ln((1 + n.n)::DOUBLE / (1 + df)) + 1) AS raw FROM k, n),
v AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS w FROM x)
"""


@query(f"WITH {TFIDF_SQL} SELECT doc_id, term, round(w, 6) AS w FROM v")
def a01_a02_tfidf(spark, d):
    vectors, members = _vectors(spark, d)
    rows = vectors.withColumnRenamed("id", "rep").join(members, "rep").select(F.col("id").alias("doc_id"), F.explode("v").alias("x"))
    return rows.select("doc_id", "x.term", _r(F.col("x.w")).alias("w"))


@query(f"""WITH {TFIDF_SQL}, key AS (SELECT doc_id, md5(string_agg(term || ':' || round(w, 9), ' ' ORDER BY term)) AS k FROM v GROUP BY doc_id), rep AS (SELECT min(doc_id) AS doc_id FROM key GROUP BY k), m AS MATERIALIZED (SELECT v.* FROM v JOIN rep USING (doc_id))
SELECT l, r, round(cosine, 5) AS cosine FROM (SELECT a.doc_id AS l, b.doc_id AS r, sum(a.w * b.w) AS cosine FROM m a JOIN m b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL) WHERE cosine >= 0.8""")
def m09_j03_cosine_pairs(spark, d):
    """All pairs of different vectors from 0.8 on; equal vectors are one, named by the least id."""
    vectors, _ = _vectors(spark, d)
    ranked, _ = S.ranked_classes(vectors)
    drop_tables(vectors)
    return S.ranked_cosine(ranked, 0.8).select("l", "r", _r(F.col("cosine"), 5).alias("cosine"))


@query(f"""WITH c AS (SELECT conv_id, turn, text, list_filter(list_transform(regexp_extract_all(text, '\\p{{L}}+|[0-9]+(?:[.,][0-9]+)?'), lambda w: lower(w)), lambda w: NOT list_contains({G.sql_list(G.EXPLANATION_STOPWORDS)}, w)) AS t FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.text AS x, b.text AS y, a.t AS tx, b.t AS ty FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
q AS (SELECT *, list_distinct(tx) AS ux, list_distinct(ty) AS uy FROM p),
r AS (SELECT conv_id, turn, x, y, tx, ty, list_sum(list_transform(list_intersect(ux, uy), lambda w: len(list_filter(tx, lambda z: z = w)) * len(list_filter(ty, lambda z: z = w))))::DOUBLE AS dot,
  sqrt(list_sum(list_transform(ux, lambda w: len(list_filter(tx, lambda z: z = w)) ** 2))) AS nx, sqrt(list_sum(list_transform(uy, lambda w: len(list_filter(ty, lambda z: z = w)) ** 2))) AS ny,
  len(list_intersect(ux, uy)) AS i, len(list_distinct(list_concat(ux, uy))) AS u FROM q),
z AS (SELECT *, CASE WHEN len(tx) > 0 AND len(ty) > 0 THEN coalesce(dot, 0) / (nx * ny) ELSE 0 END AS cos, CASE WHEN u > 0 THEN i::DOUBLE / u ELSE 1 END AS jac FROM r)
SELECT conv_id, turn, round(cos, 6) AS cosine, round(jac, 6) AS jaccard, CASE WHEN trim(x) = trim(y) OR (len(tx) = 0 AND len(ty) = 0) THEN 0 ELSE round(least(1, greatest(0, 1 - (0.7 * cos + 0.3 * jac))), 6) END AS delta FROM z""")
def m10_m11_explanation_delta(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text", G.explanation_tokens(F.col("text")).alias("t"))
    a, b = c.alias("a"), c.alias("b")
    p = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
    x, y = F.col("a.t"), F.col("b.t")
    return p.select("a.conv_id", "a.turn", _r(S.bag_cosine(x, y)).alias("cosine"), _r(S.bag_jaccard(x, y)).alias("jaccard"), S.explanation_delta(F.col("a.text"), F.col("b.text"), x, y).alias("delta"))


@query(f"""SELECT id, round(coalesce(exp(-ln(2) * abs(published_min / 60.0) / 72), 0.5), 6) AS temporal,
round(CASE WHEN published_min IS NULL THEN 0.5 ELSE exp(-ln(2) * greatest(published_min / 1440.0, 0) / CASE kind WHEN 0 THEN 1460 WHEN 1 THEN 730 WHEN 2 THEN 365 WHEN 3 THEN 1825 ELSE 540 END) END, 6) AS recency,
round(1 - power(2, -(n_chars / 1000.0) / 3.0), 6) AS saturated, round(0.6 * (id % 10) / 10.0 + 0.25 * (id % 4) / 4.0 + 0.15 * coalesce(exp(-ln(2) * abs(published_min / 60.0) / 72), 0.5), 6) AS combined FROM {sql_view('articles')}""")
def m12_m13_m15_m16_decays(spark, d):
    a = view(spark, d, "articles")
    kind = F.when(F.col("kind") == 0, "causal").when(F.col("kind") == 1, "impact").when(F.col("kind") == 2, "fiscal").when(F.col("kind") == 3, "legal").otherwise("other")
    t = S.temporal(F.col("published_min") / 60)
    return a.select(
        "id", _r(t).alias("temporal"), _r(S.recency(F.col("published_min") / 1440, kind)).alias("recency"), _r(S.saturation(F.col("n_chars") / 1000, 3.0)).alias("saturated"), _r(S.combined((F.col("id") % 10) / 10, (F.col("id") % 4) / 4, t)).alias("combined")
    )


@query("""WITH m AS (SELECT lang, source, sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) AS q FROM documents GROUP BY ALL),
t AS (SELECT *, sum(p) OVER (PARTITION BY lang) AS tp, sum(q) OVER (PARTITION BY lang) AS tq FROM m)
SELECT lang, round(0.5 * sum(CASE WHEN tp > 0 AND tq > 0 THEN abs(p::DOUBLE / tp - q::DOUBLE / tq) ELSE 0 END), 6) AS distance FROM t GROUP BY lang""")
def m14_total_variation(spark, d):
    m = table(spark, d, "documents").groupBy("lang", "source").agg(F.count_if(F.col("doc_id") % 2 == 0).alias("p"), F.count_if(F.col("doc_id") % 3 == 0).alias("q"))
    return S.total_variation(m, ["lang"], "source", "p", "q").select("lang", _r(F.col("distance")).alias("distance"))


@query(f"""WITH t AS (SELECT item_id, {G.sql_list([])}::VARCHAR[] AS none, list_distinct(regexp_extract_all({T.sql_fold('text')}, '[a-z0-9]+')) AS w FROM benchmark)
SELECT a.item_id AS l, b.item_id AS r, round(len(list_intersect(a.w, b.w))::DOUBLE / least(len(a.w), len(b.w)), 6) AS overlap, round(len(list_intersect(a.w, b.w))::DOUBLE / len(a.w), 6) AS coverage
FROM t a JOIN t b ON a.item_id < b.item_id WHERE len(list_intersect(a.w, b.w)) > 0""")
def m03_m04_overlaps(spark, d):
    t = table(spark, d, "benchmark").select("item_id", F.array_distinct(F.regexp_extract_all(T.fold(F.col("text")), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    return S.overlaps(t, "item_id", "w").select("l", "r", _r(F.col("overlap")).alias("overlap"), _r(F.col("coverage")).alias("coverage"))


@query()
def m05_m06_minhash(spark, d):
    """Pairs of articles that share a band, with the estimate; articles with equal shingles are one, and crowded bands are met exactly."""
    prints = I.fingerprints(view(spark, d, "articles"))
    prints = cut_lineage(prints.join(set_classes(prints.select("id", "s")).where("id = rep").select("id"), "id", "left_semi"))
    sig = cut_lineage(prints.select("id", S.minhash(F.col("s")).alias("sig")))
    pairs, crowded = S.lsh_pairs(sig)
    pairs = pairs.union(I.candidate_pairs(prints.select("id", "s").join(crowded, "id", "left_semi"))).distinct()
    met = pairs.join(sig.toDF("l", "x"), "l").join(sig.toDF("r", "y"), "r")
    return met.select("l", "r", S.minhash_estimate(F.col("x"), F.col("y")).alias("estimate"))


@query()
def m07_simhash(spark, d):
    t = table(spark, d, "documents").select("doc_id", S.simhash(G.comparison_tokens(F.col("text"))).alias("simhash"))
    return t.withColumn("bits", F.bit_count("simhash"))


@query("SELECT event_id, CAST(bit_count(xor(event_id, user_id)) AS INT) AS distance FROM events")
def m08_hamming(spark, d):
    return table(spark, d, "events").select("event_id", S.hamming(F.col("event_id"), F.col("user_id")).alias("distance"))


@query()
def m17_hashed_embedding(spark, d):
    t = table(spark, d, "documents").select("doc_id", S.hashed_embedding(G.comparison_tokens(F.col("text"))).alias("v"))
    return t.select("doc_id", F.transform("v", lambda x: F.round(x, 6)).alias("embedding"))


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), s AS (
SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS c FROM q, embeddings e WHERE e.vec_id <> q.vec_id)
SELECT query_id, vec_id, round(c, 5) AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 5) DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def q09_cosine_search(spark, d):
    """Every row whose id is divisible by 50 against all rows; the queries are broadcast in blocks of bounded size."""
    return C.cosine_search(table(spark, d, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0, top=10)


@query()
def c01_c02_average_linkage(spark, d):
    vectors, members = _vectors(spark, d)
    ranked, same = S.ranked_classes(vectors)
    drop_tables(vectors)
    return C.cluster_ranked(ranked, same, members, 0.34)


@query()
def c03_cluster_claims(spark, d):
    """What is said in conversations, by words alone."""
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("claim_id"), "text")
    vectors, members = S.tfidf(c, "claim_id", G.features(G.comparison_tokens(F.col("text"))), c.count())
    ranked, same = S.ranked_classes(vectors)
    drop_tables(vectors)
    return C.cluster_ranked(ranked, same, members, 0.2).withColumnRenamed("id", "claim_id")


@query("""WITH t AS (SELECT label, unnest([1, 2, 3]) AS k, vec_id FROM embeddings), m AS (SELECT label, min(vec_id) AS first, count(*) AS n FROM embeddings GROUP BY label)
SELECT label, 'cluster:' || substr(sha256(CAST(first AS VARCHAR)), 1, 16) AS cluster, n, row_number() OVER (ORDER BY n DESC, first) AS rank FROM m""")
def c04_k04_cluster_ids(spark, d):
    m = table(spark, d, "embeddings").groupBy("label").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    ranked = C.global_rank(m, F.desc("n"), F.asc("first"))
    return ranked.select("label", T.make_id("cluster", F.col("first").cast("string")).alias("cluster"), "n", "rank")


@query(f"""WITH {TFIDF_SQL}, g AS (SELECT lang AS cluster, term, sum(w) AS s FROM v JOIN documents USING (doc_id) GROUP BY ALL)
SELECT cluster, term, round(s, 4) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(s, 4) DESC, term) AS rank FROM g) WHERE rank <= 4""")
def k05_top_terms(spark, d):
    vectors, members = _vectors(spark, d)
    copies = members.join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang"), "id").groupBy("rep", "lang").agg(F.count("*").alias("n"))
    v = vectors.withColumnRenamed("id", "rep").join(copies, "rep").select("lang", "n", F.explode("v").alias("x"))
    return S.top_terms(v.select("lang", "x.term", (F.col("n") * F.col("x.w")).alias("w")), "lang", "term", 4).withColumnRenamed("lang", "cluster")


@query("""WITH u AS (SELECT label, vec_id, unnest(range(len(embedding))) AS i, unnest(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y))))) AS x FROM embeddings),
g AS (SELECT label, i, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM u GROUP BY ALL), c AS (SELECT label, max(n) AS n, round(CASE WHEN max(n) > 1 THEN (sum(s * s) - sum(q)) / (max(n) * (max(n) - 1)) ELSE 1 END, 5) AS cohesion FROM g GROUP BY label),
p AS (SELECT a.label, max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.label <> b.label GROUP BY a.label)
SELECT c.label, n, cohesion, round(coalesce(s, 0), 5) AS separation FROM c LEFT JOIN p ON c.label = p.label""")
def w08_cohesion(spark, d):
    e = table(spark, d, "embeddings")
    return C.cohesion(e, "label", "embedding").join(C.separation(e, "label", "embedding"), "label")


@query("""WITH o AS (SELECT user_id, props, min(ts) AS first, max(ts) AS last, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id || ' ' || props AS grp, n, CAST((epoch(last) - epoch(first)) / 60 AS BIGINT) AS span_min FROM o WHERE n >= 2 AND epoch(last) - epoch(first) <= 36 * 3600""")
def w05_detect_events(spark, d):
    e = table(spark, d, "events").withColumn("grp", F.concat_ws(" ", F.col("user_id").cast("string"), "props"))
    return C.detect_events(e, "grp", "ts", hours=36)


@query(f"""WITH a AS (SELECT item_id, list_distinct(regexp_extract_all({T.sql_fold('text')}, '[a-z0-9]+')) AS w FROM benchmark WHERE item_id >= 10),
c AS (SELECT item_id AS comp, list_distinct(regexp_extract_all({T.sql_fold('text')}, '[a-z0-9]+')) AS cw FROM benchmark WHERE item_id < 10),
s AS (SELECT item_id, comp, len(list_intersect(w, cw))::DOUBLE / (len(w) + len(cw) - len(list_intersect(w, cw))) AS sim FROM a, c),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(sim, 9) DESC, comp) AS k FROM s) WHERE k = 1 AND sim >= 0.06)
SELECT c.comp, count(b.item_id) AS n, min(b.item_id) AS first FROM c LEFT JOIN b ON c.comp = b.comp GROUP BY c.comp""")
def j04_component_routing(spark, d):
    w = table(spark, d, "benchmark").select("item_id", F.array_distinct(F.regexp_extract_all(T.fold(F.col("text")), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    return C.route(w.where("item_id >= 10"), w.where("item_id < 10").select(F.col("item_id").alias("comp"), F.col("w").alias("cw")), least=0.06)


@query(f"""WITH e AS {sql_view('edges')} SELECT node, edge, neighbour, direction FROM (
SELECT src AS node, edge, dst AS neighbour, 'out' AS direction, kind FROM e UNION ALL SELECT dst, edge, src, 'in', kind FROM e) WHERE kind IN ('cites', 'lies_in')""")
def j08_neighbours(spark, d):
    return R.neighbours(view(spark, d, "edges"), "both", ["cites", "lies_in"])


@query(f"""WITH e AS {sql_view('edges')}, n AS {sql_view('nodes')} SELECT n.id, count(*) FILTER (WHERE e.dst = n.id) AS n_in, count(*) FILTER (WHERE e.src = n.id) AS n_out,
count(*) FILTER (WHERE e.dst = n.id) + count(*) FILTER (WHERE e.src = n.id) AS degree FROM n LEFT JOIN e ON e.src = n.id OR e.dst = n.id GROUP BY n.id""")
def a14_degrees(spark, d):
    return R.degrees(view(spark, d, "nodes"), view(spark, d, "edges"))


@query(f"""WITH e AS {sql_view('edges')}, n AS {sql_view('nodes')} SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM n WHERE id NOT IN (SELECT src FROM e UNION SELECT dst FROM e)) AS n_isolated,
count(*) AS n_edges, count(*) FILTER (WHERE NOT supported) AS n_unsupported FROM e""")
def a13_graph_stats(spark, d):
    return R.stats(view(spark, d, "nodes"), view(spark, d, "edges"))


def _pagerank_sql(rounds: int = R.ITERATIONS) -> str:
    """One materialised step per round."""
    steps = [
        f"p{k} AS MATERIALIZED (SELECT id, 0.15 / n + 0.85 * (coalesce(got, 0) + lost / n) AS rank FROM n, c, "
        f"(SELECT coalesce(sum(rank), 0) AS lost FROM p{k - 1} WHERE id NOT IN (SELECT src FROM o)) LEFT JOIN "
        f"(SELECT dst, sum(rank * share) AS got FROM s JOIN p{k - 1} ON s.src = p{k - 1}.id GROUP BY dst) ON dst = id)"
        for k in range(1, rounds + 1)
    ]
    head = f"e AS {sql_view('edges')}, n AS {sql_view('nodes')}, o AS (SELECT src, count(*) AS k FROM e GROUP BY src), c AS (SELECT count(*)::DOUBLE AS n FROM n)"
    share = "s AS MATERIALIZED (SELECT e.src, dst, count(*)::DOUBLE / any_value(k) AS share FROM e JOIN o ON e.src = o.src GROUP BY e.src, dst), p0 AS (SELECT id, 1.0 / n AS rank FROM n, c)"
    return f"WITH {head}, {share}, {', '.join(steps)} SELECT id, round(rank, 6) AS rank FROM p{rounds}"


@query(_pagerank_sql())
def c10_pagerank(spark, d):
    return R.pagerank(view(spark, d, "nodes"), view(spark, d, "edges"))


@query(f"""WITH e AS {sql_view('edges')}, n AS {sql_view('nodes')}, g AS (SELECT n.id, n.id IN (SELECT src FROM e WHERE supported) AS ev, (SELECT count(*) FROM e WHERE e.src = n.id OR e.dst = n.id) AS degree FROM n),
r AS (SELECT id, degree, CASE WHEN ev THEN 2 ELSE 0 END AS evidence, length(id) AS rank FROM g)
SELECT id, round(0.5 * rank / max(rank) OVER () + 0.3 * degree / max(degree) OVER () + 0.2 * evidence / max(evidence) OVER (), 6) AS score FROM r""")
def c11_w11_node_score(spark, d):
    nodes, edges = view(spark, d, "nodes"), view(spark, d, "edges")
    ev = edges.where("supported").select(F.col("src").alias("id")).distinct().withColumn("evidence", F.lit(2))
    ranked = R.degrees(nodes, edges).join(ev, "id", "left").select("id", "degree", F.coalesce("evidence", F.lit(0)).alias("evidence"), F.length("id").alias("rank"))
    return R.node_score(ranked)


@query(f"""WITH RECURSIVE e AS {sql_view('edges')}, b AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e),
h AS (SELECT 'r:1' AS id, 0 AS depth UNION SELECT b.y, h.depth + 1 FROM h JOIN b ON h.id = b.x WHERE h.depth < 2) SELECT id, min(depth) AS depth FROM h GROUP BY id""")
def c12_hops(spark, d):
    return R.within_hops(view(spark, d, "edges"), spark.createDataFrame([("r:1",)], "id string"), 2)


@query("""WITH RECURSIVE p AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey - s_suppkey % 5 END AS parent FROM supplier),
q AS (SELECT id, CASE WHEN parent = 0 THEN NULL ELSE parent END AS parent FROM p), w AS (SELECT id, id AS at FROM q UNION ALL SELECT w.id, q.parent FROM w JOIN q ON w.at = q.id WHERE q.parent IS NOT NULL)
SELECT w.id, w.at AS root FROM w JOIN q ON w.at = q.id WHERE q.parent IS NULL""")
def j09_roots(spark, d):
    s = F.col("s_suppkey")
    parent = F.nullif(F.when(s % 5 != 0, s - s % 5), F.lit(0))
    return R.roots(table(spark, d, "supplier").select(s.alias("id"), parent.alias("parent")))
