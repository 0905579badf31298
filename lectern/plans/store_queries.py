"""Queries of the store, registry, aggregation, window and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as T
from lectern.operators import store as O
from lectern.plans._query import query, table
from lectern.plans.views import sql_view, view

REG = sql_view("registry")
EVI = sql_view("evidence")


@query(f"SELECT id, name FROM {REG} WHERE enabled AND kind IN (1, 2, 3) AND tier = 4 AND split_part(language, '-', 1) = 'en'")
def f01_f02_select_sources(spark, d):
    r = view(spark, d, "registry").where(O.language_matches(F.col("language"), "en"))
    return O.select_sources(r, enabled=True, kind=[1, 2, 3], tier=4).select("id", "name")


@query(f"SELECT id, enabled AND has_url AND coalesce(crawl_allowed, false) AS retrievable FROM {REG}")
def f03_retrievable(spark, d):
    return view(spark, d, "registry").select("id", O.retrievable(F.col("enabled"), F.col("has_url"), F.col("crawl_allowed")).alias("retrievable"))


@query(f"SELECT ev, claim_id, CASE WHEN contradicts THEN 'contradicts' ELSE 'supports' END AS relation FROM {EVI} WHERE claim_id = 7 AND tier IN (1, 2, 3, 4)")
def f04_f05_evidence_lookup(spark, d):
    return O.evidence_for(view(spark, d, "evidence"), claim=7, tiers=[1, 2, 3, 4]).select("ev", "claim_id", "relation")


@query(f"SELECT id, published_min FROM {sql_view('articles')} WHERE (published_min IS NULL OR published_min BETWEEN 10000 AND 20000) AND lang IN ('en', 'fr')")
def f06_null_tolerant_bounds(spark, d):
    a = view(spark, d, "articles")
    return a.where(O.within_bounds(F.col("published_min"), 10000, 20000) & F.col("lang").isin("en", "fr")).select("id", "published_min")


@query("""SELECT t.topic, count(DISTINCT d.source) AS n_sources, count(*) AS n_docs FROM documents d JOIN (VALUES ('licence', 'license'), ('licence', 'licensed'), ('insult', 'stupid'), ('insult', 'trash')) AS t(topic, kw)
ON contains(lower(d.text), t.kw) GROUP BY t.topic""")
def f08_topic_coverage(spark, d):
    topics = spark.createDataFrame([("licence", "license"), ("licence", "licensed"), ("insult", "stupid"), ("insult", "trash")], "topic string, keyword string")
    return O.topic_coverage(table(spark, d, "documents"), "source", "text", topics)


@query("SELECT item_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS terms FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]{3,}') AS w FROM benchmark)")
def f09_query_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(O.query_terms(F.col("text")), " ").alias("terms"))


@query("""SELECT event_type, props_len, n, total FROM (SELECT event_type, length(props) AS props_len, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL HAVING count(*) >= 5) ORDER BY n DESC, event_type, props_len LIMIT 6""")
def s15_f11_site_analytics(spark, d):
    e = table(spark, d, "events").withColumn("props_len", F.length("props").cast("long"))
    return O.floor_groups(e, ["event_type", "props_len"], "value").select("event_type", "props_len", "n", F.round("total", 4).alias("total"))


@query("SELECT o_orderkey AS run, c_custkey AS document, c_name, o_orderdate AS created FROM orders JOIN customer ON o_custkey = c_custkey")
def j01_runs_with_documents(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("document"), F.col("o_orderdate").alias("created"))
    return O.runs_with_documents(runs, table(spark, d, "customer").select(F.col("c_custkey").alias("document"), "c_name"), "document")


@query(f"SELECT run, document, created FROM {sql_view('snapshots')} ORDER BY created DESC, run LIMIT 500")
def k03_o04_newest(spark, d):
    return O.newest(view(spark, d, "snapshots").select("run", "document", "created"), "created", "run", 900)


@query(f"SELECT sha, run, document FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY created DESC, run DESC) AS k FROM {sql_view('snapshots')}) WHERE k = 1")
def s17_latest_snapshot(spark, d):
    s = view(spark, d, "snapshots").select("sha", "run", "document", "created")
    return O.latest_by(s, ["sha"], F.struct("created", "run")).select("sha", "run", "document")


@query(f"SELECT document, run, row_number() OVER w AS version, lag(run) OVER w AS supersedes FROM {sql_view('snapshots')} WINDOW w AS (PARTITION BY document ORDER BY created, run)")
def w10_o03_history(spark, d):
    return O.history(view(spark, d, "snapshots"), "document", "created", "run")


@query("SELECT user_id AS url, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n, arg_max(event_type, (ts, event_type)) AS last_value FROM events GROUP BY user_id")
def d07_upsert(spark, d):
    return O.upsert_seen(view(spark, d, "observations"), "url", "ts", "event_type")


@query("SELECT DISTINCT source, md5(text) AS sha FROM documents WHERE doc_id % 2 = 1 AND (source, md5(text)) NOT IN (SELECT source, md5(text) FROM documents WHERE doc_id % 2 = 0)")
def d06_s12_new_snapshots(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("sha"))
    return O.new_content(docs.where("doc_id % 2 = 1").select("source", "sha"), docs.where("doc_id % 2 = 0"), ["source", "sha"])


@query(f"""SELECT fingerprint, min(ev) AS ev, count(*) AS n FROM (SELECT ev, substr(sha256({T.sql_normalise('text')} || chr(31) || source || chr(31) || tier), 1, 16) AS fingerprint FROM {EVI}) GROUP BY fingerprint""")
def d01_evidence_fingerprint(spark, d):
    e = view(spark, d, "evidence")
    return e.select("ev", T.stable_hash(T.normalise(F.col("text")), F.col("source"), F.col("tier").cast("string")).alias("fingerprint")).groupBy("fingerprint").agg(F.min("ev").alias("ev"), F.count("*").alias("n"))


@query(f"SELECT ev, sha FROM (SELECT ev, md5(text) AS sha, row_number() OVER (PARTITION BY md5(text) ORDER BY CASE strength WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END, ev) AS k FROM {EVI}) WHERE k = 1")
def d02_d04_keep_best(spark, d):
    e = view(spark, d, "evidence").withColumn("sha", F.md5("text")).withColumn("o", F.when(F.col("strength") == "high", 0).when(F.col("strength") == "low", 2).otherwise(1))
    return O.keep_first(e.select("ev", "sha", "o"), ["sha"], ["o", "ev"]).select("ev", "sha")


@query(f"""WITH e AS (SELECT CASE WHEN ev % 50 = 7 THEN ev - 7 ELSE ev END AS ev, md5(text) AS sha, ev % 3 = 0 AS old FROM {EVI}), s AS (SELECT * FROM e WHERE old), i AS (SELECT * FROM e WHERE NOT old),
c AS (SELECT ev, sha, EXISTS (SELECT 1 FROM s WHERE s.ev = i.ev AND s.sha <> i.sha) OR EXISTS (SELECT 1 FROM i j WHERE j.ev = i.ev AND j.sha <> i.sha) AS collides, EXISTS (SELECT 1 FROM s WHERE s.sha = i.sha) AS held FROM i)
SELECT min(ev) AS ev, sha, 'stored' AS outcome FROM c WHERE NOT collides AND NOT held GROUP BY sha UNION ALL SELECT ev, sha, CASE WHEN collides THEN 'collision' ELSE 'duplicate' END FROM c WHERE collides OR held""")
def d02_insert_policies(spark, d):
    """A third of the evidence is stored, the rest comes in; some of it with the id of another item."""
    n = F.col("ev")
    e = view(spark, d, "evidence").select(F.when(n % 50 == 7, n - 7).otherwise(n).alias("ev"), F.md5("text").alias("sha"), (n % 3 == 0).alias("old"))
    new, refused = O.insert(e.where("old").drop("old"), e.where("not old").drop("old"), "ev", "sha", "reject")
    return new.withColumn("outcome", F.lit("stored")).unionByName(refused.withColumnRenamed("reason", "outcome"))


@query(f"SELECT source, tier, min(ev) AS ev, array_to_string(list_sort(list_distinct(list(claim_id))), ',') AS claims, count(*) AS n FROM {EVI} GROUP BY source, tier")
def d03_d08_merge(spark, d):
    e = view(spark, d, "evidence").select("source", "tier", "ev", F.array("claim_id").alias("claims"))
    return O.merge_groups(e, ["source", "tier"], "ev", "claims").select("source", "tier", "ev", F.array_join(F.transform("claims", lambda x: x.cast("string")), ",").alias("claims"), "n")


@query("SELECT DISTINCT doc_id % 100 AS page, n_chars % 50 AS at, lang FROM documents")
def d05_span_dedup(spark, d):
    s = table(spark, d, "documents").select((F.col("doc_id") % 100).alias("page"), (F.col("n_chars") % 50).alias("at"), "lang")
    return O.distinct_spans(s, "page", "at", "lang")


@query("""SELECT 'union' AS op, count(*) AS n FROM (SELECT doc_id FROM documents WHERE lang = 'en' UNION SELECT doc_id FROM labels)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels)
UNION ALL SELECT 'except', count(*) FROM (SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels)""")
def d11_set_operations(spark, d):
    return O.set_operations(table(spark, d, "documents").where("lang = 'en'").select("doc_id"), table(spark, d, "labels").select("doc_id"))


@query("SELECT md5(text) AS fingerprint, min(doc_id) AS document, count(*) AS n FROM documents GROUP BY md5(text)")
def d12_create_or_get(spark, d):
    return O.create_or_get(table(spark, d, "documents"), "doc_id", "text")


@query(f"""SELECT CASE WHEN gid = 1 THEN 'tier' WHEN gid = 2 THEN 'kind' ELSE 'all' END AS dimension, coalesce(tier, kind) AS value, n, n_enabled, n_verified, n_retrievable FROM (
SELECT tier, kind, CASE WHEN grouping(tier) = 0 THEN 1 WHEN grouping(kind) = 0 THEN 2 ELSE 3 END AS gid, count(*) AS n, count(*) FILTER (WHERE enabled) AS n_enabled, count(*) FILTER (WHERE verified) AS n_verified,
count(*) FILTER (WHERE enabled AND has_url AND coalesce(crawl_allowed, false)) AS n_retrievable FROM {REG} GROUP BY GROUPING SETS ((tier), (kind), ()))""")
def a04_a05_coverage_summary(spark, d):
    return O.coverage_summary(view(spark, d, "registry"))


@query(f"SELECT DISTINCT 'jurisdiction' AS dimension, jurisdiction AS value FROM {REG} UNION ALL SELECT DISTINCT 'language', language FROM {REG}")
def a06_distinct_values(spark, d):
    return O.distinct_values(view(spark, d, "registry"), ["jurisdiction", "language"])


@query("""WITH c AS (SELECT role, turn, CASE WHEN length(text) > 300 THEN 'long' ELSE 'short' END AS verdict FROM conversations WHERE turn <= 2 OR length(text) > 100), k AS (SELECT role, verdict, count(*) AS k, min(turn) AS first, max(turn) AS last FROM c GROUP BY ALL)
SELECT role, CAST(sum(k) AS BIGINT) AS n, string_agg(verdict || ':' || k, '|' ORDER BY verdict, k) AS verdicts, min(first) AS first, max(last) AS last FROM k GROUP BY role""")
def a07_a08_track_record(spark, d):
    """The verdict is the turn's length; short turns are judged at turn 2, so later ones were attributed too late."""
    c = table(spark, d, "conversations").select("role", "turn", F.when(F.length("text") > 300, "long").otherwise("short").alias("verdict"), F.when(F.length("text") > 100, F.lit(1 << 30)).otherwise(F.lit(2)).alias("judged"))
    return O.track_record(c, "role", "verdict", "turn", "judged")


@query(f"SELECT claim_id, count(DISTINCT source) FILTER (WHERE NOT restating AND NOT derived) AS n_independent, count(*) AS n FROM {EVI} GROUP BY claim_id")
def a10_v18_independent_sources(spark, d):
    return O.independent_sources(view(spark, d, "evidence"), "claim_id")


@query("""WITH p AS (SELECT o_custkey, o_orderpriority AS kind, o_orderkey, o_totalprice FROM orders)
SELECT kind, count(*) AS n, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS exemplar, round(avg(o_totalprice), 3) AS similarity FROM p GROUP BY kind""")
def a11_signal_groups(spark, d):
    return O.signal_groups(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "kind"), "kind", "o_orderkey", "o_totalprice")


@query("""SELECT l_suppkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) ELSE 'mixed' END AS direction, CASE WHEN count(*) = 1 THEN 'small' WHEN count(*) <= 3 THEN 'medium' ELSE 'large' END AS magnitude
FROM lineitem GROUP BY l_suppkey""")
def a15_policy_edges(spark, d):
    return O.policy_edges(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag")


@query("""SELECT l_suppkey AS src, l_returnflag AS kind, l_partkey % 20 AS dst, count(*) AS n, array_to_string(list_sort(list_distinct(list(l_orderkey % 9))), ',') AS refs, arg_min(l_shipdate, (l_orderkey, l_linenumber, l_shipdate)) AS first FROM lineitem GROUP BY ALL""")
def a16_edge_merge(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_returnflag").alias("kind"), (F.col("l_partkey") % 20).alias("dst"), (F.col("l_orderkey") % 9).alias("ref"), "l_shipdate", "l_orderkey", "l_linenumber")
    return O.merge_edges(li, ["src", "kind", "dst"], "ref", "l_shipdate", ["l_orderkey", "l_linenumber", "l_shipdate"])


@query("WITH w AS (SELECT l_partkey, count(*) AS weight FROM lineitem GROUP BY l_partkey) SELECT l_partkey, weight, round(weight::DOUBLE / max(weight) OVER (), 6) AS salience FROM w")
def a17_salience(spark, d):
    return O.salience(table(spark, d, "lineitem"), "l_partkey")


@query(f"SELECT role, count(*) AS n, count(DISTINCT provision) AS n_provisions, round(sum(amount), 2) AS total FROM {sql_view('money')} GROUP BY role")
def a18_fiscal_effects(spark, d):
    return O.fiscal_effects(view(spark, d, "money"))


@query("""WITH m AS (SELECT source, lang, sum(n_chars) AS mat FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY mat DESC, source) AS k FROM m)
SELECT lang, CASE WHEN k <= 8 THEN source ELSE 'rest' END AS component, CAST(sum(mat) AS BIGINT) AS materiality, count(*) AS n FROM r GROUP BY lang, CASE WHEN k <= 8 THEN source ELSE 'rest' END""")
def k09_fold_rest(spark, d):
    m = table(spark, d, "documents").groupBy("source", "lang").agg(F.sum("n_chars").alias("mat"))
    return O.fold_rest(m, "lang", "source", "mat")


@query("SELECT c_custkey, c_name, n FROM (SELECT c_custkey, c_name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL) ORDER BY n DESC, c_name LIMIT 25")
def k01_k08_top(spark, d):
    return O.top_actors(table(spark, d, "customer"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "c_name", 25)


@query("""SELECT 'order_customer' AS rule, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'label_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')
UNION ALL SELECT 'duplicate_order', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
UNION ALL SELECT 'same_text', count(*) FROM (SELECT md5(text) FROM documents GROUP BY md5(text) HAVING count(*) > 1)""")
def o05_o06_j10_integrity(spark, d):
    o, docs = table(spark, d, "orders"), table(spark, d, "documents")
    parts = [
        O.dangling(o, "o_custkey", table(spark, d, "customer"), "c_custkey", "order_customer"), O.dangling(table(spark, d, "labels"), "doc_id", docs.where("lang = 'en'"), "doc_id", "label_document"),
        O.duplicated(o, "o_orderkey", "duplicate_order"), O.duplicated(docs.select(F.md5("text").alias("h")), "h", "same_text"),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("SELECT user_id, count(*) AS seen, count(*) FILTER (WHERE event_type = 'purchase') AS relevant, count(*) FILTER (WHERE value IS NULL) AS failed FROM events GROUP BY user_id")
def o07_scrape_counters(spark, d):
    return O.scrape_counters(table(spark, d, "events"), "user_id", F.col("event_type") == "purchase", F.col("value").isNull())


@query("SELECT conv_id, turn, CAST(conv_id AS BIGINT) AS a, 'x' AS b FROM conversations")
def q06_json_recovery(spark, d):
    body = F.concat(F.lit('{"a": '), F.col("conv_id").cast("string"), F.lit(', "b": "x"}'))
    wrapped = F.when(F.col("turn") % 3 == 0, body).when(F.col("turn") % 3 == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nend"))).otherwise(F.concat(F.lit("It is "), body, F.lit(" I think")))
    c = table(spark, d, "conversations").select("conv_id", "turn", O.json_from_text(wrapped, "a bigint, b string").alias("j"))
    return c.select("conv_id", "turn", "j.a", "j.b")


@query("SELECT o_orderkey, sha256('{\"o_custkey\":' || o_custkey || ',\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}') AS digest FROM orders")
def s10_o02_canonical_json(spark, d):
    return table(spark, d, "orders").select("o_orderkey", O.canonical_digest(["o_orderkey", "o_custkey", "o_orderstatus"]).alias("digest"))


@query("""SELECT a.event_id, b.event_id AS prev, CAST((epoch(a.ts) - epoch(b.ts)) AS BIGINT) AS gap_s FROM (SELECT *, lag(event_id) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) a
JOIN events b ON a.p = b.event_id WHERE epoch(a.ts) - epoch(b.ts) <= 10800""")
def y03_cascade_predecessor(spark, d):
    return O.cascade_predecessors(table(spark, d, "events"), "user_id", "ts", "event_id")


@query("SELECT id, name, 1::BIGINT AS n FROM " + REG + " WHERE id IN (3, 5) UNION ALL SELECT 999999, NULL, 0")
def f07_require(spark, d):
    found, missing = O.require(view(spark, d, "registry"), "id", [3, 5, 999_999])
    return found.select("id", "name", F.lit(1).cast("long").alias("n")).unionByName(missing.select("id", F.lit(None).cast("string").alias("name"), "n"))


@query(f"SELECT id, kind FROM {REG} WHERE kind IN (1, 2) AND id NOT IN (SELECT ps FROM (SELECT l_suppkey AS ps FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48))")
def f10_left_over(spark, d):
    """Registered sources of two kinds that no large return has covered."""
    done = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 48").select(F.col("l_suppkey").alias("id"))
    return O.left_over(view(spark, d, "registry"), "id", done, kind=[1, 2]).select("id", "kind")


@query(f"SELECT id, kind, length(label) AS score FROM {sql_view('nodes')} WHERE kind IN ('nation', 'region') ORDER BY score DESC, id LIMIT 12")
def k06_rank_nodes(spark, d):
    n = view(spark, d, "nodes").withColumn("score", F.length("label").cast("long"))
    return O.rank_nodes(n, "score", "id", ["nation", "region"], 12).select("id", "kind", "score")


@query(f"SELECT id, published_min FROM {sql_view('articles')} ORDER BY published_min DESC NULLS LAST, id LIMIT 100")
def k10_feed(spark, d):
    return O.feed(view(spark, d, "articles").select("id", "published_min"), "published_min", "id", 100)


@query("""SELECT l_orderkey AS run, arg_min(l_suppkey, (l_shipdate, l_linenumber, l_suppkey)) AS worker FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY l_orderkey""")
def o01_claim_queued(spark, d):
    """Open orders are queued runs, and each line asks for its order: the earliest shipped gets it."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.lit(1).alias("seq"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("state"))
    asked = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_suppkey").alias("worker"), "l_shipdate", "l_linenumber", "l_suppkey")
    return O.claim_queued(o, asked, ["l_shipdate", "l_linenumber", "l_suppkey"])


@query("""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS ref FROM documents) SELECT doc_id, ref, count(*) AS n, coalesce(ref IN (SELECT doc_id::VARCHAR FROM documents), false) AS known FROM r GROUP BY ALL""")
def q04_checked_references(spark, d):
    """The numbers in a text as references to documents: those that exist and those made up."""
    docs = table(spark, d, "documents")
    refs = docs.select("doc_id", F.explode_outer(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("ref")).where("ref is not null")
    return O.checked_references(refs, docs.select(F.col("doc_id").cast("string").alias("ref")), "ref").groupBy("doc_id", "ref", "known").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, true AS same, true AS in_range FROM conversations")
def q05_synthesised_values(spark, d):
    """Values made for a schema are the same when made again, and of their types."""
    c, schema = table(spark, d, "conversations"), {"name": "string", "size": "long", "share": "double", "open": "boolean"}
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    made = lambda n: F.struct(*O.synthesised(schema, key)).alias(n)
    m = c.select("conv_id", "turn", made("a")).join(c.select("conv_id", "turn", made("b")), ["conv_id", "turn"])
    return m.select("conv_id", "turn", (F.col("a") == F.col("b")).alias("same"), (F.col("a.share").between(0, 1) & F.startswith("a.name", F.lit("name-"))).alias("in_range"))


@query("""WITH p AS (SELECT doc_id, field, text FROM (SELECT doc_id, unnest(['lang', 'text']) AS field, unnest([lang, text]) AS text FROM documents) WHERE length(text) > 0)
SELECT CAST(floor(coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY field ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 2) AS BIGINT) AS batch, doc_id, field, length(text) AS size FROM p""")
def q08_translation_batches(spark, d):
    """The source is protected, language and text are to translate."""
    t = O.translation_batches(table(spark, d, "documents"), "doc_id", ["lang", "source", "text"], ["source"], 2)
    return t.select("batch", "doc_id", "field", F.length("text").cast("long").alias("size"))
