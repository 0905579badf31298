"""Queries of the sources and of the incremental operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.graph import shared_folder
from lectern.operators.store import hashed_bytes
from lectern.plans._query import query, table
from lectern.sources import readers as R
from lectern.streaming import observations as O


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'url' WHEN 1 THEN 'path' ELSE 'text' END AS kind FROM pages""")
def s01_source_kind(spark, d):
    p = table(spark, d, "pages")
    v = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.lit("/data/x.txt")).otherwise(F.concat(F.lit("say: "), "url"))
    return p.select("page_id", R.source_kind(v).alias("kind"))


@query("SELECT page_id, sha256(html) AS sha256, CAST(strlen(html) AS BIGINT) AS size FROM pages")
def s02_hashed_bytes(spark, d):
    return hashed_bytes(table(spark, d, "pages"), "page_id", "html")


@query("SELECT page_id, url, 'About ' || page_id AS title, 'S' AS summary, make_timestamp(2024, 3, page_id % 28 + 1, 10, 0, 0) AS published_at FROM pages")
def s06_feeds(spark, d):
    """A feed of one item is made from every page and parsed back."""
    day = F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0")
    item = F.concat(F.lit("<item><title>About "), F.col("page_id").cast("string"), F.lit("</title><link>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</link><description>S</description><pubDate>2024-03-"), day, F.lit("T10:00:00Z</pubDate></item>"))
    xml = F.concat(F.lit("<rss><channel>"), item, F.lit("</channel></rss>"))
    feeds = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("feed_url"), xml.alias("xml"))
    f = R.parse_feed(feeds, "feed_url", "xml")
    return f.select(F.col("feed_url").cast("long").alias("page_id"), "url", "title", "summary", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


@query()
def s07_visible_text(spark, d):
    return table(spark, d, "pages").select("page_id", R.visible_text_udf("html").alias("text"))


@query("SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '$: no object' WHEN turn % 4 = 2 THEN '$.b: missing or of another type' END AS fault FROM conversations")
def s11_record_validation(spark, d):
    j = F.when(F.col("turn") % 4 == 3, F.lit(None).cast("string")).when(F.col("turn") % 4 == 2, F.lit('{"a": 1}')).otherwise(F.lit('{"a": 1, "b": "x"}'))
    c = table(spark, d, "conversations").select("conv_id", "turn", j.alias("j"))
    return R.valid_records(c, "j", "a bigint, b string", ["a", "b"]).select("conv_id", "turn", "fault")


@query("""WITH c AS (SELECT url, md5(html) AS sha FROM pages WHERE length(html) > 2000), k AS (SELECT url, min(sha) AS sha FROM c GROUP BY url)
SELECT page_id, lower(regexp_extract(p.url, '://([^/?#]*)', 1)) AS host, k.sha AS response, k.url IS NOT NULL AS cached FROM pages p LEFT JOIN k ON p.url = k.url""")
def s12_http_cache(spark, d):
    """Long pages have been fetched before: their urls answer from the cache, the least response of several."""
    p = table(spark, d, "pages")
    cache = p.where(F.length("html") > 2000).groupBy(F.sha2("url", 256).alias("key")).agg(F.min(F.md5("html")).alias("response"))
    r = R.cached_response(p.select("page_id", "url"), cache)
    return r.select("page_id", T.host(F.col("url")).alias("host"), "response", F.col("response").isNotNull().alias("cached"))


_TERMS = ["the", "license", "und"]


@query("""WITH f AS (SELECT source AS feed, doc_id AS item, split_part(text, chr(10), 1) AS title, text FROM documents),
s AS (SELECT feed, item, round(least(1, len(list_filter(['the', 'license', 'und'], lambda t: contains(lower(text), t))) / 3.0 + CASE WHEN len(list_filter(['the', 'license', 'und'], lambda t: contains(lower(title), t))) > 0 THEN 0.2 ELSE 0 END), 4) AS score FROM f WHERE length(text) > 0)
SELECT r.name AS feed, item, score, CASE WHEN item IS NULL THEN 'no_items' WHEN score < 0.5 THEN 'off_topic' END AS gap FROM (SELECT DISTINCT source AS name FROM documents UNION ALL SELECT 'dead') r LEFT JOIN s ON r.name = s.feed WHERE score >= 0.5 OR item IS NULL""")
def s13_feed_provider(spark, d):
    """Sources are feeds, and one feed has no items: items are scored against the query's terms, empty feeds are gaps."""
    items = table(spark, d, "documents").where("length(text) > 0").select(F.col("source").alias("feed"), F.col("doc_id").alias("item"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), "text")
    feeds = items.select("feed").union(table(spark, d, "documents").select("source")).distinct().union(spark.createDataFrame([("dead",)], "feed string"))
    return R.search_feeds(feeds, items, _TERMS, 0.5)


@query("""SELECT s_suppkey, CASE WHEN s_name LIKE '%1' THEN 'no id' WHEN row_number() OVER (PARTITION BY CASE WHEN s_name LIKE '%1' THEN NULL WHEN s_name LIKE '%7' THEN left(s_name, 17) ELSE s_name END ORDER BY s_suppkey) > 1 THEN 'repeated id'
WHEN s_acctbal < 0 THEN 'reputation field' END AS reason FROM supplier""")
def s08_registry(spark, d):
    """Suppliers as registry entries: some without an id, some that share one, and debtors with a trust field."""
    name = F.col("s_name")
    entry = F.when(~F.endswith(name, F.lit("1")), F.when(F.endswith(name, F.lit("7")), F.left(name, F.lit(17))).otherwise(name))
    e = table(spark, d, "supplier").select("s_suppkey", entry.alias("id"), F.when(F.col("s_acctbal") < 0, F.col("s_acctbal")).alias("trust"))
    return R.check_registry(e, "s_suppkey").select("s_suppkey", "reason")


@query("SELECT doc_id, sha256(text) AS sha, true AS same FROM documents")
def s09_evidence_file(spark, d):
    """Evidence saved as JSON and read back."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    path = f"{shared_folder(spark)}/evidence-{uuid.uuid4().hex}"
    R.write_evidence(docs, path)
    rows, bad = R.read_evidence(spark, path, "doc_id long, text string")
    back = rows.select("doc_id", F.sha2("text", 256).alias("sha"))
    return back.join(docs.select("doc_id", F.sha2("text", 256).alias("was")), "doc_id").select("doc_id", "sha", (F.col("sha") == F.col("was")).alias("same"))


@query()
def s14_mock_provider(spark, d):
    return R.mock_search(spark, "budget", 10).unionByName(R.null_search(spark))


def _stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(d)


def _name():
    return "s" + uuid.uuid4().hex


@query("SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY user_id")
def y02_streamed_first_last_seen(spark, d):
    with O.state_store(spark):
        return O.drained(O.seen(_stream(spark, d), "user_id", "ts", "event_id"), _name(), "update", key="user_id")


@query("SELECT event_type, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type")
def y01_streamed_deduplication(spark, d):
    s = O.first_copies(_stream(spark, d).select("ts", "user_id", "event_type"), ["user_id", "event_type"], "ts")
    once = O.drained(s, _name(), "append")
    return once.groupBy("event_type").agg(F.countDistinct("user_id").alias("n_users"))


@query("SELECT event_type, CAST(floor(epoch(ts) / 129600) AS BIGINT) AS slot, count(*) AS n FROM events GROUP BY ALL")
def y04_streamed_windows(spark, d):
    w = O.event_windows(_stream(spark, d), "ts", ["event_type"])
    out = O.drained(w, _name(), "complete")
    return out.select("event_type", (F.unix_seconds("window.start") / 129600).cast("long").alias("slot"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 10800 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, count(DISTINCT s) AS n_sessions, count(*) AS n FROM s GROUP BY user_id""")
def y03_streamed_sessions(spark, d):
    out = O.drained(O.sessions(_stream(spark, d), "ts", "user_id"), _name(), "complete")
    return out.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n"))


@query("""SELECT a.event_id AS copy, b.event_id AS origin, CAST(floor(epoch(a.ts)) - floor(epoch(b.ts)) AS BIGINT) AS gap_s FROM (SELECT *, lag(event_id) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) a
JOIN events b ON a.p = b.event_id WHERE epoch(a.ts) - epoch(b.ts) <= 10800""")
def y03_streamed_cascades(spark, d):
    """Both sides are the same events: every one may be a copy, and the origin of later ones."""
    pairs = O.cascade_pairs(_stream(spark, d), _stream(spark, d), "user_id", "ts", "event_id")
    return O.predecessors(O.drained(pairs, _name(), "append"))


@query("""SELECT event_id, user_id AS host FROM (SELECT event_id, user_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) WHERE gap < 600""")
def y05_rate_limit(spark, d):
    """Every user is a host, with ten minutes between requests."""
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("host"), "ts")
    return O.rate_violations(e, "host", "ts", 600, "event_id").select("event_id", "host")
