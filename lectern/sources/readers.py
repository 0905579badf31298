"""Sources: files of any kind, feeds, page markup, registries, evidence files, HTTP snapshots."""

from __future__ import annotations

from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

# Elements whose text isn't shown, and those that hold an article's text.
HIDDEN = frozenset({"script", "style", "noscript", "svg", "template", "nav", "footer", "header", "form", "aside"})
FOCUS = frozenset({"article", "main"})
FOCUS_LEAST = 40


def source_kind(value: Column) -> Column:
    """url, path or text, from the string alone."""
    v = F.trim(value)
    return F.when(v.rlike("(?i)^https?://"), "url").when(v.rlike(r"^(/|\./|\.\./|[A-Za-z]:\\|file:)") & ~F.contains(v, F.lit("\n")), "path").otherwise("text")


def read_files(spark: SparkSession, path: str, max_bytes: int = 64 << 20) -> DataFrame:
    """path, sha256, size and content of whole files; larger ones are listed without content."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = F.when(F.col("length") <= max_bytes, F.col("content"))
    return f.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), small.alias("content"), (F.col("length") > max_bytes).alias("too_large"))


class _Visible(HTMLParser):
    """Collects shown text, and apart from it what stands inside an article."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden = self.focus = 0
        self.shown: list[str] = []
        self.inner: list[str] = []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in HIDDEN
        self.focus += tag in FOCUS

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in HIDDEN))
        self.focus = max(0, self.focus - (tag in FOCUS))

    def handle_data(self, data):
        if not self.hidden:
            self.shown.append(data)
            if self.focus:
                self.inner.append(data)


def visible_text(markup: str | None) -> str:
    """All shown text, or an article's where that is long enough; the parser has resolved references."""
    parser = _Visible()
    parser.feed(markup or "")
    parser.close()
    inner, shown = (" ".join(" ".join(x).split()) for x in (parser.inner, parser.shown))
    return inner if len(inner) >= FOCUS_LEAST else shown


@F.pandas_udf(StringType())
def visible_text_udf(markup: pd.Series) -> pd.Series:
    return markup.map(visible_text)


ITEM = "title string, link string, description string, pubDate string, guid string"


def parse_feed(feeds: DataFrame, url_col: str, xml_col: str) -> DataFrame:
    """Items of RSS documents given as strings; documents with DOCTYPE or ENTITY, and broken ones, give none.

    A missing title falls back to the link.
    """
    safe = F.when(~F.col(xml_col).rlike("(?i)<!(DOCTYPE|ENTITY)"), F.col(xml_col))
    parsed = F.from_xml(safe, f"channel struct<item:array<struct<{', '.join(x.replace(' ', ':') for x in ITEM.split(', '))}>>>", {"mode": "PERMISSIVE"})
    items = feeds.select(F.col(url_col).alias("feed_url"), F.explode_outer(parsed.channel.item).alias("i")).where("i is not null")
    when = F.coalesce(F.try_to_timestamp(F.regexp_replace("i.pubDate", "^[A-Za-z]{3}, *", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp("i.pubDate"))
    link = F.trim("i.link")
    return items.where("i.link is not null").select("feed_url", link.alias("url"), F.coalesce(F.nullif(F.trim("i.title"), F.lit("")), link).alias("title"), F.col("i.description").alias("summary"), when.alias("published_at"))


def read_evidence(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON evidence file, and the lines that aren't any."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    rows = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return rows.where("r._bad is null").select("r.*").drop("_bad"), rows.where("r._bad is not null").select(F.col("value").alias("line"))


def write_evidence(rows: DataFrame, path: str) -> None:
    """One JSON object a line; the table is replaced when all of it is written."""
    rows.write.mode("overwrite").json(path)


def search_feeds(feeds: DataFrame, items: DataFrame, terms: list[str], least: float, bonus: float = 0.2) -> DataFrame:
    """(feed, item, score, gap): the items (feed, item, title, text) that hold enough of the terms, a hit in the title counting extra; feeds without items are recorded as gaps."""
    listed = F.array(*[F.lit(t) for t in terms])
    hits = lambda c: F.size(F.filter(listed, lambda t: F.contains(F.lower(c), t)))
    score = F.round(F.least(F.lit(1.0), hits("text") / len(terms) + F.when(hits("title") > 0, bonus).otherwise(0.0)), 4)
    scored = feeds.join(items.withColumn("score", score), "feed", "left")
    return scored.where((F.col("score") >= least) | F.col("item").isNull()).select("feed", "item", "score", F.when(F.col("item").isNull(), "no_items").alias("gap"))


def write_changed(rows: DataFrame, path: str, id_col: str) -> int:
    """Appends rows whose canonical JSON isn't stored yet; returns how many."""
    spark = rows.sparkSession
    cols = sorted(rows.columns)
    new = rows.withColumn("digest", F.sha2(F.to_json(F.struct(*cols)), 256)).dropDuplicates([id_col, "digest"])
    try:
        stored = spark.read.parquet(path).select(id_col, "digest")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = None
    if stored is not None:
        new = new.join(stored, [id_col, "digest"], "left_anti")
    observed = new.cache()
    n = observed.count()
    if n:
        observed.write.mode("append").parquet(path)
    observed.unpersist()
    return n


def load_registry(spark: SparkSession, entries: list[dict]) -> tuple[DataFrame, DataFrame]:
    """Registry entries, and the rejected ones with a reason: no id, a repeated id, or a reputation field."""
    seen, good, bad = set(), [], []
    for e in entries:
        key = e.get("id")
        reason = "no id" if not key else "repeated id" if key in seen else "reputation field" if {"reputation", "trust", "bias"} & e.keys() else None
        if reason:
            bad.append((str(key), reason))
        else:
            seen.add(key)
            good.append((key, e.get("kind"), e.get("tier"), e.get("language"), e.get("crawl_allowed"), list(e.get("feeds") or [])))
    return (
        spark.createDataFrame(good, "id string, kind string, tier int, language string, crawl_allowed boolean, feeds array<string>"),
        spark.createDataFrame(bad, "id string, reason string"),
    )


REPUTATION = ("reputation", "trust", "bias")


def check_registry(entries: DataFrame, order: str) -> DataFrame:
    """Adds the reason against each entry, null for a good one: no id, a repeated id (all but the first by `order`), or a reputation field."""
    k = F.row_number().over(Window.partitionBy("id").orderBy(order))
    held = [F.col(c).isNotNull() for c in REPUTATION if c in entries.columns]
    reputation = reduce(lambda a, b: a | b, held, F.lit(False))
    return entries.withColumn("reason", F.when(F.col("id").isNull() | (F.col("id") == ""), "no id").when(k > 1, "repeated id").when(reputation, "reputation field"))


def cached_response(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Stored responses by the hash of their url; misses stay with nulls."""
    return requests.withColumn("key", F.sha2("url", 256)).join(cache, "key", "left")


def mock_search(spark: SparkSession, query: str, n: int = 10) -> DataFrame:
    """Deterministic stand-in results for a query."""
    r = spark.range(n).select(F.sha2(F.concat(F.lit(query), F.col("id").cast("string")), 256).alias("h"), "id")
    return r.select(F.concat(F.lit("https://example.org/"), F.substring("h", 1, 12)).alias("url"), F.concat(F.lit(query), F.lit(" "), F.col("id").cast("string")).alias("title"), (1 / (1 + F.col("id"))).alias("score"))


def null_search(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "url string, title string, score double")


def valid_records(rows: DataFrame, json_col: str, schema: str, required: list[str]) -> DataFrame:
    """The first fault of each JSON record by path, null if there is none."""
    parsed = F.from_json(json_col, schema)
    faults = [F.when(parsed.isNull() | F.col(json_col).isNull(), "$: no object")] + [F.when(parsed[c].isNull(), f"$.{c}: missing or of another type") for c in required]
    return rows.withColumn("fault", F.coalesce(*faults))
