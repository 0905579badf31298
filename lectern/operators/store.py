"""Stored rows: filters, histories, upserts, deduplication, registries, integrity checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators.graph import cut_lineage
from lectern.operators.matcher import matches


def language_matches(tag: Column, wanted: str) -> Column:
    """A bare tag matches its variants, a full one only itself."""
    return tag == wanted if "-" in wanted else F.split_part(tag, F.lit("-"), F.lit(1)) == wanted


def select_sources(registry: DataFrame, **wanted) -> DataFrame:
    """Conjunction of criteria; a list means any of its values."""
    tests = [F.col(k).isin(*v) if isinstance(v, (list, tuple)) else F.col(k) == v for k, v in wanted.items()]
    return registry.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def retrievable(enabled: Column, has_url: Column, crawl: Column) -> Column:
    """Enabled, with a url, and known to allow crawling: unknown is not allowed."""
    return enabled & has_url & F.coalesce(crawl, F.lit(False))


def within_bounds(value: Column, lo, hi) -> Column:
    """Unknown values pass."""
    return value.isNull() | ((value >= lo) & (value <= hi))


def newest(df: DataFrame, order: str, tie: str, limit: int) -> DataFrame:
    return df.orderBy(F.desc(order), tie).limit(max(1, min(limit, 500)))


def latest_by(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The whole row with the greatest order per key, by an aggregation that combines early."""
    cols = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in cols])


def history(runs: DataFrame, document: str, created: str, run: str) -> DataFrame:
    """Position of each run of a document and the run it supersedes."""
    w = Window.partitionBy(document).orderBy(created, run)
    return runs.select(document, run, F.row_number().over(w).cast("long").alias("version"), F.lag(run).over(w).alias("supersedes"))


def upsert_seen(observations: DataFrame, url: str, ts: str, value: str) -> DataFrame:
    """First and last sight, number of sights, and the last value (greatest of ties)."""
    return observations.groupBy(url).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count("*").alias("n"), F.max_by(value, F.struct(F.col(ts), F.col(value))).alias("last_value"))


def new_content(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose content isn't stored yet, once each."""
    return incoming.dropDuplicates(keys).join(stored.select(*keys).distinct(), keys, "left_anti")


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def merge_groups(df: DataFrame, keys: list[str], id_col: str, set_col: str) -> DataFrame:
    """One row per key: least id, union of the sets in order, size."""
    return df.groupBy(*keys).agg(F.min(id_col).alias(id_col), F.array_sort(F.array_distinct(F.flatten(F.collect_list(set_col)))).alias(set_col), F.count("*").alias("n"))


def coverage_summary(registry: DataFrame) -> DataFrame:
    """Counts in one pass: over all, and by tier and by kind (grouping sets)."""
    agg = [F.count("*").alias("n"), F.count_if(F.col("enabled")).alias("n_enabled"), F.count_if(F.col("verified")).alias("n_verified"), F.count_if(retrievable(F.col("enabled"), F.col("has_url"), F.col("crawl_allowed"))).alias("n_retrievable")]
    g = registry.groupingSets([[F.col("tier")], [F.col("kind")], []], F.col("tier"), F.col("kind")).agg(*agg, F.grouping_id().alias("gid"))
    return g.select(F.when(F.col("gid") == 1, "tier").when(F.col("gid") == 2, "kind").otherwise("all").alias("dimension"), F.coalesce("tier", "kind").alias("value"), "n", "n_enabled", "n_verified", "n_retrievable")


def dangling(child: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """References without a target."""
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti").groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")


def duplicated(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).count().where("count > 1").groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")


def floor_groups(df: DataFrame, keys: list[str], measure: str, least: int = 5, top: int = 6) -> DataFrame:
    """Groups of at least `least`, the largest `top` of them in order."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(measure).alias("total")).where(F.col("n") >= least)
    return g.orderBy(F.desc("n"), *keys).limit(top)


def json_from_text(text: Column, schema: str) -> Column:
    """An object out of free text: the whole, a fenced block, or what stands between the outer braces."""
    whole = F.from_json(text, schema)
    fenced = F.from_json(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), schema)
    braces = F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema)
    ok = lambda c: F.when(F.to_json(c) != "{}", c)
    return F.coalesce(ok(whole), ok(fenced), ok(braces))


# --- lookups and orders --------------------------------------------------------

def evidence_for(evidence: DataFrame, claim: int | None = None, tiers: list | None = None, source: str | None = None, relation: str = "either") -> DataFrame:
    """Evidence of a claim, of classes or of a source, with its relation to the claim; `relation` keeps one of them."""
    tests = [F.col("claim_id") == claim] * (claim is not None) + ([F.col("tier").isin(*tiers)] if tiers else []) + ([F.col("source") == source] if source else [])
    e = evidence.where(reduce(lambda a, b: a & b, tests, F.lit(True))).withColumn("relation", F.when(F.col("contradicts"), "contradicts").otherwise("supports"))
    return e if relation == "either" else e.where(F.col("relation") == relation)


def require(df: DataFrame, key: str, wanted: list) -> tuple[DataFrame, DataFrame]:
    """The rows with the wanted ids, and the ids that have none or several (id, n)."""
    ids = df.sparkSession.createDataFrame([(w,) for w in wanted], df.select(key).schema)
    counted = ids.join(df.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return df.join(ids, key, "left_semi"), counted.where("n <> 1")


def left_over(items: DataFrame, key: str, evaluated: DataFrame, **wanted) -> DataFrame:
    """Items of the wanted kinds that no evaluation has covered."""
    return select_sources(items, **wanted).join(evaluated.select(key).distinct(), key, "left_anti")


def feed(items: DataFrame, published: str, tie: str, limit: int) -> DataFrame:
    """Newest first, undated last, at most `limit`."""
    return items.orderBy(F.desc_nulls_last(published), tie).limit(limit)


def rank_nodes(nodes: DataFrame, score: str, id_col: str, kinds: list[str] | None, limit: int) -> DataFrame:
    n = nodes.where(F.col("kind").isin(*kinds)) if kinds else nodes
    return n.orderBy(F.desc(score), id_col).limit(limit)


def topic_coverage(docs: DataFrame, source: str, text_col: str, topics: DataFrame) -> DataFrame:
    """(topic, n_sources, n_docs): sources and keywords met in their texts, by topic (topic, keyword); all topics."""
    found = matches(docs.select(source, F.lower(text_col).alias("t")), "t", topics.select(F.col("keyword").alias("pattern")), keep="first")
    hits = found.join(topics.withColumnRenamed("keyword", "pattern"), "pattern")
    return hits.groupBy("topic").agg(F.countDistinct(source).alias("n_sources"), F.count("*").alias("n_docs"))


def query_terms(text: Column) -> Column:
    """Different words of three letters or more, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0)))


def runs_with_documents(runs: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    return runs.join(documents, key)


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, value) of several columns in one pass."""
    parts = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(parts).alias("p")).select("p.dimension", "p.value").distinct()


def track_record(claims: DataFrame, actor: str, verdict: str, made: str, judged: str) -> DataFrame:
    """Counts by verdict of each actor's claims; attributions later than their verdict don't count."""
    c = claims.where(F.col(made) <= F.col(judged))
    counts = c.groupBy(actor, verdict).agg(F.count("*").alias("k"), F.min(made).alias("first"), F.max(made).alias("last"))
    named = F.transform(F.array_sort(F.collect_list(F.struct(verdict, "k"))), lambda x: F.concat_ws(":", x[verdict].cast("string"), x.k.cast("string")))
    return counts.groupBy(actor).agg(F.sum("k").alias("n"), F.array_join(named, "|").alias("verdicts"), F.min("first").alias("first"), F.max("last").alias("last"))


def independent_sources(evidence: DataFrame, group: str) -> DataFrame:
    free = F.when(~F.col("restating") & ~F.col("derived"), F.col("source"))
    return evidence.groupBy(group).agg(F.countDistinct(free).alias("n_independent"), F.count("*").alias("n"))


def signal_groups(pairs: DataFrame, kind: str, id_col: str, strength: str) -> DataFrame:
    """Size, strongest exemplar (least id of equals) and mean strength of each kind of signal."""
    return pairs.groupBy(kind).agg(F.count("*").alias("n"), F.max_by(id_col, F.struct(strength, -F.col(id_col))).alias("exemplar"), F.round(F.avg(strength), 3).alias("similarity"))


def policy_edges(links: DataFrame, source: str, direction: str) -> DataFrame:
    """Direction if it is the only one, else mixed; magnitude by the number of links."""
    n = F.count("*")
    return links.groupBy(source).agg(F.when(F.countDistinct(direction) == 1, F.min(direction)).otherwise("mixed").alias("direction"), F.when(n == 1, "small").when(n <= 3, "medium").otherwise("large").alias("magnitude"))


def merge_edges(edges: DataFrame, keys: list[str], ref: str, value: str, order: list[str]) -> DataFrame:
    """One edge per key: how often, all references, the first value."""
    g = edges.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(ref)).alias("refs"), F.min_by(value, F.struct(*order)).alias("first"))
    return g.withColumn("refs", F.array_join(F.transform("refs", lambda x: x.cast("string")), ","))


def salience(mentions: DataFrame, node: str) -> DataFrame:
    """Weight of each node over the greatest."""
    w = mentions.groupBy(node).agg(F.count("*").alias("weight"))
    return w.crossJoin(F.broadcast(w.agg(F.max("weight").alias("most")))).select(node, "weight", F.round(F.col("weight") / F.col("most"), 6).alias("salience"))


def fiscal_effects(money: DataFrame) -> DataFrame:
    return money.groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("provision").alias("n_provisions"), F.round(F.sum("amount"), 2).alias("total"))


def top_actors(actors: DataFrame, mentions: DataFrame, key: str, name: str, limit: int) -> DataFrame:
    """Actors by their number of mentions, then name; those without any too."""
    n = mentions.groupBy(key).agg(F.count("*").alias("n"))
    return actors.join(n, key, "left").select(key, name, F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), name).limit(limit)


def fold_rest(components: DataFrame, group: str, name: str, materiality: str, top: int = 8) -> DataFrame:
    """The `top` components by materiality; the rest as one."""
    k = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(materiality), name))
    c = components.withColumn("component", F.when(k <= top, F.col(name)).otherwise("rest"))
    return c.groupBy(group, "component").agg(F.sum(materiality).alias("materiality"), F.count("*").alias("n"))


def distinct_spans(spans: DataFrame, page: str, at: str, text: str) -> DataFrame:
    return spans.dropDuplicates([page, at, text])


def set_operations(a: DataFrame, b: DataFrame) -> DataFrame:
    """(op, n) of union, intersection and difference, from one full join of the distinct rows."""
    keys = a.columns
    m = a.distinct().withColumn("__a", F.lit(1)).join(b.distinct().withColumn("__b", F.lit(1)), keys, "full")
    counts = m.agg(F.count("*").alias("union"), F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("intersect"), F.count_if(F.col("__b").isNull()).alias("except"))
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("op"), F.col(k).alias("n")) for k in ("union", "intersect", "except")])).alias("x")).select("x.op", "x.n")


def create_or_get(incoming: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(fingerprint, document, n): the least id stands for all with the same content."""
    return incoming.groupBy(F.md5(text_col).alias("fingerprint")).agg(F.min(id_col).alias("document"), F.count("*").alias("n"))


def claim_queued(states: DataFrame, requests: DataFrame, order: list[str]) -> DataFrame:
    """(run, worker): compare and set for many at once: of the requests for a run whose latest state is queued, the first wins.

    states: run, seq, state; requests: run, worker and the columns of `order`.
    """
    queued = latest_by(states, ["run"], F.col("seq")).where("state = 'queued'").select("run")
    return requests.join(queued, "run", "left_semi").groupBy("run").agg(F.min_by("worker", F.struct(*order)).alias("worker"))


def scrape_counters(observations: DataFrame, key: str, relevant: Column, failed: Column) -> DataFrame:
    return observations.groupBy(key).agg(F.count("*").alias("seen"), F.count_if(relevant).alias("relevant"), F.count_if(failed).alias("failed"))


def canonical_digest(columns: list[str]) -> Column:
    """Digest of the row as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def cascade_predecessors(events: DataFrame, key: str, ts: str, id_col: str, minutes: int = 180) -> DataFrame:
    """Events with the one before of the same key, if it is near enough."""
    w = Window.partitionBy(key).orderBy(ts, id_col)
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withColumn("prev", F.lag(id_col).over(w)).withColumn("__p", F.lag(ts).over(w))
    gap = F.unix_micros(ts) / 1e6 - F.unix_micros("__p") / 1e6
    return e.where(F.col("prev").isNotNull() & (gap <= minutes * 60)).select(id_col, "prev", F.round(gap).cast("long").alias("gap_s"))


def hashed_bytes(df: DataFrame, id_col: str, content: str) -> DataFrame:
    return df.select(id_col, F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("size"))


def topic_graph(provisions: DataFrame, party: str, provision: str, support: DataFrame) -> DataFrame:
    """(id, kind, confidence) of provision and party nodes: half, and a little more for each further support or provision."""
    sure = lambda n: F.round(0.5 + F.least(F.lit(0.08), 0.02 * (n - 1)), 6)
    node = lambda head, c: F.concat(F.lit(f"{head}:"), F.col(c).cast("string")).alias("id")
    s = support.groupBy(provision).agg(F.count("*").alias("n"))
    p = provisions.join(s, provision, "left").select(node("o", provision), F.lit("provision").alias("kind"), sure(F.coalesce("n", F.lit(0))).alias("confidence"))
    c = provisions.groupBy(party).agg(F.count("*").alias("n")).select(node("c", party), F.lit("party").alias("kind"), sure(F.col("n")).alias("confidence"))
    return p.unionByName(c)


def coverage_by(items: DataFrame, group: str, covered: Column) -> DataFrame:
    n, k = F.count("*"), F.count_if(covered)
    return items.groupBy(group).agg(n.alias("provisions"), k.alias("covered"), F.round(k / n, 6).alias("coverage"))


def claim_history(claims: DataFrame, actor: str, no: str, words: Column, negated: Column, least: float = 0.4) -> DataFrame:
    """Earlier claims of the same actor that share enough words, and whether they differ in polarity.

    Claims meet on shared words, so those of an actor that share none make no pair.
    """
    c = claims.select(actor, no, words.alias("w"), negated.alias("neg"))
    flat = c.select(actor, no, "neg", F.size("w").alias("n"), F.explode_outer("w").alias("t")).where("t is not null")
    a, b = flat.toDF(actor, no, "neg", "n", "t"), flat.select(actor, F.col(no).alias("prior"), F.col("neg").alias("neg_b"), "t")
    m = a.join(b, [actor, "t"]).where(F.col("prior") < F.col(no)).groupBy(actor, no, "prior").agg(F.count("*").alias("both"), F.first("n").alias("n"), (F.first("neg") != F.first("neg_b")).alias("contradicts"))
    return m.where(F.col("both") / F.col("n") >= least).select(actor, no, "prior", "contradicts")


def checked_references(refs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """References of a generated text with whether each names something known: what a synthesis may keep."""
    known = ids.select(key).distinct().withColumn("known", F.lit(True))
    return refs.join(known, key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def synthesised(schema: dict[str, str], key: Column) -> list[Column]:
    """Deterministic stand-in values for a flat schema (name: string, long, double or boolean), from a hash of the key and the name."""
    h = lambda name: F.pmod(F.xxhash64(key, F.lit(name)), F.lit(1000))
    made = {"string": lambda n: F.concat(F.lit(f"{n}-"), h(n).cast("string")), "long": h, "double": lambda n: h(n) / 1000, "boolean": lambda n: h(n) % 2 == 0}
    return [made[kind](name).alias(name) for name, kind in schema.items()]


def translation_batches(rows: DataFrame, id_col: str, fields: list[str], protected: list[str], size: int) -> DataFrame:
    """(batch, id, field, text) of the fields to translate, protected and empty ones left out, at most `size` characters a batch of one id."""
    free = [f for f in fields if f not in protected]
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in free])
    t = rows.select(id_col, F.explode(parts).alias("p")).select(id_col, "p.field", "p.text").where(F.length("text") > 0)
    run = F.sum(F.length("text")).over(Window.partitionBy(id_col).orderBy("field").rowsBetween(Window.unboundedPreceding, -1))
    return t.select(F.floor(F.coalesce(run, F.lit(0)) / size).cast("long").alias("batch"), id_col, "field", "text")


def insert(stored: DataFrame, incoming: DataFrame, id_col: str, key: str, policy: str = "skip") -> tuple[DataFrame, DataFrame]:
    """New rows to store, and what was refused (id, key, reason), for rows with an id and a fingerprint.

    Of incoming rows with one fingerprint the least id counts. An id that is
    stored under another fingerprint, or comes with several, is a collision and
    always refused. A fingerprint that is stored already is left out in silence
    (skip), refused as a duplicate (reject), or comes back under the stored id to
    be merged with it (merge).
    """
    if policy not in ("merge", "skip", "reject"):
        raise ValueError("policy is one of merge, skip, reject")
    own, i, k = incoming.columns, F.col(id_col), F.col(key)
    held = stored.groupBy(F.col(key)).agg(F.min(id_col).alias("__held"))
    taken = stored.groupBy(F.col(id_col)).agg(F.min(key).alias("__as"), F.max(key).alias("__as_too"))
    several = incoming.groupBy(id_col).agg(F.min(key).alias("__lo"), F.max(key).alias("__hi"))
    rows = incoming.join(held, key, "left").join(taken, id_col, "left").join(several, id_col)
    collides = F.coalesce((F.col("__as") != k) | (F.col("__as_too") != k), F.lit(False)) | (F.col("__lo") != F.col("__hi"))
    rows = cut_lineage(rows.withColumn("__collides", collides))
    good = rows.where("not __collides")
    first = F.row_number().over(Window.partitionBy(key).orderBy(id_col)) == 1
    new = good.where("__held is null").withColumn("__first", first).where("__first").select(*own)
    refused = rows.where("__collides").select(i, k, F.lit("collision").alias("reason"))
    known = good.where("__held is not null")
    if policy == "merge":
        new = new.unionByName(known.withColumn(id_col, F.col("__held")).select(*own))
    if policy == "reject":
        refused = refused.unionByName(known.select(i, k, F.lit("duplicate").alias("reason")))
    return new, refused
