"""Actors: names that mean one person, affiliations, mentions, pages, cards, usage."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lectern.functions import text as T
from lectern.functions.arrays import bound
from lectern.operators.matcher import matches

# Titles before a name, and how alike two spellings must be.
TITLES = ("mr", "mrs", "ms", "dr", "sr", "sra", "don", "senator", "minister")
LEAST_RATIO = 0.92
LEAST_ALIAS = 5


def person_key(name: Column) -> Column:
    """Folded words without titles and punctuation."""
    words = F.filter(F.split(F.trim(F.regexp_replace(T.fold(name), r"[^a-z0-9# ]+", " ")), r"\s+"), lambda w: (w != "") & ~w.isin(*TITLES))
    return F.array_join(words, " ")


@F.pandas_udf(DoubleType())
def spelling_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def canonical_names(mentions: DataFrame, name: str, known: DataFrame, display: str) -> DataFrame:
    """(name, canonical) for each distinct mentioned name.

    An equal known name, else the only one that ends with the mentioned words,
    else the only one with the same first word and number of words that is
    spelled at least LEAST_RATIO alike; without any the name stands for itself.
    Endings join on each suffix of the known names, spellings on first word and
    length: names meet only those of their own block.
    """
    m = mentions.select(F.col(name).alias("name")).distinct().withColumn("key", person_key(F.col("name")))
    k = known.select(F.col(display).alias("canonical")).distinct().withColumn("known", person_key(F.col("canonical")))
    words = F.split("known", " ")
    suffixes = k.select("canonical", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), " "))).alias("key"), "known")
    only = lambda df: df.groupBy("name").agg(F.min("canonical").alias("canonical"), F.count("*").alias("n")).where("n = 1").drop("n")
    equal = m.join(k, m.key == k.known).groupBy("name").agg(F.min("canonical").alias("equal"))
    ends = only(m.join(suffixes, "key").select("name", "canonical").distinct()).withColumnRenamed("canonical", "ends")
    left = m.join(equal, "name", "left_anti").join(ends, "name", "left_anti")
    head = lambda c: (F.split_part(c, F.lit(" "), F.lit(1)).alias("head"), F.size(F.split(c, " ")).alias("size"))
    near = left.select("name", "key", *head(F.col("key"))).where("size >= 2").join(k.select("canonical", "known", *head(F.col("known"))), ["head", "size"])
    near = near.where(F.abs(F.length("key") - F.length("known")) <= (1 - LEAST_RATIO) * (F.length("key") + F.length("known")))
    alike = only(near.where(spelling_ratio("known", "key") >= LEAST_RATIO).select("name", "canonical")).withColumnRenamed("canonical", "alike")
    out = m.select("name").join(equal, "name", "left").join(ends, "name", "left").join(alike, "name", "left")
    return out.select("name", F.coalesce("equal", "ends", "alike", "name").alias("canonical"))


def merge_aliases(mentions: DataFrame, name: str, names: DataFrame) -> DataFrame:
    """(canonical, n, spellings): mentions counted by the name they stand for."""
    counted = mentions.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n"))
    m = counted.join(names, "name")
    return m.groupBy("canonical").agg(F.sum("n").alias("n"), F.array_sort(F.collect_set("name")).alias("spellings"))


def affiliations(actors: DataFrame, key: str, verified: DataFrame, reported: DataFrame, applies: Column) -> DataFrame:
    """(key, affiliation): not applicable, verified, reported or not documented, the first that holds."""
    flag = lambda df, n: df.select(key).distinct().withColumn(n, F.lit(True))
    a = actors.withColumn("__applies", applies).join(flag(verified, "__v"), key, "left").join(flag(reported, "__r"), key, "left")
    state = F.when(~F.col("__applies"), "not_applicable").when(F.col("__v"), "verified").when(F.col("__r"), "reported").otherwise("not_documented")
    return a.select(key, state.alias("affiliation"))


def alias_containment(texts: DataFrame, id_col: str, text_col: str, aliases: DataFrame, alias_id: str, alias: str, least: int = LEAST_ALIAS) -> DataFrame:
    """(id, alias id) where a text contains an alias of at least `least` letters, without regard to case and accents; all aliases."""
    a = aliases.where(F.length(alias) >= least).select(alias_id, T.fold(F.col(alias)).alias("pattern"))
    found = matches(texts.select(id_col, T.fold(F.col(text_col)).alias("t")), "t", a, keep="first")
    return found.join(a, "pattern").select(id_col, alias_id)


def page_anchors(pages: DataFrame, id_col: str, text_col: str, keywords: list[str], before: int = 55, length: int = 225) -> DataFrame:
    """The first keyword of the list that a page has, where it stands and what stands around it."""
    low = F.lower(text_col)
    kw = F.coalesce(*[F.when(F.contains(low, F.lit(k)), k) for k in keywords])
    p = pages.select(id_col, F.col(text_col).alias("t"), kw.alias("kw")).where("kw is not null").withColumn("at", F.expr("instr(lower(t), kw)").cast("long"))
    return p.select(id_col, "kw", "at", F.substring(F.col("t"), F.greatest(F.lit(1), (F.col("at") - before).cast("int")), F.lit(length)).alias("excerpt"))


def quote_window(text: Column, wanted: Column, size: int = 12) -> Column:
    """The run of `size` words that shares most words with `wanted`, the first of equals; start (from 1), hits and text."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def best(hit: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(hit) - size + 1))
        return F.array_max(F.transform(starts, lambda i: F.struct(F.aggregate(F.slice(hit, i, F.lit(size)), F.lit(0), lambda a, x: a + x).alias("hits"), (-i).alias("order"))))

    def window(ws: Column) -> Column:
        hit = F.transform(ws, lambda w: F.array_contains(wanted, F.regexp_replace(T.fold(w), "[^a-z0-9]", "")).cast("int"))
        quote = lambda b: F.struct((-b["order"]).alias("start"), b["hits"].alias("hits"), F.array_join(F.slice(ws, -b["order"], F.lit(size)), " ").alias("quote"))
        return bound(bound(hit, best), quote)

    return bound(words, window)


def feed_cards(rows: DataFrame, group: str, kind: str, kinds: list[str]) -> DataFrame:
    """Counts of each kind in a fixed order, and how many kinds occur at all; one pass."""
    return rows.groupBy(group).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds], F.countDistinct(kind).alias("n_kinds"))


def usage(calls: DataFrame, batch: str, side: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Words sent and received of each batch of calls, and their sums with the number of batches."""
    n = F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+"), lambda w: w != ""))
    b = calls.groupBy(batch).agg(F.sum(F.when(F.col(side) == "user", n).otherwise(0)).alias("prompt"), F.sum(F.when(F.col(side) != "user", n).otherwise(0)).alias("completion"))
    return b, b.agg(F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.sum(F.col("prompt") + F.col("completion")).alias("total"), F.count("*").alias("batches"))


def affected_groups(provisions: DataFrame, id_col: str, text_col: str, signals: dict[str, str], declared: Column) -> DataFrame:
    """(grp, n_provisions, n): populations that provisions declare or whose signal words they hold."""
    t = T.fold(F.coalesce(F.col(text_col), F.lit("")))
    found = F.array_compact(F.array(declared, *[F.when(t.rlike(p), F.lit(g)) for g, p in signals.items()]))
    g = provisions.select(F.col(id_col).alias("provision"), F.explode(F.array_distinct(found)).alias("grp"))
    return g.groupBy("grp").agg(F.countDistinct("provision").alias("n_provisions"), F.count("*").alias("n"))
