"""Search vocabulary of a document, its profile, and types of propositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as T
from lectern.functions.arrays import spread
from lectern.functions.tokens import TOPIC_STOPWORDS
from lectern.operators.blocks import union_all
from lectern.operators.claims import MARKERS, cue, language_votes
from lectern.operators.numbers import quantities
from lectern.operators.propositions import CUES, modality

# The ten sets of terms, the earlier one keeps a term that several have; base weights by set.
SETS = ("official_names", "common_names", "identifiers", "abbreviations", "political_terminology", "technical_terminology", "sector_terminology", "synonyms", "provision_names", "actor_terms")
WEIGHTS = {"official_names": 0.8, "common_names": 0.75, "identifiers": 0.8, "abbreviations": 0.6, "technical_terminology": 0.5, "synonyms": 0.4}
BASE_WEIGHT = 0.5
PROFILE_LEAST, PROFILE_SHARE = 20, 0.12
CONDITION = cue(CUES["en"]["condition"])
DEFINITION, TEMPORAL, PROCEDURAL = r"\b(?:means|refers to|is defined as|se entiende por)\b", r"\b(?:until|before|after|during|as of|hasta|desde)\b", r"\b(?:procedure|shall submit|report to|delegates?|transitional)\b"
IDENTIFIER = r"\b[A-Z]{2,6}[-/ ]?[0-9]{1,6}(?:[-/][0-9]{1,6})?\b"
ABBREVIATION = r"\b[A-Z]{2,6}\b"


def proposition_type(text: Column) -> Column:
    """definitional, conditional, quantitative, temporal, procedural or assertion_of_content, the first that fits."""
    t = T.fold(text)
    return (
        F.when(t.rlike(DEFINITION), "definitional").when(t.rlike(CONDITION), "conditional").when(F.size(quantities(t)) > 0, "quantitative").when(t.rlike(TEMPORAL), "temporal").when(t.rlike(PROCEDURAL), "procedural").otherwise("assertion_of_content")
    )


def statement_type(kind: Column, mode: Column) -> Column:
    return F.when(kind == "definitional", "interpretation").when(mode.isin("obligation", "prohibition", "permission"), "normative").when(mode == "proposal", "forecast").otherwise("fact")


def typed(sentences: DataFrame, text_col: str) -> DataFrame:
    """Adds type, modality and statement type."""
    df = sentences.withColumn("type", proposition_type(F.col(text_col))).withColumn("modality", modality(T.fold(F.col(text_col)), F.lit("en")))
    return df.withColumn("statement_type", statement_type(F.col("type"), F.col("modality")))


def profile(text: Column, declared: Column) -> Column:
    """The declared language where it has a profile; else the one whose function words make up most of the text, generic below a share."""
    tag = F.lower(F.split_part(F.regexp_replace(F.coalesce(declared, F.lit("")), "_", "-"), F.lit("-"), F.lit(1)))
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    votes = language_votes(F.array_join(words, " "))
    best = F.greatest(*[votes[k] for k in MARKERS])
    voted = F.coalesce(*[F.when(votes[k] == best, k) for k in sorted(MARKERS)])
    sure = (F.size(words) >= PROFILE_LEAST) & (best >= PROFILE_SHARE * F.size(words))
    return F.when(tag.isin(*MARKERS), tag).when(F.coalesce(sure, F.lit(False)), voted).otherwise("generic")


def short_forms(title: Column) -> Column:
    """What a title may be called: its parts between colons, dashes and commas, and its first five words without closing function words."""
    clean = T.collapse(title)
    parts = F.filter(F.transform(F.split(clean, r" ?[:,–—] ?| - "), lambda p: F.trim(p)), lambda p: (F.length(p) >= 8) & (F.length(p) < F.length(clean)))
    words = F.split(clean, " ")
    stop = "|".join(sorted(set(TOPIC_STOPWORDS), key=lambda w: (-len(w), w)))
    head = F.regexp_replace(F.array_join(F.slice(words, 1, 5), " "), rf"(?i)(?: (?:{stop}))+$", "")
    return F.array_distinct(F.concat(parts, F.when((F.size(words) > 5) & (F.length(head) >= 8), F.array(head)).otherwise(F.array().cast("array<string>"))))


def mechanical_synonyms(term: Column) -> Column:
    """Without hyphens, and without what stands in brackets."""
    bare = T.collapse(F.regexp_replace(term, r"\([^)]*\)", " "))
    return F.array_distinct(F.array_compact(F.array(F.when(F.contains(term, F.lit("-")), F.replace(term, F.lit("-"), F.lit(" "))), F.when((bare != term) & (bare != ""), bare))))


def collect(docs: DataFrame, doc: str, text_col: str, actor: str) -> DataFrame:
    """(document, set_name, term): what the first lines, identifiers, abbreviations and actors of a document's texts give."""
    first = F.split_part(F.col(text_col), F.lit("\n"), F.lit(1))
    sets = {
        "official_names": F.array(T.collapse(first)), "common_names": short_forms(first), "identifiers": F.regexp_extract_all(text_col, F.lit(IDENTIFIER), F.lit(0)), "abbreviations": F.regexp_extract_all(text_col, F.lit(ABBREVIATION), F.lit(0)),
        "synonyms": mechanical_synonyms(T.collapse(first)), "actor_terms": F.array(F.col(actor)),
    }
    return union_all([spread(docs, [F.col(doc).alias("document"), F.lit(name).alias("set_name")], terms, "term") for name, terms in sets.items()]).where(F.length("term").between(2, 120))


def merge_terms(terms: DataFrame, keys: list[str], shown: str = "term") -> DataFrame:
    """Terms once each by their folded form: of several sets the earliest, occurrences summed, the least spelling."""
    order = F.array_position(F.array(*[F.lit(s) for s in SETS]), F.col("set_name"))
    g = terms.groupBy(*keys, T.term_key(F.col(shown)).alias("key")).agg(F.min(order).alias("place"), F.min(shown).alias("term"), F.count("*").alias("n")).where("key <> ''")
    return g.select(*keys, "key", F.element_at(F.array(*[F.lit(s) for s in SETS]), F.col("place").cast("int")).alias("set_name"), "term", "n")


def term_weight(set_name: Column, term: Column, n: Column) -> Column:
    """Base by set, more for several words and repetition (up to 0.08), less for very short ones."""
    base = F.coalesce(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[set_name], F.lit(BASE_WEIGHT))
    w = base + 0.05 * F.size(F.split(term, " ")) + F.least(F.lit(0.08), 0.02 * (n - 1)) - F.when(F.length(term) < 6, 0.15).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), w)), 3)


def build(terms: DataFrame, top: int = 5) -> DataFrame:
    """The `top` terms of each document and set by weight."""
    v = merge_terms(terms, ["document"]).withColumn("weight", term_weight(F.col("set_name"), F.col("term"), F.col("n")))
    k = F.row_number().over(Window.partitionBy("document", "set_name").orderBy(F.desc("weight"), "key"))
    return v.withColumn("rank", k.cast("long")).where(F.col("rank") <= top)


def gaps(terms: DataFrame) -> DataFrame:
    """(document, gaps): the sets that came up empty."""
    g = merge_terms(terms, ["document"]).groupBy("document").agg(F.collect_set("set_name").alias("have"))
    return g.select("document", F.array_except(F.array(*[F.lit(s) for s in SETS]), "have").alias("gaps"))


def text_relevance(text: Column, terms: list[str], title_word: str, bonus: float = 0.2) -> Column:
    """Part of the terms that the text contains, more with a hit in its first line; at most 1."""
    hits = F.size(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(text), t)))
    title = F.contains(F.lower(F.split_part(text, F.lit("\n"), F.lit(1))), F.lit(title_word))
    return F.round(F.least(F.lit(1.0), hits / len(terms) + F.when(title, bonus).otherwise(0.0)), 3)


def top_per_group(counts: DataFrame, group: str, value: str, n: str, top: int) -> DataFrame:
    k = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(n), value))
    return counts.withColumn("__k", k).where(F.col("__k") <= top).drop("__k")


def route_queries(plan: DataFrame, registry: DataFrame, key: str = "kind") -> DataFrame:
    """(audience, sources): the enabled sources of the kinds that each audience is served by."""
    r = registry.where("enabled").join(plan, key)
    return r.groupBy("audience").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("sources"))


def number_in_order(rows: DataFrame, group: str, order: list[str], name: str = "number") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))
