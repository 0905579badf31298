"""Ranking evidence for questions: what a class of source can settle, features of the texts, corroboration, gaps.

Tables: questions (claim_id, question) and evidence (ev, claim_id, statement,
source, tier, derived, restating, age_days).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import tokens as G
from lectern.functions.arrays import rounded, spread
from lectern.operators import scoring as S
from lectern.operators.graph import cut_lineage
from lectern.operators.numbers import claim_numbers
from lectern.operators.similarity import recency

# Kinds of questions, and how well each class of source answers each of them.
KINDS = ("textual_content", "formal_process", "legal_interpretation", "measured_quantity", "projection", "attribution", "causal_effect", "implementation_status", "public_reaction")
AFFINITY = {
    "primary_document": (1.0, 0.6, 0.8, 0.3, 0.35, 0.5, 0.1, 0.15, 0.05),
    "legislative_record": (0.7, 1.0, 0.6, 0.2, 0.2, 0.85, 0.1, 0.35, 0.2),
    "official_technical_report": (0.4, 0.4, 0.3, 0.75, 0.8, 0.5, 0.45, 0.6, 0.1),
    "statistical_dataset": (0.1, 0.1, 0.05, 1.0, 0.3, 0.05, 0.35, 0.5, 0.15),
    "peer_reviewed": (0.15, 0.1, 0.2, 0.7, 0.6, 0.1, 0.85, 0.4, 0.2),
    "expert_analysis": (0.2, 0.2, 0.5, 0.4, 0.55, 0.3, 0.5, 0.4, 0.25),
    "journalism": (0.25, 0.4, 0.15, 0.25, 0.15, 0.9, 0.15, 0.55, 0.85),
    "political_statement": (0.1, 0.2, 0.1, 0.05, 0.1, 1.0, 0.05, 0.15, 0.6),
    "social_media": (0.05, 0.05, 0.05, 0.05, 0.05, 0.7, 0.03, 0.1, 0.7),
}
TIERS = tuple(AFFINITY)
# Questions that a class can't settle at all.
INCAPABLE = {
    "primary_document": ("causal_effect", "public_reaction"), "legislative_record": ("causal_effect",), "official_technical_report": ("public_reaction",), "statistical_dataset": ("textual_content", "legal_interpretation", "attribution"),
    "peer_reviewed": ("textual_content", "formal_process", "attribution"), "journalism": ("causal_effect",), "political_statement": ("textual_content", "legal_interpretation", "measured_quantity", "causal_effect"),
    "social_media": ("textual_content", "formal_process", "legal_interpretation", "measured_quantity", "causal_effect"),
}
UNKNOWN_AFFINITY, MISSING_AFFINITY, MOST_INCAPABLE, CAPABLE = 0.5, 0.4, 0.2, 0.6
# How far figures answer each kind.
QUANTITATIVENESS = {"textual_content": 0.2, "measured_quantity": 1.0, "causal_effect": 0.7, "projection": 0.9, "implementation_status": 0.3, "unknown": 0.4}
# Words that tell the kind of a question, the first that fits; on folded text.
QUESTION_WORDS = [
    ("legal_interpretation", r"\b(?:legal|law|interpret|constitutional)\b"), ("textual_content", r"\b(?:article|text|says|wording)\b"), ("formal_process", r"\b(?:vote|procedure|passed|committee)\b"),
    ("causal_effect", r"\b(?:cause|effect|because|impact|led to)\b"), ("projection", r"\b(?:will|forecast|projected|expected)\b"), ("measured_quantity", r"\b(?:how many|how much|percent|number|rate)\b"),
    ("attribution", r"\b(?:who|said|claimed|statement)\b"), ("implementation_status", r"\b(?:implemented|in force|delivered|status)\b"), ("public_reaction", r"\b(?:protest|support|oppose|reaction)\b"),
]
SCOPE = r"\b(?:national|regional|local|annual|per|average|total|all|each|every)\b"
HALF_LIFE_KIND = {"causal_effect": "causal", "measured_quantity": "fiscal", "legal_interpretation": "legal", "implementation_status": "impact"}
SATURATION = 3


def question_kind(question: Column) -> Column:
    t = T.fold(question)
    return F.coalesce(*[F.when(t.rlike(p), k) for k, p in QUESTION_WORDS], F.lit("unknown"))


def affinity(tier: Column, kind: Column) -> Column:
    """How well a class of source answers a kind of question; unknown kinds and classes have middling values."""
    table = F.create_map(*[F.lit(x) for t, row in AFFINITY.items() for k, v in zip(KINDS, row, strict=True) for x in (f"{t}/{k}", v)])
    return F.when(kind == "unknown", UNKNOWN_AFFINITY).otherwise(F.coalesce(table[F.concat_ws("/", tier, kind)], F.lit(MISSING_AFFINITY)))


def incapable(tier: Column, kind: Column) -> Column:
    return F.concat_ws("/", tier, kind).isin(*[f"{t}/{k}" for t, ks in INCAPABLE.items() for k in ks])


def tier_table(spark: SparkSession) -> DataFrame:
    """The matrix as rows: tier, kind, affinity, incapable."""
    rows = [(t, k, float(v), k in INCAPABLE.get(t, ())) for t, row in AFFINITY.items() for k, v in zip(KINDS, row, strict=True)]
    return spark.createDataFrame(rows, "tier string, kind string, affinity double, incapable boolean")


def capabilities(matrix: DataFrame) -> DataFrame:
    """What each class can and can't establish."""
    names = lambda when: F.array_join(F.array_sort(F.collect_list(F.when(when, F.col("kind")))), ",")
    return matrix.groupBy("tier").agg(names(F.col("affinity") >= CAPABLE).alias("can"), names(F.col("incapable")).alias("cannot"), F.round(F.avg("affinity"), 6).alias("mean"))


def matrix_faults(matrix: DataFrame, tiers: DataFrame) -> DataFrame:
    """(tier, fault): classes without a row, no better than chance at anything, or incapable with a high affinity."""
    absent = tiers.join(matrix.select("tier").distinct(), "tier", "left_anti").select("tier", F.lit("missing").alias("fault"))
    high = matrix.where(F.col("incapable") & (F.col("affinity") > MOST_INCAPABLE)).select("tier", F.concat(F.lit("incapable_but_high:"), "kind").alias("fault"))
    idle = matrix.groupBy("tier").agg(F.max("affinity").alias("most")).where(F.col("most") < UNKNOWN_AFFINITY).select("tier", F.lit("nothing_established").alias("fault"))
    return absent.unionByName(high).unionByName(idle)


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(T.fold(F.coalesce(text, F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0)))


def topical_relevance(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(ev, claim_id, topical): the part of a question's words that an item has, weighted by how rare they are among the question's candidates.

    Only the words shared with the question are spread out, never whole texts.
    """
    q = questions.select("claim_id", words(F.col("question")).alias("qw"))
    e = evidence.select("ev", "claim_id", words(F.col("statement")).alias("w")).join(q, "claim_id")
    return _topical(q, e.select("ev", "claim_id", F.array_intersect("w", "qw").alias("shared")))


def _topical(q: DataFrame, evidence: DataFrame) -> DataFrame:
    """From questions (claim_id, qw) and evidence on them (ev, claim_id, shared), all distinct words."""
    n = evidence.groupBy("claim_id").agg(F.count("*").alias("n"))
    hits = spread(evidence, ["ev", "claim_id"], "shared", "t")
    df = hits.groupBy("claim_id", "t").agg(F.count("*").alias("df"))
    rare = spread(q, ["claim_id"], "qw", "t").join(df, ["claim_id", "t"], "left").join(n, "claim_id").withColumn("idf", F.log((1 + F.col("n")) / (1 + F.coalesce("df", F.lit(0)))) + 1)
    total = rare.groupBy("claim_id").agg(F.sum("idf").alias("total"))
    got = hits.join(rare.select("claim_id", "t", "idf"), ["claim_id", "t"]).groupBy("ev", "claim_id").agg(F.sum("idf").alias("got"))
    return evidence.select("ev", "claim_id").join(got, ["ev", "claim_id"], "left").join(total, "claim_id").select("ev", "claim_id", rounded(F.coalesce("got", F.lit(0.0)) / F.col("total"), 6).alias("topical"))


def text_features(evidence: DataFrame) -> DataFrame:
    """Figures, scope words and length of the statement, and its specificity."""
    t = T.fold(F.coalesce(F.col("statement"), F.lit("")))
    n = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    f = evidence.withColumns({"n_figures": F.size(claim_numbers(t)), "n_scope": F.regexp_count(t, F.lit(SCOPE)), "n_words": n})
    return f.withColumn("specificity", rounded(S.specificity(F.col("n_figures"), F.col("n_scope"), F.col("n_words")), 6))


def quantitative_content(n_figures: Column, kind: Column) -> Column:
    """Three figures are enough; null where figures don't answer the question."""
    factor = F.coalesce(F.create_map(*[F.lit(x) for kv in QUANTITATIVENESS.items() for x in kv])[kind], F.lit(0.0))
    return F.when(factor > 0, rounded(F.least(F.lit(1.0), n_figures / 3) * factor, 6))


def corroboration(evidence: DataFrame) -> DataFrame:
    """(ev, sources): other sources that say something on the claim on their own account.

    Sources with an item that neither restates nor derives are counted once a
    claim, and an item's own source is taken off: no pairs of items are made.
    """
    free = F.when(~F.col("derived") & ~F.col("restating"), F.col("source"))
    count = evidence.groupBy("claim_id").agg(F.countDistinct(free).alias("all"))
    own = evidence.groupBy("claim_id", "source").agg(F.bool_or(~F.col("derived") & ~F.col("restating")).alias("counted"))
    return evidence.select("ev", "claim_id", "source").join(count, "claim_id").join(own, ["claim_id", "source"]).select("ev", (F.col("all") - F.col("counted").cast("int")).alias("sources"))


def read(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """What ranking takes from the texts, in one pass over them: evidence on the questions with its figures, specificity, shared words and kind of question, without the statement."""
    q = questions.select("claim_id", question_kind(F.col("question")).alias("kind"), words(F.col("question")).alias("qw"))
    e = text_features(evidence).withColumn("w", words(F.col("statement"))).join(q, "claim_id")
    return cut_lineage(e.select("ev", "claim_id", "source", "tier", "derived", "restating", "age_days", "n_figures", "specificity", "kind", F.array_intersect("w", "qw").alias("shared")))


def rank(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence that bears on its question, with its score out of 100 and rank: ev, claim_id, source, tier, kind, incapable, score, rank."""
    return rank_read(questions, read(questions, evidence))


def rank_read(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """The same from evidence that is read already."""
    q = questions.select("claim_id", words(F.col("question")).alias("qw"))
    e = evidence.join(_topical(q, evidence.select("ev", "claim_id", "shared")), ["ev", "claim_id"]).join(corroboration(evidence), "ev")
    life = F.coalesce(F.create_map(*[F.lit(x) for kv in HALF_LIFE_KIND.items() for x in kv])[F.col("kind")], F.lit("other"))
    e = e.withColumn("affinity", affinity(F.col("tier"), F.col("kind"))).withColumn("incapable", incapable(F.col("tier"), F.col("kind")))
    parts = {
        "affinity": F.col("affinity"), "topical": F.col("topical"), "specificity": F.col("specificity"), "quantitative": quantitative_content(F.col("n_figures"), F.col("kind")),
        "recency": rounded(recency(F.col("age_days"), life), 6), "corroboration": rounded(F.least(F.lit(1.0), F.col("sources") / SATURATION), 6),
    }
    # a name apart from the row's own, so that the components stay what they are when the score is taken
    e = e.select("ev", "claim_id", "source", "tier", "kind", "incapable", "restating", *[c.alias(f"p_{k}") for k, c in parts.items()])
    return S.rank_evidence(e, "claim_id", {k: F.col(f"p_{k}") for k in parts}, F.col("incapable"), F.col("restating"), "ev")


def named_gaps(questions: DataFrame, evidence: DataFrame, ranked: DataFrame) -> DataFrame:
    """(claim_id, kind, gaps): what a retriever would have to look for."""
    wanted = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, ",".join(sorted(t for t, row in AFFINITY.items() if row[i] >= CAPABLE)))])
    seen = evidence.groupBy("claim_id").agg(F.count("*").alias("n"))
    r = ranked.groupBy("claim_id").agg(F.count("*").alias("kept"), F.count_if(~F.col("incapable")).alias("capable"), F.countDistinct("source").alias("sources"))
    q = questions.select("claim_id", question_kind(F.col("question")).alias("kind")).join(seen, "claim_id", "left").join(r, "claim_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    some = zero("kept") > 0
    gaps = F.array_compact(
        F.array(
            F.when(~some, "nothing_bears_on_it"),
            F.when(some & (zero("capable") == 0), F.concat(F.lit("no_capable_source:"), F.coalesce(wanted[F.col("kind")], F.lit("")))),
            F.when(some & (zero("sources") < 2), "one_source"),
            F.when(some & (zero("n") > zero("kept")), F.concat(F.lit("off_target:"), (zero("n") - zero("kept")).cast("string"))),
        )
    )
    return q.select("claim_id", "kind", gaps.alias("gaps"))


def search(evidence: DataFrame, query: str, tiers: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Items that share words with the query, most of them first, then by content hash."""
    wanted = F.array_distinct(F.regexp_extract_all(T.fold(F.lit(query)), F.lit("[a-z]{3,}"), F.lit(0)))
    e = evidence.where(F.col("tier").isin(*tiers)) if tiers else evidence
    e = e.withColumn("score", F.round(F.size(F.array_intersect(words(F.col("statement")), wanted)) / F.size(wanted), 6)).where("score > 0").withColumn("sha", F.sha2("statement", 256))
    e = e.orderBy(F.desc("score"), "sha", "ev")
    return e.limit(limit) if limit else e


def best_source(sentences: DataFrame, sources: DataFrame, margin: float = 0.05) -> DataFrame:
    """For each sentence (group, no, sentence) the source statement (group, ref, statement, certainty) that fits best.

    A shared amount counts 0.65 + 0.35 of the word overlap, a shared year 0.35 +
    0.45 of it, overlap alone from 0.3 on. Of those within `margin` of the best
    the most certain wins.
    """
    read = lambda c: (G.claim_words(F.col(c)), F.transform(F.filter(claim_numbers(T.fold(F.col(c))), lambda n: ~n.ambiguous), lambda n: n.value), F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b(1[89][0-9]{2}|2[01][0-9]{2})\b"), F.lit(1))))
    a, b = read("sentence"), read("statement")
    s = sentences.select("group", "no", a[0].alias("sw"), a[1].alias("sn"), a[2].alias("sy"))
    t = sources.select("group", "ref", "certainty", b[0].alias("tw"), b[1].alias("tn"), b[2].alias("ty"))
    overlap = F.round(G.containment(F.col("sw"), F.col("tw")), 6)
    m = s.join(t, "group").withColumn("overlap", overlap)
    strength = F.when(F.arrays_overlap("sn", "tn"), 0.65 + 0.35 * F.col("overlap")).when(F.arrays_overlap("sy", "ty"), 0.35 + 0.45 * F.col("overlap")).when(F.col("overlap") >= 0.3, F.col("overlap"))
    m = m.withColumn("strength", F.round(strength, 6)).where("strength is not null").select("group", "no", "ref", "certainty", "strength")
    best = m.groupBy("group", "no").agg(F.max("strength").alias("best"))
    close = m.join(best, ["group", "no"]).where(F.col("strength") >= F.col("best") - margin - 1e-9)
    return close.groupBy("group", "no").agg(F.max_by(F.struct("ref", "strength"), F.struct("certainty", "strength", -F.col("ref"))).alias("b")).select("group", "no", "b.ref", "b.strength")


def support_index(evidence: DataFrame, supports: str, provisions: DataFrame) -> DataFrame:
    """(provision, n, best_tier, items): the evidence that names each provision in `supports`, an array; provisions without any too."""
    s = spread(evidence, ["ev", "tier"], supports, "provision").groupBy("provision").agg(F.count("*").alias("n"), F.min("tier").alias("best_tier"), F.min("ev").alias("first"))
    return provisions.join(s, "provision", "left").select("provision", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "best_tier", "first")
