"""Claims from the sentence to the verdict, all from texts: language, kind, assumptions, evidence, ten checks.

Tables: claims (claim_id, text, and made_at where known) and evidence (ev,
claim_id, statement, source, tier, derived, restating, strength, published_at).
Evidence meets claims by one join on the claim; everything that a check reads
is then an aggregate that combines before its shuffle, so a claim with a third
of all evidence costs no task more than its part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import tokens as G
from lectern.functions.arrays import bound, spread
from lectern.operators import propositions as P
from lectern.operators import scoring as S
from lectern.operators.graph import cut_lineage
from lectern.operators.numbers import claim_numbers

# Function words by language.
MARKERS = {
    "en": "the of and to in that is are for with on as by from will not it this an be was".split(),
    "es": "el la los las de del que en por para con una un se es son no al como pero su".split(),
    "fr": "le la les des et est dans pour une du sur pas que qui avec au sont ce par plus ne".split(),
    "de": "der die das und ist nicht mit den von zu ein eine auf im des dem sich auch als an".split(),
}
# What raises each kind of statement, as (family, language, weight, pattern on folded text).
CUES = [
    ("forecast", "en", 1.4, r"\b(?:will|shall) [a-z]"), ("forecast", "en", 1.5, r"\b(?:is|are) (?:expected|projected|forecast|set) to\b"), ("forecast", "en", 0.8, r"\b(?:by 20[0-9]{2}|over the next|in the coming)\b"),
    ("forecast", "es", 1.5, r"\bse (?:espera|proyecta|preve|estima)\b"), ("forecast", "es", 1.2, r"\b(?:va|van) a [a-z]+r\b"),
    ("opinion", "en", 1.6, r"\b(?:i|we) (?:think|believe|feel)\b"), ("opinion", "en", 1.2, r"\b(?:terrible|wonderful|disgraceful|stupid|pathetic)\b"), ("opinion", "es", 1.6, r"\b(?:creo|creemos|opino) que\b"),
    ("normative", "en", 1.5, r"\b(?:should|must|ought to|has to)\b"), ("normative", "es", 1.5, r"\b(?:debe|deben|deberia|hay que)\b"),
    ("interpretation", "en", 1.3, r"\b(?:suggests|implies|indicates|means that|amounts to)\b"), ("interpretation", "es", 1.3, r"\b(?:sugiere|implica|significa que)\b"),
    ("fact", "en", 1.2, r"\b(?:reported|recorded|measured|published|according to)\b"), ("fact", "es", 1.2, r"\b(?:registro|publico|segun)\b"),
    ("conditional", "en", 1.0, r"\b(?:if|unless|provided that)\b"), ("conditional", "es", 1.0, r"\b(?:siempre que|a menos que)\b"),
    ("hedge", "en", 1.0, r"\b(?:may|might|could|perhaps|possibly|likely)\b"), ("hedge", "es", 1.0, r"\b(?:podria|quizas|tal vez|probablemente)\b"),
    ("certainty", "en", 1.0, r"\b(?:certainly|clearly|undoubtedly|definitely)\b"), ("certainty", "es", 1.0, r"\b(?:claramente|sin duda)\b"),
    ("causal", "en", 1.0, r"\b(?:because|causes?|caused|leads? to|led to|due to)\b"), ("causal", "es", 1.0, r"\b(?:porque|causa|provoca|debido a)\b"),
    ("universal", "en", 1.0, r"\b(?:all|every|never|always|none)\b"), ("universal", "es", 1.0, r"\b(?:todos|todas|siempre|nunca|ningun)\b"),
    ("assumption", "en", 1.0, r"\b(?:assuming|assumes|on the assumption)\b"), ("assumption", "es", 1.0, r"\b(?:suponiendo|asumiendo)\b"),
    ("quantity", "xx", 0.6, r"[0-9]"),
]
FAMILIES = tuple(dict.fromkeys(c[0] for c in CUES))
# How a modifier's strongest cue shifts each kind, where each kind starts, and who wins a tie.
CONTRIBUTIONS = {
    "conditional": {"forecast": 0.5, "interpretation": 0.2, "fact": -0.4}, "hedge": {"forecast": 0.2, "interpretation": 0.2, "fact": -0.3},
    "causal": {"interpretation": 0.4}, "assumption": {"forecast": 0.3}, "quantity": {"fact": 0.3},
}
START = {"fact": 1.0}
TIE_ORDER = ("normative", "opinion", "forecast", "interpretation", "fact")
FOREIGN = 0.6
COMPOUND = r"(?:; |\band also\b|\bas well as\b|\by ademas\b)"


def cue(phrases: str) -> str:
    """A pattern of any of the phrases (folded, separated by commas), as whole words."""
    return r"\b(?:" + "|".join(p.strip() for p in phrases.split(",")) + r")\b"


# Words of a conclusion, of how something works, of a period, of a baseline and of the future, in English and Spanish.
CONCLUSION = cue("therefore, thus, hence, so that, it follows, consequently, por lo tanto, por tanto, asi que, en consecuencia, de modo que")
MECHANISM = cue(
    "mechanism, mecanismo, because, porque, via, through, mediante, a traves de, channel, canal, pathway, identification strategy,"
    "counterfactual, contrafactual, control group, grupo de control"
)
YEAR = "(?:19|20|21)[0-9]{2}"
PERIOD = cue(
    f"{YEAR}, since, from, between, over the, compared with, compared to, year on year, year-on-year, desde, entre, respecto de, respecto a,"
    "comparado con, en relacion a, en relacion con, interanual"
)
BASELINE = cue("baseline, per capita, out of, of the total, share of, relative to, linea base, del total, respecto del total, sobre un total")
FUTURE = cue(f"will, shall, by {YEAR}, next year, in the coming, se espera, se proyecta, hacia {YEAR}, en los proximos")
NEGATION = r"\b(?:not|no|never|without|nor|ni|nunca|sin|nicht|kein|ne)\b"
# Signals of what a projection takes for granted, and time frames, the first that fits.
SIGNALS = {
    "macroeconomic": cue("gdp, pib, growth, crecimiento, inflation, inflacion, revenue, recaudacion, deficit, interest rate, tasa de interes, exchange rate, tipo de cambio"),
    "take_up": cue("beneficiar[a-z]*, recipients, households, hogares, families, familias, applicants, solicitantes, cobertura, coverage, take.?up"),
    "behavioural": cue(
        "demand, demanda, behaviour, behavior, comportamiento, response, respuesta, incentive, incentivo, compliance, cumplimiento, evasion, hiring, contratacion"
    ),
}
IMPLIED = ("implementation", "external_condition")
HORIZONS = [
    ("immediate", r"\b(?:immediately|at once|right away|de inmediato)\b"), ("short_term", r"\b(?:this year|next year|within (?:the )?(?:next )?12 months|corto plazo)\b"),
    ("medium_term", r"\b(?:medium.term|over the next (?:two|three|four|five)|mediano plazo)\b"), ("long_term", r"\b(?:long.term|over a decade|in a decade|largo plazo)\b"),
]
CLAUSE = r"\b((?:if|unless|provided that|assuming|assumes|on the assumption|siempre que|a menos que|suponiendo|asumiendo)\b[^,;.:!?]*)"
CLAUSE_WORDS = 25
TOLERANCE, POINT_TOLERANCE, CONSISTENT = 0.005, 0.5, 0.02
COVERING, CONFLICT_COVERING = 0.45, 0.35
DOCUMENTARY, ANALYTICAL = 2, (3, 4, 5)
FROM_TO = r"\bfrom ([0-9][^,;]{0,44}?) to ([0-9][0-9.,]*)"
SHARE = r"([0-9][0-9.,]*) (?:out )?of ([0-9][0-9.,]*)"
# Words of change, and those of them that go down.
UP = "increase rise rose grew growth up aumento alza incremento subida crecimiento".split()
DOWN = "drop fall fell decrease decline reduction cut caida baja reduccion descenso disminucion".split()
CHANGE = r"\b(" + "|".join(UP + DOWN) + r")\b"
# Named patterns of how a claim is put.
RHETORIC = {
    "appeal_to_authority": r"\b(?:experts agree|any expert|los expertos coinciden)\b", "false_dilemma": r"\bthe only (?:option|alternative|way)\b", "anecdote": r"\bi (?:know|met) (?:someone|a [a-z]+)\b",
    "urgency": r"\b(?:crisis|emergency|urgent(?:ly)?|before it is too late)\b", "moral": r"\b(?:immoral|shameful|betrayal|obscene)\b", "loaded_comparison": r"\b(?:worse than|nothing short of|tantamount to)\b",
}
JARGON = 13


def language_votes(text: Column) -> Column:
    """Number of function words of each language, as a struct."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    among = lambda ws, marks: F.size(F.filter(ws, lambda w: w.isin(*marks)))
    return bound(words, lambda ws: F.struct(*[among(ws, marks).alias(lang) for lang, marks in MARKERS.items()]))


def detect_language(text: Column) -> Column:
    """The language with most function words; xx for a tie or none."""

    def decided(votes: Column) -> Column:
        best = F.greatest(*[votes[k] for k in MARKERS])
        leaders = F.size(F.array_compact(F.array(*[F.when(votes[k] == best, F.lit(k)) for k in MARKERS])))
        found = F.coalesce(*[F.when(votes[k] == best, F.lit(k)) for k in MARKERS])
        return F.when((best == 0) | (leaders > 1), "xx").otherwise(found)

    return bound(language_votes(text), decided)


def classify(claims: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds language, kind, margin, and what the checks ask of the wording.

    A cue of another language than the text's counts 0.6. Kinds add up their own
    cues; of a modifier only the strongest cue counts.
    """
    df = claims.withColumn("folded", T.fold(F.coalesce(F.col(text_col), F.lit("")))).withColumn("language", detect_language(F.coalesce(F.col(text_col), F.lit(""))))
    weight = lambda lang, w: F.when((F.col("language") == lang) | (F.lit(lang) == "xx") | (F.col("language") == "xx"), w).otherwise(w * FOREIGN)
    hits = {f: [(F.regexp_count("folded", F.lit(p)), weight(lang, w)) for fam, lang, w, p in CUES if fam == f] for f in FAMILIES}
    zero = F.lit(0.0)
    total = lambda pairs: reduce(lambda a, b: a + b, [n * w for n, w in pairs])
    peak = lambda pairs: F.greatest(zero, *[F.when(n > 0, w).otherwise(0.0) for n, w in pairs])
    df = df.withColumns({f"__{f}": F.round(total(h) if f in TIE_ORDER else peak(h), 6) for f, h in hits.items()})
    for kind in TIE_ORDER:
        parts = [F.col(f"__{m}") * F.lit(d[kind]) for m, d in CONTRIBUTIONS.items() if kind in d]
        df = df.withColumn(f"__s_{kind}", F.round(reduce(lambda a, b: a + b, parts, F.col(f"__{kind}") + START.get(kind, 0.0)), 6))
    ranked = F.sort_array(F.array(*[F.struct(F.col(f"__s_{k}").alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("kind")) for i, k in enumerate(TIE_ORDER)]), asc=False)
    df = df.withColumn("__ranked", ranked).withColumn("kind", F.col("__ranked")[0]["kind"]).withColumn("margin", F.round(F.col("__ranked")[0]["score"] - F.col("__ranked")[1]["score"], 6))
    horizon = F.coalesce(*[F.when(F.col("folded").rlike(p), h) for h, p in HORIZONS], F.lit("unknown"))
    df = df.withColumn("horizon", F.when(F.col("kind") == "forecast", horizon).otherwise("unknown"))
    flag = lambda f: F.col(f"__{f}") > 0
    df = df.withColumns(
        {"conditional": flag("conditional"), "hedged": flag("hedge"), "certain": flag("certainty"), "causal": flag("causal"), "universal": flag("universal"), "quantitative": flag("quantity"), "compound": F.col("folded").rlike(COMPOUND)}
    ).withColumn("falsifiable", F.when(F.col("kind") == "forecast", F.col("quantitative") | (F.col("horizon") != "unknown")).otherwise(~F.col("kind").isin("opinion", "normative")))
    df = df.withColumn("assumptions", assumptions(F.col("folded"), F.col("kind")))
    return df.drop(*[f"__{f}" for f in FAMILIES], *[f"__s_{k}" for k in TIE_ORDER], "__ranked")


def stated_assumptions(folded: Column) -> Column:
    """The clauses after conditional and assumption cues, two words or more, at most CLAUSE_WORDS of them, once each."""
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    clauses = F.transform(F.regexp_extract_all(folded, F.lit(CLAUSE), F.lit(1)), lambda c: F.slice(words(c), F.lit(1), F.lit(CLAUSE_WORDS)))
    return F.array_distinct(F.transform(F.filter(clauses, lambda w: F.size(w) >= 2), lambda w: F.array_join(w, " ")))


def assumptions(folded: Column, kind: Column) -> Column:
    """Stated clauses, then for forecasts what the form of a projection implies and what its subject signals."""
    signals = F.array_compact(F.array(*[F.when(folded.rlike(p), F.lit(f"implied:{n}")) for n, p in SIGNALS.items()]))
    implied = F.concat(F.array(*[F.lit(f"implied:{n}") for n in IMPLIED]), signals)
    return F.concat(stated_assumptions(folded), F.when(kind == "forecast", implied).otherwise(F.array().cast("array<string>")))


def evidence_view(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each item of evidence beside its claim, with what the checks read from the two texts.

    claims: as classify() returns them. coverage is the part of the claim's
    content words that the statement has; an item conflicts if it covers the
    claim and differs in polarity or in a figure of the same kind.
    """
    c = claims.select("claim_id", "folded", "made_at", G.claim_words(F.col("text")).alias("cw"), claim_numbers(F.col("folded")).alias("cn"))
    e = evidence.withColumn("folded_statement", T.fold(F.coalesce(F.col("statement"), F.lit("")))).withColumn("ew", G.claim_words(F.col("statement"))).withColumn("en", claim_numbers(F.col("folded_statement")))
    m = c.join(e, "claim_id").withColumn("coverage", G.coverage(F.col("cw"), F.col("ew")))
    relevance = G.jaccard(F.col("cw"), F.col("ew"))
    m = m.withColumn("weight", S.evidential_weight(F.col("strength"), relevance, F.col("coverage"), F.col("derived"), F.col("restating")))
    polarity = F.col("folded").rlike(NEGATION) != F.col("folded_statement").rlike(NEGATION)
    sure = lambda ns: F.filter(ns, lambda n: ~n.ambiguous)
    alike = lambda x: F.filter(sure(F.col("en")), lambda n: n.kind == x.kind)
    far = lambda x: F.forall(alike(x), lambda n: F.abs(n.value - x.value) / F.greatest(F.abs(x.value), F.lit(1e-9)) > 4 * TOLERANCE)
    magnitude = F.exists(sure(F.col("cn")), lambda x: (F.size(alike(x)) > 0) & far(x))
    return m.withColumn("conflicts", (F.col("coverage") >= CONFLICT_COVERING) & (polarity | magnitude))


def evidence_summary(view: DataFrame) -> DataFrame:
    """One row per claim with evidence: counts, coverage, weights for and against, spread of figures of one kind."""
    free = F.when(~F.col("derived") & ~F.col("restating"), F.col("source"))
    words = F.col("folded_statement")
    sums = view.groupBy("claim_id").agg(
        F.count("*").alias("n"), F.max("coverage").alias("coverage"), F.count_if(F.col("coverage") >= COVERING).alias("covering"), F.count_if(F.col("tier") <= DOCUMENTARY).alias("documentary"), F.count_if(F.col("tier").isin(*ANALYTICAL)).alias("analytical"),
        F.countDistinct(free).alias("independent"), F.max(F.when(F.col("conflicts"), F.col("weight"))).alias("against"), F.max(F.when(~F.col("conflicts"), F.col("weight"))).alias("for"), F.bool_or(words.rlike(MECHANISM)).alias("mechanism"),
        F.bool_or(words.rlike(PERIOD) | words.rlike(BASELINE)).alias("supplies_period"), F.count_if(F.col("published_at") > F.col("made_at")).alias("later"),
    )
    figures = spread(view, ["claim_id", "ev"], F.filter("en", lambda n: ~n.ambiguous), "x")
    by_kind = figures.groupBy("claim_id", "x.kind").agg(F.min("x.value").alias("lo"), F.max("x.value").alias("hi"), (F.min("ev") != F.max("ev")).alias("several"))
    apart = (F.col("hi") - F.col("lo")) / F.greatest(F.abs("lo"), F.abs("hi"), F.lit(1e-9)) > CONSISTENT
    consistent = by_kind.where("several").groupBy("claim_id").agg(F.when(F.bool_or(apart), "fail").otherwise("pass").alias("data_consistency"))
    return sums.join(consistent, "claim_id", "left")


def recheck_quantities(claims: DataFrame, view: DataFrame) -> DataFrame:
    """(claim_id, quantity_recheck): a stated change or share redone, and each figure held against the evidence's."""
    c = claims.select("claim_id", "folded", claim_numbers(F.col("folded")).alias("cn"))
    # figure by figure: is there one of its kind in the evidence, and does one agree
    own = F.transform("cn", lambda n, i: F.struct(i.alias("i"), n.kind.alias("kind"), n.value.alias("value"), n.ambiguous.alias("ambiguous")))
    x = spread(view, ["claim_id", "en"], own, "x")
    kin = F.filter("en", lambda n: n.kind == F.col("x.kind"))
    near = F.exists(kin, lambda n: ~n.ambiguous & (F.abs(n.value - F.col("x.value")) / F.greatest(F.abs("x.value"), F.abs(n.value), F.lit(1e-9)) <= TOLERANCE))
    met = x.groupBy("claim_id", "x.i").agg(F.bool_or(F.size(kin) > 0).alias("comparable"), F.bool_or(near).alias("hit"), F.bool_or("x.ambiguous").alias("doubtful"))
    outside = met.groupBy("claim_id").agg(F.count_if(F.col("comparable") & ~F.col("doubtful") & F.col("hit")).alias("agree"), F.count_if(F.col("comparable") & ~F.col("doubtful") & ~F.col("hit")).alias("differ"))
    percent = F.get(F.transform(F.filter("cn", lambda n: n.kind == "percentage"), lambda n: n.value), F.lit(0))
    has = F.exists("cn", lambda n: n.kind == "percentage")
    first = lambda t: F.get(claim_numbers(t), F.lit(0))
    part = lambda p, k: first(F.regexp_extract("folded", p, k))
    close = lambda computed: F.abs(F.abs(computed) - percent) <= F.greatest(F.lit(POINT_TOLERANCE), 0.05 * percent)
    a, b = part(FROM_TO, 1), part(FROM_TO, 2)
    change = (b.value - a.value) / a.value * 100
    word = F.regexp_extract("folded", CHANGE, 1)
    direction = (word == "") | ((change < 0) == word.isin(*DOWN))
    usable = has & F.col("folded").rlike(FROM_TO) & (a.value != 0) & ~a.ambiguous & ~b.ambiguous
    p, w = part(SHARE, 1), part(SHARE, 2)
    shares = has & ~F.col("folded").rlike(FROM_TO) & F.col("folded").rlike(SHARE) & (w.value != 0)
    inside = F.when(F.coalesce(usable, F.lit(False)), close(change) & direction).when(F.coalesce(shares, F.lit(False)), close(p.value / w.value * 100))
    out = c.withColumn("inside", inside).join(outside, "claim_id", "left")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0))
    fails = F.coalesce(~F.col("inside"), F.lit(False)) | (zero("differ") > 0)
    passes = F.coalesce(F.col("inside"), F.lit(False)) | (zero("agree") > 0)
    return out.select("claim_id", F.when(F.size("cn") == 0, "na").when(fails, "fail").when(passes, "pass").otherwise("na").alias("quantity_recheck"))


def checks(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Classified claims with their ten outcomes (pass, fail or na) and the number of items and of independent sources.

    claims must have claim_id, text and made_at. The classified claims and the
    joined evidence are written once, since several aggregates read them.
    """
    c = cut_lineage(classify(claims))
    view = cut_lineage(evidence_view(c, evidence))
    df = c.join(evidence_summary(view), "claim_id", "left").join(recheck_quantities(c, view), "claim_id", "left")
    count = lambda n: F.coalesce(F.col(n), F.lit(0))
    said = lambda p: F.col("folded").rlike(p)
    value_free = F.col("kind").isin("opinion", "normative")
    outcome = lambda bad: F.when(bad, "fail").otherwise("pass")
    stated = F.size(stated_assumptions(F.col("folded")))
    forward = (F.col("kind") == "forecast") | said(FUTURE)
    overconfident = (F.col("certain") & (stated == 0) & ~F.col("hedged")) | ((F.col("kind") == "forecast") & ~F.col("falsifiable"))
    loose = (F.col("universal") & (count("independent") < 2)) | (said(CONCLUSION) & (count("n") == 0)) | F.col("compound")
    return df.select(
        "claim_id", "kind", "margin", "language", "horizon", "assumptions", "folded", "quantitative", "certain", "causal", "falsifiable", count("n").alias("n"), count("independent").alias("independent"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), count("documentary").alias("documentary"), count("analytical").alias("analytical"),
        F.when(value_free, "na").otherwise(outcome(count("covering") == 0)).alias("direct_textual_evidence"),
        F.coalesce("quantity_recheck", F.lit("na")).alias("quantity_recheck"),
        F.coalesce("data_consistency", F.lit("na")).alias("data_consistency"),
        F.when(value_free, "na").otherwise(outcome(loose)).alias("logical_validity"),
        F.when(~F.col("causal"), "na").otherwise(outcome((count("analytical") == 0) & ~F.coalesce("mechanism", F.lit(False)))).alias("causal_support"),
        F.when(~F.col("quantitative"), "na").otherwise(outcome(~said(PERIOD) & ~said(BASELINE) & F.coalesce("supplies_period", F.lit(False)))).alias("context_completeness"),
        F.when(F.col("made_at").isNull(), "na").otherwise(outcome((F.col("kind") == "fact") & said(FUTURE))).alias("temporal_correctness"),
        F.when(value_free, "na").otherwise(outcome(count("independent") < 2)).alias("independent_corroboration"),
        F.when(~forward, "na").otherwise(outcome(overconfident)).alias("uncertainty_handling"),
        F.when(count("n") == 0, "na").otherwise(outcome(F.coalesce(F.col("against") > F.coalesce("for", F.lit(0.0)), F.lit(False)))).alias("contradiction"),
    )


def evaluate(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """checks() with verdict, confidence and the part that limits it most."""
    c = checks(claims, evidence)
    passed = reduce(lambda a, b: a + b, [(F.col(k) == "pass").cast("int") for k in S.CHECKS])
    failed = reduce(lambda a, b: a + b, [(F.col(k) == "fail").cast("int") for k in S.CHECKS])
    deltas = [("agreement", F.round(0.05 * passed - 0.08 * failed, 6)), ("coverage", F.round(0.3 * F.col("coverage") - 0.05 + 1e-9, 4)), ("ambiguity", F.when(F.col("margin") < 0.5, -0.1).otherwise(0.0))]
    confidence, limiting = S.claim_confidence(deltas, F.col("independent"))
    return c.select("*", S.verdict(F.col("kind"), {k: F.col(k) for k in S.CHECKS}, F.col("n")).alias("verdict"), confidence.alias("confidence"), limiting.alias("limiting"))


def rhetoric(evaluated: DataFrame) -> DataFrame:
    """Adds the named patterns of how each claim is put, none_detected without any, and notes on its framing; the verdict stays."""
    t = F.col("folded")
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    jargon = F.size(F.filter(words, lambda w: F.regexp_replace(w, r"[^\p{L}]", "").rlike(rf"^\p{{L}}{{{JARGON},}}$"))) > 0.25 * F.size(words)
    found = [F.when(t.rlike(p), F.lit(n)) for n, p in RHETORIC.items()]
    found += [F.when((F.col("kind") == "forecast") & ~F.col("falsifiable"), "unfalsifiable_prediction"), F.when(F.col("quantitative") & ~t.rlike(PERIOD) & ~t.rlike(BASELINE), "cherry_picked_statistic"), F.when(jargon, "technical_obfuscation")]
    patterns = F.array_compact(F.array(*found))
    notes = F.array_compact(F.array(F.when(F.col("certain"), "certainty_language"), F.when(F.col("causal"), "causal_frame"), F.when(F.col("quantitative"), "leads_with_figure"), F.when(F.col("kind") == "forecast", "projection")))
    return evaluated.withColumn("patterns", F.when(F.size(patterns) > 0, patterns).otherwise(F.array(F.lit("none_detected")))).withColumn("framing_notes", notes)


def changed_verdicts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Claims whose verdict or outcomes a later stage has changed, lost or added: must be empty."""
    digest = F.sha2(F.concat_ws("|", "verdict", *S.CHECKS), 256)
    a, b = before.select("claim_id", digest.alias("was")), after.select("claim_id", digest.alias("is"))
    return a.join(b, "claim_id", "full").where(~F.col("was").eqNullSafe(F.col("is"))).select("claim_id", "was", "is")


def blind(claims: DataFrame, evidence: DataFrame, names: list[str], at_issue: Column | None = None, word: str = T.WORD_CHARACTER) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Claims and evidence without identities, and what still leaks.

    Names become a placeholder, sources a hash. Where the attribution itself is
    at issue (`at_issue` on the claims) the claim's text stays as it is, and
    its leaks aren't reported.
    """
    kept = F.lit(False) if at_issue is None else at_issue
    c = claims.withColumn("original", F.col("text")).withColumn("attribution_kept", kept).withColumn("text", F.when(kept, F.col("text")).otherwise(P.redact(F.col("text"), names, w=word)))
    c = c.withColumn("interpretable", P.interpretable(F.col("text"), F.col("original")))
    e = evidence.withColumn("statement", P.redact(F.col("statement"), names, w=word)).withColumn("source", F.sha2(F.col("source"), 256))
    found = P.leaks(c.where(~F.col("attribution_kept")), "claim_id", ["text"], names)
    return c, e, found
