"""Propositions in texts: scope, modality, redaction, leaks, perturbations, grounding."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import tokens as G
from lectern.functions.arrays import spread
from lectern.operators.extract import FIGURE, short_label
from lectern.operators.matcher import matches
from lectern.operators.segment import LEGAL, sentence_array

# Cues by language of conditions, exceptions, periods, units of time, negation, modality (strongest first) and hedges.
CUES = {
    "en": {
        "condition": "if, unless, provided that, in the event that, where, when, subject to, conditional on, once",
        "exception": "except, excluding, other than, save for, with the exception of, does not apply to, shall not apply to",
        "period": "from, until, before, after, during, within, as of, with effect from, no later than",
        "unit": "day, days, week, weeks, month, months, year, years",
        "negation": "not, no, never, neither, nor, without, cannot, may not",
        "prohibition": "shall not, must not, may not, is prohibited, are prohibited",
        "obligation": "shall, must, is required to, are required to, is obliged to",
        "permission": "may, is entitled to, are entitled to, is permitted to, can",
        "proposal": "proposes, is proposed, would, seeks to, intends to",
        "hedge": "approximately, about, around, estimated, is expected to, are expected to, may, could, likely, up to, at least, roughly, in principle",
    },
    "es": {
        "condition": "si, salvo que, siempre que, en caso de, cuando, en el evento de, sujeto a, una vez que, a condición de",
        "exception": "salvo, excepto, con excepción de, sin perjuicio de, no se aplica a, no será aplicable a, quedan excluidos, quedan exceptuados",
        "period": "desde, hasta, antes de, después de, durante, dentro de, a partir de, a contar de, a más tardar",
        "unit": "día, días, semana, semanas, mes, meses, año, años",
        "negation": "no, ni, nunca, sin, tampoco, ninguno, ninguna",
        "prohibition": "no podrá, no podrán, queda prohibido, quedan prohibidas, se prohíbe",
        "obligation": "deberá, deberán, debe, deben, estará obligado, estarán obligados, corresponderá",
        "permission": "podrá, podrán, puede, pueden, tendrá derecho, tendrán derecho",
        "proposal": "se propone, propone, el proyecto, se plantea, busca",
        "hedge": "aproximadamente, cerca de, alrededor de, se estima, estimado, se espera, podría, eventualmente, hasta, al menos, en principio",
    },
}
MODALITIES = ("prohibition", "obligation", "permission", "proposal")
NEGATION = r"\b(not|no|never|neither|nor|without)\b"
#: How a document defines a word of its own, takes something for granted, and sets a term.
DEFINITION = r"""["“«'‘]([^"“”«»'‘’]{2,60})["”»'’]\s+(?:means|shall mean|is defined as|significa|se define como)\s+([^;.]{3,400})"""
ASSUMED = "assuming, on the assumption that, it is assumed that, suponiendo, bajo el supuesto de, se supone que"
DUE = r"\d{4}-\d{2}-\d{2}|(?:\d{1,4}|one|two|three|four|five|six|seven|eight|nine|ten|twelve)\s+(?:(?:working|business)\s+)?(?:days?|weeks?|months?|years?|días?|semanas?|meses|mes|años?)"
TERM_CUES = "within, no later than, not later than, before, by, until, dentro de, a más tardar, antes de, hasta"
QUALITY_CAP = {"good": 1.0, "degraded": 0.75, "poor": 0.5}
PLACEHOLDER = "[ACTOR]"
# Rewrites that keep a sentence's meaning.
PARAPHRASES = [(r"\bof the\b", "of that"), (r"\bin the\b", "inside the"), (r"\bis\b", "remains"), (r"\band\b", "as well as")]


def _any(phrases: str) -> str:
    """The phrases as whole words, the longest first; only at their first letters what stands before is looked at."""
    words = sorted((w.strip() for w in phrases.split(",")), key=lambda w: (-len(w), w))
    w = T.WORD_CHARACTER
    return rf"(?=[{''.join(sorted({x[0] for x in words}))}])(?<!{w})(?:{'|'.join(words)})(?!{w})".replace(" ", r"\s+")


def _by_language(lang: Column, build) -> Column:
    """build(cues) of the language that `lang` names; null for languages without cues."""
    code = F.lower(F.substring(lang, 1, 2))
    out = F.lit(None)
    for name, cues in CUES.items():
        out = F.when(code == name, build(cues)).otherwise(out)
    return out


def _clauses(text: Column, cues: str, ends: str) -> Column:
    """From every cue to the end of its clause, also where one begins inside another; each once, over three characters."""
    # what a look-ahead takes stays there for the next match
    found = F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)(?=({_any(cues)}[^{ends}]*))"), F.lit(1)), T.collapse)
    return F.when(text.rlike("(?i)" + _any(cues)), F.array_distinct(F.filter(found, lambda c: F.length(c) > 3))).otherwise(F.array().cast("array<string>"))


def modality(sentence: Column, lang: Column) -> Column:
    """The strongest that is cued, else asserted; a sentence without any cue is searched once."""

    def strongest(cues: dict[str, str]) -> Column:
        found = F.coalesce(*[F.when(sentence.rlike("(?i)" + _any(cues[m])), F.lit(m)) for m in MODALITIES])
        return F.when(sentence.rlike("(?i)" + _any(", ".join(cues[m] for m in MODALITIES))), found)

    return F.coalesce(_by_language(lang, strongest), F.lit("asserted"))


def scope(sentence: Column, lang: Column) -> dict[str, Column]:
    """Conditions, exceptions, period, hedges and negation of a unit, none of which reaches over its clause.

    A period is a date, or a cued clause that holds a year or a unit of time:
    "up to 300 units" sets none.
    """
    none = F.array().cast("array<string>")
    figured = sentence.rlike("[0-9]")
    listed = lambda c: F.coalesce(c, none)
    timed = lambda cues: F.filter(_clauses(sentence, cues["period"], ",;."), lambda c: c.rlike(rf"(?i)(?<!\d)(?:1[89]\d\d|2[01]\d\d)(?!\d)|{_any(cues['unit'])}"))
    hedges = lambda cues: F.array_distinct(F.transform(F.regexp_extract_all(sentence, F.lit("(?i)" + _any(cues["hedge"])), F.lit(0)), lambda h: F.lower(T.collapse(h))))
    return {
        "negated": F.coalesce(_by_language(lang, lambda cues: sentence.rlike("(?i)" + _any(cues["negation"]))), F.lit(False)),
        "modality": modality(sentence, lang),
        "conditions": listed(_by_language(lang, lambda cues: _clauses(sentence, cues["condition"], ",;."))),
        "exceptions": listed(_by_language(lang, lambda cues: _clauses(sentence, cues["exception"], ";."))),
        "period": F.coalesce(F.when(figured, F.nullif(F.regexp_extract(sentence, r"(?<!\d)(\d{4}-\d{2}-\d{2})(?!\d)", 1), F.lit(""))), F.get(_by_language(lang, timed), F.lit(0))),
        "hedges": listed(_by_language(lang, hedges)),
    }


BRANCHES = ("clause", "value", "definition", "assumption", "deadline")


def propositions(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None = None) -> DataFrame:
    """(id, no, branch, at, text, negated, modality, conditions, exceptions, period, hedges).

    Units are sentences, cut at semicolons, of three words or more. Beside the
    unit itself its figures (with the words before them), definitions,
    assumptions and terms are propositions of their own; they have the scope of
    their unit, but a definition is stipulated and neither negated nor modal.
    """
    lang = F.col(lang_col) if lang_col else F.lit("en")
    cut = F.flatten(F.transform(sentence_array(F.coalesce(F.col(text_col), F.lit("")), LEGAL), lambda s: F.filter(F.transform(F.split(s, r";\s*"), T.collapse), lambda p: F.size(F.split(p, " ")) >= 3)))
    units = spread(docs.withColumn("__lang", lang), [id_col, "__lang"], F.transform(cut, lambda s, i: F.struct(i.alias("no"), s.alias("unit"))), "u")
    units = units.select(id_col, "__lang", F.col("u.no").cast("long").alias("no"), F.col("u.unit").alias("unit"))
    u = F.col("unit")
    units = units.select("*", *[c.alias(n) for n, c in scope(u, F.col("__lang")).items()])

    def rows(branch: str, found: Column, value) -> Column:
        return F.transform(found, lambda x, i: F.struct(F.lit(branch).alias("branch"), i.cast("long").alias("at"), value(x).alias("text")))

    none = F.array().cast("array<string>")
    figures = F.when(u.rlike("[0-9]"), F.regexp_extract_all(u, F.lit(FIGURE), F.lit(0))).otherwise(none)
    definitions = F.regexp_extract_all(u, F.lit(f"(?i){DEFINITION}"), F.lit(0))
    named = lambda d: F.concat(F.lit("'"), F.regexp_extract(d, f"(?i){DEFINITION}", 1), F.lit("' means "), T.collapse(F.regexp_extract(d, f"(?i){DEFINITION}", 2)))
    terms = F.regexp_extract_all(u, F.lit(rf"(?i)({_any(TERM_CUES)}[^,;.]{{0,40}}?(?<!{T.WORD_CHARACTER})(?:{DUE})(?!{T.WORD_CHARACTER}))"), F.lit(1))
    before = lambda f: F.trim(F.concat_ws(": ", F.nullif(short_label(u, f), F.lit("")), f))
    all_rows = F.concat(
        F.array(F.struct(F.lit("clause").alias("branch"), F.lit(0).cast("long").alias("at"), u.alias("text"))),
        rows("value", figures, before), rows("definition", definitions, named), rows("assumption", _clauses(u, ASSUMED, ",;."), lambda x: x), rows("deadline", terms, T.collapse),
    )
    carried = ["negated", "modality", "conditions", "exceptions", "period", "hedges"]
    out = spread(units, [id_col, "no", *carried], all_rows, "r").select(id_col, "no", "r.branch", "r.at", "r.text", *carried)
    defined = F.col("branch") == "definition"
    return out.withColumn("negated", F.col("negated") & ~defined).withColumn("modality", F.when(defined, "asserted").otherwise(F.col("modality")))


def extraction_confidence(conditional: Column, inferred: Column, hedged: Column, quantified: Column, quality: Column) -> Column:
    raw = 0.9 - F.when(conditional, 0.05).otherwise(0.0) - F.when(inferred, 0.2).otherwise(0.0) - F.when(hedged, 0.15).otherwise(0.0) + F.when(quantified, 0.03).otherwise(0.0)
    cap = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in QUALITY_CAP.items() for x in kv]), quality), F.lit(0.8))
    return F.round(F.least(raw, cap), 4)


def redact(text: Column, names: list[str], placeholder: str = PLACEHOLDER, w: str = T.WORD_CHARACTER) -> Column:
    """Names, the longest first, with honorific and possessive, become a placeholder; `w` is what words are made of. For many names or protected wordings see matcher.redacted."""
    escaped = [re.sub(r"([^\w\s])", r"\\\1", n) for n in names]
    pattern = "|".join(sorted(escaped, key=lambda n: (-len(n), n)))
    return F.regexp_replace(text, rf"(?i)(?:(?<!{w})(?:mr|mrs|ms|dr|sr|sra)\.? )?(?<!{w})(?:{pattern})(?!{w})(?:['’]s)?", placeholder)


def leaks(frame: DataFrame, id_col: str, fields: list[str], names: list[str]) -> DataFrame:
    """Names of three letters or more that a field still holds, word-bounded and without regard to accents."""
    kept = frame.sparkSession.createDataFrame([(n,) for n in names if len(n) >= 3], "name string").select("name", T.fold(F.col("name")).alias("pattern"))
    rows = F.array(*[F.struct(F.lit(f).alias("field"), T.fold(F.col(f)).alias("value")) for f in fields])
    r = frame.select(id_col, F.explode(rows).alias("r")).select(id_col, "r.field", "r.value")
    return matches(r, "value", kept, bounded=True, keep="first").join(kept, "pattern").select(id_col, "field", "name")


def interpretable(redacted: Column, original: Column) -> Column:
    """Few placeholders, three content words or more, and the same figures."""
    holes = F.regexp_count(redacted, F.lit(r"\[ACTOR\]"))
    words = F.size(F.filter(F.split(redacted, r"\s+"), lambda w: w != ""))
    figures = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)))
    return (holes <= 0.35 * words) & (F.size(G.claim_words(F.replace(redacted, F.lit(PLACEHOLDER), F.lit("")))) >= 3) & (figures(redacted) == figures(original))


def pick_alternative(key: Column, pool: list[str], current: Column) -> Column:
    """An entry of the pool other than the current one, by a hash of the key."""
    others = F.filter(F.array(*[F.lit(p) for p in pool]), lambda p: p != current)
    at = F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long"), F.size(others))
    return F.element_at(others, (at + 1).cast("int"))


def paraphrase(text: Column, offset: Column) -> Column:
    """The first rewrite, from an offset on, that changes the text and keeps its figures and negations; null if none does."""
    signature = lambda c: F.concat(F.array_sort(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0))), F.regexp_extract_all(F.lower(c), F.lit(NEGATION), F.lit(0)))
    n = len(PARAPHRASES)
    made = [F.when((F.regexp_replace(text, p, r) != text) & (signature(F.regexp_replace(text, p, r)) == signature(text)), F.regexp_replace(text, p, r)) for p, r in PARAPHRASES]
    turns = [F.coalesce(*(made[(k + j) % n] for j in range(n))) for k in range(n)]
    return reduce(lambda acc, k: F.when(F.pmod(offset, F.lit(n)) == k, turns[k]).otherwise(acc), range(n), F.lit(None).cast("string"))


def shuffled(items: Column, key: Column) -> Column:
    """Order by a hash with the key; turned by one where that changes nothing."""
    by_hash = F.transform(F.array_sort(F.transform(items, lambda x: F.struct(F.sha2(F.concat(key, F.lit(":"), x.cast("string")), 256).alias("h"), x.alias("x")))), lambda s: s.x)
    turned = F.concat(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), F.slice(items, 1, 1))
    return F.when((by_hash == items) & (F.size(items) > 1), turned).otherwise(by_hash)


def grounding(mention: DataFrame, name: str, action: str, quote: str, text: str) -> Column:
    """The first reason against a mention; null if it stands."""
    words = lambda c: G.claim_words(F.col(c))
    return (
        F.when(F.length(quote) < 12, "quote_too_short")
        .when(~F.contains(T.collapse(F.col(text)), T.collapse(F.col(quote))), "quote_not_found")
        .when(F.size(F.array_intersect(words(name), words(quote))) == 0, "name_not_in_quote")
        .when(F.size(F.array_intersect(words(action), words(quote))) == 0, "action_not_in_quote")
        .when(F.lower(F.col(quote)).rlike(r"\b(was|were|been) \w+ed by\b"), "passive")
    )
