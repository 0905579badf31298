"""Figures, money, dates and durations in texts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import ACCENTED, PLAIN, fold

# a figure groups with one separator throughout, and the other one may cut off decimals
GROUPED = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d{1,3}(?: \d{3})+(?:[.,]\d+)?"
FIGURE = rf"(?<![\d.,])(?:{GROUPED}|\d+(?:[.,]\d+)?)(?!\d|[.,]\d)"
FOUR_DIGITS = r"(?<!\d)(\d{4})(?!\d)"
FIRST_YEAR, LAST_YEAR = 1800, 2199

# Scale words and the multiple they stand for.
SCALES = {"thousand": 1e3, "mil": 1e3, "tausend": 1e3, "mille": 1e3, "million": 1e6, "millones": 1e6, "millionen": 1e6, "billion": 1e9, "milliard": 1e9, "billones": 1e12, "trillion": 1e12}
# Symbols and codes that name one currency; others stay unresolved as XXX.
CURRENCIES = {"US$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "USD": "USD", "EUR": "EUR", "GBP": "GBP", "CHF": "CHF", "JPY": "JPY", "BRL": "BRL"}
UNKNOWN_CURRENCY = "XXX"
# Months and the units of durations.
MONTHS = {m: i + 1 for i, m in enumerate("january february march april may june july august september october november december".split())}
UNITS = {"day": "day", "days": "day", "week": "week", "weeks": "week", "month": "month", "months": "month", "year": "year", "years": "year", "dias": "day", "meses": "month", "anos": "year", "tage": "day", "jours": "day"}
NUMBER_WORDS = {w: i + 1 for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve".split())}
DEADLINE_CUES = ("within", "no later than", "before", "until", "dentro de", "a mas tardar")
ROLE_CUES = {"penalty": ("penalty", "fine of"), "cap": ("cap of", "not exceed"), "floor": ("at least", "floor of"), "revenue": ("revenue", "receipts"), "cost": ("cost of", "expenditure")}
REACH = 90


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def figures(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(FIGURE), F.lit(0))


def decimal_convention(text: Column) -> Column:
    """point, comma or unknown, by votes: three for a figure with both separators, two for a clear decimal."""
    point = lambda s: F.when(s.rlike(r"^\d{1,3}(,\d{3})+\.\d+$"), 3).when(s.rlike(r"^\d+\.(\d{1,2}|\d{4,})$"), 2).otherwise(0)
    comma = lambda s: F.when(s.rlike(r"^\d{1,3}(\.\d{3})+,\d+$"), 3).when(s.rlike(r"^\d+,(\d{1,2}|\d{4,})$"), 2).otherwise(0)
    total = lambda vote: F.aggregate(figures(text), F.lit(0), lambda a, s: a + vote(s))
    return F.when(total(point) > total(comma), "point").when(total(comma) > total(point), "comma").otherwise("unknown")


def parse_figure(raw: Column, convention: Column) -> Column:
    """value and whether another reading was possible; an unknown convention reads three digits as grouped."""
    body = F.replace(F.trim(raw), F.lit(" "), F.lit(""))
    points, commas = F.length(body) - F.length(F.replace(body, F.lit("."), F.lit(""))), F.length(body) - F.length(F.replace(body, F.lit(","), F.lit("")))
    single = points + commas == 1
    three = body.rlike(r"^\d{1,3}[.,]\d{3}$")
    separator = F.regexp_extract(body, "([.,])", 1)
    last = F.regexp_extract(body, r"([.,])\d+$", 1)
    grouping = F.when(convention == "point", ",").otherwise(".")
    expected = F.when(convention == "point", ".").otherwise(",")
    decimal = (
        F.when((points > 0) & (commas > 0), last)
        .when(single & three & (convention == "unknown"), F.lit(None))
        .when(single & three & (separator == grouping), F.lit(None))
        .when(single, separator)
    )
    ambiguous = (single & three & (convention == "unknown")) | (single & ~three & (convention != "unknown") & (separator != expected))
    plain = F.regexp_replace(body, "[.,]", "")
    other = F.when(decimal == ".", ",").otherwise(".")
    value = F.when(decimal.isNull(), plain).otherwise(F.replace(F.replace(body, other, F.lit("")), decimal, F.lit(".")))
    return F.struct(value.try_cast("double").alias("value"), F.coalesce(ambiguous, F.lit(False)).alias("ambiguous"))


def canonical_numeral(raw: Column) -> Column:
    """One spelling of a figure whatever its separators: the last of two kinds is the decimal one, groups of three are grouped."""
    body = F.replace(raw, F.lit(" "), F.lit(""))
    both = F.contains(body, F.lit(".")) & F.contains(body, F.lit(","))
    last = F.regexp_extract(body, r"([.,])\d+$", 1)
    other = F.when(last == ".", ",").otherwise(".")
    grouped = body.rlike(r"^\d{1,3}([.,]\d{3})+$")
    return F.when(both, F.replace(F.replace(body, other, F.lit("")), last, F.lit("."))).when(grouped, F.regexp_replace(body, "[.,]", "")).otherwise(F.replace(body, F.lit(","), F.lit(".")))


def years(text: Column) -> Column:
    """Four digits among no others that read as a year of this span, once each and in order."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(FOUR_DIGITS), F.lit(1)), lambda y: y.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda y: y.between(FIRST_YEAR, LAST_YEAR))))


def percents(text: Column) -> Column:
    """kind and value: points before plain percent, basis points as hundredths of a point."""
    number = r"(\d+(?:[.,]\d+)?)[ ]*"
    kinds = [("points", rf"(?i){number}(?:percentage points?|pp\b|puntos porcentuales)", 1.0), ("points", rf"(?i){number}(?:basis points?|bps\b|puntos base)", 0.01), ("percent", rf"(?i){number}(?:%|per ?cent\b|por ciento\b|prozent\b|pour cent\b)(?! points?| porcentuales)", 1.0)]
    return F.concat(*[_percent(text, *k) for k in kinds])


def _percent(text: Column, kind: str, pattern: str, factor: float) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda s: F.struct(F.lit(kind).alias("kind"), (F.replace(s, F.lit(","), F.lit(".")).cast("double") * F.lit(factor)).alias("value")))


MONEY = r"(?i)(US\$|[€£¥$]|\b(?:USD|EUR|GBP|CHF|JPY|BRL)\b)?[ ]*(\d+(?:[.,]\d+)*)[ ]*(thousand|millones|millionen|million|milliard|billones|billion|trillion|tausend|mille|mil)?\b[ ]*(?:of |de )?(US\$|[€£¥$]|\b(?:USD|EUR|GBP|CHF|JPY|BRL)\b)?"


def money(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Amounts with a currency sign, code or scale word: amount, currency, role by the nearest cue before it."""
    raw = docs.select(id_col, text_col, F.posexplode(F.regexp_extract_all(text_col, F.lit(MONEY), F.lit(0))).alias("ord", "raw"))
    part = lambda k: F.nullif(F.regexp_extract("raw", MONEY, k), F.lit(""))
    m = raw.select(id_col, text_col, "ord", "raw", part(2).alias("number"), F.lower(part(3)).alias("scale"), F.upper(F.coalesce(part(1), part(4))).alias("mark"))
    m = m.where("mark is not null or scale is not null")
    amount = parse_figure(F.col("number"), F.lit("unknown")).value * F.coalesce(_map(SCALES)[F.col("scale")], F.lit(1.0))
    currency = F.coalesce(_map(CURRENCIES)[F.col("mark")], F.lit(UNKNOWN_CURRENCY))
    before = fold(F.col(text_col))
    at = F.expr(f"instr({text_col}, raw)")
    window = F.substring(before, F.greatest(at - 60, F.lit(1)), F.least(at, F.lit(60)))
    cues = [(role, cue) for role, group in ROLE_CUES.items() for cue in group]
    m = m.withColumn("w", window)
    found = F.array(*[F.when(F.contains("w", F.lit(cue)), F.struct(F.length(F.substring_index("w", cue, -1)).alias("gap"), F.lit(k).alias("rank"), F.lit(role).alias("role"))) for k, (role, cue) in enumerate(cues)])
    nearest = F.array_min(F.array_compact(found)).role
    return m.select(id_col, F.col("ord").cast("long").alias("ord"), "raw", amount.alias("amount"), currency.alias("currency"), F.coalesce(nearest, F.lit("unspecified")).alias("role"))


def dates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """ISO, numeric (a part over 12 decides the order, else day first and ambiguous) and written dates."""
    low = F.lower(F.col(text_col))
    months = "|".join(MONTHS)
    iso = F.transform(F.regexp_extract_all(low, F.lit(r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)"), F.lit(0)), lambda s: F.struct(s.alias("raw"), F.try_to_timestamp(s, F.lit("yyyy-MM-dd")).cast("date").alias("date"), F.lit(False).alias("ambiguous")))

    def numeric(s: Column) -> Column:
        p = F.split(s, "[/.-]")
        a, b, y = (p[k].cast("int") for k in range(3))
        year = F.when(y >= 100, y).when(y <= 68, y + 2000).otherwise(y + 1900)
        day, month = F.when(b > 12, b).otherwise(a), F.when(b > 12, a).otherwise(b)
        return F.struct(s.alias("raw"), F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, day), F.lit("yyyy-MM-dd")).cast("date").alias("date"), ((a <= 12) & (b <= 12) & (a != b)).alias("ambiguous"))

    num = F.transform(F.regexp_extract_all(low, F.lit(r"(?<![\d./-])\d{1,2}[/.-]\d{1,2}[/.-](?:\d{4}|\d{2})(?![\d./-])"), F.lit(0)), numeric)

    def written(s: Column) -> Column:
        day, name, year = (F.regexp_extract(s, rf"(\d{{1,2}}) ({months}) (\d{{4}})", k) for k in (1, 2, 3))
        text = F.format_string("%s-%02d-%02d", year, _map(MONTHS)[name], day.cast("int"))
        return F.struct(s.alias("raw"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date").alias("date"), F.lit(False).alias("ambiguous"))

    words = F.transform(F.regexp_extract_all(low, F.lit(rf"(?<!\d)\d{{1,2}} (?:{months}) \d{{4}}(?!\d)"), F.lit(0)), written)
    return docs.select(id_col, F.explode(F.concat(iso, num, words)).alias("d")).select(id_col, "d.raw", "d.date", "d.ambiguous").where("date is not null")


def durations(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    units, words = "|".join(sorted(UNITS, key=len, reverse=True)), "|".join(NUMBER_WORDS)
    pattern = rf"(?<!\w)(\d{{1,4}}|{words}) +(?:(?:working|business) +)?({units})\b"
    raw = docs.select(id_col, F.explode(F.regexp_extract_all(fold(F.col(text_col)), F.lit(pattern), F.lit(0))).alias("raw"))
    n, unit = F.regexp_extract("raw", pattern, 1), F.regexp_extract("raw", pattern, 2)
    value = F.coalesce(_map(NUMBER_WORDS)[n], n.try_cast("int"))
    return raw.select(id_col, "raw", value.alias("value"), F.concat(F.when(F.col("raw").rlike("working|business"), "working_").otherwise(""), _map(UNITS)[unit]).alias("unit"))


def deadlines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The first date or duration within reach after a cue; the earlier one, a date before a duration; cues without one give nothing."""
    units, words = "|".join(sorted(UNITS, key=len, reverse=True)), "|".join(NUMBER_WORDS)
    cues = "|".join(sorted(DEADLINE_CUES, key=len, reverse=True))
    thing = rf"\d{{4}}-\d{{2}}-\d{{2}}|(?:\d{{1,4}}|{words}) +(?:{units})\b"
    pattern = rf"\b({cues})\b((?s:.{{0,{REACH - 1}}}?))({thing})"
    found = docs.select(id_col, F.explode(F.regexp_extract_all(fold(F.col(text_col)), F.lit(pattern), F.lit(0))).alias("hit"))
    part = lambda k: F.regexp_extract("hit", pattern, k)
    return found.select(id_col, part(1).alias("cue"), part(3).alias("object"), F.when(part(3).rlike(r"^\d{4}-"), "date").otherwise("duration").alias("kind"))


# The orders in which kinds claim the characters of a figure.
PRECEDENCE = ("money", "percent", "date", "duration", "count")


def claim_ranges(spans: DataFrame, id_col: str) -> DataFrame:
    """Spans (start, end, kind) that overlap none of an earlier kind; within a kind the leftmost stays.

    One window per text: a span of a later kind goes if it meets any of an
    earlier one, and a text's spans are few.
    """
    rank = F.array_position(F.array(*[F.lit(k) for k in PRECEDENCE]), F.col("kind"))
    grouped = spans.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind"))).alias("s"))
    empty = F.array().cast("array<struct<rank:bigint,start:bigint,end:bigint,kind:string>>")

    def step(kept: Column, x: Column) -> Column:
        return F.when(F.exists(kept, lambda k: (k.start < x.end) & (x.start < k.end)), kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate(F.transform("s", lambda x: F.struct(x.rank.cast("bigint").alias("rank"), x.start.cast("bigint").alias("start"), x.end.cast("bigint").alias("end"), x.kind.alias("kind"))), empty, step)
    return grouped.select(id_col, F.explode(kept).alias("k")).select(id_col, "k.start", "k.end", "k.kind")


# Phrases that credit another source with a text.
CREDITS = (
    "with reporting by", "reporting by", "reported by", "originally published by", "originally published in", "originally published at", "first reported by",
    "republished from", "syndicated from", "syndicated by", "con información de", "información de", "según informó", "publicó originalmente",
    "reproduzido de", "com informações de", "com informações do", "avec informations de", "avec des informations de", "d'après un article de",
)
LEAST_NAME = 2


def _spellings(phrases: tuple[str, ...]) -> list[str]:
    """The phrases with any white space, each also as it is written without accents."""
    plain = str.maketrans(ACCENTED, PLAIN)
    both = {p: None for phrase in phrases for p in (phrase, phrase.translate(plain))}
    return [p.replace(" ", r"\s+") for p in both]


#: Constructions that name a source, the most particular first: a dateline, a bracket at the start, a phrase, a desk after a dash.
WIRE = (
    r"^\s*\p{Lu}[\p{L} .'-]{1,40},\s*\d{1,2}\s*\p{L}{0,12}\.?\s*\(([^)]{2,40})\)",
    r"^\s*\((\p{L}[^)]{1,39})\)\s*[-–—:]",
    rf"(?i)(?:{'|'.join(_spellings(CREDITS))})\s+([\p{{L}}\p{{N}} .'&-]{{2,40}})",
    r"(?i)[/–—-]\s*(?:agencia|agency|wire)\s+([\p{L}\p{N} .'&-]{2,30})",
)
_MARGIN = r"^[ .,–—-]+|[ .,–—-]+$"


def _trie(words: list[str]) -> str:
    """A pattern for any of some patterns of which none begins another; what stands first in several is tried once."""
    heads: dict[str, list[str]] = {}
    for w in words:
        head = r"\s+" if w.startswith(r"\s+") else w[:1]
        heads.setdefault(head, []).append(w[len(head) :])
    parts = [head + (rest[0] if len(rest) == 1 else _trie(rest)) for head, rest in heads.items()]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


#: WIRE with its long alternation factored, which takes a fraction of the time.
_FAST_WIRE = tuple(p.replace(f"(?:{'|'.join(_spellings(CREDITS))})", _trie(_spellings(CREDITS))) for p in WIRE)


#: What the normalised text holds wherever the construction of WIRE at that place fits; nothing stands for any text.
_WIRE_SIGNS = ((), (), tuple({p.translate(str.maketrans(ACCENTED, PLAIN)): None for p in CREDITS}), ("agencia", "agency", "wire"))


def wire_agency(text: Column, plain: Column | None = None) -> Column:
    """Whom a text credits, by the first construction that names anyone; null without.

    plain: the normalised text, where it is at hand; only texts whose plain form has the words of a construction are searched for it.
    """

    def found(p: str, signs: tuple[str, ...]) -> Column:
        name = F.regexp_extract(text, p, 1)
        return name if plain is None or not signs else F.when(reduce(or_, [F.contains(plain, F.lit(s)) for s in signs]), name).otherwise("")

    names = [F.regexp_replace(found(p, signs), _MARGIN, "") for p, signs in zip(_FAST_WIRE, _WIRE_SIGNS)]
    return F.coalesce(*[F.when(F.length(n) >= LEAST_NAME, n) for n in names])


def sql_wire_agency(x: str) -> str:
    """The same in DuckDB."""
    names = [f"regexp_replace(regexp_extract({x}, '{p.replace(chr(39), chr(39) * 2)}', 1), '{_MARGIN}', '', 'g')" for p in WIRE]
    return "coalesce(" + ", ".join(f"CASE WHEN length({n}) >= {LEAST_NAME} THEN {n} END" for n in names) + ")"


def short_label(text: Column, figure: Column, words: int = 4) -> Column:
    """Up to `words` words before the first occurrence of a figure."""
    before = F.filter(F.split(F.call_function("substring_index", text, figure, F.lit(1)), r"\s+"), lambda w: w != "")
    size = F.size(before)
    return F.array_join(F.slice(before, F.greatest(size - words + 1, F.lit(1)), F.lit(words)), " ")
