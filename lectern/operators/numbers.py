"""Numbers as claims and propositions state them: kinds, values, doubtful separators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.arrays import spread
from lectern.operators.extract import UNITS
from lectern.operators.segment import LEGAL, sentence_array

NUM = "[0-9]+(?:[.,][0-9]+)*"
# Scale words and their factors; codes and signs of currencies.
SCALES = {"thousand": 1e3, "million": 1e6, "millions": 1e6, "billion": 1e9, "billions": 1e9, "millones": 1e6}
CURRENCY = r"US\$|[€£¥]|(?:USD|EUR|GBP|CHF|JPY|BRL)\b"
_SCALE = "|".join(sorted(SCALES, key=len, reverse=True))

PERCENT = rf"(?i)({NUM}) ?(?:%|per ?cent\b|por ciento\b)"
POINTS = rf"(?i)({NUM}) ?(?:percentage points?\b|puntos porcentuales\b|pp\b)"
MONEY = rf"(?:{CURRENCY}) ?({NUM})(?: ?({_SCALE})\b)?"
MONEY_AFTER = rf"({NUM})(?: ?({_SCALE})\b)? ?(?:{CURRENCY})"
PLAIN = rf"(?:^|[^\w.,])({NUM})(?: ?({_SCALE})\b)?"
YEAR_LIKE = r"^(1[5-9]|20|21)[0-9][0-9]$"
#: In this order, and each takes its characters away from the later ones.
KINDS = (("percentage", PERCENT), ("percentage_point", POINTS), ("money", MONEY), ("money", MONEY_AFTER), ("count", PLAIN))
MASK = " § "


def _factor(word: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv])[word], F.lit(1.0))


def number_value(raw: Column) -> Column:
    """value and whether another reading was possible.

    With both separators the last is the decimal one. One kind before three
    closing digits groups, and is doubtful after a single digit; else it is
    decimal. What is no number then is 0 and doubtful.
    """
    sep = F.regexp_extract(raw, "([.,])[0-9]+$", 1)
    both = F.contains(raw, F.lit(".")) & F.contains(raw, F.lit(","))
    other = F.when(sep == ".", ",").otherwise(".")
    bare = F.regexp_replace(raw, "[.,]", "")
    grouped = ~both & raw.rlike("[.,][0-9]{3}$")
    plain = F.when(both, F.replace(F.replace(raw, other, F.lit("")), F.lit(","), F.lit("."))).when(grouped, bare).otherwise(F.replace(raw, F.lit(","), F.lit(".")))
    value = plain.try_cast("double")
    return F.struct(F.coalesce(value, F.lit(0.0)).alias("value"), (value.isNull() | (grouped & (F.length(bare) - 3 < 2))).alias("ambiguous"))


def claim_numbers(text: Column) -> Column:
    """Array of kind, value and ambiguous: percent, points, money, then plain numbers that are no years."""
    def reader(kind: str, pattern: str):
        def read(m: Column) -> Column:
            v = number_value(F.regexp_extract(m, pattern, 1))
            factor = F.lit(1.0) if pattern in (PERCENT, POINTS) else _factor(F.regexp_extract(m, pattern, 2))
            return F.struct(F.lit(kind).alias("kind"), (v.value * factor).alias("value"), v.ambiguous.alias("ambiguous"))

        return read

    rest, parts = text, []
    for kind, pattern in KINDS:
        found = F.regexp_extract_all(rest, F.lit(pattern), F.lit(0))
        if kind == "count":
            found = F.filter(found, lambda m: ~(F.regexp_extract(m, PLAIN, 1).rlike(YEAR_LIKE) & (F.regexp_extract(m, PLAIN, 2) == "")))
        parts.append(F.transform(found, reader(kind, pattern)))
        rest = F.regexp_replace(rest, pattern, MASK)
    # most texts have no digit, and need none of the patterns
    return F.when(~text.rlike("[0-9]"), F.array().cast("array<struct<kind:string,value:double,ambiguous:boolean>>")).otherwise(F.concat(*parts))


# Words before an identifier.
IDENTIFIER_CUES = ("article", "art", "section", "chapter", "annex", "number", "no")
_UNIT = "|".join(sorted(UNITS, key=len, reverse=True))
QUANTITY = rf"(?i)(?:\b(?:{'|'.join(IDENTIFIER_CUES)})\.? ?)?{NUM}(?:[-/][0-9]+)*(?: ?(?:%|percentage points?\b|pp\b|per ?cent\b|(?:{_UNIT})\b))?"


def quantities(sentence: Column) -> Column:
    """Array of kind and value of a proposition's numbers; identifiers and joined numerals are none."""
    found = F.filter(F.regexp_extract_all(sentence, F.lit(QUANTITY), F.lit(0)), lambda m: ~m.rlike("(?i)^[a-z]") & ~m.rlike("[0-9][-/][0-9]"))

    def read(m: Column) -> Column:
        raw = F.regexp_extract(m, f"({NUM})", 1)
        value, tail = number_value(raw).value, F.lower(F.trim(F.regexp_replace(m, f"^{NUM}", "")))
        kind = (
            F.when(tail.rlike("^(percentage|pp)"), "percentage_point")
            .when(tail.rlike("^(%|per)"), "percentage")
            .when(tail != "", "duration")
            .when(raw.rlike("^[0-9]{4}$") & value.between(1800, 2200), "calendar_year")
            .when(value != F.floor(value), "ratio")
            .otherwise("count")
        )
        return F.struct(kind.alias("kind"), value.alias("value"))

    return F.transform(found, read)


def proposition_quantities(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per number: sentence, kind, value."""
    parts = F.transform(sentence_array(F.coalesce(F.col(text_col), F.lit("")), LEGAL), lambda s, i: F.struct(i.alias("no"), quantities(s).alias("q")))
    s = spread(docs, [id_col], parts, "p")
    return spread(s, [id_col, F.col("p.no").cast("long").alias("no")], F.col("p.q"), "q").select(id_col, "no", "q.kind", "q.value")


