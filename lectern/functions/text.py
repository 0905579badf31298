"""Text normalisation and cleaning as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _latin() -> tuple[str, str]:
    """Lower-case letters from U+00E0 to U+017F that decompose to one ASCII letter and marks, and those letters."""
    pairs = []
    for code in range(0xE0, 0x180):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base.islower():
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _latin()

# Typographic characters and what they compare as.
QUOTES_FROM, QUOTES_TO = "‘’‚“”„«»–—― ", "'''\"\"\"\"\"--- "
ELLIPSIS, ZERO_WIDTH = "…", "​"
# Tracking parameters that say nothing about the page.
TRACKING = "utm_[^=]+|fbclid|gclid|mc_cid|mc_eid"
# Articles and legal forms that don't tell entities apart.
ARTICLES = ("the", "a", "an", "el", "la", "los", "las", "un", "una")
LEGAL_FORMS = ("inc", "ltd", "ltda", "llc", "sa", "corp", "co", "plc", "gmbh")

LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "­": "", " ": " ", "‐": "-", "‑": "-", "‒": "-"}


WORD_CHARACTER = r"[\p{L}\p{N}_]"


ASCII_WORD_CHARACTER = "[A-Za-z0-9_]"


def edges(pattern: str, w: str = WORD_CHARACTER) -> str:
    """The pattern with each \\b spelled out, by default for letters of all scripts; what \\b itself means differs between Java versions."""
    return pattern.replace(r"\b", f"(?:(?<!{w})(?={w})|(?<={w})(?!{w}))")


def sql_words(x: str) -> str:
    """For DuckDB: every other character doubled, so that `sql_word` finds neighbouring words."""
    return f"regexp_replace({x}, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g')"


def sql_word(pattern: str) -> str:
    """The pattern between characters of no word; DuckDB's \\b knows ASCII letters only."""
    return f"(?:^|[^\\p{{L}}\\p{{N}}_])(?:{pattern})(?:$|[^\\p{{L}}\\p{{N}}_])"


def fold(text: Column) -> Column:
    """Lower case without accents; other scripts stay."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def collapse(text: Column) -> Column:
    """Runs of white space to one blank; a blank that stands alone is no match."""
    return F.trim(F.regexp_replace(text, r"[\t-\r]\s*| \s+", " "))


def normalise(text: Column) -> Column:
    """The form that comparisons use: folded, typographic marks plain, white space collapsed."""
    plain = F.translate(F.lower(text), ACCENTED + QUOTES_FROM + ZERO_WIDTH, PLAIN + QUOTES_TO)
    return collapse(F.replace(plain, F.lit(ELLIPSIS), F.lit("...")))


def substitute(text: Column) -> Column:
    """Ligatures, soft hyphens and odd dashes to plain characters."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), LIGATURES.items(), text)


def rejoin_hyphens(text: Column) -> Column:
    """Words that a line end split: letter, hyphen, line end, small letter."""
    return F.regexp_replace(text, r"(\p{L})-[ \t]*\n[ \t]*(\p{Ll})", "$1$2")


def collapse_keeping_paragraphs(text: Column) -> Column:
    """Runs of blanks to one, line ends inside a paragraph to a blank, blank lines to one empty line."""
    lines = F.regexp_replace(text, r"[ \t]*\n[ \t]*", "\n")
    paragraphs = F.regexp_replace(lines, r"\n{2,}", "\x01")
    return F.trim(F.replace(F.regexp_replace(paragraphs, r"[ \t\n]+", " "), F.lit("\x01"), F.lit("\n\n")))


def slug(text: Column, longest: int = 80) -> Column:
    """[a-z0-9._-] only, other runs to one hyphen, none at the ends."""
    s = F.regexp_replace(fold(text), r"[^a-z0-9._-]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(s, r"^[-._]+|[-._]+$", ""), 1, longest), r"[-._]+$", "")


def stable_hash(*parts: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, length)


def make_id(prefix: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(prefix), stable_hash(*parts))


def valid_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[a-z]+:[A-Za-z0-9._:-]+$") & F.length(value).between(3, 200), F.lit(False))


def strip_markup(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", " ")


def canonical_url(url: Column) -> Column:
    """No scheme, www, fragment, tracking parameters or closing slash; lower case."""
    s = F.regexp_replace(F.regexp_replace(url, r"[.,;:)’\"']+$", ""), "(?i)^https?://", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)^www\.", ""), "#.*$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(s, rf"[?&]({TRACKING})=[^&]*", ""), "[?&/]+$", ""))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def same_host(host_: Column, base: Column) -> Column:
    """The base host itself or a subdomain."""
    bare = F.regexp_replace(base, r"^www\.", "")
    return (host_ == bare) | F.endswith(host_, F.concat(F.lit("."), bare))


def initials(text: Column) -> Column:
    """First letters of the words of three letters or more, folded."""
    words = F.filter(F.split(fold(text), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def acronym_fits(acronym: Column, expansion: Column) -> Column:
    """The acronym's letters appear in order among the expansion's initials, beginning with the first."""
    letters = F.split(F.regexp_replace(fold(acronym), "[^a-z0-9]", ""), "")
    pattern = F.concat(F.lit("^"), F.array_join(F.filter(letters, lambda x: x != ""), ".*"))
    return (F.size(F.filter(letters, lambda x: x != "")) >= 2) & F.regexp_like(initials(expansion), pattern)


def entity_key(label: Column) -> Column:
    """Without parentheses, punctuation, leading articles and legal forms."""
    s = F.regexp_replace(F.regexp_replace(fold(label), r"\([^)]*\)", " "), "[^a-z0-9]+", " ")
    words = F.filter(F.split(F.trim(s), " "), lambda w: w != "")
    first = F.when(F.element_at(words, 1).isin(*ARTICLES), F.slice(words, F.lit(2), F.size(words))).otherwise(words)
    return F.array_join(F.filter(first, lambda w: ~w.isin(*LEGAL_FORMS)), " ")


def spelling_variants(value: Column) -> Column:
    """An identifier as it stands, and with dots, hyphens and slashes dropped or exchanged."""
    swaps = [value, F.replace(value, F.lit("."), F.lit("")), F.replace(value, F.lit("-"), F.lit(" ")), F.replace(value, F.lit("/"), F.lit("-")), F.replace(value, F.lit("-"), F.lit("/")), F.split_part(value, F.lit("/"), F.lit(1))]
    return F.array_sort(F.array_distinct(F.filter(F.array(*swaps), lambda v: F.length(v) > 0)))


def term_key(text: Column) -> Column:
    """Normalised, with punctuation flattened."""
    return collapse(F.regexp_replace(normalise(text), r"[^a-z0-9]+", " "))


def line_signature(line: Column) -> Column:
    """A line with digit runs masked and white space collapsed."""
    return F.regexp_replace(collapse(F.lower(line)), "[0-9]+", "#")


# --- the same in DuckDB, for the queries' SQL ---

def sql_fold(x: str) -> str:
    return f"translate(lower({x}), '{ACCENTED}', '{PLAIN}')"


def sql_normalise(x: str) -> str:
    marks = QUOTES_TO.replace("'", "''")
    return f"trim(regexp_replace(replace(replace(translate({sql_fold(x)}, '{QUOTES_FROM}', '{marks}'), '…', '...'), chr(8203), ''), '\\s+', ' ', 'g'))"
