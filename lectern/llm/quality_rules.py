"""Quality rules as a short-circuit cascade, with DataFrame functions only.

Each rule is an expression that is true for a document to reject, and names the
measures it reads. A sample of about SAMPLE_ROWS rows (a parameter; drawn alike from all
partitions) gives the verdict of each rule; a measure costs its
weight times the characters it touches. Rules then run greedily by rejection per
cost: of the documents that are left in the sample, those the rule rejects, over
the cost of the measures that no earlier rule has taken. A document that one
rule rejects meets no later one: later measures read a text that is null by
then. The order changes the cost, never the verdict, and doesn't depend on
clocks.

Words are runs without \\x20 and \\x09-\\x0D. Null texts count as empty: no
words, so the base rule rejects them. Repeated rows are judged alike. Other
columns are kept unless a result column has their name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 400
SEED = 11
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8


# --- measures ----------------------------------------------------------------

def words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{BLANKS}]+"), "")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def count_of(text: Column, letters: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, letters, ""))).cast("long")


def with_windows(df: DataFrame, words_col: str, out: str) -> DataFrame:
    """Adds hashes of all windows of eight words, by pairing neighbours three times."""
    hashes = F.transform(words_col, lambda w: F.xxhash64(w))
    df = df.withColumn(out, hashes)
    for span in (1, 2, 4):
        pair = F.zip_with(F.col(out), F.slice(F.col(out), F.lit(1 + span), F.greatest(F.size(out) - span, F.lit(0))), lambda a, b: F.xxhash64(a, b))
        df = df.withColumn(out, F.slice(pair, F.lit(1), F.greatest(F.size(out) - span, F.lit(0))))
    return df


def covered(starts: Column) -> Column:
    """Words covered by windows at these sorted starts."""
    step = lambda acc, s: F.struct((acc.n + F.least(F.lit(WINDOW), s - acc.last)).alias("n"), s.alias("last"))
    return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), step, lambda acc: acc.n)


def repeat_words(df: DataFrame, windows_col: str, out: str) -> DataFrame:
    """Adds the number of words in windows found twice or more.

    Most texts repeat no window, which a distinct count shows; only the others
    sort their windows and look at neighbours.
    """
    several = F.size(F.array_distinct(windows_col)) < F.size(windows_col)
    marked = F.array_sort(F.transform(windows_col, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__sorted", F.when(several, marked))
    before = F.concat(F.array(F.lit(None).cast("long")), F.slice(F.col("__sorted.h"), F.lit(1), F.size("__sorted") - 1))
    after = F.concat(F.slice(F.col("__sorted.h"), F.lit(2), F.size("__sorted") - 1), F.array(F.lit(None).cast("long")))
    joined = F.arrays_zip(F.col("__sorted.h").alias("h"), F.col("__sorted.i").alias("i"), before.alias("b"), after.alias("a"))
    df = df.withColumn("__joined", F.when(F.col("__sorted").isNotNull(), joined))
    again = F.filter("__joined", lambda x: F.coalesce(x.h == x.b, F.lit(False)) | F.coalesce(x.h == x.a, F.lit(False)))
    df = df.withColumn("__starts", F.array_sort(F.transform(again, lambda x: x.i)))
    return df.withColumn(out, F.coalesce(covered(F.col("__starts")), F.lit(0)).cast("long")).drop("__sorted", "__joined", "__starts")


# --- rules -------------------------------------------------------------------

@dataclass(frozen=True)
class Rule:
    """`reject` is true for a text to reject, in integers; `needs` names the measures it reads."""

    name: str
    reject: Column
    needs: tuple[str, ...]


@dataclass(frozen=True)
class Measure:
    """`add` puts columns beside the text column it is given; `weight` is the CPU time a character, in translations of one."""

    add: Callable[[DataFrame, str], DataFrame]
    columns: tuple[str, ...]
    weight: float
    after: tuple[str, ...] = ()


def _count_words(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("__words", words(F.col(text))).withColumn("n_words", F.size("__words").cast("long")).withColumn("word_chars", F.char_length(F.array_join("__words", "")).cast("long"))


def _count_repeats(df: DataFrame, text: str) -> DataFrame:
    live = df.withColumn("__own_words", F.when(F.col(text).isNotNull(), F.col("__words")))
    return repeat_words(with_windows(live, "__own_words", "__windows"), "__windows", "n_repeat_words").drop("__windows", "__own_words")


#: Weights were fitted once on texts of 2 to 20,000 words.
MEASURES = {
    "words": Measure(_count_words, ("n_words", "word_chars", "__words"), 4.0),
    "symbols": Measure(lambda df, t: df.withColumn("n_symbols", count_of(F.col(t), SYMBOLS)), ("n_symbols",), 1.0),
    "bangs": Measure(lambda df, t: df.withColumn("__bangs", count_of(F.col(t), "!")), ("__bangs",), 1.0),
    "dup_lines": Measure(lambda df, t: df.withColumn("n_dup_lines", dup_lines(F.col(t))), ("n_dup_lines",), 2.0),
    "lines": Measure(lambda df, t: df.withColumn("__lines", F.size(F.split(t, "\n")).cast("long")), ("__lines",), 1.0),
    "repeats": Measure(_count_repeats, ("n_repeat_words",), 20.0, ("words",)),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BASE_MEASURES = ("words", "symbols", "dup_lines", "repeats")
BASE_RULES = ("few_words", "repeats")


def rules() -> list[Rule]:
    c = F.col
    return [
        Rule("few_words", c("n_words") < 20, ("words",)),
        Rule("repeats", 100 * c("n_repeat_words") > 30 * c("n_words"), ("words", "repeats")),
        Rule("symbols", 100 * c("n_symbols") > 30 * c("n_words"), ("words", "symbols")),
        Rule("exclamations", 100 * c("__bangs") > 50 * c("n_words"), ("words", "bangs")),
        Rule("short_words", c("word_chars") < 2 * c("n_words"), ("words",)),
        Rule("long_words", c("word_chars") > 15 * c("n_words"), ("words",)),
        Rule("dup_lines", 100 * c("n_dup_lines") > 40 * c("__lines"), ("dup_lines", "lines")),
    ]


def with_measures(df: DataFrame, names, have: set[str], text: str = "__text", measures: dict[str, Measure] | None = None) -> DataFrame:
    """Adds the measures that are not there yet; `have` is kept up to date."""
    measures = measures or MEASURES
    for name in names:
        if name not in have:
            df = with_measures(df, measures[name].after, have, text, measures)
            df = measures[name].add(df, text)
            have.add(name)
    return df


def missing(names, have: set[str], measures: dict[str, Measure]) -> set[str]:
    """The measures that `names` still ask for, those before them included."""
    out: set[str] = set()
    for name in set(names) - have:
        out |= {name} | missing(measures[name].after, have, measures)
    return out


def ordered(cascade: list[Rule], verdicts: list[tuple[int, dict[str, bool]]], have: set[str] | None = None, measures: dict[str, Measure] | None = None) -> list[Rule]:
    """Greedy: most rejected of what is left over the cost of what has to be measured; ties by cost, then by name.

    verdicts: for each text of the sample its characters and the rules that reject it.
    """
    measures = measures or MEASURES
    have, left, out, rest = set(have or ()), list(verdicts), [], sorted(cascade, key=lambda r: r.name)
    while rest:
        chars = sum(n for n, _ in left)

        def worth(r: Rule) -> tuple[float, float, str]:
            cost = (0.01 + sum(measures[m].weight for m in missing(r.needs, have, measures))) * (chars + 1)
            return -sum(v[r.name] for _, v in left) / cost, cost, r.name

        best = min(rest, key=worth)
        rest.remove(best)
        out.append(best)
        have |= missing(best.needs, have, measures)
        left = [x for x in left if not x[1][best.name]]
    return out


def planned(docs: DataFrame, text_col: str, sample_rows: int, have: set[str] | None = None, cascade: list[Rule] | None = None, measures: dict[str, Measure] | None = None) -> list[Rule]:
    """The rules in the order that a sample of the documents suggests; about `sample_rows` rows of verdicts reach the driver.

    The share to draw comes from a count, for which Parquet reads its footers only.
    """
    cascade = rules() if cascade is None else cascade
    share = min(1.0, sample_rows / max(docs.count(), 1))
    sample = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text")).sample(share, SEED)
    measured = with_measures(sample, [n for r in cascade for n in r.needs], set(), measures=measures)
    rows = measured.select(F.char_length("__text").alias("chars"), *[F.coalesce(r.reject, F.lit(False)).alias(f"r{k}") for k, r in enumerate(cascade)]).collect()
    return ordered(cascade, [(x["chars"], {r.name: x[f"r{k}"] for k, r in enumerate(cascade)}) for x in rows], have, measures)


def judged(
    docs: DataFrame,
    text_col: str = "text",
    keep: list[str] | None = None,
    sample_rows: int = SAMPLE_ROWS,
    always: tuple[str, ...] = BASE_MEASURES,
    cascade: list[Rule] | None = None,
    measures: dict[str, Measure] | None = None,
) -> DataFrame:
    """The measures in `always`, kept, and the first rule that rejects beside the columns in `keep`.

    With the base measures, base_failed comes too. What is not in `always` is
    measured only of texts that no earlier rule has rejected.
    """
    known = measures or MEASURES
    results = [c for m in always for c in known[m].columns if not c.startswith("__")]
    base = [F.coalesce(r.reject, F.lit(False)) for r in rules() if r.name in BASE_RULES] if {"words", "repeats"} <= set(always) else []
    taken = {*results, "base_failed", "kept", "rule", "__text", "__live", *(c for m in known.values() for c in m.columns)}
    names = [c for c in (docs.columns if keep is None else keep) if c not in taken]
    plain = [f"__own{k}" for k in range(len(names))]
    have: set[str] = set()
    order = planned(docs, text_col, sample_rows, set(always), cascade, measures)
    df = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(names, plain, strict=True)], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"))
    df = with_measures(df, always, have, measures=measures)
    if base:
        df = df.withColumn("base_failed", base[0] | base[1])
    df = df.withColumn("rule", F.lit(None).cast("string"))
    for r in order:
        if missing(r.needs, have, known):
            df = df.withColumn("__live", F.when(F.col("rule").isNull(), F.col("__text")))
            df = with_measures(df, r.needs, have, "__live", measures)
        df = df.withColumn("rule", F.coalesce("rule", F.when(r.reject, F.lit(r.name))))
    df = df.select(*plain, *results, *["base_failed"] * bool(base), F.col("rule").isNull().alias("kept"), "rule")
    return df.toDF(*names, *df.columns[len(plain) :])


def filtered(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, cascade: list[Rule] | None = None, measures: dict[str, Measure] | None = None) -> DataFrame:
    """The documents that no rule rejects, with their own columns.

    One filter follows the other, and a measure is taken only of documents
    that are still there when a rule first asks for it.
    """
    own = [f"__own{k}" for k in range(len(docs.columns))]
    df = docs.toDF(*own).withColumn("__text", F.coalesce(F.col(own[docs.columns.index(text_col)]).cast("string"), F.lit("")))
    have: set[str] = set()
    for rule in planned(docs, text_col, sample_rows, cascade=cascade, measures=measures):
        df = with_measures(df, rule.needs, have, measures=measures)
        # The partition's number isn't deterministic, so the optimiser leaves the filter above the
        # measures; pushed below them, it would repeat their expressions inside one another.
        df = df.withColumn("__at", F.spark_partition_id()).where(~rule.reject & (F.col("__at") >= 0)).drop("__at")
    return df.select(*own).toDF(*docs.columns)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(docs, keep=["doc_id"]).drop("rule")


OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS raw FROM t
), g AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), chr(10)) AS win
  FROM w, unnest(range(1, len(ws) - 6)) AS u(i) WHERE len(ws) >= 8
), r AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g
), s AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r WHERE n > 1
), c AS (
  SELECT doc_id, CAST(sum(least(8, i - coalesce(p, i - 8))) AS BIGINT) AS n_repeat_words FROM s GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(raw, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
              - len(list_distinct(list_filter(raw, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         length(text) - length(translate(text, '!', '')) AS n_bangs, len(raw) AS n_lines
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (""" + " OR ".join(f"({r})" for r in (
    "n_words < 20 OR 100 * n_repeat_words > 30 * n_words", "100 * n_symbols > 30 * n_words", "100 * n_bangs > 50 * n_words",
    "word_chars < 2 * n_words", "word_chars > 15 * n_words", "100 * n_dup_lines > 40 * n_lines",
)) + """) AS kept
FROM m
"""
