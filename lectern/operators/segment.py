"""Segmentation: pages, lines, sentences, clauses, paragraphs, chunks, quotations, phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as T
from lectern.functions.arrays import bound, spread
from lectern.functions.tokens import comparison_tokens
from lectern.operators.graph import cut_lineage
from lectern.operators.matcher import matches
from lectern.operators.phrases import phrases  # noqa: F401

# Words whose full stop ends no sentence, for news, legal and claim texts.
NEWS = tuple(
    """art arts aprox cap cf cfr co dr dra ed eds eg etc fig ie inc ing lic ltd ltda min mr mrs ms n no nro num p pag pp
    prof sa sr sra srta st ud uds vs""".split()
)
LEGAL = ("art", "arts", "cap", "inc", "lit", "no", "nro", "num", "par", "sec", "vol")
CLAIM = (*NEWS, "gov", "sen", "rep", "gen", "jr", "us", "uk", "ee", "uu")
COORDINATORS = ("and", "but", "or", "y", "pero", "o", "et", "mais", "und", "aber")

#: Stands where a full stop or a break was, and occurs in no text.
STOP, BREAK = "\x02", "\x01"


def pages(docs: DataFrame, id_col: str, text_col: str, separator: str) -> DataFrame:
    """Parts between separators with their offset in the text."""
    p = docs.select(id_col, F.posexplode(F.split(text_col, separator)).alias("page_no", "page_text"))
    w = Window.partitionBy(id_col).orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("page_text") + len(separator)).over(w), F.lit(0)).cast("long")
    return p.select(id_col, F.col("page_no").cast("long").alias("page_no"), "page_text", start.alias("char_start"))


def running_lines(pages_: DataFrame, doc_col: str, page_col: str, share: float = 0.6, depth: int = 3, longest: int = 160, least_pages: int = 3) -> DataFrame:
    """Headers and footers: signatures at the same place of many pages of a document.

    One explode of lines and two aggregations; the page counts join back on the
    document key.
    """

    def edge(lines: Column) -> Column:
        placed = F.transform(lines, lambda x, i: F.struct(x.alias("line"), (i + 1).alias("pos"), F.size(lines).alias("n")))
        return F.filter(placed, lambda s: ((s.pos <= depth) | (s.pos > s.n - depth)) & F.length(s.line).between(1, longest))

    e = spread(pages_, [doc_col, page_col], bound(F.split("text", "\n"), edge), "s").withColumn("n", F.col("s.n"))
    place = F.when(F.col("s.pos") <= depth, F.concat(F.lit("top"), F.col("s.pos").cast("string"))).otherwise(F.concat(F.lit("end"), (F.col("n") - F.col("s.pos")).cast("string")))
    counts = e.groupBy(doc_col, place.alias("place"), T.line_signature(F.col("s.line")).alias("sig")).agg(F.countDistinct(page_col).alias("n_pages"))
    total = pages_.groupBy(doc_col).agg(F.count("*").alias("pages"))
    return counts.join(total, doc_col).where((F.col("pages") >= least_pages) & (F.col("n_pages") >= F.greatest(F.lit(2), F.ceil(F.lit(share) * F.col("pages"))))).drop("pages")


def extraction_quality(docs: DataFrame, group: str, chars: str) -> DataFrame:
    covered = F.avg(F.when(F.col(chars) > 20, 1.0).otherwise(0.0))
    out = docs.groupBy(group).agg(F.count("*").alias("n_pages"), covered.alias("covered"), F.sum(chars).alias("chars"), F.avg(chars).alias("mean"))
    state = F.when((F.col("covered") >= 0.95) & (F.col("mean") >= 200), "good").when(F.col("covered") >= 0.6, "degraded").otherwise("poor")
    return out.withColumn("state", state).drop("mean")


def sentence_array(text: Column, abbreviations: tuple[str, ...]) -> Column:
    """Sentences: a stop, closing quotes and white space before what can open one; abbreviations and initials don't end any."""
    words = "|".join(sorted(abbreviations, key=len, reverse=True))
    # found by their stops, of which there are few, and only then by what stands before
    held = F.regexp_replace(text, rf"(?i)\.(?<=(?<!{T.WORD_CHARACTER})(?:{words})\.)", STOP)
    held = F.regexp_replace(held, rf"\.(?=\s\p{{Lu}})(?<=(?<!{T.WORD_CHARACTER})\p{{Lu}}\.)", STOP)
    cut = F.regexp_replace(held, r"([.!?…]+[\"'»”’)]*)\s+(?=[\"'«“¿¡(\[]*[\p{Lu}0-9])", f"$1{BREAK}")
    parts = F.transform(F.split(cut, BREAK), lambda s: F.trim(F.replace(s, F.lit(STOP), F.lit("."))))
    return F.filter(parts, lambda s: F.length(s) > 0)


def sql_sentences(x: str, abbreviations: tuple[str, ...]) -> str:
    """The same in DuckDB, which can't look around: what a match takes beside its own text is found in a second pass."""
    words = "|".join(sorted(abbreviations, key=len, reverse=True))
    before = r"(^|[^\p{L}\p{N}_])"
    for _ in range(2):
        x = rf"regexp_replace({x}, '(?i){before}({words})\.', '\1\2' || chr(2), 'g')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '{before}(\p{{Lu}})\.(\s\p{{Lu}})', '\1\2' || chr(2) || '\3', 'g')"
    x = rf"""regexp_replace({x}, '([.!?…]+["'')»”’]*)\s+(["''«“¿¡(\[]*[\p{{Lu}}0-9])', '\1' || chr(1) || '\2', 'g')"""
    return f"list_filter(list_transform(string_split({x}, chr(1)), lambda s: trim(replace(s, chr(2), '.'))), lambda s: length(s) > 0)"


def sentences(docs: DataFrame, id_col: str, text_col: str, abbreviations: tuple[str, ...]) -> DataFrame:
    s = docs.select(id_col, F.posexplode(sentence_array(F.coalesce(F.col(text_col), F.lit("")), abbreviations)).alias("no", "sentence"))
    return s.select(id_col, F.col("no").cast("long").alias("sentence_no"), "sentence")


def clauses(docs: DataFrame, id_col: str, text_col: str, least: int = 4) -> DataFrame:
    """Sentences cut at ; : and at coordinators where both sides have four words or more.

    Every coordinator is a possible cut; a fold over the pieces joins those
    that are too short to the clause before.
    """
    words = "|".join(COORDINATORS)
    size = lambda c: F.size(F.filter(F.split(c, " "), lambda w: w != ""))

    def joined(pieces: Column) -> Column:
        def step(acc: Column, piece: Column) -> Column:
            short = (size(piece) < least) | (size(F.element_at(acc, -1)) < least)
            grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat_ws(" ", F.element_at(acc, -1), piece)))
            return F.when(F.size(acc) == 0, F.array(piece)).when(short, grown).otherwise(F.concat(acc, F.array(piece)))

        return F.aggregate(pieces, F.array().cast("array<string>"), step)

    s = sentences(docs, id_col, text_col, LEGAL)
    hard = spread(s, [id_col, "sentence_no"], F.transform(F.split("sentence", r"[;:]\s+"), lambda p, i: F.struct(i.alias("i"), T.collapse(p).alias("p"))), "x")
    soft = F.split(F.regexp_replace("x.p", rf"(?i),? (?=(?:{words}) )", BREAK), BREAK)
    out = hard.select(id_col, "sentence_no", F.col("x.i").alias("part"), F.posexplode(joined(soft)).alias("k", "clause")).where("clause <> ''")
    no = F.row_number().over(Window.partitionBy(id_col, "sentence_no").orderBy("part", "k")) - 1
    return out.select(id_col, "sentence_no", no.cast("long").alias("clause_no"), "clause")


def paragraphs(docs: DataFrame, id_col: str, text_col: str, separator: str = r"\n\s*\n", least: int = 20) -> DataFrame:
    blocks = F.filter(F.transform(F.split(text_col, separator), T.collapse), lambda p: F.length(p) >= least)
    p = docs.select(id_col, F.posexplode(blocks).alias("n", "para"))
    return p.select(id_col, (F.col("n") + 1).cast("long").alias("para_no"), "para")


def chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 12_000, overlap: int = 800) -> DataFrame:
    """Overlapping pieces; the last begins where less than the overlap would be left."""
    step = size - overlap
    last = F.greatest(F.lit(1), F.ceil((F.length(text_col) - overlap) / step)) - 1
    c = docs.select(id_col, text_col, F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("chunk_no"))
    start = F.col("chunk_no") * step
    return c.select(id_col, "chunk_no", start.alias("char_start"), F.substring(F.col(text_col), (start + 1).cast("int"), F.lit(size)).alias("chunk"))


QUOTES = ("“([^“”]{8,600})”", "«([^«»]{8,600})»", "„([^„“”]{8,600})[“”]", '"([^"]{8,600})"')


def quotation_array(text: Column, least_words: int = 6) -> Column:
    # a text without the opening mark is spared the search
    found = F.concat(*[F.when(~F.contains(text, F.lit(q[0])), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(text, F.lit(q), F.lit(1))) for q in QUOTES])
    words = lambda q: F.size(F.filter(F.split(F.trim(q), r"\s+"), lambda w: w != ""))
    return F.array_distinct(F.transform(F.filter(found, lambda q: words(q) >= least_words), lambda q: F.trim(q)))


def quotations(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return spread(docs, [id_col], quotation_array(F.col(text_col)), "quote")


def abbreviations(frame: DataFrame, text_col: str) -> DataFrame:
    """`of Long Name (LN)`: acronyms that fit their expansion; the smallest expansion stands for all."""
    pattern = r"of (.*) \(([A-Z]+)\)"
    m = frame.select(F.regexp_extract(text_col, pattern, 1).alias("expansion"), F.regexp_extract(text_col, pattern, 2).alias("acronym"))
    fits = m.where((F.length("acronym") >= 2) & T.acronym_fits(F.col("acronym"), F.col("expansion")))
    return fits.groupBy("acronym").agg(F.min("expansion").alias("expansion"), F.count("*").alias("n"))


# What a hit in each zone of an article weighs.
ZONES = {"headline": 1.5, "dek": 1.2, "body": 1.0, "summary": 0.0}


def zones(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """First line, second line and the rest."""
    lines = F.split(text_col, "\n")
    body = F.array_join(F.slice(lines, F.lit(3), F.size(lines)), "\n")
    parts = F.array(
        F.struct(F.lit("headline").alias("zone"), F.element_at(lines, 1).alias("part")),
        F.struct(F.lit("dek").alias("zone"), F.try_element_at(lines, F.lit(2)).alias("part")),
        F.struct(F.lit("body").alias("zone"), F.when(F.size(lines) >= 3, body).alias("part")),
    )
    z = docs.select(id_col, F.explode(parts).alias("p")).where("p.part is not null").select(id_col, "p.zone", "p.part")
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv]), F.col("zone"))
    return z.select(id_col, "zone", weight.alias("weight"), F.length("part").cast("long").alias("chars"))


def has_body(text: Column) -> Column:
    """Whether anything stands behind the headline and the line under it."""
    return F.trim(F.array_join(F.slice(F.split(F.coalesce(text, F.lit("")), r"\s*\n"), F.lit(3), F.lit(1 << 30)), " ")) != ""


def locate(docs: DataFrame, id_col: str, text_col: str, needles: DataFrame) -> DataFrame:
    """(id, needle, at): where a passage first stands verbatim but for white space, from 1; all passages."""
    n = needles.select("needle", T.collapse(F.col("needle")).alias("pattern")).distinct()
    found = matches(docs.select(id_col, T.collapse(F.col(text_col)).alias("t")), "t", n, keep="first")
    return found.join(n, "pattern").select(id_col, "needle", (F.col("start") + 1).alias("at"))


def lexical_search(docs: DataFrame, id_col: str, text_col: str, queries: DataFrame, query_id: str, query_text: str) -> DataFrame:
    """(query, document, score) of all documents that share a token, over the number of the query's tokens: rarer tokens among the documents count more.

    Documents and queries meet on the token; only tokens that a query has are
    kept, and what a document holds of them is written once.
    """
    q = spread(queries, [query_id], F.array_distinct(comparison_tokens(F.col(query_text))), "t")
    size = q.groupBy(query_id).agg(F.count("*").alias("size"))
    w = spread(docs, [id_col], F.array_distinct(comparison_tokens(F.col(text_col))), "t")
    hits = cut_lineage(w.join(q.select("t").distinct(), "t", "left_semi"))
    n = docs.count()
    df = hits.groupBy("t").agg(F.count("*").alias("df"))
    weight = 1 / (1 + F.col("df") / F.lit(n))
    found = hits.join(df, "t").join(q, "t").groupBy(query_id, id_col).agg(F.sum(weight).alias("sum"))
    return found.join(size, query_id).select(query_id, id_col, F.round(F.col("sum") / F.col("size"), 4).alias("score"))
