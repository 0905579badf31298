"""Whole documents into the text that is analysed, with the way back to the source.

Positions need the characters one by one, so a document is rewritten in Arrow
batches; what the result says of the source is then plain columns.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.segment import pages, running_lines

HYPHEN = re.compile(r"([^\W\d_])-[ \t]*\n[ \t]*(?=[^\W\d_])")
SEGMENTS = "array<struct<start:int,length:int,source:int>>"
_SEGMENTS = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source", pa.int32())]))
RUNNING, PAGE_BREAK = frozenset(), "\f"


def rewrite(text: str, marks: frozenset[tuple[str, str]] = RUNNING, separator: str = PAGE_BREAK, depth: int = 3) -> tuple[str, list[int]]:
    """The normalised text and the place in the source of each of its characters.

    In this order: running lines go (marks are their place and signature),
    odd characters become plain ones, words that a line end split are joined,
    white space collapses but for paragraphs. A character that stands for
    several keeps the first one's place.
    """
    chars, places = list(text), list(range(len(text)))
    if marks:
        chars, places = _without_lines(text, marks, separator, depth)
    out, at = chars, places
    if not T.LIGATURES.keys().isdisjoint(chars):
        out, at = [], []
        for c, p in zip(chars, places, strict=True):
            for x in T.LIGATURES.get(c, c):
                out.append(x)
                at.append(p)
    whole = "".join(out)
    keep = [True] * len(out)
    for m in HYPHEN.finditer(whole):
        if whole[m.end()].islower():
            keep[m.start() + 1 : m.end()] = [False] * (m.end() - m.start() - 1)
    if not all(keep):
        out, at = [c for c, k in zip(out, keep, strict=True) if k], [p for p, k in zip(at, keep, strict=True) if k]
    text, kept, where, pos = "".join(out), [], [], 0
    for m in re.finditer(r"[ \t\n]{2,}|[\t\n]", text):  # a single space stays as it is
        lo, hi = m.span()
        kept.append(text[pos:lo])
        where += at[pos:lo]
        gap = "\n\n" if m[0].count("\n") > 1 else " "
        kept.append(gap)
        where += [at[lo]] * len(gap)
        pos = hi
    kept.append(text[pos:])
    where += at[pos:]
    done = "".join(kept)
    left = len(done) - len(done.lstrip(" \n"))
    right = len(done.rstrip(" \n"))
    return (done[left:right], where[left:right]) if right > left else ("", [])


def signature(line: str) -> str:
    return re.sub("[0-9]+", "#", " ".join(line.lower().split()))


def _without_lines(text: str, marks, separator: str, depth: int) -> tuple[list[str], list[int]]:
    chars, places, start = [], [], 0
    for page in text.split(separator):
        lines, at = page.split("\n"), start
        for k, line in enumerate(lines):
            place = [f"top{k + 1}"] * (k < depth) + [f"end{len(lines) - k - 1}"] * (k >= len(lines) - depth)
            if not any((p, signature(line)) in marks for p in place[:1]):
                chars += [*line, "\n"]
                places += [*range(at, at + len(line)), min(at + len(line), len(text) - 1)]
            at += len(line) + 1
        start += len(page) + len(separator)
    return chars[:-1], places[:-1]


def segments(places: list[int]) -> list[dict]:
    """Runs of neighbouring characters: start in the result, length, start in the source."""
    at = np.asarray(places, np.int64)
    first = np.flatnonzero(np.r_[True, np.diff(at) != 1]) if len(at) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[first, len(at)])
    return [{"start": i, "length": n, "source": p} for i, n, p in zip(first.tolist(), sizes.tolist(), at[first].tolist(), strict=True)]


def normalise_documents(docs: DataFrame, id_col: str, text_col: str, separator: str = PAGE_BREAK) -> DataFrame:
    """(id, text, segments, n_running): normalised text, its map to the source, and how many running lines were named.

    Headers and footers are counted over all pages by one aggregation; each
    document then is rewritten with its own marks. A null text is empty.
    """
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    p = pages(own, "id", "text", separator).withColumnRenamed("page_text", "text")
    marks = running_lines(p, "id", "page_no").groupBy("id").agg(F.collect_set(F.concat_ws("\x1f", "place", "sig")).alias("marks"))

    def run(batches):
        for b in batches:
            texts, maps, counts = [], [], []
            for t, m in zip(b.column("text").to_pylist(), b.column("marks").to_pylist(), strict=True):
                named = frozenset(tuple(x.split("\x1f", 1)) for x in m or ())
                done, places = rewrite(t, named, separator)
                texts.append(done)
                maps.append(segments(places))
                counts.append(len(named))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string()), pa.array(maps, _SEGMENTS), pa.array(counts, pa.int64())], names=["id", "text", "segments", "n_running"])

    kind = own.schema["id"].dataType.simpleString()
    out = own.join(marks, "id", "left").mapInArrow(run, f"id {kind}, text string, segments {SEGMENTS}, n_running long")
    return out.withColumnRenamed("id", id_col)


def source_offset(map_: Column, offset: Column) -> Column:
    """Where the character at an offset (from 0) of the normalised text stands in the source; null past its end."""
    hit = F.filter(map_, lambda s: (s.start <= offset) & (offset < s.start + s.length))
    return F.get(F.transform(hit, lambda s: s.source + offset - s.start), F.lit(0))


def running_line_counts(pages_: DataFrame, doc_col: str, page_col: str, share: float = 0.6) -> DataFrame:
    """(document, running, pages): how many lines run through each document's pages, and on how many pages the commonest of them stands."""
    return running_lines(pages_, doc_col, page_col, share).groupBy(doc_col).agg(F.count("*").alias("running"), F.max("n_pages").alias("pages"))
