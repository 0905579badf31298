"""Candidate search for repeated windows, shared by the byte and the word operator.

A window of fixed length is named by its minimiser: the unit (a run of bytes
or words) with the least hash, the leftmost of equals. Equal windows have equal
minimisers at equal offsets, so a window whose minimiser occurs once in the
corpus is not repeated, and consecutive windows with one minimiser travel as
one segment. Segments with equal content are counted by partial aggregation
before any of their text moves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import _kernels as K

SEGMENT_SCHEMA = "doc_id long, th long, s0 int, nw int, a0 int, size int, key long, seg long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("s0", pa.int32()), ("nw", pa.int32()), ("a0", pa.int32()), ("size", pa.int32()), ("key", pa.int64()), ("seg", pa.int64())])


def runs_of_minimisers(order: np.ndarray, ends: np.ndarray, width: int, unit: int):
    """Runs of windows with one minimiser.

    order: 32-bit order values of the units, by start; ends: for each start of
    a window the end of its text, in the same positions. Returns first window,
    number of windows and minimiser position of each run.
    """
    span = width - unit + 1
    if len(order) < span:
        return (np.zeros(0, np.int64),) * 3
    x = (order.astype(np.uint64) << np.uint64(32)) | np.arange(len(order), dtype=np.uint64)
    p = (K.window_min(x, span) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    m = len(p)
    inside = np.arange(m) + width <= ends[:m]
    new = np.ones(m, bool)
    new[1:] = (p[1:] != p[:-1]) | (inside[1:] != inside[:-1])
    border = np.flatnonzero(new)
    length = np.diff(np.append(border, m))
    keep = inside[border]
    first = border[keep]
    return first, length[keep], p[first]


def order32(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def byte_unit_order(data: np.ndarray, unit: int) -> np.ndarray:
    """Order values of all runs of `unit` (a power of two) bytes, by doubling."""
    h = data.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(12345)
    span, factor = 1, 0x01000193
    while span < unit:
        h = h[:-span] * np.uint32(factor) + h[span:]
        factor, span = factor * factor & 0xFFFFFFFF, span * 2
    return order32(h)


def byte_segments(window: int, unit: int, reach: int):
    """Segments of windows of `window` bytes, with the bytes that windows of `reach` from the same starts cover.

    The first `window` bytes of a longer string name it, so equal strings of
    either length meet at one minimiser.
    """

    def run(batches):
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("th")
            for lo, data, off in K.text_chunks(batch.column("text")):
                if len(data) < window:
                    continue
                sizes = np.diff(off)
                ends = np.repeat(off[1:], sizes)
                s, nw, p = runs_of_minimisers(byte_unit_order(data, unit), ends, window, unit)
                if not len(s):
                    continue
                doc = np.searchsorted(off, s, side="right") - 1
                key = K.span_hashes(data, p, np.full(len(p), unit))
                size = np.minimum(nw + (reach - 1), off[doc + 1] - s)
                seg = K.span_hashes(data, s, size, seed=1)
                yield _emit(ids, hashes, lo + doc, s - off[doc], nw, p - s, size, key, seg)
            K.trim()

    return run


def word_segments(window: int, unit: int):
    def run(batches):
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("th")
            for lo, data, off in K.text_chunks(batch.column("text")):
                starts, ends, first = K.word_bounds(data, off)
                if len(starts) < window:
                    continue
                wh = K.span_hashes(data, starts, ends - starts)
                grams = K.gram_hashes(wh, unit)
                text_end = np.repeat(first[1:], np.diff(first))
                s, nw, p = runs_of_minimisers(order32((grams >> np.uint64(17)).astype(np.uint32)), text_end, window, unit)
                if not len(s):
                    continue
                doc = np.searchsorted(first, s, side="right") - 1
                # the words of a segment as one span would also hold its white space; hash the word hashes
                flat = wh.view(np.uint8)
                size = nw + (window - 1)
                seg = K.span_hashes(flat, s * 8, size * 8, seed=1)
                yield _emit(ids, hashes, lo + doc, s - first[doc], nw, p - s, size, grams[p], seg)
            K.trim()

    return run


def _emit(ids, hashes, row, s0, nw, a0, size, key, seg) -> pa.RecordBatch:
    at = pa.array(row)
    cols = [ids.take(at), hashes.take(at), pa.array(s0.astype(np.int32)), pa.array(nw.astype(np.int32)), pa.array(a0.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(K.signed(key)), pa.array(K.signed(seg))]
    return pa.RecordBatch.from_arrays(cols, schema=_ARROW)


def keyed_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and a hash of the text: rows that repeat an id with another text stay apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))


def repeated_segments(stages, keyed: DataFrame, find) -> DataFrame:
    """Segments whose minimiser occurs more than once, as a table."""
    found = stages.save(keyed.select("doc_id", "th", "text").mapInArrow(find, SEGMENT_SCHEMA), "segments")
    # as a table of its own, so that the join deals both sides and can split a hot key
    often = stages.save(found.groupBy("key").count().where("count > 1").select("key"), "often")
    out = stages.save(found.join(often, "key").select("doc_id", "th", "s0", "nw", "a0", "size", "key", "seg"), "repeated")
    stages.drop("segments", "often")
    return out


def distinct_segments(stages, repeated: DataFrame, latest: bool = False) -> DataFrame:
    """One row per (key, seg): copies, the earliest place (nulls last) and on demand the latest."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "s0")
    columns = [F.count("*").alias("copies"), F.min(place).alias("src"), *(F.first(c).alias(c) for c in ("nw", "a0", "size"))]
    return stages.save(repeated.groupBy("key", "seg").agg(*columns, *([F.max(place).alias("last")] * latest)), "distinct")


def with_text(parts: DataFrame, keyed: DataFrame, cut, schema: str) -> DataFrame:
    """Parts (with doc_id, th, s0 ...) meet their document and `cut` takes their texts."""
    cols = [c for c in parts.columns if c not in ("doc_id", "th")]
    lists = parts.groupBy("doc_id", "th").agg(F.collect_list(F.struct(*cols)).alias("parts"))
    same = F.col("l.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("l.th") == F.col("k.th"))
    met = keyed.alias("k").join(lists.alias("l"), same).select("k.doc_id", "k.th", "k.text", "l.parts")
    return met.mapInArrow(cut, schema)
