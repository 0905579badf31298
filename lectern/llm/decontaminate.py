"""Benchmark passages inside documents, by SimHash over item-sized windows.

Words are runs of letters and digits, lower-cased; shingles are five words, and
a shingle weighs as many bytes as its words have. For an item of n words every
window of n words of a document that shares a shingle with an item of that size
gets a weighted SimHash of 64 bits (windows that share none have similarity 0).
A multi-index finds all items within RADIUS bits: the fingerprint is cut into
BLOCKS blocks, and by the pigeonhole rule one of them lies within
RADIUS // BLOCKS bits. The radius is five standard deviations above the mean
distance at the threshold, so a pair there is missed about once in a million
windows. Candidates count only if the exact weighted similarity of the shingle
multisets, sum of minima over sum of maxima, reaches the threshold.

Items go to the executors in blocks of at most BLOCK_BYTES of text (a longer item
is a block of its own), read one partition after the other and counted as they
come. A benchmark of one block is matched in the pass that returns the
documents. Further blocks take a pass each: what they find goes into a table by
the text's digest, the broadcast is released, and the matches join at the end.
A worker keeps the tables of one block at a time.

Items of fewer than five words are no evidence and are left out; repeated items
count once; a document shorter than the item is one window. Null or empty texts
match nothing. Repeated rows are judged alike. Other columns are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import _kernels as K
from lectern.llm import _stages

SHINGLE = 5
THRESHOLD = (80, 100)
RADIUS, BLOCKS, BITS = 24, 4, 64
BLOCK_BYTES = 8 << 20
U64 = np.uint64


def alnum_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_bounds, for runs of ASCII letters and digits and of bytes from 128."""
    solid = (((data | 32) - np.uint8(97)) < 26) | ((data - np.uint8(48)) < 10) | (data >= 128)
    return K.word_bounds(np.where(solid, data, np.uint8(32)), offsets)


def grams_of(column, limit: int = K.CHUNK_BYTES):
    """Yield (first row, shingle hashes, their weights, first word of each text) of chunks of texts."""
    for lo, data, off in K.text_chunks(pc.utf8_lower(column), limit):
        starts, ends, first = alnum_bounds(data, off)
        sizes = ends - starts
        total = np.concatenate([[0], np.cumsum(sizes)])
        g = K.gram_hashes(K.span_hashes(data, starts, sizes), SHINGLE)
        yield lo, g, total[SHINGLE:] - total[:-SHINGLE] if len(g) else total[:0], first


def simhash(grams: np.ndarray, weights: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Weighted fingerprints of the windows of `size` shingles at `starts` (sorted)."""
    lo, hi = int(starts[0]), int(starts[-1]) + size
    signs = ((grams[lo:hi, None] >> np.arange(BITS, dtype=U64)) & U64(1)).astype(np.int64) * 2 - 1
    run = np.zeros((hi - lo + 1, BITS), np.int64)
    np.cumsum(signs * weights[lo:hi, None], axis=0, out=run[1:])
    bits = run[starts - lo + size] - run[starts - lo] > 0
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


class HammingIndex:
    """All fingerprints within a radius, by blocks whose values may differ in a few bits.

    A block's near values are either enumerated from the query's or, where
    fewer values occur at all, picked among those.
    """

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS):
        self.prints, self.radius, self.reach = prints, radius, radius // blocks
        self.width = BITS // blocks
        self.shifts = np.arange(blocks, dtype=U64) * U64(self.width)
        self.tables = []
        for s in self.shifts:
            values = self._block(prints, s)
            order = np.argsort(values, kind="stable")
            distinct, start = np.unique(values[order], return_index=True)
            self.tables.append((distinct, order, np.append(start, len(order))))
        flips = sum(comb(self.width, r) for r in range(self.reach + 1))
        self.flips = None
        if max(len(t[0]) for t in self.tables) > flips:
            self.flips = np.array([sum(1 << b for b in c) for r in range(self.reach + 1) for c in combinations(range(self.width), r)], np.int64)

    def _block(self, prints: np.ndarray, shift) -> np.ndarray:
        return ((prints >> shift) & U64((1 << self.width) - 1)).astype(np.int64)

    def search(self, fingerprint: np.uint64) -> np.ndarray:
        found = []
        for s, (distinct, order, start) in zip(self.shifts, self.tables, strict=True):
            value = self._block(np.array([fingerprint]), s)[0]
            if self.flips is None:
                at = np.flatnonzero(np.bitwise_count(distinct ^ value) <= self.reach)
            else:
                near = value ^ self.flips
                at = np.minimum(np.searchsorted(distinct, near), len(distinct) - 1)
                at = at[distinct[at] == near]
            found += [order[start[k] : start[k + 1]] for k in at.tolist()]
        if not found:
            return np.zeros(0, np.int64)
        ids = np.unique(np.concatenate(found))
        return ids[np.bitwise_count(self.prints[ids] ^ fingerprint) <= self.radius]


class Items:
    """Benchmark items: shingle postings, and by size the fingerprints."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids, self.sizes, self.bags = [], [], []
        prints: dict[int, list[tuple[int, np.uint64]]] = {}
        grams, owners = [], []
        for _, g, w, first in ((0, *x[1:]) for t in texts for x in grams_of(pa.array([t], pa.string()))):
            self.ids.append(ids[len(self.sizes)])
            self.sizes.append(len(g))
            self.bags.append(bag(g, w))
            k = len(self.sizes) - 1
            if len(g):
                prints.setdefault(len(g), []).append((k, simhash(g, w, np.array([0]), len(g))[0]))
                grams.append(self.bags[k][0])
                owners.append(np.full(len(self.bags[k][0]), len(g)))
        self.index = {m: (np.array([k for k, _ in v]), HammingIndex(np.array([f for _, f in v], U64))) for m, v in prints.items()}
        all_grams, all_sizes = (np.concatenate(x) if x else np.zeros(0, U64) for x in (grams, owners))
        order = np.lexsort((all_sizes, all_grams))
        keep = np.ones(len(order), bool)
        keep[1:] = (all_grams[order[1:]] != all_grams[order[:-1]]) | (all_sizes[order[1:]] != all_sizes[order[:-1]])
        self.grams, self.gram_sizes = all_grams[order][keep], all_sizes[order][keep].astype(np.int64)
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.grams & U64(len(self.sieve) - 1)).astype(np.int64)] = True

    def hits(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose shingle some item has, once for each item size with it."""
        at = np.flatnonzero(self.sieve[(g & U64(len(self.sieve) - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(self.grams, g[at], "left"), np.searchsorted(self.grams, g[at], "right")
        n = hi - lo
        pos = np.repeat(at, n)
        return pos, self.gram_sizes[np.repeat(lo, n) + np.arange(len(pos)) - np.repeat(np.cumsum(n) - n, n)]

    def matches(self, g: np.ndarray, w: np.ndarray, pos: np.ndarray, sizes: np.ndarray, num: int, den: int) -> list[tuple]:
        """(item, start, words, similarity) of the best window for each item that one document holds."""
        best: dict[int, tuple[float, int, int]] = {}
        for m in np.unique(sizes).tolist():
            size = min(m, len(g))
            near = np.zeros(len(g) + 1, np.int64)
            p = pos[sizes == m]
            np.add.at(near, np.maximum(p - size + 1, 0), 1)
            np.add.at(near, np.minimum(p, len(g) - size) + 1, -1)
            starts = np.flatnonzero(np.cumsum(near[:-1]) > 0)
            rows, index = self.index[m]
            prints, back = np.unique(simhash(g, w, starts, size), return_inverse=True)
            for f, fp in enumerate(prints):
                for k in rows[index.search(fp)].tolist():
                    for s in starts[back == f].tolist():
                        low, high = overlap(bag(g[s : s + size], w[s : s + size]), self.bags[k])
                        if den * low >= num * high:
                            best[k] = max(best.get(k, (0.0, 0, 0)), (low / high, -s, size + SHINGLE - 1))
        return [(self.ids[k], -s, n, sim) for k, (sim, s, n) in sorted(best.items())]


def bag(g: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and the weight each has with its repeats."""
    u, back = np.unique(g, return_inverse=True)
    return u, np.bincount(back, w, len(u)).astype(np.int64)


def overlap(a, b) -> tuple[int, int]:
    """Sums of minima and of maxima."""
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    low = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    return low, int(a[1].sum() + b[1].sum()) - low


_MATCH = "array<struct<item_id:long,start:long,words:long,similarity:double>>"
_MATCH_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("words", pa.int64()), ("similarity", pa.float64())]))


def _marker(shared, digest: str, num: int, den: int):
    def run(batches):
        cache = K.process_cache()
        if cache.get("items_digest") != digest:
            cache["items_digest"], cache["items"] = digest, Items(*shared.value)
        items = cache["items"]
        for batch in batches:
            out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for lo, g, w, first in grams_of(batch.column("__text")):
                pos, sizes = items.hits(g)
                doc = np.searchsorted(first, pos, side="right") - 1
                inside = pos + SHINGLE <= first[doc + 1]
                pos, sizes, doc = pos[inside], sizes[inside], doc[inside]
                for d in np.unique(doc).tolist():
                    a, b = int(first[d]), int(first[d + 1]) - SHINGLE + 1
                    own = doc == d
                    found = items.matches(g[a:b], w[a:b], pos[own] - a, sizes[own], num, den)
                    out[lo + d] = [{"item_id": i, "start": s, "words": n, "similarity": x} for i, s, n, x in found]
            rest = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(out, _MATCH_ARROW)], names=[*rest, "__found"])

    return run


def item_blocks(items: DataFrame, block_bytes: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of the items, cut before a block would exceed `block_bytes`; one partition and one block are held."""
    ids, texts, size = [], [], 0
    for r in items.distinct().orderBy("id", "text").toLocalIterator():
        own = len(r.text.encode())
        if texts and size + own > block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r.id)
        texts.append(r.text)
        size += own
    if texts:
        yield ids, texts


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: tuple[int, int] = THRESHOLD, block_bytes: int = BLOCK_BYTES, out_col: str = "matches") -> DataFrame:
    """The documents with an array of the items each holds: item_id, start word, words, similarity."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("id"), F.col(f"`{item_text}`").cast("string").alias("text")).where("text is not null")
    cols = [c for c in docs.columns if c != out_col]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    df = docs.select(*[F.col(f"`{c}`") for c in cols], text.alias("__text"))
    blocks = item_blocks(items, block_bytes)
    block, later = next(blocks, None), next(blocks, None)
    if block is None:
        return df.drop("__text").withColumn(out_col, F.array().cast(_MATCH))

    def marker(shared, own):
        return _marker(shared, hashlib.sha256(repr(own).encode()).hexdigest(), *threshold)

    if later is None:
        return _stages.arrow_map(df, marker(spark.sparkContext.broadcast(block), block), {"__found": _MATCH}, ("__text",)).withColumnRenamed("__found", out_col)
    stages = _stages.Stages(spark, "benchmark")
    texts, tables = stages.save(df.select("__text").where("__text <> ''").distinct().select(F.sha2("__text", 256).alias("h"), "__text"), "texts"), []
    for k, own in enumerate(chain([block, later], blocks)):
        shared = spark.sparkContext.broadcast(own)
        found = _stages.arrow_map(texts, marker(shared, own), {"__found": _MATCH}, ("__text",)).where(F.size("__found") > 0)
        tables.append(stages.save(found, f"found-{k}"))
        shared.destroy()
    met = spark.read.schema(tables[0].schema).parquet(*[f"{stages.root}/found-{k}" for k in range(len(tables))]).groupBy("h").agg(F.array_sort(F.flatten(F.collect_list("__found"))).alias(out_col))
    plain = df.toDF(*[f"__own{k}" for k in range(len(cols))], "__text").withColumn("h", F.sha2("__text", 256))
    out = plain.join(met, "h", "left").select(*[f"__own{k}" for k in range(len(cols))], F.coalesce(out_col, F.array().cast(_MATCH)).alias(out_col))
    return out.toDF(*cols, out_col)


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that it holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = mark_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", F.col("m.start").alias("start_word"), F.col("m.words").alias("n_words"), F.round("m.similarity", 6).alias("similarity"))
