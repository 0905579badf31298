"""Near duplicates by SimHash, compared in bit slices.

Words are runs without \\x20 and \\x09-\\x0D with A-Z lower-cased. Every shingle
of three words, repeats included, votes with its XXH64 (UTF-8 of the words
joined by one space, seed 42): a bit of the fingerprint is 1 if it is set in
over half of the hashes. Fewer words give their whole sequence as one shingle,
no words the fingerprint zero, which is linked like any other. Fingerprints
that differ in at most `radius` bits are linked.

Rows with one fingerprint form a class, and only different fingerprints are
compared. Two within the radius agree in at least one of radius + 1 parts of
their bits, so fingerprints meet in buckets by (part, value). A bucket of more
than BLOCK members is split again in the same way by the bits it has left, until
all fit: a bucket with few bits left can't hold more different fingerprints.

Inside a bucket fingerprints lie vertically: word w of plane p holds bit p of 64
fingerprints. A fingerprint meets 64 others at once; their distances are counted
by carry-save adders over the planes, and a word is abandoned once all its
distances exceed the radius. Of the links found in a bucket a spanning forest
goes on, so that a group of near copies gives fewer links than members.

Null texts are empty. Rows with a null id get a fingerprint, but count in no
component (component_id null) and link nothing. Rows that repeat an id are rows
of their own, linked through their texts only. Columns beside id and text are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import _kernels as K
from lectern.llm._stages import Stages, grouped_batches
from lectern.llm.components import components

BITS = 64
BLOCK = 1024
SEED = 42
SLICE = 1 << 16
PLANES_BETWEEN = 4
U64 = np.uint64
ALL = U64(0xFFFFFFFFFFFFFFFF)


# --- fingerprints ------------------------------------------------------------

def spread_bits() -> np.ndarray:
    """For each byte a word with its bits as eight bytes, so that additions count eight bits at once."""
    cache = K.process_cache()
    if "spread" not in cache:
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
        cache["spread"] = bits.copy().view("<u8")[:, 0]
    return cache["spread"]


def bit_counts(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often each bit is set among the hashes of each text; `first` has one entry more than there are texts."""
    out = np.zeros((len(first) - 1, BITS), np.int64)
    lanes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    table = spread_bits()
    # runs of at most 255 hashes of one text, whose counts fit a byte
    for lo in range(0, len(hashes), SLICE):
        hi = min(lo + SLICE, len(hashes))
        cuts = np.unique(np.concatenate([first[(first > lo) & (first < hi)], np.arange(lo, hi, 255)]))
        cuts = cuts[cuts < hi]
        sums = np.add.reduceat(table[lanes[lo:hi]], cuts - lo, axis=0)
        # a text may start amid the runs of 255, so its runs are summed by their text
        np.add.at(out, np.searchsorted(first, cuts, side="right") - 1, np.ascontiguousarray(sums).view(np.uint8).reshape(-1, BITS).astype(np.int64))
    return out


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts, and the first one of each text (one entry more)."""
    starts, ends, first = K.word_bounds(data, offsets)
    sizes = ends - starts
    at = np.cumsum(sizes + 1) - (sizes + 1)
    joined = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
    solid = np.repeat(at - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
    joined[solid] = data[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]
    count = np.diff(first)
    own = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(own)])
    head = np.repeat(first[:-1], own) + np.arange(begin[-1]) - np.repeat(begin[:-1], own)
    last = np.minimum(head + n, np.repeat(first[1:], own)) - 1
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    out = np.zeros(len(head), U64)
    for lo in range(0, len(head), SLICE):
        h, e = head[lo : lo + SLICE], last[lo : lo + SLICE]
        spans = zip(at[h].tolist(), (at[e] + sizes[e]).tolist(), strict=True)
        out[lo : lo + SLICE] = np.fromiter((digest(raw[a:b], SEED) for a, b in spans), U64, len(h))
    return out, begin


def fingerprints(data: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    hashes, first = shingle_hashes(K.fold_ascii(data), offsets, n)
    if not len(hashes):
        return np.zeros(len(offsets) - 1, U64)
    bits = 2 * bit_counts(hashes, first) > np.diff(first)[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0].astype(U64)


def fingerprinter(n: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, data, off in K.text_chunks(batch.column("text")):
                prints = fingerprints(data, off, n)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, len(prints)), pa.array(K.signed(prints))], names=["doc_id", "print"])
        K.trim()

    return run


# --- buckets -----------------------------------------------------------------

def parts(mask: int, count: int) -> list[int]:
    """The bits that `mask` lacks, dealt into `count` masks."""
    left = [b for b in range(BITS) if not mask >> b & 1]
    cuts = [len(left) * k // count for k in range(count + 1)]
    return [sum(1 << b for b in left[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _buckets(stages: Stages, prints: DataFrame, radius: int) -> list[DataFrame]:
    """Tables (mask, value, print) whose buckets hold 2 to BLOCK different fingerprints.

    The masks of a round follow from `radius` alone: three, nine, ... of them for
    a radius of 2, until so few bits are left that every bucket fits.
    """
    ready, masks, level = [], [0], 0
    held = prints.select(F.lit(0).cast("long").alias("mask"), "print")
    while True:
        finer = {m: [m | p for p in parts(m, radius + 1)] for m in masks}
        choose = F.create_map(*[x for m, deeper in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(d)) for d in deeper]))])
        dealt = held.select(F.explode(choose[F.col("mask")]).alias("mask"), "print")
        dealt = dealt.select("mask", F.col("mask").bitwiseAND(F.col("print")).alias("value"), "print").distinct() if level else dealt.select("mask", F.col("mask").bitwiseAND(F.col("print")).alias("value"), "print")
        dealt = stages.save(dealt, f"dealt-{level}")
        sizes = stages.save(dealt.groupBy("mask", "value").agg(F.count("*").alias("size")).where("size > 1"), f"sizes-{level}")
        sized = dealt.join(sizes, ["mask", "value"])
        ready.append(sized.where(F.col("size") <= BLOCK).drop("size"))
        masks = sorted({m for deeper in finer.values() for m in deeper})
        most = max((BITS - m.bit_count() for m in masks), default=0)
        if 1 << most <= BLOCK or not sizes.where(F.col("size") > BLOCK).limit(1).count():
            return ready
        held = sized.where(F.col("size") > BLOCK).select("mask", "print")
        level += 1


# --- comparison --------------------------------------------------------------

def planes_of(prints: np.ndarray) -> np.ndarray:
    """(64, words): bit i of word w of plane p is bit p of fingerprint 64 * w + i."""
    words = -(-len(prints) // 64)
    padded = np.zeros(words * 64, U64)
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8").astype(U64)


def close_pairs(prints: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions i < j of one group (equal, neighbouring entries of `group`) within the radius.

    An entry is a fingerprint and a word of 64 others. Counters start so high
    that a carry out of the last one means a distance beyond the radius.
    """
    n, planes = len(prints), planes_of(prints)
    last = np.searchsorted(group, group, side="right") - 1
    here = np.arange(n)
    width = np.where(last > here, last // 64 - here // 64 + 1, 0)
    row = np.repeat(here, width)
    word = row // 64 + np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)
    low = np.clip(row + 1 - 64 * word, 0, 64)
    high = np.clip(last[row] + 1 - 64 * word, 0, 64)
    ones = lambda k: np.where(k > 0, ALL >> (U64(64) - np.maximum(k, 1).astype(U64)), U64(0))
    live = ones(high) & ~ones(low)
    keep = live != 0
    row, word, live = row[keep], word[keep], live[keep]
    depth = max(1, radius.bit_length())
    start = (1 << depth) - 1 - radius
    counters = [np.full(len(row), ALL if start >> k & 1 else 0, U64) for k in range(depth)]
    share = np.array([np.bitwise_count(p).sum() for p in planes])
    for k, p in enumerate(np.argsort(np.abs(2 * share - n), kind="stable")):
        carry = planes[p][word] ^ (U64(0) - (prints[row] >> U64(p) & U64(1)))
        for c in range(depth):
            counters[c], carry = counters[c] ^ carry, counters[c] & carry
        live &= ~carry
        if k % PLANES_BETWEEN == PLANES_BETWEEN - 1:
            keep = live != 0
            if not keep.all():
                row, word, live = row[keep], word[keep], live[keep]
                counters = [c[keep] for c in counters]
    bits = np.unpackbits(live.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    entry, bit = np.nonzero(bits)
    return row[entry], 64 * word[entry] + bit


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n positions the least one it reaches through the pairs."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while not np.array_equal(deeper := root[root], root):
            root = deeper
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def linker(radius: int):
    def run(batches):
        for t in grouped_batches(batches, ["mask", "value"], rows=4 * BLOCK):
            mask, value, prints = (t[c].to_numpy() for c in ("mask", "value", "print"))
            border = np.r_[False, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])]
            a, b = close_pairs(prints.view(U64), np.cumsum(border), radius)
            root = forest(len(prints), a, b)
            far = np.flatnonzero(root != np.arange(len(root)))
            if len(far):
                yield pa.RecordBatch.from_arrays([pa.array(prints[root[far]]), pa.array(prints[far])], names=["a", "b"])
        K.trim()

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least id that links reach)."""
    stages = Stages(docs.sparkSession, "simhash")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = stages.save(plain.mapInArrow(fingerprinter(shingle), "doc_id long, print long"), "rows")
    classes = stages.save(rows.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("least")), "classes")
    found = None
    for k, table in enumerate(_buckets(stages, classes, radius)):
        links = table.repartition("mask", "value").sortWithinPartitions("mask", "value", "print").mapInArrow(linker(radius), "a long, b long")
        links = stages.save(links, f"links-{k}")
        found = links if found is None else found.unionByName(links)
    reached = components(found, stages, "comp")
    placed = stages.save(classes.join(reached, F.col("print") == F.col("id"), "left").select("print", "least", F.coalesce("comp", "print").alias("comp")), "placed")
    least = stages.save(placed.groupBy("comp").agg(F.min("least").alias("component_id")), "least")
    labels = stages.save(placed.join(least, "comp").select("print", "component_id"), "labels")
    out = rows.join(labels, "print", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), own.alias("component_id"))


def op11_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs)
