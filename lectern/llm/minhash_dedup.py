"""Near duplicates by circulant MinHash.

Words are runs without \\x20 and \\x09-\\x0D with A-Z lower-cased; a document's
set holds its distinct word shingles (the whole sequence if it is shorter,
nothing without words). One permutation scatters the shingles over a universe
of UNIVERSE cells, a second one, shifted circularly by 0, 1, 2 ..., gives all
signature coordinates. Bands of coordinates propose candidates, and shared full
sets decide. The number of bands is taken from the threshold so that a pair at
the threshold is missed with a probability under MISS.

Documents with one set form a class, and only classes are compared. In a bucket
all members are held against a hub, the member that most buckets share. Where
members other than the hub stay in different components, their signatures of
LONG coordinates are compared inside the bucket, in blocks of BLOCK members, and
the pairs that may reach the threshold are confirmed on full sets as well.

Documents without words or text are linked with nothing. Rows with a null id
count in no component (component_id null) and are kept. Rows that share an id
count as one document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import _kernels as K
from lectern.llm._stages import Stages, grouped_batches
from lectern.llm.components import components

UNIVERSE = 1 << 20
ROWS = 5
LONG = 4096
BLOCK = 4096
MISS = 1e-6
SEED = 20240229
U64 = np.uint64

_SKETCH = "doc_id long, n_shingles long, hi long, lo long, bands array<long>"


def band_count(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return max(1, math.ceil(math.log(miss) / math.log1p(-(threshold**rows))))


def permutations(width: int) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and all circular shifts of the second one as rows of a view."""
    cache = K.process_cache()
    if ("pi", width) not in cache:
        rng = np.random.default_rng(SEED)
        sigma, pi = rng.permutation(UNIVERSE).astype(np.uint32), rng.permutation(UNIVERSE).astype(np.uint32)
        cache["pi", width] = sigma, np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: width - 1]]), width)
    return cache["pi", width]


def signature(shingles: np.ndarray, width: int) -> np.ndarray:
    """Least value of each shifted permutation over the set."""
    sigma, shifts = permutations(width)
    cells = sigma[(shingles >> U64(11)).astype(np.int64) & (UNIVERSE - 1)]
    out = np.full(width, UNIVERSE, np.uint32)
    step = max(1, (1 << 19) // width)
    for lo in range(0, len(cells), step):
        np.minimum(out, shifts[cells[lo : lo + step]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    m = sig.reshape(-1, rows).astype(U64)
    acc = np.arange(len(m), dtype=U64) + U64(1)
    for k in range(rows):
        acc = K.mix(acc * U64(0x9E3779B97F4A7C15) + m[:, k])
    return acc


def sketcher(n: int, rows: int, bands: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, data, off in K.text_chunks(batch.column("text")):
                data = K.fold_ascii(data)
                sizes, hi, low, keys = [], [], [], []
                for s in K.text_shingle_sets(data, off, n):
                    sizes.append(len(s))
                    # sets are compared by two 64-bit sums of independent mixes
                    hi.append(int(K.mix(s + U64(1)).sum(dtype=U64)) - (1 << 63))
                    low.append(int(K.mix(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64)) - (1 << 63))
                    keys.append(K.signed(band_keys(signature(s, rows * bands), rows)) if len(s) else np.zeros(0, np.int64))
                values = np.concatenate(keys)
                offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, len(sizes)), pa.array(sizes, pa.int64()), pa.array(hi, pa.int64()), pa.array(low, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                    names=["doc_id", "n_shingles", "hi", "lo", "bands"],
                )
        K.trim()

    return run


def set_builder(n: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, data, off in K.text_chunks(batch.column("text")):
                sets = [K.signed(s) for s in K.text_shingle_sets(K.fold_ascii(data), off, n)]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, len(sets)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["doc_id", "shingles"])
        K.trim()

    return run


def long_signatures(batches):
    """One bit of each of LONG coordinates."""
    for batch in batches:
        sets = batch.column("shingles")
        values, off = _unsigned(sets)
        out = [np.packbits(signature(values[off[i] : off[i + 1]], LONG) & 1).tobytes() for i in range(len(sets))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "print"])
    K.trim()


def _unsigned(lists) -> tuple[np.ndarray, np.ndarray]:
    return lists.values.to_numpy().view(U64), lists.offsets.to_numpy()


def similar_pairs(num: int, den: int):
    """Pairs of one bucket in different components whose long signatures don't rule out the threshold.

    A pair at the threshold agrees in fewer bits than asked for with a
    probability under MISS (five standard deviations). A pair that shares
    several buckets is named by the one with the least key.
    """
    p = (1 + num / den) / 2
    most = LONG - int(LONG * p - 5 * math.sqrt(LONG * p * (1 - p)))

    def run(batches):
        for t in grouped_batches(batches, ["key", "i", "j"], rows=BLOCK, size=16 << 20):
            key, i, j, rep, n, comp, own = (t[c].to_numpy() for c in ("key", "i", "j", "rep", "n", "comp", "own"))
            prints = np.frombuffer(b"".join(t["print"].to_pylist()), "<u8").reshape(-1, LONG // 64)
            keys = t["keys"].combine_chunks()
            keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
            off, flat = keys.offsets.to_numpy(), keys.values.to_numpy()
            border = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), True])
            a, b = [], []
            for lo, hi in zip(border[:-1], border[1:], strict=True):
                for x in range(lo, hi):
                    y = np.arange(x + 1, hi)
                    ok = (comp[y] != comp[x]) & (den * np.minimum(n[y], n[x]) >= num * np.maximum(n[y], n[x]))
                    if i[x] != j[x]:
                        ok &= own[y] != own[x]
                    y = y[ok]
                    y = y[np.bitwise_count(prints[y] ^ prints[x]).sum(axis=1) <= most]
                    mine = flat[off[x] : off[x + 1]]
                    y = [k for k in y.tolist() if np.intersect1d(mine, flat[off[k] : off[k + 1]], assume_unique=True)[0] == key[x]]
                    a.append(np.minimum(rep[y], rep[x]))
                    b.append(np.maximum(rep[y], rep[x]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
        K.trim()

    return run


def _confirm(edges: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Edges with `linked`: den * intersection >= num * union, on full sets."""
    a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    met = edges.join(a, "a").join(b, "b").select("a", "b", both.alias("n"), (F.size("sa") + F.size("sb")).cast("long").alias("total"))
    return met.select("a", "b", (F.lit(den) * F.col("n") >= F.lit(num) * (F.col("total") - F.col("n"))).alias("linked"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; documents with Jaccard num/den or more are linked."""
    stages = Stages(docs.sparkSession, "minhash")
    bands = band_count(num / den, rows)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sketch = stages.save(plain.mapInArrow(sketcher(shingle, rows, bands), _SKETCH), "sketch")
    classes = sketch.where("n_shingles > 0 and doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"))
    classes = stages.save(classes, "classes")  # a table of its own: the join can then split a hot class
    members = stages.save(sketch.join(classes, ["hi", "lo"], "left").select("doc_id", "n_shingles", "rep", "bands"), "members")
    stages.drop("sketch", "classes")
    reps = members.where("doc_id = rep")
    buckets = _buckets(stages, reps)
    sets = stages.save(plain.join(buckets.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(set_builder(shingle), "doc_id long, shingles array<long>").distinct(), "sets")
    links = _linked(stages, buckets, sets, num, den)
    out = members.select("doc_id", "n_shingles", "rep")
    if links is None:
        comp = F.col("rep")
    else:
        out = out.join(links.withColumnRenamed("id", "rep"), "rep", "left")
        comp = F.coalesce("comp", "rep")
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(comp)
    own = F.when(F.col("doc_id").isNotNull(), alone)
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def _buckets(stages: Stages, reps: DataFrame) -> DataFrame:
    """(key, rep, n): the buckets with more than one class."""
    flat = reps.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    several = flat.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("key")
    return stages.save(flat.join(stages.save(several, "several"), "key"), "buckets")


def _linked(stages: Stages, buckets: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame | None:
    """Components (id, comp) of the confirmed links; None without any."""
    fits = F.lit(den) * F.least("n", "hub_n") >= F.lit(num) * F.greatest("n", "hub_n")
    sizes = buckets.groupBy("key").agg(F.count("*").alias("size"))
    popular = buckets.join(stages.save(sizes, "sizes"), "key").groupBy("rep").agg(F.sum("size").alias("pop"))
    ranked = stages.save(buckets.join(popular, "rep"), "ranked")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("pop", (-F.col("rep")).alias("minus"), "n")).alias("hub")).select("key", (-F.col("hub.minus")).alias("hub"), F.col("hub.n").alias("hub_n"))
    hubs = stages.save(hubs, "hubs")
    star = ranked.join(hubs, "key").where((F.col("rep") != F.col("hub")) & fits).select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    seen = stages.save(_confirm(star, sets, num, den), "star")
    comps = components(seen.where("linked"), stages, "star-comp")
    # a bucket is open while members other than its hub, which was compared with all, lie in several components
    placed = ranked.join(hubs.select("key", "hub"), "key").where(F.col("rep") != F.col("hub")).join(comps, F.col("rep") == F.col("id"), "left").select("key", "rep", "n", F.coalesce("comp", "rep").alias("comp"))
    placed = stages.save(placed, "placed")
    unsettled = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    blocks = stages.save(unsettled.select("key", F.ceil(F.col("size") / F.lit(BLOCK)).cast("int").alias("blocks")), "unsettled")
    left = placed.join(blocks, "key")
    prints = sets.join(left.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(long_signatures, "doc_id long, print binary")
    shared = left.groupBy("rep").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    prints = prints.join(shared, F.col("doc_id") == F.col("rep")).select("doc_id", "print", "keys")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")))
    dealt = left.join(prints, F.col("rep") == F.col("doc_id")).select("key", "rep", "n", "comp", "print", "keys", own.alias("own"), F.explode(pairs).alias("p")).select("key", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "rep", "n", "comp", "print", "keys", "own")
    likely = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(similar_pairs(num, den), "a long, b long").distinct()
    more = stages.save(_confirm(likely.join(seen.select("a", "b"), ["a", "b"], "left_anti"), sets, num, den), "rest")
    return components(seen.where("linked").union(more.where("linked")), stages, "comp")


def op4_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, shingle=3, num=85)
