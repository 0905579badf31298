"""Repeated word passages by super-k-mer partitioning.

A window is `window` consecutive words (runs without \\x20 and \\x09-\\x0D) of
one document. Each word covered by a window whose word sequence also starts
earlier - at a smaller id, or earlier in the same document - is removed.
Consecutive windows with one minimiser travel as one packed string to the
bucket of that minimiser, where sorting counts the windows exactly: words get
dense numbers, and pairs of numbers are sorted for doubling lengths until they
name whole windows. Equal packed strings are counted before they travel, and
only the earliest copy does. Buckets with many different strings are dealt to
several tasks; each sends the first place of its windows to a merge by window.

Null or empty texts have no words. A null id counts as later than all others,
rows with equal id and text as one document, rows with equal id and different
texts as two, ordered by a hash of the text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import _kernels as K
from lectern.llm import _segments as S
from lectern.llm._stages import Stages, grouped_batches

WINDOW = 20
UNIT = 4
HOT_SEGMENTS = 2_000

_PART = "key long, shard int, shards int, seg long, nw int, no_id boolean, doc_id long, th long, s0 int, body string"
_FOUND = "key long, seg long, runs array<struct<lo:int,hi:int>>, hi long, lo long, t int, no_id boolean, doc_id long, th long, s int"
_RUNS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
_FOUND_ARROW = pa.schema(
    [("key", pa.int64()), ("seg", pa.int64()), ("runs", _RUNS), ("hi", pa.int64()), ("lo", pa.int64()), ("t", pa.int32()), ("no_id", pa.bool_()), ("doc_id", pa.int64()), ("th", pa.int64()), ("s", pa.int32())]
)


def cut_words(window: int):
    """Packed strings of the segments of each document: its words joined by one space."""

    def run(batches):
        fields = ("key", "shard", "shards", "seg", "nw", "no_id", "s0")
        for batch in batches:
            parts = batch.column("parts").to_pylist()
            out: dict[str, list] = {f: [] for f in (*fields, "doc_id", "th", "body")}
            ids, hashes = batch.column("doc_id").to_pylist(), batch.column("th").to_pylist()
            for lo, data, off in K.text_chunks(batch.column("text")):
                starts, ends, first = K.word_bounds(data, off)
                raw = data.tobytes()
                for i in range(len(off) - 1):
                    a = int(first[i])
                    for p in parts[lo + i]:
                        w = a + p["s0"]
                        e = w + p["nw"] + window - 1
                        for f in fields:
                            out[f].append(p[f])
                        out["doc_id"].append(ids[lo + i])
                        out["th"].append(hashes[lo + i])
                        out["body"].append(" ".join(raw[x:y].decode() for x, y in zip(starts[w:e].tolist(), ends[w:e].tolist(), strict=True)))
            kinds = {"key": pa.int64(), "shard": pa.int32(), "shards": pa.int32(), "seg": pa.int64(), "nw": pa.int32(), "no_id": pa.bool_(), "doc_id": pa.int64(), "th": pa.int64(), "s0": pa.int32(), "body": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(out[f], k) for f, k in kinds.items()], names=list(kinds))
            del parts, out
            K.trim()

    return run


def window_classes(words: np.ndarray, begin: np.ndarray, nw: np.ndarray, window: int) -> np.ndarray:
    """Dense class of each window, by sorting pairs of classes of doubling length.

    words: numbers of the words of all packed strings; begin, nw: first word
    and number of windows of each. Windows are listed string by string.
    """
    rank, span = words, 1
    while span * 2 <= window:
        rank = _paired(rank[:-span], rank[span:])
        span *= 2
    row = np.repeat(np.arange(len(begin)), nw)
    at = begin[row] + np.arange(len(row)) - (np.cumsum(nw) - nw)[row]
    if span == window:
        return rank[at]
    return _paired(rank[at], rank[at + window - span])


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    _, out = np.unique((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64), return_inverse=True)
    return out


def bucket_sorter(window: int):
    def run(batches):
        for t in grouped_batches(batches, ["key", "shard"], rows=8_000, size=4 << 20):
            m = t.num_rows
            lists = pc.split_pattern(t["body"], " ").combine_chunks()
            if isinstance(lists, pa.ChunkedArray):
                lists = lists.chunk(0)
            begin = lists.offsets.to_numpy()[:-1].astype(np.int64)
            words = lists.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
            nw = t["nw"].to_numpy().astype(np.int64)
            begin = begin - begin[0]
            cls = window_classes(words, begin, nw, window)
            row = np.repeat(np.arange(m), nw)
            step = np.arange(len(row)) - (np.cumsum(nw) - nw)[row]
            no_id = t["no_id"].to_numpy().astype(np.int8)
            doc = t["doc_id"].fill_null(0).to_numpy()
            th, start = t["th"].to_numpy(), t["s0"].to_numpy().astype(np.int64)[row] + step
            order = np.lexsort((start, th[row], doc[row], no_id[row], cls))
            c, r = cls[order], row[order]
            lead = np.ones(len(order), bool)
            lead[1:] = c[1:] != c[:-1]
            group = np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))
            # the same place twice, from rows that repeat a document, is one place
            same = (doc[r] == doc[r[group]]) & (th[r] == th[r[group]]) & (no_id[r] == no_id[r[group]]) & (start[order] == start[order[group]])
            late = ~lead & ~same
            flags = np.zeros((m, int(nw.max())), bool)
            flags[r[late], step[order][late]] = True
            key, seg = t["key"].to_numpy(), t["seg"].to_numpy()
            frow, lo, hi = runs_of_true(flags)
            has = np.unique(frow)
            lists_out = run_lists(len(has), np.searchsorted(has, frow), lo, hi)
            blank = [pa.nulls(len(has), f.type) for f in list(_FOUND_ARROW)[3:]]
            yield pa.RecordBatch.from_arrays([pa.array(key[has]), pa.array(seg[has]), lists_out, *blank], schema=_FOUND_ARROW)
            split = t["shards"].to_numpy() > 1
            pick = order[lead & split[r]]
            if len(pick):
                wh = K.span_hashes(*_spans(lists.flatten()))
                at = begin[row[pick]] + step[pick]
                pr = row[pick]
                cols = [
                    pa.array(key[pr]), pa.array(seg[pr]), pa.nulls(len(pick), _RUNS),
                    pa.array(K.signed(K.gram_hashes(wh, window, seed=3)[at])), pa.array(K.signed(K.gram_hashes(wh ^ np.uint64(0x5DEECE66D), window, seed=5)[at])),
                    pa.array(step[pick].astype(np.int32)), *(t[f].take(pa.array(pr)).combine_chunks() for f in ("no_id", "doc_id", "th")), pa.array(start[pick].astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(cols, schema=_FOUND_ARROW)
            K.trim()

    return run


def _spans(strings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    _, data, off = next(iter(K.text_chunks(strings, limit=1 << 62)))
    return data, off[:-1], np.diff(off)


def runs_of_true(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    wide = np.zeros((flags.shape[0], flags.shape[1] + 2), np.int8)
    wide[:, 1:-1] = flags
    change = np.diff(wide, axis=1)
    row, lo = np.nonzero(change == 1)
    _, hi = np.nonzero(change == -1)
    return row, lo, hi


def run_lists(count: int, row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    offsets = np.searchsorted(row, np.arange(count + 1)).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["lo", "hi"])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def repeated_word_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, unit: int = UNIT, hot: int = HOT_SEGMENTS) -> tuple[DataFrame, DataFrame]:
    """(documents keyed by id and text hash, word ranges to remove per key)."""
    stages = Stages(docs.sparkSession, "superkmer")
    keyed = S.keyed_documents(docs, id_col, text_col)
    repeated = S.repeated_segments(stages, keyed, S.word_segments(window, unit))
    distinct = S.distinct_segments(stages, repeated)
    groups = distinct.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    groups = stages.save(groups.select("key", F.ceil(F.col("n") / F.lit(hot)).cast("int").alias("shards")), "groups")
    parts = distinct.join(groups, "key").select(
        "src.no_id", "src.doc_id", "src.th", "src.s0", "key", F.pmod("seg", "shards").cast("int").alias("shard"), "shards", "seg", "nw"
    )
    bodies = S.with_text(parts, keyed, cut_words(window), _PART)
    found = stages.save(bodies.repartition("key", "shard").sortWithinPartitions("key", "shard").mapInArrow(bucket_sorter(window), _FOUND), "found")
    # first places of the windows of divided buckets: all but the first of each window are late
    place = F.struct("no_id", "doc_id", "th", "s")
    heads = found.where("runs is null").groupBy("hi", "lo").agg(F.min(place).alias("first"), F.collect_list(F.struct("key", "seg", "t", place.alias("own"))).alias("all")).where(F.size("all") > 1)
    across = heads.select("first", F.explode("all").alias("w")).where("first <> w.own").select("w.key", "w.seg", F.array(F.struct(F.col("w.t").alias("lo"), (F.col("w.t") + 1).alias("hi"))).alias("runs"))
    own = found.where("runs is not null").select("key", "seg", "runs").unionByName(across)
    # windows of the earliest copy are late where the bucket says so; those of other copies always
    first = distinct.select("key", "seg", "src", "nw", "copies")
    mine = own.join(first, ["key", "seg"]).select("src.doc_id", "src.th", "src.s0", F.explode("runs").alias("r"))
    copies = repeated.join(first.where("copies > 1").select("key", "seg", "src"), ["key", "seg"])
    elsewhere = ~(F.col("doc_id").eqNullSafe(F.col("src.doc_id")) & (F.col("th") == F.col("src.th")) & (F.col("s0") == F.col("src.s0")))
    others = copies.where(elsewhere).select("doc_id", "th", "s0", F.struct(F.lit(0).alias("lo"), F.col("nw").alias("hi")).alias("r"))
    ranges = mine.unionByName(others).select("doc_id", "th", (F.col("s0") + F.col("r.lo")).alias("lo"), (F.col("s0") + F.col("r.hi") + F.lit(window - 1)).alias("hi"))
    return keyed, ranges.groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("cuts"))


def _strip(batches):
    for batch in batches:
        cuts = batch.column("cuts").to_pylist()
        n_words, n_removed, sha, gone_col = [], [], [], []
        for lo, data, off in K.text_chunks(batch.column("text")):
            starts, ends, first = K.word_bounds(data, off)
            raw = data.tobytes()
            for i in range(len(off) - 1):
                a, b = int(first[i]), int(first[i + 1])
                gone = np.zeros(b - a + 1, np.int32)
                for c in cuts[lo + i] or ():
                    gone[c["lo"]] += 1
                    gone[c["hi"]] -= 1
                keep = np.cumsum(gone[:-1]) == 0
                x, y = starts[a:b][keep].tolist(), ends[a:b][keep].tolist()
                sha.append(hashlib.sha256(b" ".join([raw[s:e] for s, e in zip(x, y, strict=True)])).hexdigest())
                n_words.append(b - a)
                n_removed.append(b - a - len(x))
                _, lo_, hi_ = runs_of_true(~keep[None, :]) if b > a else ((), (), ())
                gone_col.append([{"lo": int(s), "hi": int(e)} for s, e in zip(lo_, hi_, strict=True)])
        spans = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(gone_col, spans)],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed"],
        )
        del cuts, gone_col
        K.trim()


def strip_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, unit: int = UNIT, hot: int = HOT_SEGMENTS) -> DataFrame:
    """Per row: sizes, the removed word ranges and a digest of the words that stay."""
    keyed, cuts = repeated_word_ranges(docs, id_col, text_col, window, unit, hot)
    same = F.col("k.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("k.th") == F.col("c.th"))
    met = keyed.alias("k").join(cuts.alias("c"), same, "left").select("k.doc_id", "k.text", "c.cuts")
    return met.mapInArrow(_strip, "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<lo:long,hi:long>>")


def op5_superkmer_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return strip_repeated_words(docs).drop("removed")
