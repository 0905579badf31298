"""Repeated byte strings by suffix arrays.

Every byte covered by a string of `window` bytes that also starts elsewhere is
removed. Beside that, `n_late` counts the bytes covered by a string of `passage`
bytes that also starts earlier (smaller id, or same document, earlier start):
what has to go where the first copy of each passage stays.

A string is named by the minimiser of its first `passage` bytes, the anchor.
Segments (see _segments) that share an anchor travel to the shard of that
anchor. A shard sorts what stands right of its anchors, and what stands left of
them reversed, by Larsson-Sadakane refinement over eight-byte symbols aligned at
the anchor; Kasai's method gives the common prefixes. A string that reaches `a`
bytes left of its anchor equals another one if both agree on `a` bytes to the
left and on the rest to the right: its classes in the two arrays at these
depths, for both lengths. Of segments with equal content the earliest and the
latest travel, and the arrays decide that they are equal. Anchors with many
different segments are dealt to several shards; these merge by binary search of
their sorted fingerprints of windows.

Null or empty texts have nothing to remove. Rows are judged one by one; an id
that occurs twice gives two rows, and a null id counts as later than all others.
Texts shorter than `passage` stay whole and have nothing late; only those of
`window` bytes or more can lose bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import _kernels as K
from lectern.llm import _segments as S
from lectern.llm._stages import Stages, grouped_batches

WINDOW = 400
PASSAGE = 250  # fifty words of four letters, each with its blank
UNIT = 64
HOT_SEGMENTS = 500
U64 = np.uint64
REPEATED, LATE = 0, 1

_PART = "key long, shard int, shards int, seg long, nw int, a0 int, s0 int, no_id boolean, first boolean, doc_id long, th long, body binary"
_FOUND = "key long, seg long, kind int, runs array<struct<lo:int,hi:int>>, block int, prints binary, refs binary"
_RUNS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
_FOUND_ARROW = pa.schema([("key", pa.int64()), ("seg", pa.int64()), ("kind", pa.int32()), ("runs", _RUNS), ("block", pa.int32()), ("prints", pa.binary()), ("refs", pa.binary())])
_PRINT = np.dtype([("hi", "<u8"), ("lo", "<u8")])
_REF = np.dtype([("seg", "<i8"), ("t", "<i4"), ("kind", "i1"), ("known", "i1"), ("no_id", "i1"), ("doc", "<i8"), ("th", "<i8"), ("s", "<i4")])


# --- suffix arrays -----------------------------------------------------------

def suffix_array(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of many strings at once by Larsson-Sadakane refinement.

    symbols: all strings, one after another; ends: for each position the end of
    its string. A suffix stops at its string's end, before any symbol. Groups
    of equal prefixes are numbered by their first slot; each round doubles the
    compared length and sorts only groups of more than one. Equal suffixes keep
    the order of their positions, which Kasai's scan relies on.
    """
    n = len(symbols)
    sa = np.argsort(symbols, kind="stable")
    head = np.ones(n, bool)
    head[1:] = symbols[sa[1:]] != symbols[sa[:-1]]
    slot = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, slot, 0))
    h, longest = 1, int((ends - slot).max()) if n else 0
    while h < longest:
        alone = head & np.append(head[1:], True)
        act = np.flatnonzero(~alone)
        if not len(act):
            break
        at = sa[act]
        nxt = at + h
        second = np.where(nxt < ends[at], rank[np.minimum(nxt, n - 1)] + 1, 0)
        pair = (rank[at] << 32) | second
        order = np.argsort(pair, kind="stable")
        pair, at = pair[order], at[order]
        sa[act] = at
        fresh = np.ones(len(act), bool)
        fresh[1:] = pair[1:] != pair[:-1]
        head[act] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, act, 0))
        h *= 2
    slots = np.empty(n, np.int64)
    slots[sa] = slot
    return sa, slots


def kasai(symbols: np.ndarray, starts: np.ndarray, ends_of: np.ndarray, sa: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it, in symbols, by slot.

    Kasai's scan carries the match length from one position to the next; all
    strings are scanned side by side.
    """
    n = len(symbols)
    lcp = np.zeros(n, np.int64)
    prev = np.full(n, -1, np.int64)
    prev[sa[1:]] = sa[:-1]
    end = np.repeat(ends_of, ends_of - starts)
    live = np.flatnonzero(ends_of > starts)
    pos, h = starts[live].copy(), np.zeros(len(live), np.int64)
    while len(pos):
        j = prev[pos]
        grow = np.flatnonzero(j >= 0)
        h[j < 0] = 0
        while len(grow):
            a, b = pos[grow] + h[grow], j[grow] + h[grow]
            ok = (a < end[pos[grow]]) & (b < end[j[grow]])
            ok[ok] = symbols[a[ok]] == symbols[b[ok]]
            grow = grow[ok]
            h[grow] += 1
        lcp[rank[pos]] = h
        h = np.maximum(h - 1, 0)
        pos = pos + 1
        keep = pos < ends_of[live]
        pos, h, live = pos[keep], h[keep], live[keep]
    return lcp


def anchor_order(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of byte strings, and each one's common prefix in bytes with the one before."""
    m = len(starts)
    blocks = np.maximum((lengths + 7) // 8, 1)
    b_end = np.cumsum(blocks)
    b_start = b_end - blocks
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), ">u8", buffer=padded, strides=(1,))
    owner = np.repeat(np.arange(m), blocks)
    k = np.arange(int(b_end[-1])) - b_start[owner]
    at = starts[owner] + 8 * k
    left = np.clip(lengths[owner] - 8 * k, 0, 8)
    symbols = lanes[np.minimum(at, len(data))].astype(U64)
    short = left < 8
    symbols[short] &= ~U64(0) << (U64(64) - U64(8) * np.maximum(left[short], 1).astype(U64))
    symbols[left == 0] = 0
    _, dense = np.unique(symbols, return_inverse=True)
    ends = b_end[owner]
    sa, rank = suffix_array(dense, ends)
    lcp = kasai(dense, b_start, b_end, sa, rank)
    slots = rank[b_start]
    order = np.argsort(slots)
    slots = slots[order]
    common = np.zeros(m, np.int64)
    if m > 1:
        # the least common prefix over the slots between two anchors, then the bytes of the next symbol
        c = np.minimum.reduceat(lcp, slots[:-1] + 1)
        if slots[-1] + 1 < len(lcp):
            c[-1] = lcp[slots[-2] + 1 : slots[-1] + 1].min()
        i, j = b_start[order[:-1]] + c, b_start[order[1:]] + c
        more = (i < b_end[order[:-1]]) & (j < b_end[order[1:]])
        x = symbols[i[more]] ^ symbols[j[more]]
        extra = np.zeros(m - 1, np.int64)
        for q in range(1, 8):
            extra[more] += (x >> U64(64 - 8 * q)) == 0
        common[1:] = 8 * c + extra
    return order, common


def repeated_windows(bodies: list[bytes], nw: np.ndarray, a0: np.ndarray, window: int, passage: int, unit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For strings of `window` and of `passage` bytes: whether each one of a segment occurs again here, and whether it is the first of its class.

    Segments come in the order of the places of their anchors.
    """
    m, reach = len(bodies), passage - unit + 1
    sizes = np.fromiter(map(len, bodies), np.int64, m)
    data = np.frombuffer(b"".join(bodies), np.uint8)
    begin = np.cumsum(sizes) - sizes
    back = data[::-1]
    right, r_common = anchor_order(data, begin + a0, sizes - a0)
    left, l_common = anchor_order(back, len(data) - begin - a0, a0)
    fits = sizes - (window - 1)  # starts whose longer string lies inside
    out = [(np.zeros((m, reach), bool), np.zeros((m, reach), bool)) for _ in range(2)]
    l_class, r_class = np.empty(m, np.int64), np.empty(m, np.int64)
    for a in range(reach):
        here = np.flatnonzero((a <= a0) & (a > a0 - nw))
        if not len(here):
            continue
        l_class[left] = np.cumsum(l_common < a)
        for (again, lead), length in zip(out, (window, passage), strict=True):
            idx = here if length == passage else here[a0[here] - a < fits[here]]
            if not len(idx):
                continue
            r_class[right] = np.cumsum(r_common < length - a)
            pair = l_class[idx] * (m + 1) + r_class[idx]
            order = np.argsort(pair, kind="stable")
            same = pair[order[1:]] == pair[order[:-1]]
            flag, first = np.zeros(len(idx), bool), np.ones(len(idx), bool)
            flag[1:] |= same
            flag[:-1] |= same
            first[1:] = ~same
            at = idx[order]
            again[at, a0[at] - a] = flag
            lead[at, a0[at] - a] = first
    return out


# --- shards ------------------------------------------------------------------

def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the runs of True in each row."""
    wide = np.zeros((flags.shape[0], flags.shape[1] + 2), np.int8)
    wide[:, 1:-1] = flags
    step = np.diff(wide, axis=1)
    row, lo = np.nonzero(step == 1)
    _, hi = np.nonzero(step == -1)
    return row, lo, hi


def _run_lists(count: int, row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    offsets = np.searchsorted(row, np.arange(count + 1)).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["lo", "hi"])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def shard_scanner(window: int, passage: int, unit: int):
    def run(batches):
        for t in grouped_batches(batches, ["key", "shard"], rows=8_000, size=4 << 20):
            places = [t["first"].to_numpy(zero_copy_only=False) ^ True, t["s0"].to_numpy().astype(np.int64) + t["a0"].to_numpy(), t["th"].to_numpy(), t["doc_id"].fill_null(0).to_numpy(), t["no_id"].to_numpy(zero_copy_only=False)]
            order = np.lexsort(places)
            # rows that repeat a document bring its parts again
            fresh = np.ones(len(order), bool)
            fresh[1:] = np.any([p[order[1:]] != p[order[:-1]] for p in (*places, t["seg"].to_numpy())], axis=0)
            t = t.take(pa.array(order[fresh]))
            bodies, own = t["body"].to_pylist(), t["first"].to_numpy(zero_copy_only=False)
            nw, a0 = (t[c].to_numpy().astype(np.int64) for c in ("nw", "a0"))
            key, seg = (t[c].to_numpy() for c in ("key", "seg"))
            (again, lead), (more, earliest) = repeated_windows(bodies, nw, a0, window, passage, unit)
            for kind, flags in ((REPEATED, again), (LATE, more & ~earliest)):
                row, lo, hi = _runs(flags & own[:, None])
                has = np.unique(row)
                none = len(has)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[has]), pa.array(seg[has]), pa.array(np.full(none, kind, np.int32)), _run_lists(none, np.searchsorted(has, row), lo, hi), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary()), pa.nulls(none, pa.binary())],
                    schema=_FOUND_ARROW,
                )
            shards, shard = t["shards"].to_numpy(), t["shard"].to_numpy()
            for k, s in sorted(set(zip(key[shards > 1].tolist(), shard[shards > 1].tolist(), strict=True))):
                rows = np.flatnonzero((key == k) & (shard == s))
                kinds = [(REPEATED, window, lead[rows], again[rows]), (LATE, passage, earliest[rows], more[rows])]
                yield from _print_blocks(k, t.take(pa.array(rows)), [bodies[r] for r in rows], kinds)
            K.trim()

    return run


def _print_blocks(key: int, t: pa.Table, bodies: list[bytes], kinds):
    """Sorted fingerprints of one shard's classes of strings, cut by their value into blocks."""
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    data = np.frombuffer(b"".join(bodies), np.uint8)
    begin = np.cumsum(sizes) - sizes
    prints, refs = [], []
    for kind, length, lead, known in kinds:
        i, at = np.nonzero(lead)
        start, full = begin[i] + at, np.full(len(i), length)
        p, r = np.empty(len(i), _PRINT), np.empty(len(i), _REF)
        p["hi"], p["lo"] = K.span_hashes(data, start, full, seed=7), K.span_hashes(data, start, full, seed=11)
        r["seg"], r["t"], r["kind"], r["known"], r["s"] = t["seg"].to_numpy()[i], at, kind, known[i, at], t["s0"].to_numpy()[i] + at
        r["no_id"], r["doc"], r["th"] = t["no_id"].to_numpy(zero_copy_only=False)[i], t["doc_id"].fill_null(0).to_numpy()[i], t["th"].to_numpy()[i]
        prints.append(p)
        refs.append(r)
    prints, refs = np.concatenate(prints), np.concatenate(refs)
    order = np.argsort(prints["hi"], kind="stable")
    prints, refs = prints[order], refs[order]
    blocks = 16 * int(t["shards"][0].as_py())
    cuts = np.searchsorted(prints["hi"], np.arange(1, blocks, dtype=U64) * U64(2**64 // blocks))
    for b, (p, r) in enumerate(zip(np.split(prints, cuts), np.split(refs, cuts), strict=True)):
        if len(p):
            one = [[key], [None], [None], [None], [b], [p.tobytes()], [r.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(one, _FOUND_ARROW, strict=True)], schema=_FOUND_ARROW)


def merge_blocks(batches):
    """Strings that stand in several shards, by binary search block by block.

    Those of `window` bytes that are single in their own shard are repeated,
    those of `passage` bytes are late where another shard has an earlier one.
    """
    for t in grouped_batches(batches, ["key", "block"], rows=256):
        key, block = t["key"].to_numpy(), t["block"].to_numpy()
        for k, b in sorted(set(zip(key.tolist(), block.tolist(), strict=True))):
            rows = np.flatnonzero((key == k) & (block == b))
            prints = [np.frombuffer(t["prints"][int(r)].as_py(), _PRINT) for r in rows]
            refs = [np.frombuffer(t["refs"][int(r)].as_py(), _REF) for r in rows]
            joint, places = np.concatenate(prints), np.concatenate(refs)
            order = np.lexsort((places["s"], places["th"], places["doc"], places["no_id"], joint["lo"], joint["hi"]))
            joint, places = joint[order], places[order]
            code = joint["hi"] ^ (joint["lo"] * U64(0x9E3779B97F4A7C15))
            order = np.argsort(code, kind="stable")
            code, places = code[order], places[order]
            hit: dict[tuple[int, int], list[int]] = {}
            for p, r in zip(prints, refs, strict=True):
                own = p["hi"] ^ (p["lo"] * U64(0x9E3779B97F4A7C15))
                lo, hi = np.searchsorted(code, own, "left"), np.searchsorted(code, own, "right")
                shared = hi - lo > 1
                earliest = places[lo]
                behind = (earliest["doc"] != r["doc"]) | (earliest["th"] != r["th"]) | (earliest["no_id"] != r["no_id"]) | (earliest["s"] != r["s"])
                for s, at, kind in r[shared & np.where(r["kind"] == LATE, behind, r["known"] == 0)][["seg", "t", "kind"]].tolist():
                    hit.setdefault((s, kind), []).append(at)
            if hit:
                runs = [[{"lo": x, "hi": x + 1} for x in sorted(v)] for v in hit.values()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(hit), pa.int64()), pa.array([s for s, _ in hit], pa.int64()), pa.array([c for _, c in hit], pa.int32()), pa.array(runs, _RUNS)], names=["key", "seg", "kind", "runs"]
                )


def cut_bytes(batches):
    """The bytes of each part of a document."""
    fields = {"key": pa.int64(), "shard": pa.int32(), "shards": pa.int32(), "seg": pa.int64(), "nw": pa.int32(), "a0": pa.int32(), "s0": pa.int32(), "no_id": pa.bool_(), "first": pa.bool_()}
    for batch in batches:
        texts, parts, ids, hashes = batch.column("text"), batch.column("parts").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("th").to_pylist()
        out = {f: [] for f in (*fields, "doc_id", "th", "body")}
        for i, own in enumerate(parts):
            raw = texts[i].as_buffer()
            for p in own:
                for f in fields:
                    out[f].append(p[f])
                out["doc_id"].append(ids[i])
                out["th"].append(hashes[i])
                out["body"].append(raw[p["s0"] : p["s0"] + p["size"]].to_pybytes())
        kinds = [*fields.values(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))
        del parts, out
        K.trim()


def merged(spans) -> list[tuple[int, int]]:
    """Union of half-open ranges, in order."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


# --- operator ----------------------------------------------------------------

def repeated_byte_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, passage: int = PASSAGE, unit: int = UNIT, hot: int = HOT_SEGMENTS) -> tuple[DataFrame, DataFrame]:
    """(documents keyed by id and text hash, byte ranges per key: those to remove and those that are late)."""
    stages = Stages(docs.sparkSession, "suffix")
    keyed = S.keyed_documents(docs, id_col, text_col)
    repeated = S.repeated_segments(stages, keyed, S.byte_segments(passage, unit, window))
    distinct = S.distinct_segments(stages, repeated, latest=True)
    groups = stages.save(distinct.groupBy("key").agg(F.ceil(F.count("*") / F.lit(hot)).cast("int").alias("shards")), "groups")
    # the latest of several copies comes along, so that the arrays see whether they are equal
    ends = F.array(F.struct("src.*", F.lit(True).alias("first")), F.when(F.col("copies") > 1, F.struct("last.*", F.lit(False).alias("first"))))
    parts = distinct.join(groups, "key").select("key", "seg", "shards", "nw", "a0", "size", F.explode(F.filter(ends, lambda x: x.isNotNull())).alias("at"))
    parts = parts.select("at.no_id", "at.doc_id", "at.th", "at.s0", "at.first", "key", F.pmod("seg", "shards").cast("int").alias("shard"), "shards", "seg", "nw", "a0", "size")
    bodies = S.with_text(parts, keyed, cut_bytes, _PART)
    found = stages.save(bodies.repartition("key", "shard").sortWithinPartitions("key", "shard").mapInArrow(shard_scanner(window, passage, unit), _FOUND), "found")
    across = found.where("prints is not null").select("key", "block", "prints", "refs").repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(merge_blocks, "key long, seg long, kind int, runs array<struct<lo:int,hi:int>>")
    flags = found.where("prints is null").select("key", "seg", "kind", "runs").unionByName(across)
    # what is repeated counts for all copies of a segment, what is late for the earliest; the other copies are late as a whole
    first = distinct.select("key", "seg", "src", "nw", "copies")
    late = flags.where(f"kind = {LATE}").join(first, ["key", "seg"]).select("src.doc_id", "src.th", "src.s0", "kind", F.explode("runs").alias("r"))
    elsewhere = ~(F.col("doc_id").eqNullSafe(F.col("src.doc_id")) & (F.col("th") == F.col("src.th")) & (F.col("s0") == F.col("src.s0")))
    copies = repeated.join(first.where("copies > 1").select("key", "seg", "src"), ["key", "seg"]).where(elsewhere)
    copies = copies.select("doc_id", "th", "s0", F.lit(LATE).alias("kind"), F.struct(F.lit(0).alias("lo"), F.col("nw").alias("hi")).alias("r"))
    gone = repeated.join(flags.where(f"kind = {REPEATED}"), ["key", "seg"]).select("doc_id", "th", "s0", "kind", F.explode("runs").alias("r"))
    reach = F.when(F.col("kind") == REPEATED, F.lit(window)).otherwise(F.lit(passage))
    ranges = gone.unionByName(late).unionByName(copies).select("doc_id", "th", "kind", (F.col("s0") + F.col("r.lo")).alias("lo"), (F.col("s0") + F.col("r.hi") + reach - 1).alias("hi"))
    return keyed, ranges.groupBy("doc_id", "th").agg(F.collect_list(F.struct("kind", "lo", "hi")).alias("cuts"))


def _strip(batches):
    spans_type = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
    for batch in batches:
        texts, cuts = batch.column("text"), batch.column("cuts").to_pylist()
        counts, sha, kept_col = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "n_late")}, [], []
        for i, own in enumerate(cuts):
            raw = texts[i].as_buffer().to_pybytes()
            spans, late = (merged((c["lo"], c["hi"]) for c in own or () if c["kind"] == kind) for kind in (REPEATED, LATE))
            kept, at = [], 0
            for lo, hi in spans:
                kept.append(raw[at:lo])
                at = hi
            kept.append(raw[at:])
            for k, n in zip(counts, (len(raw), sum(hi - lo for lo, hi in spans), len(spans), sum(hi - lo for lo, hi in late)), strict=True):
                counts[k].append(n)
            sha.append(hashlib.sha256(b"".join(kept)).hexdigest())
            kept_col.append([{"lo": lo, "hi": hi} for lo, hi in spans])
        columns = [batch.column("doc_id"), *(pa.array(v, pa.int64()) for v in counts.values()), pa.array(sha, pa.string()), pa.array(kept_col, spans_type)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *counts, "kept_sha256", "removed"])
        del cuts, kept_col
        K.trim()


def strip_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, passage: int = PASSAGE, unit: int = UNIT, hot: int = HOT_SEGMENTS) -> DataFrame:
    """Per row: sizes, the removed byte ranges, a digest of what is left, and the bytes of later copies of passages."""
    keyed, cuts = repeated_byte_ranges(docs, id_col, text_col, window, passage, unit, hot)
    same = F.col("k.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("k.th") == F.col("c.th"))
    met = keyed.alias("k").join(cuts.alias("c"), same, "left").select("k.doc_id", "k.text", "c.cuts")
    return met.mapInArrow(_strip, "doc_id long, n_bytes long, n_removed long, n_spans long, n_late long, kept_sha256 string, removed array<struct<lo:long,hi:long>>")


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return strip_repeated_bytes(docs).drop("removed")
