"""The commonest phrases of each group, counted without a row per occurrence.

A first pass counts the hashes of all runs of words in BUCKETS cells a group; no
phrase is commoner than its cell. A second one counts the phrases of the fullest
cells exactly, which gives a count that the top ones reach, and a third those of
any other cell that reaches it. So the result is exact, and only counts travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import ACCENTED, PLAIN, ZERO_WIDTH
from lectern.functions.tokens import TOPIC_STOPWORDS
from lectern.operators.blocks import union_all
from lectern.operators.graph import cut_lineage

BUCKETS = 1 << 16
FULLEST, BLOCK = 128, 1 << 20
SIZES = (2, 3, 4)
PIECE, SHORTEST = 1 << 19, 3
U64 = np.uint64
_MUL, _MIX = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)
# the accented letters are all two bytes long in UTF-8, by their code points
_BASE = np.zeros(1 << 11, np.uint8)
_BASE[[ord(c) for c in ACCENTED]] = [ord(c) for c in PLAIN]
_NOTHING = ZERO_WIDTH.encode()


def phrases(frame: DataFrame, group: str, words_col: str, top: int = 30, least: int = 2) -> DataFrame:
    """(group, phrase, n, rank): repeated runs of two to four words that neither begin nor end with a function word.

    words_col: lists of words, or texts in lower case, whose words are runs of
    SHORTEST letters or more when accents are taken off.
    """
    rows = frame.select(F.col(group).alias("g"), F.col(words_col).alias("w")).where("w is not null")
    kind = rows.schema["g"].dataType.simpleString()
    cells = rows.mapInArrow(_cells, f"g {kind}, cell long, n long").groupBy("g", "cell").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("n"), "cell"))
    cells = cut_lineage(cells.withColumn("place", place))

    def counted(wanted: DataFrame) -> DataFrame:
        parts = -(-wanted.count() // BLOCK)
        blocks = [[(r.g, r.cell) for r in wanted.where(F.pmod(F.xxhash64("g", "cell"), F.lit(parts)) == k).collect()] for k in range(parts)]
        found = [rows.mapInArrow(_named(b), f"g {kind}, phrase string, n long") for b in blocks if b]
        if not found:
            return rows.limit(0).select("g", F.lit("").alias("phrase"), F.lit(0).cast("long").alias("n"))
        return union_all(found).groupBy("g", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)

    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("n"), "phrase")).cast("long")
    first = cut_lineage(counted(cells.where(F.col("place") <= FULLEST)).withColumn("rank", rank).where(F.col("rank") <= top))
    reached = first.where(F.col("rank") == top).select(F.col("g").alias("own"), F.col("n").alias("reached"))
    more = cells.where(F.col("place") > FULLEST).join(F.broadcast(reached), F.col("g").eqNullSafe(F.col("own")), "left").where(F.col("n") >= F.coalesce("reached", F.lit(least)))
    both = first.drop("rank").unionByName(counted(more.select("g", "cell")))
    return both.withColumn("rank", rank).where(F.col("rank") <= top).select(F.col("g").alias(group), "phrase", "n", "rank")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many runs fall into each cell, a row for each cell that has any."""
    for b in batches:
        groups = b.column(0).dictionary_encode()
        codes = groups.indices.fill_null(len(groups.dictionary)).to_numpy()
        total = np.zeros((len(groups.dictionary) + 1, BUCKETS), np.int64)
        for lo, data, starts, ends, first in _words(b.column(1)):
            for run, _, text, _ in _runs(data, starts, ends, first):
                flat = codes[lo + text].astype(np.int64) * BUCKETS + _cell(run)
                total += np.bincount(flat, minlength=total.size).reshape(total.shape)
        g, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([_values(groups, g), pa.array(cell), pa.array(total[g, cell])], names=["g", "cell", "n"])


def _named(wanted: list[tuple]):
    """How often the runs of the wanted (group, cell) occur, with their words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict = {}
        for g, cell in wanted:
            cells.setdefault(g, []).append(cell)
        for b in batches:
            groups = b.column(0).dictionary_encode()
            codes = groups.indices.fill_null(len(groups.dictionary)).to_numpy()
            keep = np.zeros((len(groups.dictionary) + 1, BUCKETS), bool)
            for code, g in enumerate([*groups.dictionary.to_pylist(), None]):
                keep[code, cells.get(g, [])] = True
            found: dict = {}
            for lo, data, starts, ends, first in _words(b.column(1)):
                raw = data.tobytes()
                for run, at, text, size in _runs(data, starts, ends, first):
                    code = codes[lo + text]
                    hit = np.flatnonzero(keep[code, _cell(run)])
                    pairs = np.stack([run[hit], code[hit].astype(U64)], axis=1)
                    _, one, n = np.unique(pairs, axis=0, return_index=True, return_counts=True) if len(hit) else ((), (), ())
                    for k, count_ in zip(hit[list(one)] if len(hit) else (), n, strict=True):
                        i = at[k]
                        key = (int(code[k]), b" ".join(raw[starts[j] : ends[j]] for j in range(i, i + size)))
                        found[key] = found.get(key, 0) + int(count_)
            g = _values(groups, np.array([c for c, _ in found], np.int64))
            yield pa.RecordBatch.from_arrays([g, pa.array([p.decode() for _, p in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["g", "phrase", "n"])

    return count


def _cell(run: np.ndarray) -> np.ndarray:
    return (run >> U64(48)).astype(np.int64)


def _values(groups: pa.DictionaryArray, codes: np.ndarray) -> pa.Array:
    return groups.dictionary.take(pa.array(codes, pa.int64(), mask=codes == len(groups.dictionary)))


def _words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, starts and ends of the words, first word of each text and one entry more) in pieces of rows."""
    lists = pa.types.is_list(column.type)
    values = (column.flatten() if lists else column).cast(pa.large_string()).fill_null("")
    _, at, data = values.buffers()
    bounds = np.frombuffer(at, np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    own = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())]).astype(np.int64) if lists else np.arange(len(column) + 1)
    lo = 0
    while lo < len(column):
        reach = np.searchsorted(bounds, bounds[own[lo]] + PIECE, "right") - 1
        hi = min(max(lo + 1, int(np.searchsorted(own, reach, "right")) - 1), len(column))
        cut = bounds[own[lo] : own[hi] + 1]
        part, cut = data[cut[0] : cut[-1]], cut - cut[0]
        if lists:
            yield lo, part, cut[:-1], cut[1:], own[lo : hi + 1] - own[lo]
        else:
            yield lo, *_cut(np.insert(part, cut[1:], 10), cut + np.arange(len(cut)))
        lo = hi


def _cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts that each end in a line end, without accents; starts and ends of their words and the first word of each."""
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))
    base = _BASE[((data[lead].astype(np.int64) & 0x1F) << 6) | (data[lead + 1] & 0x3F)] if len(lead) else np.zeros(0, np.uint8)
    lead, base = lead[base > 0], base[base > 0]
    data[lead] = base
    gap = np.flatnonzero(data[:-2] == _NOTHING[0])
    gap = gap[(data[gap + 1] == _NOTHING[1]) & (data[gap + 2] == _NOTHING[2])]
    gone = np.sort(np.concatenate([lead + 1, gap, gap + 1, gap + 2]))
    data, offsets = np.delete(data, gone), offsets - np.searchsorted(gone, offsets)
    letter = np.concatenate([[False], (data - np.uint8(97)) < 26])
    turn = np.flatnonzero(letter[1:] != letter[:-1])  # the last character is none
    starts, ends = turn[::2], turn[1::2]
    long = ends - starts >= SHORTEST
    starts, ends = starts[long], ends[long]
    return data, starts, ends, np.searchsorted(starts, offsets)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans, eight bytes a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    left = ends - starts
    h = left.astype(U64) * _MIX
    live, at = np.arange(len(starts)), starts
    while len(live):
        h[live] = _mixed((h[live] ^ (lanes[at] & _MASK[np.minimum(left, 8)])) * _MUL)
        on = left > 8
        live, at, left = live[on], at[on] + 8, left[on] - 8
    return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> U64(32)
    h *= _MIX
    h ^= h >> U64(29)
    return h


def _runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(hashes, first words, texts, size) of the runs of each size within one text that may be phrases."""
    h = _hashes(data, starts, ends)
    stop = "".join(TOPIC_STOPWORDS).encode()
    until = np.cumsum([len(w) for w in TOPIC_STOPWORDS])
    stops = _hashes(np.frombuffer(stop, np.uint8), np.append(0, until[:-1]), until)
    maybe = np.zeros(1 << 16, bool)
    maybe[stops >> U64(48)] = True
    ok = ~maybe[h >> U64(48)]
    look = np.flatnonzero(~ok)
    ok[look] = ~np.isin(h[look], stops)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for size in SIZES:
        n = len(h) - size + 1
        if n <= 0:
            return
        at = np.flatnonzero(ok[:n] & ok[size - 1 :] & (text[:n] == text[size - 1 :]))
        run = np.full(len(at), U64(size))
        for k in range(size):
            run *= _MUL
            run += h[at + k]
        yield _mixed(run), at, text[at], size
