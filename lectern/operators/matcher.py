"""Many fixed wordings found in texts by one automaton.

The patterns are few beside the texts: they are read in blocks of checked size,
and an automaton with failure links, built once in each task, reads every text
once for a whole block, however many patterns that has. Texts and patterns are
compared as they stand, so callers fold both alike.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.blocks import broadcast_blocks, union_all

KEEP = ("all", "first", "tiles")


def automaton(patterns: list[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for at, p in enumerate(patterns):
        a.add_word(p, (at, len(p)))
    a.make_automaton()
    return a


def occurrences(a: ahocorasick.Automaton, text: str, bounded: bool) -> list[tuple[int, int, int]]:
    """(start, end, pattern) in order of their ends; bounded: between characters that are neither letters nor digits."""
    out = []
    for last, (at, size) in a.iter(text):
        start, end = last - size + 1, last + 1
        if bounded and (start > 0 and _inside(text[start - 1]) or end < len(text) and _inside(text[end])):
            continue
        out.append((start, end, at))
    return out


def _inside(c: str) -> bool:
    return c.isalnum() or c == "_"


def tiled(found: list[tuple[int, int, int]], rank: list[int], taken: list[tuple[int, int]] = ()) -> list[tuple[int, int, int]]:
    """Occurrences that overlap no other of a better rank, no earlier one of the same, and nothing taken; in order."""
    kept: list[tuple[int, int, int]] = []
    busy: set[int] = {i for lo, hi in taken for i in range(lo, hi)}
    for start, end, at in sorted(found, key=lambda x: (rank[x[2]], x[0], -x[1])):
        if not any(i in busy for i in range(start, end)):
            busy.update(range(start, end))
            kept.append((start, end, at))
    return sorted(kept)


def matches(frame: DataFrame, text_col: str, patterns: DataFrame, bounded: bool = False, keep: str = "all") -> DataFrame:
    """The columns of `frame` but the text, then pattern, start and end (code points from 0) of each occurrence.

    patterns: column pattern; empty and repeated ones count once or not at all.
    keep: all occurrences, the first of each pattern, or tiles: the longest
    patterns first (of equal ones the lesser), each taking its characters. Tiles
    need all patterns in one block. A null text has no occurrence.
    """
    if keep not in KEEP:
        raise ValueError(f"keep is one of {', '.join(KEEP)}")
    names = [c for c in frame.columns if c != text_col]
    plain = frame.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)], F.col(text_col).alias("text"))
    schema = ", ".join([f"{n} {t}" for n, t in plain.dtypes[:-1]] + ["pattern string", "start long", "end long"])
    blocks = list(broadcast_blocks(patterns.select("pattern").where(F.length("pattern") > 0)))
    if keep == "tiles" and len(blocks) > 1:
        raise ValueError("tiles need all patterns in one block")
    parts = [plain.mapInArrow(_search(sorted(r.pattern for r in b.collect()), bounded, keep), schema) for b in blocks]
    return union_all(parts).toDF(*names, "pattern", "start", "end")


def _search(patterns: list[str], bounded: bool, keep: str):
    by_size = sorted(range(len(patterns)), key=lambda k: (-len(patterns[k]), patterns[k]))
    rank = [0] * len(patterns)
    for place, k in enumerate(by_size):
        rank[k] = place

    def run(batches):
        a = automaton(patterns)
        words = pa.array(patterns, pa.string())
        for batch in batches:
            rows, hits = [], []
            for row, text in enumerate(batch.column(batch.num_columns - 1).to_pylist() if patterns else []):
                found = occurrences(a, text, bounded) if text else []
                if keep == "first":
                    found = list({at: (s, e, at) for s, e, at in reversed(found)}.values())
                elif keep == "tiles":
                    found = tiled(found, rank)
                rows += [row] * len(found)
                hits += found
            at = np.array(hits, np.int64).reshape(-1, 3)
            take = pa.array(rows, pa.int64())
            own = [batch.column(k).take(take) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*own, words.take(pa.array(at[:, 2])), pa.array(at[:, 0]), pa.array(at[:, 1])], names=[*batch.schema.names[:-1], "pattern", "start", "end"])

    return run


def redacted(frame: DataFrame, text_col: str, names: DataFrame, out: str, protected: list[str] = (), honorifics: list[str] = (), placeholder: str = "[ACTOR]") -> DataFrame:
    """`frame` with `out`: the text with every name (column pattern) as a placeholder, and hits, their number.

    The longest names go first, whole words without regard to case; wordings in
    `protected` stay, with all that overlaps them. An honorific before a name
    goes with it, and the possessive stays. All names, in one block of checked size.
    """
    folded = names.select(F.lower("pattern").alias("pattern")).where(F.length("pattern") > 0)
    blocks = list(broadcast_blocks(folded))
    if len(blocks) > 1:
        raise ValueError("redaction needs all names in one block")
    patterns = sorted(r.pattern for r in blocks[0].collect())
    columns = [c for c in frame.columns]
    plain = frame.toDF(*[f"c{k}" for k in range(len(columns))])
    at_text = columns.index(text_col)
    schema = ", ".join([f"{n} {t}" for n, t in plain.dtypes] + ["out string", "hits int"])
    heads = tuple(f"{h.lower()}{dot} " for h in honorifics for dot in (".", ""))
    kept = sorted({p.lower() for p in protected if p})

    def one(text: str, a, rank, guard) -> tuple[str, int]:
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        shields = [(s, e) for s, e, _ in occurrences(guard, low, True)] if guard else []
        parts, end = [], 0
        found = tiled(occurrences(a, low, True), rank, shields)
        for s, e, _ in found:
            for h in heads:
                if low[end:s].endswith(h) and (s - len(h) == 0 or not _inside(low[s - len(h) - 1])):
                    s -= len(h)
                    break
            parts += [text[end:s], placeholder]
            end = e
        return "".join([*parts, text[end:]]), len(found)

    def run(batches):
        a, guard = automaton(patterns), automaton(kept) if kept else None
        rank = [0] * len(patterns)
        for place, k in enumerate(sorted(range(len(patterns)), key=lambda k: (-len(patterns[k]), patterns[k]))):
            rank[k] = place
        for batch in batches:
            done = [(t, 0 if t is not None else None) if not t or not patterns else one(t, a, rank, guard) for t in batch.column(at_text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())], names=[*batch.schema.names, "out", "hits"])

    return plain.mapInArrow(run, schema).toDF(*columns, out, "hits")
