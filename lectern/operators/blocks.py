"""Broadcasts of checked size."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS, BLOCK_BYTES = 20_000, 16 << 20


def broadcast_blocks(df: DataFrame, rows: int = BLOCK_ROWS, size: int = BLOCK_BYTES) -> Iterator[DataFrame]:
    """The distinct rows in parts of about `rows` rows and `size` bytes at most, each marked for broadcast; all of them, in as many parts as it takes.

    One aggregation measures rows and bytes; a part is a hash class of whole
    rows, so any recomputation deals alike.
    """
    df = df.distinct()
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0))).first()
    parts = max(1, -(-n // rows), -(-total // size))
    if parts > 1:
        parts *= 2  # hash classes differ in size
    for k in range(parts):
        part = df.where(F.pmod(F.xxhash64(*df.columns), F.lit(parts)) == k) if parts > 1 else df
        yield F.broadcast(part)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
