"""How filters interact: every order of them, visited by swaps of neighbours.

A document is a mask of the filters that it fails; per part the masks are
counted, with the good and toxic documents among them, in at most 2^k cells.
All that follows reads these cells alone. The k! orders are visited so that each
differs from the one before by one swap of neighbours (plain changes): the set
of filters before and after the two steps stays, so only these two steps are
computed anew. The Shapley sums gather what each filter removes along the walk.

Null texts are empty, null sources the empty part. A copy is a document whose
whole text (compared by SHA-256) a smaller id has, in any part; rows with a null
id are no copies and have no label, and rows that repeat an id and a text aren't
copies of each other. A document is good or toxic if any of its labels says so.
A table without rows has no parts, hence no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import _kernels as K
from lectern.llm._stages import Stages
from lectern.llm.quality_rules import count_of, words

#: More filters than this have too many orders to list.
MOST_FILTERS = 8
PARTS_AT_ONCE = 128
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def neighbour_swaps(k: int) -> Iterator[int]:
    """Positions i whose swap with i + 1 leads through all orders of k things.

    The largest thing wanders from one end to the other; each time it arrives,
    the others take one step of their own walk, shifted by one while it stands
    at the front.
    """
    if k < 2:
        return
    inner, at_front = neighbour_swaps(k - 1), False
    while True:
        yield from range(k - 1) if at_front else range(k - 2, -1, -1)
        at_front = not at_front
        step = next(inner, None)
        if step is None:
            return
        yield step + at_front


def walk(cells: np.ndarray, k: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """All orders, and their counts as (orders, steps, COUNTS, parts).

    cells: (3, parts, 2^k), the documents of each mask, the good and the toxic ones.
    """
    masks = np.arange(1 << k)
    parts = cells.shape[1]
    out = np.zeros((factorial(k), k, len(COUNTS), parts), np.int64)
    state = np.zeros((k, len(COUNTS), parts), np.int64)
    shapley = np.zeros((k, parts), np.int64)

    def count(step: int, name: int, before: int) -> None:
        fails, gone = masks >> name & 1 == 1, masks & before != 0
        new, again = fails & ~gone, fails & gone
        state[step, 0] = cells[0][:, ~fails & ~gone].sum(axis=1)
        state[step, 1] = cells[0][:, new].sum(axis=1)
        state[step, 2] = cells[0][:, again].sum(axis=1)
        state[step, 3] = cells[0][:, 1 << name]
        state[step, 4] = cells[1][:, new].sum(axis=1)
        state[step, 5] = cells[2][:, new].sum(axis=1)

    order, orders = list(range(k)), []
    for step, name in enumerate(order):
        count(step, name, (1 << step) - 1)
    swaps = neighbour_swaps(k)
    while True:
        out[len(orders)] = state
        orders.append(tuple(order))
        shapley[order] += state[:, 1]
        i = next(swaps, None)
        if i is None:
            break
        order[i], order[i + 1] = order[i + 1], order[i]
        before = sum(1 << name for name in order[:i])
        count(i, order[i], before)
        count(i + 1, order[i + 1], before | 1 << order[i])
    for at, one in enumerate(orders):
        out[at, :, 6] = shapley[list(one)]
    return orders, out


def walker(letters: str):
    k = len(letters)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, PARTS_AT_ONCE):
                some = batch.slice(lo, PARTS_AT_ONCE)
                names, held = some.column("part"), some.column("cells").to_pylist()
                cells = np.zeros((3, len(held), 1 << k), np.int64)
                for at, own in enumerate(held):
                    for c in own:
                        cells[:, at, c["mask"]] = c["n"], c["good"], c["toxic"]
                orders, counts = walk(cells, k)
                steps = len(orders) * k
                rows = counts.transpose(3, 0, 1, 2).reshape(len(held) * steps, len(COUNTS))
                columns = [
                    names.take(pa.array(np.repeat(np.arange(len(held)), steps))),
                    pa.array(["".join(letters[f] for f in one) for one in orders for _ in range(k)] * len(held)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(held) * len(orders))),
                    *(pa.array(np.ascontiguousarray(rows[:, c])) for c in range(len(COUNTS))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *COUNTS])
        K.trim()

    return run


def interaction_audit(failed: DataFrame, letters: str) -> DataFrame:
    """A row per part, order and step.

    failed: part (string), mask (int, bit i set where filter letters[i] rejects),
    good and toxic (boolean).
    """
    if not 1 <= len(letters) <= MOST_FILTERS or len(set(letters)) < len(letters):
        raise ValueError(f"between 1 and {MOST_FILTERS} different letters are needed")
    number = lambda c: F.sum(F.coalesce(F.col(c).cast("long"), F.lit(0)))
    cells = failed.groupBy("part", "mask").agg(F.count("*").alias("n"), number("good").alias("good"), number("toxic").alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return parts.mapInArrow(walker(letters), "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def copies(rows: DataFrame, stages: Stages) -> DataFrame:
    """`rows` (doc_id, digest, ...) with `copy`: a smaller id has the digest. Only repeated digests are joined."""
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")).where("size > 1").select("digest", "least")
    joined = rows.join(stages.save(least, "least"), "digest", "left")
    return joined.withColumn("copy", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))).drop("least")


def text_failures(text: Column) -> list[Column]:
    """Few words, few different words, many capitals, marks."""
    own = words(text)
    size = F.size(own)
    return [
        size < 50,
        F.size(F.array_distinct(own)).cast("long") * 100 < size.cast("long") * 65,
        count_of(text, CAPITALS) * 100 > F.char_length(text).cast("long") * 5,
        text.rlike("[#$%&*|]"),
    ]


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The four filters on texts and the one on copies, by source."""
    stages = Stages(docs.sparkSession, "audit")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bits = sum((fails.cast("int") * (1 << k) for k, fails in enumerate(text_failures(F.col("text")))), F.lit(0))
    rows = stages.save(plain.select("doc_id", "part", bits.alias("bits"), F.unhex(F.sha2("text", 256)).alias("digest")), "rows")
    marked = copies(rows, stages).select("doc_id", "part", (F.col("bits") + F.col("copy").cast("int") * 16).alias("mask"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return interaction_audit(marked.join(known, "doc_id", "left").select("part", "mask", "good", "toxic"), "ABCDE")


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return audit_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM t
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), d AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CAST(len(ws) < 50 AS INT)
         + 2 * CAST(100 * len(list_distinct(ws)) < 65 * len(ws) AS INT)
         + 4 * CAST(100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(text) AS INT)
         + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
         + 16 * CAST(coalesce(w.doc_id > least, false) AS INT) AS mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY part, mask
), f(letter, bit) AS (
  VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[:step - 1]), 0)::INT AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)
), r AS (
  SELECT part, filter_order, CAST(step AS INT) AS step, bit,
         CAST(coalesce(sum(n) FILTER (mask & (bit | earlier) = 0), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier = 0), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier > 0), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (mask & bit > 0 AND mask & earlier = 0), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & earlier = 0), 0) AS BIGINT) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit
)
SELECT * EXCLUDE (bit), CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
