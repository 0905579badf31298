"""Hard negatives by dual-tree search over anchors and candidates.

Scores are integer inner products of vectors whose components x became
floor(256 * x); higher ones come first, ties by smaller vec_id. An anchor's
positives are its first rows of the same label; its negatives for a positive are
the first rows of other labels whose score lies between two shares of the
positive's score. Both searches are windows of scores with the k best wanted.

Candidates are written once in parts of about PART rows, ordered by label;
anchors are dealt into blocks of about ANCHORS. A cell is a part met by a block
of anchors, and a task holds one cell at a time. In it both sides become trees:
nodes of one label first, then halves along the widest component, with centre
and radius. For a pair of nodes the centres' product and the radii bound all
inner products below. A pair is dropped, with all anchors of its group, if its
labels don't fit, if the upper end lies under every score that a window of the
group still takes, or if the lower end lies over all windows; pairs of leaves
are scored exactly. With many parts a share of them is searched first, and the
others give only what can still be among the first k.

Rows with a null id, label, vector or component, or with a component that isn't
finite (times 256), take no part. Vectors of unequal length count as filled up
with zeros. A row is no partner of an anchor with its own id; rows that repeat
an id otherwise count one by one, as anchors too. Scores that a double holds
exactly come from matrix products, others from Python's integers, held to the
range of a long. A positive that no row fits gives no row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm import _kernels as K
from lectern.llm._stages import Stages, grouped_batches

SCALE = 256
PART = 1 << 14
ANCHORS = 1 << 12
ANCHOR_LEAF = 16
LEAF = 64
#: With more parts than this, one in so many is searched before the others.
PILOT = 16
EXACT = 2.0**53
LONGEST = (1 << 63) - 1

_FOUND = "akey long, anchor_id long, w int, score long, vec_id long"


# --- trees -------------------------------------------------------------------

@dataclass
class Tree:
    """Nodes by number, the root first; node i holds rows lo[i]:hi[i] of `order`."""

    order: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    children: list[tuple[int, int] | None]
    pure: np.ndarray
    label: np.ndarray
    centre: np.ndarray
    norm: np.ndarray
    radius: np.ndarray


def build_tree(vectors: np.ndarray, labels: np.ndarray, leaf: int) -> Tree:
    order = np.argsort(labels, kind="stable")
    spans, children, stack = [(0, len(order))], [None], [0]
    while stack:
        at = stack.pop()
        lo, hi = spans[at]
        own = labels[order[lo:hi]]
        if own[0] != own[-1]:
            borders = np.flatnonzero(own[1:] != own[:-1]) + 1
            cut = lo + int(borders[np.argmin(np.abs(borders - (hi - lo) / 2))])
        elif hi - lo > leaf:
            rows = vectors[order[lo:hi]]
            axis = int(np.argmax(rows.max(axis=0) - rows.min(axis=0))) if rows.shape[1] else 0
            cut = (lo + hi) // 2
            if rows.shape[1]:
                order[lo:hi] = order[lo:hi][np.argpartition(rows[:, axis], cut - lo)]
        else:
            continue
        children[at] = (len(spans), len(spans) + 1)
        stack += children[at]
        spans += [(lo, cut), (cut, hi)]
        children += [None, None]
    lo, hi = (np.array(x) for x in zip(*spans, strict=True))
    centre = np.zeros((len(spans), vectors.shape[1]))
    radius = np.zeros(len(spans))
    with np.errstate(over="ignore", invalid="ignore"):
        for i, (a, b) in enumerate(spans):
            rows = vectors[order[a:b]]
            centre[i] = rows.mean(axis=0)
            radius[i] = np.sqrt(((rows - centre[i]) ** 2).sum(axis=1).max())
        norm = np.sqrt((centre**2).sum(axis=1))
    first, last = labels[order[lo]], labels[order[hi - 1]]
    return Tree(order, lo, hi, children, first == last, first, centre, norm, radius)


def intervals(a: Tree, b: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product that each pair of nodes can hold, with room for rounding."""
    with np.errstate(over="ignore", invalid="ignore"):
        middle = a.centre @ b.centre.T
        reach = np.outer(a.norm, b.radius) + np.outer(a.radius, b.norm) + np.outer(a.radius, b.radius)
        room = 1e-9 * (np.outer(a.norm, b.norm) + reach) + 1e-6
        return middle - reach - room, middle + reach + room


# --- search ------------------------------------------------------------------

@dataclass
class Windows:
    """Per window: its anchor's row, its number there, bounds, and the best (score, id) so far, k at most."""

    anchor: np.ndarray
    number: np.ndarray
    low: np.ndarray
    high: np.ndarray
    k: int

    def __post_init__(self):
        n = len(self.anchor)
        self.score = np.full((n, self.k), -LONGEST - 1, np.int64)
        self.id = np.full((n, self.k), LONGEST, np.int64)
        self.count = np.zeros(n, np.int64)

    def sort_by(self, order: np.ndarray) -> np.ndarray:
        """Puts windows in the order of their anchors; where in `order` each anchor stands."""
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by = np.argsort(place[self.anchor], kind="stable")
        self.anchor, self.number, self.low, self.high = (x[by] for x in (self.anchor, self.number, self.low, self.high))
        return place[self.anchor]

    def take(self, w: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Merges hits into the best of their windows; a full window asks for its last score from then on."""
        touched, w = np.unique(w, return_inverse=True)
        held = np.arange(self.k) < self.count[touched][:, None]
        all_w = np.concatenate([np.nonzero(held)[0], w])
        all_s = np.concatenate([self.score[touched][held], score])
        all_i = np.concatenate([self.id[touched][held], ids])
        by = np.lexsort((all_i, -all_s, all_w))
        all_w, all_s, all_i = all_w[by], all_s[by], all_i[by]
        rank = np.arange(len(all_w)) - np.searchsorted(all_w, all_w)
        keep = rank < self.k
        all_w, all_s, all_i, rank = all_w[keep], all_s[keep], all_i[keep], rank[keep]
        self.score[touched[all_w], rank], self.id[touched[all_w], rank] = all_s, all_i
        self.count[touched] = np.bincount(all_w, minlength=len(touched))
        full = touched[self.count[touched] == self.k]
        self.low[full] = self.score[full, self.k - 1]


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return a @ b.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], dtype=object).reshape(m.shape)
    out = whole(a) @ whole(b).T if a.shape[1] else np.zeros((len(a), len(b)))
    return np.array([[max(-LONGEST, min(LONGEST, int(x))) for x in row] for row in out.tolist()], dtype=np.int64).reshape(out.shape)


def dual_search(a_vec, a_label, a_id, c_vec, c_label, c_id, windows: Windows, same: bool) -> tuple[int, int]:
    """Fills `windows` from the candidates; (leaf pairs scored, leaf pairs in all)."""
    a, c = build_tree(a_vec, a_label, ANCHOR_LEAF), build_tree(c_vec, c_label, LEAF)
    at = windows.sort_by(a.order)
    first = np.searchsorted(at, np.arange(len(a.order) + 1))
    a_vec, a_label, a_id = a_vec[a.order], a_label[a.order], a_id[a.order]
    c_vec, c_label, c_id = c_vec[c.order], c_label[c.order], c_id[c.order]
    least, most = intervals(a, c)
    ceiling = [int(windows.high[first[lo] : first[hi]].max(initial=-LONGEST - 1)) for lo, hi in zip(a.lo, a.hi, strict=True)]
    exact = bool(np.abs(a_vec).max(initial=0) * np.abs(c_vec).max(initial=0) * max(1, a_vec.shape[1]) < EXACT)
    stack, scored = [(0, 0)], 0
    while stack:
        i, j = stack.pop()
        lo, hi = first[a.lo[i]], first[a.hi[i]]
        if lo == hi or a.pure[i] and c.pure[j] and (a.label[i] == c.label[j]) != same:
            continue
        if most[i, j] < windows.low[lo:hi].min() or least[i, j] > ceiling[i]:
            continue
        own, other = a.children[i], c.children[j]
        if own is None and other is None:
            scored += 1
            _score_leaves(slice(a.lo[i], a.hi[i]), slice(c.lo[j], c.hi[j]), (a_vec, a_label, a_id), (c_vec, c_label, c_id), windows, slice(lo, hi), at, same, exact)
        elif other is None or own is not None and a.radius[i] > c.radius[j]:
            stack += [(x, j) for x in own]
        else:
            stack += [(i, x) for x in sorted(other, key=lambda x: most[i, x])]
    leaves = lambda t: sum(x is None for x in t.children)
    return scored, leaves(a) * leaves(c)


def _score_leaves(left: slice, right: slice, anchors, candidates, windows: Windows, mine: slice, at: np.ndarray, same: bool, exact: bool) -> None:
    scores = products(anchors[0][left], candidates[0][right], exact)
    fits = (anchors[1][left, None] == candidates[1][None, right]) == same
    fits &= anchors[2][left, None] != candidates[2][None, right]
    row = at[mine] - left.start
    w, c = np.nonzero(fits[row] & (scores[row] >= windows.low[mine, None]) & (scores[row] <= windows.high[mine, None]))
    if len(w):
        windows.take(w + mine.start, scores[row[w], c].astype(np.int64), candidates[2][right][c])


# --- cells -------------------------------------------------------------------

def _matrix(column) -> np.ndarray:
    """Rows of floor(256 * x), filled up with zeros."""
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    dim = int(sizes.max())
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def cell_search(k: int, same: bool):
    """Cells (part, block; anchors first) to their best hits."""

    def run(batches):
        for table in grouped_batches(batches, ["part", "block"], rows=1):
            part, block = table["part"].to_numpy(), table["block"].to_numpy()
            border = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (block[1:] != block[:-1]), True])
            for lo, hi in zip(border[:-1], border[1:], strict=True):
                found = _cell(table.slice(lo, hi - lo), k, same)
                if found is not None:
                    yield found
        K.trim()

    return run


def _cell(cell: pa.Table, k: int, same: bool) -> pa.RecordBatch | None:
    anchors = int((cell["side"].to_numpy() == 0).sum())
    asked = [(row, x["w"], x["low"], x["high"]) for row, own in enumerate(cell["windows"].slice(0, anchors).to_pylist()) for x in own if x["low"] <= x["high"]]
    if not asked or anchors == cell.num_rows:
        return None
    windows = Windows(*(np.array(x, np.int64) for x in zip(*asked, strict=True)), k)
    vec, label, ids = _matrix(cell["vec"]), cell["label"].to_numpy(), cell["vec_id"].to_numpy()
    a, c = slice(0, anchors), slice(anchors, None)
    dual_search(vec[a], label[a], ids[a], vec[c], label[c], ids[c], windows, same)
    w, at = np.nonzero(np.arange(k) < windows.count[:, None])
    row = windows.anchor[w]
    columns = [cell["akey"].slice(0, anchors).to_numpy()[row].astype(np.int64), ids[row], windows.number[w].astype(np.int32), windows.score[w, at], windows.id[w, at]]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["akey", "anchor_id", "w", "score", "vec_id"])


# --- the two searches --------------------------------------------------------

def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label and vec of the rows that take part."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < float("inf")))
    plain = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vec"))
    return plain.where("vec_id is not null and label is not null and vec is not null").where(finite)


def _search(stages: Stages, name: str, anchors: DataFrame, candidates: DataFrame, blocks: int, k: int) -> DataFrame:
    """(akey, anchor_id, w, score, vec_id, rank): the first k of each window.

    anchors: part, block, akey, vec_id, label, vec, windows; candidates: part, vec_id, label, vec.
    """
    columns = ["part", "block", "side", "akey", "vec_id", "label", "vec", "windows"]
    blank = F.lit(None).cast(anchors.schema["windows"].dataType).alias("windows")
    right = candidates.select("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("akey"), "vec_id", "label", "vec", blank)
    cells = anchors.withColumn("side", F.lit(0)).select(*columns).unionByName(right)
    found = cells.repartition("part", "block").sortWithinPartitions("part", "block", "side").mapInArrow(cell_search(k, name == "positives"), _FOUND)
    return stages.save(first(found, k), name)


def first(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("akey", "w").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _searched(stages: Stages, name: str, spread, anchors: DataFrame, candidates: DataFrame, parts: int, blocks: int, k: int) -> DataFrame:
    """The first k of each window over all parts; `spread` deals anchors to the parts that they have to meet.

    With many parts a share of them tells how good a hit has to be in the others.
    """
    if parts <= PILOT:
        return _search(stages, name, spread(anchors), candidates, blocks, k)
    pilot = F.col("part") % PILOT == 0
    known = _search(stages, name, spread(anchors).where(pilot), candidates.where(pilot), blocks, k)
    known = stages.save(known.drop("rank"), f"{name}-pilot")
    last = known.groupBy("akey", "w").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") == k)
    last = last.groupBy("akey").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("last"))
    raised = F.transform("windows", lambda x: F.struct(x.w.alias("w"), F.greatest(x.low, F.coalesce(F.col("last")[x.w], x.low)).alias("low"), x.high.alias("high")))
    sharper = stages.save(anchors.join(last, "akey", "left").withColumn("windows", raised).drop("last"), f"{name}-sharper")
    rest = _search(stages, name, spread(sharper).where(~pilot), candidates.where(~pilot), blocks, k)
    return stages.save(first(known.unionByName(rest.drop("rank")), k), f"{name}-all")


def share(score: str, num: int, den: int, rounded):
    """num / den of a long, rounded, without leaving the range of a long."""
    rest = F.col(score) % den
    return F.expr(f"`{score}` div {den}") * num + rounded(rest * num / F.lit(float(den))).cast("long")


def mine(rows: DataFrame, every: int, positives: int = 5, negatives: int = 10, low: tuple[int, int] = (30, 100), high: tuple[int, int] = (90, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, vec, as `usable` gives them; anchors are those whose
    vec_id is divisible by `every`.
    """
    stages = Stages(rows.sparkSession, "negatives")
    number = max(1, -(-rows.count() // PART))
    dealt = rows.repartitionByRange(number, "label", F.xxhash64("vec_id")).withColumn("part", F.spark_partition_id())
    candidates = stages.save(dealt, "candidates")
    parts = (candidates.agg(F.max("part")).first()[0] or 0) + 1
    asked = candidates.where(F.col("vec_id") % every == 0).drop("part")
    blocks = max(1, -(-asked.count() // ANCHORS))
    anchors = stages.save(asked.withColumn("akey", F.monotonically_increasing_id()).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")), "anchors")
    holds = stages.save(candidates.select("part", "label").distinct(), "holds")

    window = lambda w, lo, hi: F.struct(w.cast("int").alias("w"), lo.cast("long").alias("low"), hi.cast("long").alias("high"))
    everything = F.array(window(F.lit(0), F.lit(-LONGEST), F.lit(LONGEST)))
    near = _searched(stages, "positives", lambda a: a.join(holds, "label"), anchors.withColumn("windows", everything), candidates, parts, blocks, positives)
    near = stages.save(near.select("akey", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "near")
    between = window(F.col("w"), share("positive_score", *low, F.ceil), share("positive_score", *high, F.floor))
    windows = near.groupBy("akey").agg(F.collect_list(between).alias("windows"))
    to_all = lambda a: a.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    far = _searched(stages, "negatives", to_all, stages.save(anchors.join(windows, "akey"), "asked"), candidates, parts, blocks, negatives)
    out = far.select("akey", "w", "anchor_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return out.join(near, ["akey", "w"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), every=100)


OP12_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
