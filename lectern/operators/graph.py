"""Property graphs as node and edge tables: neighbours, degrees, rank, components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAMPING, ITERATIONS = 0.85, 60
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only for a local master without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "" not in _own:
        _own[""] = "file://" + tempfile.mkdtemp(prefix="lectern-checkpoint-")
    return _own[""]


_own: dict[str, str] = {}
_used: dict[str, tuple[SparkSession, str]] = {}


def _remove_tables(app: str) -> None:
    spark, path = _used.pop(app)
    with contextlib.suppress(Exception):  # the session may be gone at exit
        _remove_folder(spark, path)


def _remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def cut_lineage(df: DataFrame, conf: dict[str, str] | None = None) -> DataFrame:
    """Cuts the lineage: the rows are written once, as a table in the folder that the cluster names, and read from there.

    Unlike a checkpoint this computes them once, and later joins know their size.
    What was shuffled for them goes when they are written, instead of whenever
    the driver collects its garbage. Settings in `conf` hold while they are written.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _used:
        _used[app] = (spark, f"{shared_folder(spark).rstrip('/')}/lectern-tables-{app}")
        atexit.register(_remove_tables, app)
    path = f"{_used[app][1]}/{uuid.uuid4().hex}"
    with _set(spark, {CLEANUP: "true"} | (conf or {})):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def _set(spark: SparkSession, conf: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drop_tables(*frames: DataFrame) -> None:
    """Removes the tables of `cut_lineage` that the frames read: all that was made from these must be written."""
    for df in frames:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if f"/lectern-tables-{df.sparkSession.sparkContext.applicationId}/" in folder:
                _remove_folder(df.sparkSession, folder)


#: Pairs that meet what they are compared by at a time.
PASS_PAIRS = 1 << 21


def in_passes(pairs: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `step` writes for the table `pairs`, of which it gets at most about PASS_PAIRS rows at a time: what travels with a pair is on disk for these only."""
    parts = max(1, -(-pairs.count() // PASS_PAIRS))
    own = F.pmod(F.xxhash64(*pairs.columns), F.lit(parts))
    return reduce(DataFrame.unionByName, [step(pairs.where(own == k) if parts > 1 else pairs) for k in range(parts)])


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for links (a, b): the least reachable id.

    Each round hooks every vertex on its least neighbour, follows these hooks to
    their ends and contracts the links to the ends. A vertex that hooks is gone,
    and a local minimum on which none hooks has a smaller neighbour after the
    round: two rounds at least halve what is unfinished, in any order of ids.
    """
    both = cut_lineage(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    steps = []
    while not steps or not both.isEmpty():
        ends = _hook_ends(both)
        steps.append(ends)
        for side in ("a", "b"):
            both = both.join(ends.withColumnRenamed("id", side), side).drop(side).withColumnRenamed("comp", side)
        both = cut_lineage(both.where("a <> b").select("a", "b").distinct())
    labels = steps.pop()
    while steps:
        far = labels.select(F.col("id").alias("comp"), F.col("comp").alias("far"))
        labels = cut_lineage(steps.pop().join(far, "comp", "left").select("id", F.coalesce("far", "comp").alias("comp")))
    return labels


def _hook_ends(both: DataFrame) -> DataFrame:
    """(id, comp): where the chain of least neighbours ends; half the way is left after each jump."""
    at = cut_lineage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "id"))
    while True:
        nxt = at.select(F.col("id").alias("comp"), F.col("comp").alias("far"))
        new = cut_lineage(at.join(nxt, "comp").select("id", F.col("far").alias("comp"), (F.col("far") != F.col("comp")).alias("moved")))
        at = new.select("id", "comp")
        if new.where("moved").isEmpty():
            return at


def neighbours(edges: DataFrame, direction: str = "both", kinds: list[str] | None = None) -> DataFrame:
    e = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    out = e.select(F.col("src").alias("node"), "edge", F.col("dst").alias("neighbour"), F.lit("out").alias("direction"))
    back = e.select(F.col("dst").alias("node"), "edge", F.col("src").alias("neighbour"), F.lit("in").alias("direction"))
    return {"out": out, "in": back}.get(direction, out.unionByName(back))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In, out and total degree of every node, zeros included; one pass over the edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    d = ends.groupBy(F.col("x.id").alias("id")).agg(F.sum("x.i").alias("n_in"), F.sum("x.o").alias("n_out"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return nodes.select("id").join(d, "id", "left").select("id", zero(F.col("n_in")).alias("n_in"), zero(F.col("n_out")).alias("n_out"), (zero(F.col("n_in")) + zero(F.col("n_out"))).alias("degree"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    n = nodes.join(ends.withColumn("linked", F.lit(1)), "id", "left").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("linked").isNull()).alias("n_isolated"))
    e = edges.agg(F.count("*").alias("n_edges"), F.count_if(~F.col("supported")).alias("n_unsupported"))
    return n.crossJoin(e)


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """(id, rank): parallel edges count, and what nodes without edges hold is spread evenly.

    A round is one join on the source and one aggregation that combines before
    its shuffle. It uses the ranks twice, so each round's ranks are written:
    otherwise the plan would double with every round.
    """
    out = edges.groupBy("src").agg(F.count("*").alias("n_out"))
    shares = cut_lineage(edges.join(out, "src").groupBy("src", "dst").agg((F.count("*") / F.first("n_out")).alias("share")))
    base = cut_lineage(nodes.select("id").join(out.withColumnRenamed("src", "id"), "id", "left").select("id", F.col("n_out").isNull().alias("sink")))
    n = base.count()
    rank = base.select("id", "sink", F.lit(1.0 / n).alias("rank"))
    for _ in range(iterations):
        given = shares.join(rank.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("sink"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        new = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)
        rank = cut_lineage(base.join(given, "id", "left").crossJoin(F.broadcast(lost)).select("id", "sink", new.alias("rank")))
    return rank.select("id", F.round("rank", 6).alias("rank"))


def within_hops(edges: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """(id, depth) of the nodes reached from the roots over edges of either direction."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    seen = roots.select("id", F.lit(0).alias("depth"))
    front = seen
    for k in range(1, hops + 1):
        front = cut_lineage(front.join(both, front.id == both.src).select(F.col("dst").alias("id"), F.lit(k).alias("depth")).distinct().join(seen.select("id"), "id", "left_anti"))
        seen = seen.unionByName(front)
    return seen


def roots(parents: DataFrame) -> DataFrame:
    """(id, root) for (id, parent): where a chain of parents ends; a cycle ends at its least id.

    Each round doubles the way. After as many rounds as the number of rows has
    binary digits every chain has come to its end, and who is still on the way
    goes round in a cycle, all of which it has seen.
    """
    links = parents.where("parent is not null and parent <> id").select("id", "parent")
    at = cut_lineage(parents.select("id", F.coalesce("parent", "id").alias("to"), F.least("id", F.coalesce("parent", "id")).alias("low")))
    for _ in range(at.count().bit_length() + 1):
        nxt = at.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("low").alias("far_low"))
        new = cut_lineage(at.join(nxt, "to", "left").select("id", "to", "low", F.coalesce("far", "to").alias("new_to"), F.least("low", F.coalesce("far_low", "low")).alias("new_low")))
        done = new.where("to <> new_to or low <> new_low").isEmpty()
        at = new.select("id", F.col("new_to").alias("to"), F.col("new_low").alias("low"))
        if done:
            break
    ends = at.join(links.select(F.col("id").alias("to")), "to", "left_semi").select("id", F.col("low").alias("root"))
    return at.join(ends, "id", "left").select("id", F.coalesce("root", "to").alias("root"))


def node_score(ranked: DataFrame) -> DataFrame:
    """Half rank, three tenths degree, two tenths evidence, each over its maximum."""
    most = ranked.agg(*[F.max(c).alias(f"m_{c}") for c in ("rank", "degree", "evidence")])
    share = lambda c: F.col(c) / F.when(F.col(f"m_{c}") > 0, F.col(f"m_{c}")).otherwise(1)
    return ranked.crossJoin(F.broadcast(most)).select("id", F.round(0.5 * share("rank") + 0.3 * share("degree") + 0.2 * share("evidence"), 6).alias("score"))
