"""Connected components of a link table, without bringing links to the driver."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._stages import Stages


def components(links: DataFrame, stages: Stages, tag: str) -> DataFrame:
    """(id, comp): each linked id with the smallest id it can reach.

    links: columns a, b. Each round hooks every vertex on its least neighbour,
    follows these hooks to their ends and contracts the links to the ends. A
    vertex that hooks is gone, and a local minimum on which none hooks has a
    smaller neighbour after the round: two rounds at least halve what is
    unfinished, in any order of ids. Tables go to the shared folder.
    """
    number = count()
    used: list[str] = []

    def save(df: DataFrame) -> DataFrame:
        used.append(f"{tag}-{next(number)}")
        return stages.save(df, used[-1])

    both = save(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    steps = []
    while not steps or both.limit(1).count():
        ends = _hook_ends(both, save)
        steps.append(ends)
        for side in ("a", "b"):
            both = both.join(ends.withColumnRenamed("id", side), side).drop(side).withColumnRenamed("comp", side)
        both = save(both.where("a <> b").select("a", "b").distinct())
    labels = steps.pop()
    while steps:
        far = labels.select(F.col("id").alias("comp"), F.col("comp").alias("far"))
        labels = steps.pop().join(far, "comp", "left").select("id", F.coalesce("far", "comp").alias("comp"))
    labels = stages.save(labels, f"{tag}-labels")
    stages.drop(*used)
    return labels


def _hook_ends(both: DataFrame, save) -> DataFrame:
    """(id, comp): where the chain of least neighbours ends; half the way is left after each jump."""
    at = save(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "id"))
    while True:
        nxt = at.select(F.col("id").alias("comp"), F.col("comp").alias("far"))
        new = save(at.join(nxt, "comp").select("id", F.col("far").alias("comp"), (F.col("far") != F.col("comp")).alias("moved")))
        at = new.select("id", "comp")
        if new.where("moved").limit(1).count() == 0:
            return at
