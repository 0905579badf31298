"""Rows from arrays; rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """Scaled, rounded half away from zero and scaled back, as DuckDB and C do; F.round reads the decimal text instead, which differs at halves."""
    scale = F.lit(10.0**digits)
    return F.round(x * scale) / scale


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row.

    An expression that occurs several times, or inside a lambda, is computed at
    every occurrence and for every element; a lambda's argument isn't.
    """
    return F.transform(F.array(value), use)[0]


def counted(values: Column) -> Column:
    """The different values in order, each with its number: structs of term and c."""

    def runs(s: Column) -> Column:
        first = lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), F.struct(x.alias("term"), i.alias("at")))
        count = lambda firsts: F.transform(firsts, lambda x, i: F.struct(x["term"].alias("term"), (F.coalesce(F.get(firsts, i + 1)["at"], F.size(s)) - x["at"]).cast("long").alias("c")))
        return bound(F.array_compact(F.transform(s, first)), count)

    return bound(F.sort_array(values), runs)


def spread(df: DataFrame, keep: list, values: Column | str, name: str) -> DataFrame:
    """A row per non-null element beside the columns in `keep`.

    Not with explode: for that the optimiser infers a filter on the array's
    size and repeats the expression of a computed array below it, inside
    lambdas even once per element.
    """
    return df.select(*keep, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())
