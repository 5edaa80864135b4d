"""Checks of tables against each other, and statistics of a sequence table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.ordering import numbered


def zip_compare(left: DataFrame, right: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """(on, status): equal, left only, right only, or the first column that differs; nulls equal each other."""
    a, b = left.select(on, F.lit(1).alias("_l"), *[F.col(c).alias(f"l_{c}") for c in columns]), right.select(on, F.lit(1).alias("_r"), *[F.col(c).alias(f"r_{c}") for c in columns])
    status = F.when(F.col("_r").isNull(), "left only").when(F.col("_l").isNull(), "right only")
    for c in columns:
        status = status.when(~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), f"{c} differs")
    return a.join(b, on, "full_outer").select(on, status.otherwise("equal").alias("status"))


def first_mismatches(zipped: DataFrame, on: str, limit: int = 10) -> DataFrame:
    """The first rows of zip_compare() that are not equal, after which a comparison gives up."""
    return zipped.filter("status <> 'equal'").orderBy(on).limit(limit)


def length_stats(sequences: DataFrame, seq_col: str) -> DataFrame:
    """n, total, mean, shortest and longest of the lengths; nulls do not count."""
    size = F.length(seq_col)
    return sequences.agg(
        F.count(size).alias("n"), F.sum(size).cast("long").alias("total"), F.round(F.avg(size), 6).alias("mean"),
        F.min(size).alias("shortest"), F.max(size).alias("longest"),
    )


def out_of_order(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, breaks): in each group, rows whose value is above the one before them in order. 0: sorted descending.

    Rows are numbered over ranges of keys and order and meet the row before them by its number, so a group may span
    any number of tasks.
    """
    ranked = numbered(df.select(*keys, order, value), [F.asc(c) for c in (*keys, order)], rank="_place")
    before = ranked.select((F.col("_place") + 1).alias("_place"), *[F.col(k).alias(f"_before_{k}") for k in keys], F.col(value).alias("_before"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_before_{k}"))
    up = F.when(same & (F.col(value) > F.col("_before")), 1).otherwise(0)
    return ranked.join(before, "_place", "left").groupBy(*keys).agg(F.sum(up).cast("long").alias("breaks"))
