"""Row numbers and running sums over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import Workspace, cut_lineage


def numbered(df: DataFrame, order: list[Column], running: dict[str, Column] | None = None, rank: str = "rank") -> DataFrame:
    """df with `rank` from 1 in the given order, and for each name in `running` the sum of its column up to and with the row.

    Rows are dealt out by ranges of the order; ranks and sums start in each range from the totals of those before.
    The order should tell all rows apart.
    """
    running = running or {}
    sums = {f"_sum_{i}": c for i, c in enumerate(running.values())}
    dealt = cut_lineage(df.repartitionByRange(*order).withColumns({"_part": F.spark_partition_id(), **sums}))
    totals = dealt.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(s).alias(f"_total{s}") for s in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    firsts = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_first{c}") for c in ["_n", *[f"_total{s}" for s in sums]]]
    starts = totals.select("_part", *firsts)
    within = Window.partitionBy("_part").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.join(F.broadcast(starts), "_part")  # as many rows as partitions
    out = {rank: F.row_number().over(within) + F.col("_first_n")}
    out |= {name: F.sum(s).over(upto) + F.col(f"_first_total{s}") for name, s in zip(running, sums)}
    return joined.withColumns(out).select(*df.columns, *out)


def placed(work: Workspace, df: DataFrame, group: str, order: list[Column], running: dict[str, Column] | None = None) -> DataFrame:
    """df with `place` from 1 within its group in the given order, `group_size`, and for each name in `running` the sum
    of its column over the group's rows up to and with the row; and `_part`, which tells parts of a group apart.

    Rows are dealt out by ranges of group and order, so a group of any size lies in as many tasks as its rows need;
    places and sums in each start from the totals of the group's parts before. The group must not be null, and the
    order should tell its rows apart. Written tables belong to `work`.
    """
    running = running or {}
    sums = {f"_sum_{i}": c for i, c in enumerate(running.values())}
    dealt = work.keep(df.withColumns(sums).repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n"), *[F.sum(s).alias(f"_total{s}") for s in sums])
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    firsts = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_first{c}") for c in ("_n", *[f"_total{s}" for s in sums])]
    starts = totals.select(group, "_part", F.sum("_n").over(Window.partitionBy(group)).alias("group_size"), *firsts)
    within = Window.partitionBy(group, "_part").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    out = {"place": F.row_number().over(within) + F.col("_first_n")}
    out |= {name: F.sum(s).over(upto) + F.col(f"_first_total{s}") for name, s in zip(running, sums)}
    return dealt.join(starts, [group, "_part"]).withColumns(out).select(*df.columns, "group_size", *out, "_part")


def length_ranks(sequences: DataFrame, id_col: str, length: Column) -> DataFrame:
    """(id_col, length, sorted_position): positions from 0 by length descending, ids ascending; also the inverse index."""
    rows = sequences.select(F.col(id_col), length.cast("long").alias("length"))
    ranked = numbered(rows, [F.desc_nulls_last("length"), F.asc(id_col)], rank="sorted_position")
    return ranked.withColumn("sorted_position", F.col("sorted_position") - 1)


def is_permutation(df: DataFrame, column: str) -> DataFrame:
    """One row is_permutation: the column holds each of 0 to n - 1 once."""
    stats = df.agg(F.count("*").alias("n"), F.count_distinct(column).alias("k"), F.min(column).alias("a"), F.max(column).alias("b"))
    return stats.select(((F.col("n") == F.col("k")) & (F.col("a") == 0) & (F.col("b") == F.col("n") - 1)).alias("is_permutation"))


def work_left(lengths: DataFrame, id_col: str, length_col: str) -> DataFrame:
    """(id_col, length, cells_left): cell updates of the triangular join from each query on, longest queries first.

    A query meets itself and all after it: its length times theirs. Cells are decimals of 38 digits: those of some
    10^9 sequences don't fit in 64 bits.
    """
    order = [F.desc(length_col), F.asc(id_col)]
    rows = lengths.select(F.col(id_col), F.col(length_col).cast("long").alias(length_col))
    run = numbered(rows, order, {"upto": F.col(length_col)}, rank="place")
    total = rows.agg(F.sum(length_col)).first()[0] or 0
    cells = run.withColumn("cells", (F.col(length_col).cast("decimal(19,0)") * (total - F.col("upto") + F.col(length_col)).cast("decimal(19,0)")).cast("decimal(38,0)"))
    done = numbered(cells.select(id_col, length_col, "cells"), order, {"done": F.col("cells")}, rank="place")
    all_cells = cells.agg(F.sum("cells")).first()[0] or 0
    return done.select(id_col, length_col, (all_cells - F.col("done") + F.col("cells")).alias("cells_left"))


def work_estimates(lengths: DataFrame, id_col: str, length_col: str, cells_per_second: int) -> DataFrame:
    """(id_col, length, residues_done, cells_done, cells_left, seconds_left) once each query is done, longest queries first.

    residues_done and cells_done are percents; a run that has done a share f of the residues has done 1 - (1 - f)^2 of
    the triangular join's cells. cells_left counts them exactly.
    """
    total = lengths.agg(F.sum(length_col)).first()[0] or 0
    left = work_left(lengths, id_col, length_col)
    rows = lengths.select(F.col(id_col), F.col(length_col).cast("long").alias(length_col))
    upto = numbered(rows, [F.desc(length_col), F.asc(id_col)], {"upto": F.col(length_col)}, rank="place").select(id_col, "upto")
    joined = left.join(upto, id_col)
    share = F.col("upto") / F.lit(float(max(total, 1)))
    # a query's own cells meet what comes from it on
    after = F.col("cells_left") - F.col(length_col) * (total - F.col("upto") + F.col(length_col))
    return joined.select(
        id_col, length_col, (share * 100).alias("residues_done"), (100 * (1 - (1 - share) * (1 - share))).alias("cells_done"), after.alias("cells_left"),
        F.floor(after / cells_per_second).cast("long").alias("seconds_left"),
    )
