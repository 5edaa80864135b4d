"""Groups of rows that links between their numbers make, and one row of each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.operators.components import connected_components


def grouped(found: DataFrame, linked: DataFrame, id_col: str) -> DataFrame:
    """(fp, least, group) for each distinct number: its smallest id and the least number of its group."""
    of_fp = connected_components(linked).withColumnRenamed("node", "fp")
    least = found.groupBy("fp").agg(F.min(id_col).alias("least")).join(of_fp, "fp", "left")
    return least.select("fp", "least", F.coalesce("component", "fp").alias("group"))


def keep_least(documents: DataFrame, found: DataFrame, linked: DataFrame, number_of: Callable[[str | None], int], *, id_col: str, text_col: str) -> DataFrame:
    """The row with the smallest id of every group that links between numbers (fp) make; found has each row's id and number.

    Columns of any name are kept as they are: none of the documents' names can clash with those of the work.
    """
    best = F.min(F.struct(F.col("least").isNull(), F.col("least"), F.col("fp")))
    chosen = grouped(found, linked, id_col).groupBy("group").agg(best.alias("best")).select(F.col("best.least").alias("_kept_id"), F.col("best.fp").alias("_kept_fp"))
    inner = [f"c{i}" for i in range(len(documents.columns))]
    named, id_name, text_name = documents.toDF(*inner), inner[documents.columns.index(id_col)], inner[documents.columns.index(text_col)]
    if found.groupBy(id_col).count().filter((F.col("count") > 1) | F.col(id_col).isNull()).isEmpty():
        # each id is one row, so the ids say which rows stay
        stay = named.join(chosen.select("_kept_id"), F.col(id_name) == F.col("_kept_id"), "left_semi")
    else:
        same = F.col(id_name).eqNullSafe(F.col("_kept_id")) & (F.col("_row_fp") == F.col("_kept_fp"))
        stay = numbered_rows(named, text_name, number_of).join(chosen, same, "left_semi").dropDuplicates([id_name, "_row_fp"]).select(*inner)
    return stay.toDF(*documents.columns)


def numbered_rows(documents: DataFrame, text_col: str, number_of: Callable[[str | None], int]) -> DataFrame:
    """The rows with all their columns and their number in _row_fp."""
    at = documents.columns.index(text_col)
    schema = T.StructType([*documents.schema, T.StructField("_row_fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((number_of(t) for t in batch.column(at).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], names=schema.names)

    return documents.mapInArrow(run, schema)
