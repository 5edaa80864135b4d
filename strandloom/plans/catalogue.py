"""All registered queries and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.operators.forest import maximum_spanning_forest
from strandloom.plans import annotation_queries, format_queries, graph_queries, search_queries, sequence_queries, table_queries

QUERIES = {**sequence_queries.QUERIES, **graph_queries.QUERIES, **annotation_queries.QUERIES, **table_queries.QUERIES, **format_queries.QUERIES, **search_queries.QUERIES}
ORACLES = {**sequence_queries.ORACLES, **graph_queries.ORACLES, **annotation_queries.ORACLES, **table_queries.ORACLES, **format_queries.ORACLES, **search_queries.ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity join of part names, reduced to its maximum spanning forest."""
    links = sequence_queries.sim_join_parts(spark, sf_dir)
    return maximum_spanning_forest(links)
