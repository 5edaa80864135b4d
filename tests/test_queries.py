import math
import os
from glob import glob

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from strandloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if isinstance(value, (list, np.ndarray)):
        return tuple(map(plain, value))
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    return str(float(value)) if isinstance(value, (int, float, np.number)) and not isinstance(value, bool) else str(value)


def rows(frame):
    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLES:
        want = duck.sql(catalogue.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns) > 1


def test_transforms_leave_what_they_say(spark):
    found = catalogue.QUERIES["kabsch_rmsd"](spark, SF).toPandas()
    assert np.allclose(found["rmsd"], found["applied_rmsd"], atol=1e-5)


def test_supply_forest_spans_what_components_connect(spark):
    from strandloom.operators.components import connected_components
    from strandloom.plans.graph_queries import supply_links

    links = supply_links(spark, SF)
    parts = connected_components(links, "query_seq", "target_seq").toPandas()
    assert catalogue.QUERIES["forest_supply"](spark, SF).count() == len(parts) - parts["component"].nunique()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
