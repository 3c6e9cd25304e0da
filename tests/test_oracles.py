"""Every query against its DuckDB oracle on the smallest tables."""

import os

import duckdb
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from florilege.operators import hierarchy as h
from florilege.plans import core_problems

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def connected(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(folder):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{folder}/{file}'")
    return con


@pytest.fixture(scope="module")
def duck(small):
    return connected(small)


#: Queries that are compared at the next scale too: all matching steps, cuts of pools and pages.
AT_THE_NEXT_SCALE = ("p6_errors", "match_batch", "suggest_in_space", "synonyms_to_publish", "translate_hints", "value_quantiles")


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(str(v) for v in r) for r in df.where(df.notna(), None).values.tolist())


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, small, duck, name):
    got, want = QUERIES[name](spark, small).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", AT_THE_NEXT_SCALE)
def test_oracle_at_the_next_scale(spark, middle, name):
    got, want = QUERIES[name](spark, middle).toPandas(), connected(middle).execute(ORACLES[name]).df()
    assert len(want) > 0 and rows(got) == rows(want)


def test_contracted_lists_at_the_next_scale(spark, middle):
    """Lists contracted down to 500 elements, so that most of the ranking is parallel, give the hierarchy of the oracle."""
    tree = h.hierarchy(core_problems._peeled(spark, middle), residual=500).withColumn("path", F.array_join("path", ">"))
    assert rows(tree.toPandas()) == rows(connected(middle).execute(ORACLES["p2_hierarchy"]).df())


def test_core_queries_have_oracles():
    """Only queries of the training-data operators go without (their own tests say what must hold of them)."""
    assert all(name.startswith("p") and name[1].isdigit() for name in set(QUERIES) - set(ORACLES))
