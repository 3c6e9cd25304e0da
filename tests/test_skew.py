"""Joins in which one key, or no key, holds most rows: how many rows each task gets, and the same result as a plain join."""

import pytest
from pyspark.sql import functions as F

from florilege.skew import hot_values, hot_values_of, salted_join


@pytest.fixture
def shuffled(spark):
    """Shuffle joins over 16 tasks, as they are planned for large sides."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, x in settings.items():
        spark.conf.set(k, x)
    yield spark
    for k, x in before.items():
        spark.conf.set(k, x)


def tables(spark, n=400_000):
    """Nine rows of ten without a key or with one and the same; the rest of 5,000 keys."""
    kind = F.col("id") % 20
    key = F.when(kind < 9, F.lit(None)).when(kind < 18, F.lit("hub")).otherwise(F.concat(F.lit("k"), F.col("id") % 5000))
    big = spark.range(n).select("id", key.alias("k"))
    small = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v")).unionByName(spark.range(1).select(F.lit("hub").alias("k"), F.lit(-1).cast("long").alias("v")))
    return big, small


def loads(df):
    return sorted(r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())


def test_no_task_gets_much_more_than_the_others(shuffled):
    big, small = tables(shuffled)
    hot = hot_values(big, "k")
    assert hot == ["hub"]
    salted = salted_join(big, small, "k", F.col("id"), hot, "left")
    n = loads(salted)
    assert sum(n) == 400_000 and len(n) == 16 and n[-1] <= 2 * n[len(n) // 2]
    plain = loads(big.join(small, "k", "left"))
    assert plain[-1] > 5 * n[-1]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_same_result_as_a_plain_join(spark, how):
    big, small = tables(spark, 2000)
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    for hot in ([], ["hub"], ["hub", "k19", "absent"]):
        assert rows(salted_join(big, small, "k", F.col("id"), hot, how)) == rows(big.join(small, "k", how))


def test_hot_values_of_several_columns(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "a").alias("x"), F.when(F.col("id") % 2 == 0, "b").otherwise(F.col("id").cast("string")).alias("y"))
    assert hot_values_of(df, ["x", "y"], least=10) == {"x": ["a"], "y": ["b"]}
    assert hot_values_of(df.where("false"), ["x", "y"], least=10) == {"x": [], "y": []} and hot_values(df, "x", least=2000) == []
