"""Joins that stay balanced when one key, or no key at all, holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on, so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE = 1 / 64
SALTS = 32
#: Rows without a key match nothing and are spread over this many salts of their own.
NULL_SALTS = 1 << 16


def hot_values(df: DataFrame, key: str, share: float = HOT_SHARE, least: int = 10_000) -> list:
    """The values of one column that hold at least `share` of the rows (and `least` rows): at most 1/share values.

    Rows are counted before the shuffle (partial aggregation); nulls are left out. An empty table has none.
    """
    return hot_values_of(df, [key], share, least)[key]


def hot_values_of(df: DataFrame, keys: list[str], share: float = HOT_SHARE, least: int = 10_000) -> dict[str, list]:
    """`hot_values` of several columns of one type, from one pass over the rows."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in keys])).alias("x")
    counts = df.select(cells).groupBy("x.key", "x.value").agg(F.count(F.lit(1)).alias("n"))
    # Every value that is hot has `least` rows; the total counts null cells too and comes out of the same pass.
    total = F.sum("n").alias("total")
    top = counts.where(F.col("value").isNotNull() & (F.col("n") >= least)).orderBy(F.desc("n")).limit(len(keys) * int(1 / share)).collect()
    if not top:
        return {k: [] for k in keys}
    rows = counts.agg(total).first()["total"] / len(keys)
    return {k: [r["value"] for r in top if r["key"] == k and r["n"] >= share * rows] for k in keys}


def salted_join(big: DataFrame, small: DataFrame, on: str, spread: Column, hot: list, how: str = "left", nulls: bool = True) -> DataFrame:
    """Join big to small on one equal-named column: `hot` values of it spread over SALTS tasks, rows of big without a value too.

    `small` must hold the key once (or few times) as its hot rows are repeated SALTS times; `how` is inner or left
    (left_semi and left_anti work as well). Rows of big with a null key match nothing; nulls=False says that there are none.
    """
    if not hot and not nulls:
        return big.join(small, on, how)
    key = F.col(on)
    own = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    apart = (-1 - F.pmod(F.xxhash64(spread), F.lit(NULL_SALTS))).cast("int")
    salt = F.when(key.isNull(), apart)
    right = small.where(key.isNotNull())
    if hot:
        is_hot = F.array_contains(F.lit(hot), key)  # an array is no part of the generated code, which so can be used again
        salt = salt.when(is_hot, own)
        salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        right = right.withColumn("_salt", F.explode(salts))
    else:
        right = right.withColumn("_salt", F.lit(0))
    return big.withColumn("_salt", salt.otherwise(F.lit(0))).join(right, [on, "_salt"], how).drop("_salt")
