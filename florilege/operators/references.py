"""References to records that do not exist: dictionary-encoded keys, compressed bitmaps, reference AND-NOT parent.

1. Every distinct key of a target table (referenced, delivered or withdrawn) becomes an integer; one aggregation gathers
   for each key who refers to it in which period, when it was first delivered and whether it was withdrawn.
2. The integers are cut into ranges of 65,536; each (range, referring field, period) and each range's deliveries by period
   and withdrawals are one compressed bitmap (`functions.bitmap`).
3. Range by range: references AND withdrawn = deleted; the rest AND-NOT delivered ever = missing; the rest AND-NOT
   delivered up to the period = late.
4. The surviving bits are decoded to keys and joined to the referring rows (hot keys salted).

Null and blank references are no references. A referring row without period is never late; a target without any period
counts as delivered from the start. Empty tables give an empty result; repeated rows are each reported.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from florilege.functions import bitmap
from florilege.session import cut
from florilege.skew import HOT_SHARE, salted_join

#: Below this many rows no key is treated as hot.
LEAST_HOT = 10_000
#: Tags of the bitmaps that are not references.
DELIVERED, WITHDRAWN = "+delivered", "+withdrawn"


def broken(refs: DataFrame, targets: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """(src, field, row_seq, kind, period) of each row whose reference is deleted, missing or late.

    refs: (src, field, target, row_seq, key, period); targets: (target, key, period), a row per delivery;
    withdrawn: (target, key). Keys are already normalised, period is text that sorts in time.
    """
    refs = refs.where(F.col("key").isNotNull())
    cells = refs.groupBy("target", "key", F.concat_ws("\x1f", "src", "field").alias("tag"), "period").agg(F.count(F.lit(1)).alias("n"))
    first = targets.where(F.col("key").isNotNull()).groupBy("target", "key").agg(F.coalesce(F.min("period"), F.lit("")).alias("period"))
    gone = withdrawn.where(F.col("key").isNotNull()).select("target", "key").distinct()
    marks = (
        cells.unionByName(first.withColumn("tag", F.lit(DELIVERED)).withColumn("n", F.lit(0).cast("long")))
        .unionByName(gone.withColumn("tag", F.lit(WITHDRAWN)).withColumn("period", F.lit(None).cast("string")).withColumn("n", F.lit(0).cast("long")))
    )
    # A key has at most fields x periods + 2 marks.
    keys = marks.groupBy("target", "key").agg(F.collect_list(F.struct("tag", "period", "n")).alias("marks"))
    keys = cut(keys.withColumn("kid", F.monotonically_increasing_id()))
    bits = keys.select("kid", F.explode("marks").alias("m")).select(
        F.shiftright("kid", bitmap.RANGE_BITS).alias("range"), F.col("kid").bitwiseAND(bitmap.RANGE - 1).cast("int").alias("low"), "m.tag", "m.period"
    )
    containers = bits.groupBy("range", "tag", "period").agg(F.collect_list("low").alias("lows")).select("range", "tag", "period", _encode("lows").alias("bits"))
    left = containers.groupBy("range").applyInPandas(_survivors, "kid long, tag string, period string, kind string")
    link = lambda tag: F.concat_ws("\x1f", F.coalesce("period", F.lit("")), tag, "target", "key")
    found = left.join(keys.select("kid", "target", "key"), "kid").select(link("tag").alias("link"), "kind")
    counts = keys.select("target", "key", F.explode("marks").alias("m")).select("target", "key", "m.tag", "m.period", "m.n").where("n > 0")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = [r["link"] for r in counts.where(F.col("n") >= max(LEAST_HOT, HOT_SHARE * total)).select(link("tag").alias("link")).limit(int(1 / HOT_SHARE)).collect()]
    rows = refs.select("src", "field", "row_seq", "period", link(F.concat_ws("\x1f", "src", "field")).alias("link"))
    return salted_join(rows, found, "link", F.col("row_seq"), hot, "inner").select("src", "field", "row_seq", "kind", "period")


@F.pandas_udf(T.BinaryType())
def _encode(lows: pd.Series) -> pd.Series:
    return lows.map(bitmap.encode)


def _survivors(pdf: pd.DataFrame) -> pd.DataFrame:
    """One range's containers (as many as fields x periods + periods + 1) to its surviving bits."""
    base = int(pdf["range"].iloc[0]) << bitmap.RANGE_BITS
    gone = next(iter(pdf.loc[pdf["tag"] == WITHDRAWN, "bits"]), None)
    delivered = pdf[pdf["tag"] == DELIVERED].sort_values("period")
    upto, running = [], None
    for p, b in zip(delivered["period"], delivered["bits"]):
        running = bitmap.union(running, b)
        upto.append((p, running))
    out = []
    refs = pdf[~pdf["tag"].isin([WITHDRAWN, DELIVERED])]
    for tag, period, bits in zip(refs["tag"], refs["period"], refs["bits"]):
        alive = bitmap.and_not(bits, gone)
        present = bitmap.intersect(alive, running)
        kinds = [("deleted", bitmap.intersect(bits, gone)), ("missing", bitmap.and_not(alive, running))]
        if isinstance(period, str):
            kinds.append(("late", bitmap.and_not(present, next((b for p, b in reversed(upto) if p <= period), None))))
        for kind, c in kinds:
            if len(low := bitmap.decode(c)):
                out.append(pd.DataFrame({"kid": low + base, "tag": tag, "period": period if isinstance(period, str) else None, "kind": kind}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"kid": pd.Series(dtype="int64"), "tag": [], "period": [], "kind": []})


def report(found: DataFrame) -> DataFrame:
    """(src, field, period, kind, n_rows): the broken references of each table, field and period."""
    return found.groupBy("src", "field", "period", "kind").agg(F.count(F.lit(1)).alias("n_rows"))
