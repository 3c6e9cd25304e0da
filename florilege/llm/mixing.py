"""Mixing sources to target weights: hash-threshold histograms.

The size of the mix is the largest at which no source is needed more than `max_repeats` times (or a size asked for, if that
is smaller). What a source owes is a number of whole rounds of it and a remainder; for the remainder tokens are summed by
source and hash bucket, the bucket in which the remainder ends is found, and only that bucket is cut into finer buckets,
until it holds one document. Then one threshold per source filters all documents, without a sort.

Histograms stay in Spark: a running sum by source finds the boundary bucket, and one row a source comes to the driver.

Sources without a target and targets without documents have no part in the mix and are reported with 0 tokens; the shares
of the others keep their proportions. A null source is no source; max_repeats below 1 counts as 0 (source left out).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from florilege.session import cut

#: The hash has LEVELS groups of BITS bits: buckets of one level and how often the boundary bucket can be refined.
BITS, LEVELS = 12, 5
#: More target sources than this are refused (their thresholds, a row each, are broadcast).
MOST_SOURCES = 10_000


@dataclass
class Part:
    """What one source gives: `rounds` whole rounds and the documents below the threshold once more."""

    source: str
    share: float
    max_repeats: int
    tokens: int = 0
    rounds: int = 0
    due: float = 0.0
    prefix: int = 0
    threshold: int = 0
    below: int = 0
    done: bool = field(default=False)


def _hashed(sizes: DataFrame) -> DataFrame:
    return sizes.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - BITS * LEVELS))


def plan(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> list[Part]:
    """sizes (doc_id, source, n_tokens; written once beforehand), targets (source, target_share, max_repeats): each part."""
    rows = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    parts = {r["source"]: Part(r["source"], r["share"], max(0, r["repeats"] or 0)) for r in rows}
    if not parts:
        return []
    spark = sizes.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(s,) for s in parts], "source string"))
    hashed = _hashed(sizes).join(wanted, "source", "left_semi")
    histogram = cut(_histogram(hashed, BITS * (LEVELS - 1)))
    for r in histogram.groupBy("source").agg(F.sum("t").alias("t")).collect():
        parts[r["source"]].tokens = r["t"]
    able = [p for p in parts.values() if p.tokens > 0 and p.max_repeats > 0]
    if not able:
        return list(parts.values())
    size = min(p.max_repeats * p.tokens / p.share for p in able)
    size = size if total is None else min(size, total / sum(p.share for p in able))
    for p in able:
        due = p.share * size
        p.rounds = min(p.max_repeats, int(due / p.tokens + 1e-9))
        p.due = due - p.rounds * p.tokens if p.rounds < p.max_repeats else 0.0
        p.done = p.due <= 0
    for level in range(LEVELS):
        todo = [p for p in able if not p.done]
        if not todo:
            break
        shift = BITS * (LEVELS - 1 - level)
        room = F.broadcast(spark.createDataFrame([(p.source, p.prefix, p.due - p.below) for p in todo], "source string, prefix long, room double"))
        if level:
            inside = hashed.withColumn("prefix", F.shiftright("h", shift + BITS)).join(room.drop("room"), ["source", "prefix"], "left_semi")
            histogram = _histogram(inside, shift)
        upto = F.sum("t").over(Window.partitionBy("source").orderBy("bucket"))  # at most 2^BITS rows a source
        over = histogram.join(room, "source").withColumn("upto", upto).where(F.col("upto") > F.col("room"))
        first = {r["source"]: r["b"] for r in over.groupBy("source").agg(F.min(F.struct("bucket", "t", "n", "upto")).alias("b")).collect()}
        for p in todo:
            _narrow(p, first.get(p.source), shift, level == LEVELS - 1)
    return list(parts.values())


def _histogram(hashed: DataFrame, shift: int) -> DataFrame:
    """(source, bucket, t, n): tokens and documents of each bucket of the hash."""
    return hashed.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))


def _narrow(p: Part, boundary: Row | None, shift: int, last: bool) -> None:
    """Take the whole buckets before the one in which the remainder ends; without such a bucket all of them."""
    if boundary is None:
        p.threshold, p.done = 1 << (BITS * LEVELS), True
        return
    p.below += boundary["upto"] - boundary["t"]
    p.prefix, p.threshold = boundary["bucket"], boundary["bucket"] << shift
    if boundary["n"] == 1 or last:
        # One document is left over or taken, whichever comes closer.
        if p.below + boundary["t"] - p.due < p.due - p.below:
            p.below += boundary["t"]
            p.threshold = (boundary["bucket"] + 1) << shift
        p.done = True


def mix(sizes: DataFrame, parts: list[Part]) -> DataFrame:
    """(doc_id, source, n_tokens, copies): every document that is in the mix, with how often."""
    used = [p for p in parts if p.rounds or p.due > 0]
    if not used:
        return sizes.select("doc_id", "source", "n_tokens", F.lit(0).alias("copies")).where("false")
    rules = F.broadcast(sizes.sparkSession.createDataFrame([(p.source, p.rounds, p.threshold) for p in used], "source string, rounds int, below long"))
    chosen = _hashed(sizes).join(rules, "source")
    copies = F.col("rounds") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    return chosen.select("doc_id", "source", "n_tokens", copies.cast("int").alias("copies")).where("copies > 0")


def report(sizes: DataFrame, mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_tokens, used_tokens, actual_share, times_used, most_copies) of every source."""
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"))
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    wanted = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = have.where("source is not null").join(wanted, "source", "full").join(used, "source", "left").na.fill(0, ["n_tokens", "used_tokens", "most_copies"])
    total = used.agg(F.sum("used_tokens").alias("total"))
    share = F.coalesce(F.col("used_tokens") / total.scalar(), F.lit(0.0))
    times = F.when(F.col("n_tokens") > 0, F.col("used_tokens") / F.col("n_tokens"))
    return rows.select("source", "target_share", "max_repeats", "n_tokens", "used_tokens", share.alias("actual_share"), times.alias("times_used"), "most_copies")


def verify(sizes: DataFrame, mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, in_target, n_documents, over_repeats, uneven, off_target): what is wrong with each source's part, 0 each.

    over_repeats: documents used more often than they may be; uneven: 1 if some document is used two times more than another
    (or at all, of a source without target); off_target: 1 if its tokens are off its share of all by more than its largest
    document, beside what the largest documents of the others may add.
    """
    have = sizes.where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.max("n_tokens").alias("largest"))
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used"), F.count(F.lit(1)).alias("n_used"), F.min("copies").alias("low"), F.max("copies").alias("high"))
    wanted = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    most = mixed.join(F.broadcast(wanted.limit(MOST_SOURCES)), "source", "left").groupBy("source").agg(F.count_if(F.col("copies") > F.coalesce("repeats", F.lit(0))).alias("over_repeats"))
    rows = have.join(used, "source", "left").join(wanted, "source", "left").join(most, "source", "left")
    able = F.coalesce(F.col("repeats") > 0, F.lit(False))
    sums = rows.where(able).agg(F.sum("used").alias("total"), F.sum("share").alias("shares"), F.sum("largest").alias("slack"))
    j = rows.join(sums, F.lit(True))
    low = F.when(F.coalesce("n_used", F.lit(0)) < F.col("n_documents"), 0).otherwise(F.col("low"))
    high = F.coalesce("high", F.lit(0))
    uneven = F.when(able, high - F.coalesce(low, F.lit(0)) > 1).otherwise(high > 0)
    off = able & (F.abs(F.coalesce("used", F.lit(0)) - F.col("share") / F.col("shares") * F.col("total")) > F.col("largest") + F.col("share") * F.col("slack"))
    flag = lambda c, name: F.when(c, 1).otherwise(0).alias(name)
    return j.select("source", F.col("share").isNotNull().alias("in_target"), "n_documents", F.coalesce("over_repeats", F.lit(0)).cast("int").alias("over_repeats"), flag(uneven, "uneven"), flag(off, "off_target"))
