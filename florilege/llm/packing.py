"""Filling fixed-capacity containers with items: sum-of-squares online packing.

Items are dealt by hash to streams of about `stream_items` items. Within a stream each item goes to the fill level that
makes the sum of squared counts of partly filled containers smallest, kept in an array with a count per level; a container
of the chosen level is taken, or a new one opened. Items larger than the capacity are cut into full containers and a rest,
no other item is cut. At the end of a stream its partly filled containers are put together where two or more fit into one
(largest first, best fit), so that a stream leaves little unused space however few items it has.

Items of size 0 need no container and get a null one. Ties between levels go to the fuller level; equal items are taken in
the order of their hash and id, so the result is the same in every run.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STREAM_ITEMS = 25_000
#: More runs than this are refused (the table of runs is sent to every task).
MOST_RUNS = 1000


def place(sizes: list[int], capacity: int) -> list[int]:
    """The container number of each item (sizes from 1 to capacity), in the order given."""
    counts = np.zeros(capacity + 1, np.int64)
    stacks: dict[int, list[int]] = {}
    containers: list[int] = []
    opened = 0
    never = np.iinfo(np.int64).max
    cost = np.empty(capacity + 1, np.int64)
    for s in sizes:
        # Moving a container from level h to h + s changes the sum of squares by 2 * (N(h+s) - N(h) + 1); a full one and a
        # new one do not count, so their term is left out.
        top = capacity - s
        c = cost[: top + 1]
        np.subtract(counts[s:], counts[: top + 1], out=c)
        c += 1
        c *= 2
        c[counts[: top + 1] == 0] = never
        if counts[top] > 0 and top > 0:
            c[top] = 1 - 2 * counts[top]
        c[0] = 2 * counts[s] + 1 if s < capacity else 0
        level = top - int(np.argmin(c[::-1]))
        if level == 0:
            container, opened = opened, opened + 1
        else:
            container = stacks[level].pop()
            counts[level] -= 1
        containers.append(container)
        if level + s < capacity:
            counts[level + s] += 1
            stacks.setdefault(level + s, []).append(container)
    # Put partly filled containers together.
    levels = sorted(((level, c) for level, held in stacks.items() for c in held), reverse=True)
    room: list[tuple[int, int]] = []  # (free space, container), ascending
    into: dict[int, int] = {}
    for level, c in levels:
        i = bisect.bisect_left(room, (level, -1))
        if i < len(room):
            free, target = room.pop(i)
            into[c] = target
            if free > level:
                bisect.insort(room, (free - level, target))
        else:
            bisect.insort(room, (capacity - level, c))
    return [into.get(c, c) for c in containers]


def pack(sizes: DataFrame, runs: DataFrame, stream_items: int = STREAM_ITEMS) -> DataFrame:
    """sizes (doc_id, n_tokens; written once beforehand) and runs (run_name, capacity_tokens) to
    (run_name, container, doc_id, piece, start, length): what lies in each container; start is the place in the document.

    container: stream number * 2^32 + number within the stream. Runs without a positive capacity are left out.
    """
    given = runs.where("run_name is not null and capacity_tokens > 0").select("run_name", F.col("capacity_tokens").cast("int").alias("capacity")).distinct().limit(MOST_RUNS + 1).collect()
    if len(given) > MOST_RUNS:
        raise ValueError(f"more than {MOST_RUNS} runs")
    streams = max(1, round(sizes.count() / stream_items))
    run = F.array(*[F.struct(F.lit(r["run_name"]).alias("run_name"), F.lit(r["capacity"]).alias("capacity")) for r in given])
    empty = "run_name string, container long, doc_id long, piece int, start long, length long"
    if not given:
        return sizes.sparkSession.createDataFrame([], empty)
    hashed = sizes.select("doc_id", "n_tokens", F.xxhash64("doc_id").alias("h")).withColumn("stream", F.pmod("h", F.lit(streams)))
    per_run = hashed.withColumn("r", F.explode(run)).select("doc_id", "n_tokens", "h", "stream", "r.run_name", "r.capacity")
    spread = per_run.repartition(max(per_run.sparkSession.sparkContext.defaultParallelism, min(20_000, streams * len(given))), "run_name", "capacity", "stream")
    return spread.groupBy("run_name", "capacity", "stream").applyInPandas(_pack_stream, empty)


def _pack_stream(pdf: pd.DataFrame) -> pd.DataFrame:
    run, capacity, stream = pdf["run_name"].iloc[0], int(pdf["capacity"].iloc[0]), int(pdf["stream"].iloc[0])
    pdf = pdf.sort_values(["h", "doc_id"], kind="stable")
    n = pdf["n_tokens"].to_numpy(np.int64)
    full, rest = n // capacity, n % capacity
    rows = np.flatnonzero(rest > 0)
    base = stream << 32
    placed = np.array(place(rest[rows].tolist(), capacity), np.int64)
    doc = pdf["doc_id"].to_numpy()
    parts = [pd.DataFrame({"container": placed, "doc_id": doc[rows], "piece": full[rows], "start": full[rows] * capacity, "length": rest[rows]})]
    whole = np.repeat(np.arange(len(n)), full)
    if len(whole):
        piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        first = int(placed.max()) + 1 if len(placed) else 0
        parts.append(pd.DataFrame({"container": first + np.arange(len(whole)), "doc_id": doc[whole], "piece": piece, "start": piece * capacity, "length": capacity}))
    out = pd.concat(parts, ignore_index=True)
    out["container"] += base
    nothing = np.flatnonzero(n == 0)
    if len(nothing):
        void = pd.DataFrame({"container": pd.array([None] * len(nothing), "Int64"), "doc_id": doc[nothing], "piece": 0, "start": 0, "length": 0})
        out = pd.concat([out.astype({"container": "Int64"}), void], ignore_index=True)
    out.insert(0, "run_name", run)
    return out


def report(packed: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_name, capacity, n_containers, n_tokens, least, fill): least is the number of containers no packing can go below."""
    per = packed.where("container is not null").groupBy("run_name", "container").agg(F.sum("length").alias("used"))
    total = per.groupBy("run_name").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"))
    named = runs.select("run_name", F.col("capacity_tokens").alias("capacity")).distinct()
    least = F.ceil(F.col("n_tokens") / F.col("capacity"))
    return total.join(named, "run_name").select("run_name", "capacity", "n_containers", "n_tokens", "fullest", least.alias("least"), (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))).alias("fill"))


def verify(packed: DataFrame, sizes: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_name, capacity, over_full, cut_without_need, pieces_out_of_place, texts_lost): what is wrong with a packing, 0 each.

    over_full: containers beyond their capacity; cut_without_need: documents in several pieces that would fit into one;
    pieces_out_of_place: pieces that do not begin where the one before ends; texts_lost: documents of which tokens are missing
    or too many. Documents with one id are taken together.
    """
    named = runs.where("run_name is not null and capacity_tokens > 0").select("run_name", F.col("capacity_tokens").alias("capacity")).distinct()
    full = packed.where("container is not null").groupBy("run_name", "container").agg(F.sum("length").alias("used")).join(named, "run_name")
    over = full.groupBy("run_name").agg(F.count_if(F.col("used") > F.col("capacity")).alias("over_full"))
    whole = sizes.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("copies"))
    placed = packed.join(named, "run_name")
    each = placed.groupBy("run_name", "doc_id").agg(F.sum("length").alias("have"), F.count(F.lit(1)).alias("pieces"), F.count_if(F.col("start") != F.col("piece") * F.col("capacity")).alias("misplaced"))
    every = whole.join(named, F.lit(True)).join(each, ["run_name", "doc_id"], "left")
    lost = F.coalesce(F.col("have"), F.lit(-1)) != F.col("n_tokens")
    judged = every.groupBy("run_name", "capacity").agg(
        F.count_if((F.col("copies") == 1) & (F.col("pieces") > 1) & (F.col("n_tokens") <= F.col("capacity"))).alias("cut_without_need"), F.coalesce(F.sum("misplaced"), F.lit(0)).alias("pieces_out_of_place"), F.count_if(lost).alias("texts_lost"),
    )
    ints = [F.col(c).cast("int").alias(c) for c in ("over_full", "cut_without_need", "pieces_out_of_place", "texts_lost")]
    return judged.join(over, "run_name", "left").na.fill(0, ["over_full"]).select("run_name", "capacity", *ints)
