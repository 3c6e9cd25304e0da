"""Consolidating pairwise matches into groups: connected components over an edge list.

1. The giant component is peeled by frontier breadth-first joins from the vertex of highest degree, as long as the
   frontier stays wide; what was reached becomes one vertex.
2. Edges inside the reached set are anti-joined away, edges that leave it (the tail of long chains that a breadth-first
   search would follow for hundreds of rounds) are kept with the reached set as their end.
3. The rest is labelled by minimum propagation, as alternating large-star and small-star steps: every vertex passes the
   smallest vertex it sees to its neighbours, so a chain of n links takes about log n rounds instead of n.

Vertices are order-keeping integers, so the smallest integer of a group is its smallest text. Every join on a vertex spreads
the vertices of very many links (`skew.salted_join`), found from counts that each round takes anyway. Null and blank ends and
self-loops make no group; repeated and reversed edges count once; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.session import cut
from florilege.skew import HOT_SHARE, hot_values_of, salted_join

#: The search stops when a round reaches less than this share of what was reached before; the rest is left to step 3.
FRONTIER_SHARE = 0.01
BFS_ROUNDS = 12
#: Below this many links no vertex is spread.
LEAST_HOT = 10_000


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: text) to (vertex, component): every vertex of a group of two or more, with the smallest of the group."""
    clean = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    clean = cut(clean)
    names = clean.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    names = cut(names.repartitionByRange("name").sortWithinPartitions("name").withColumn("v", F.monotonically_increasing_id()))
    left = names.select(F.col("name").alias("a"), F.col("v").alias("x"))
    right = names.select(F.col("name").alias("b"), F.col("v").alias("y"))
    hot = hot_values_of(clean, ["a", "b"], HOT_SHARE, LEAST_HOT)
    numbered = _join(_join(clean, left, "a", "b", hot["a"], "inner"), right, "b", "a", hot["b"], "inner")
    links = cut(numbered.select("x", "y"), clean)
    labels, hot_low = _label(links)
    smallest = names.select(F.col("v").alias("low"), F.col("name").alias("component"))
    return _join(labels.join(names, "v"), smallest, "low", "v", hot_low, "inner").select(F.col("name").alias("vertex"), "component")


def _join(big: DataFrame, small: DataFrame, on: str, spread: str, hot: list, how: str) -> DataFrame:
    return salted_join(big, small, on, F.col(spread), hot, how, nulls=False)


def _both(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(x, y) of each pair from both its ends."""
    return pairs.select(F.explode(F.array(F.struct(F.col(a).alias("x"), F.col(b).alias("y")), F.struct(F.col(b).alias("x"), F.col(a).alias("y")))).alias("e")).select("e.*")


def _label(links: DataFrame) -> tuple[DataFrame, list[int]]:
    """links (x < y, distinct) to (v, low), each vertex with the smallest vertex of its component, and the lows of very many."""
    both = _both(links, "x", "y")
    busiest = both.groupBy("x").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "x").limit(int(2 / HOT_SHARE)).collect()
    if not busiest:
        return links.select(F.col("x").alias("v"), F.col("y").alias("low")), []
    n_links = links.count()
    hot = [r["x"] for r in busiest if r["n"] >= max(LEAST_HOT, HOT_SHARE * n_links)]
    frontiers = [links.sparkSession.range(1).select(F.lit(busiest[0]["x"]).cast("long").alias("v"))]
    total = 1
    for _ in range(BFS_ROUNDS):
        at = frontiers[-1].select(F.col("v").alias("x"))
        step = _join(both, at, "x", "y", hot, "left_semi").select(F.col("y").alias("v")).distinct()
        # A vertex next to the frontier was reached in one of the last two rounds, or is new.
        frontier = cut(step.join(reduce(DataFrame.unionByName, frontiers[-2:]), "v", "left_anti"))
        n = frontier.count()
        if n:
            frontiers.append(frontier)
        if n < max(1, FRONTIER_SHARE * total):
            break
        total += n
    reached = cut(reduce(DataFrame.unionByName, frontiers), *frontiers[1:])
    giant = reached.agg(F.min("v")).first()[0]
    inside = reached.withColumn("inside", F.lit(True))
    a = inside.select(F.col("v").alias("x"), F.col("inside").alias("in_x"))
    b = inside.select(F.col("v").alias("y"), F.col("inside").alias("in_y"))
    marked = _join(_join(links, a, "x", "y", hot, "left"), b, "y", "x", hot, "left").where("in_x is null or in_y is null")
    ends = [F.when(F.col(f"in_{c}"), F.lit(giant)).otherwise(F.col(c)) for c in ("x", "y")]
    rest = cut(marked.select(F.least(*ends).alias("x"), F.greatest(*ends).alias("y")).distinct())
    small, hot = _stars(rest, [*hot, giant][: int(2 / HOT_SHARE)])
    # The reached set has the label that its stand-in got.
    low_of_giant = small.where(F.col("v") == giant).agg(F.min("low")).first()[0]
    low_of_giant = giant if low_of_giant is None else min(low_of_giant, giant)
    return reached.select("v", F.lit(low_of_giant).alias("low")).unionByName(small.where(F.col("v") != giant)), [*hot, low_of_giant]


def _stars(links: DataFrame, hot: list[int]) -> tuple[DataFrame, list[int]]:
    """Alternate large-star and small-star until every vertex points straight at the smallest of its component.

    hot: vertices of very many links; later rounds count who has become one. Also returns those of the last round.
    """
    pairs, before, state = links.select(F.col("y").alias("v"), F.col("x").alias("low")), (), None
    while state != before:
        # Large star: each vertex sends its greater neighbours to the smallest of its neighbourhood.
        turned = _both(pairs, "v", "low")
        near = turned.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = _join(turned.where("y > x"), near, "x", "y", hot, "inner").select(F.col("y").alias("v"), F.col("m").alias("low")).distinct()
        # Small star: each vertex sends its smaller neighbours, and itself, to the smallest of them.
        least = large.groupBy("v").agg(F.min("low").alias("m"))
        sent = _join(large, least, "v", "low", hot, "inner").select(F.explode(F.array(F.struct(F.col("low").alias("v"), F.col("m").alias("low")), F.struct(F.col("v"), F.col("m").alias("low")))).alias("e")).select("e.*")
        pairs, before = cut(sent.where("v <> low").distinct(), *([pairs] if state else [])), state
        hot, state = _state(pairs, state[0] if state else 0)
    roots = pairs.select(F.col("low").alias("v")).distinct()
    return pairs.unionByName(roots.select("v", F.col("v").alias("low"))), hot


def _state(pairs: DataFrame, links: int) -> tuple[list[int], tuple[int, int]]:
    """(the lows of very many pairs, the number of pairs with what tells two sets of pairs apart), from one pass.

    links: how many pairs there were a round before; there are never more afterwards.
    """
    mark = F.bit_xor(F.xxhash64("v", "low")).alias("h")
    if 0 < links < LEAST_HOT:
        r = pairs.agg(F.count(F.lit(1)).alias("n"), mark).first()
        return [], (r["n"], r["h"] or 0)
    per = pairs.groupBy("low").agg(F.count(F.lit(1)).alias("n"), mark)
    many = F.col("n") >= F.lit(max(LEAST_HOT, int(HOT_SHARE * links)))
    r = per.agg(F.sum("n").alias("n"), F.bit_xor("h").alias("h"), F.collect_list(F.when(many, F.struct("n", "low"))).alias("hot")).first()
    return [x["low"] for x in sorted(r["hot"], reverse=True)[: int(2 / HOT_SHARE)]], (r["n"] or 0, r["h"] or 0)
