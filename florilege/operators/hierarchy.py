"""Parent-child links to full hierarchies: peeling, cycles, Euler tours, paths.

Stages, each a handful of joins on 64-bit integers:

1. `encode`    text ids become order-keeping integers (a range sort), parents are looked up, absent parents become null.
2. `peel`      leaves are peeled off in rounds; what is left (cycles and long spines) is told apart by pointer doubling,
               because peeling alone needs as many rounds as the longest chain. Nodes that never reach a root keep the
               smallest id on their cycle.
3. `euler`     the forest's Euler tour as linked lists (one per root), ranked by random-mate contraction: each round takes
               about a quarter of the list elements out, so all rounds together shuffle some four times the list.
4. `hierarchy` entry-exit intervals give depth, root and number of descendants; a sweep over intervals cut into chunks of
               bounded size gives each node its full path. `descendants` turns paths into ancestor-descendant pairs.

Empty tables give empty results; null or blank ids are no nodes; repeated rows of an id count once (the parent of the
first row by `order`); a node that is its own parent is a cycle; a parent without a row ends the chain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.session import cut
from florilege.skew import HOT_SHARE, hot_values, salted_join

#: Siblings are linked in ranges of this many ids, so that one parent of very many children is no single task.
SIBLING_BITS = 16
#: Lists are contracted until this many elements are left, which one task ranks (about 30 MB).
RESIDUAL = 200_000
#: Intervals are swept in chunks of this many positions.
CHUNK = 1 << 16
PEEL_ROUNDS = 3
#: Below this many rows no node is spread.
LEAST_HOT = 10_000


def encode(rows: DataFrame) -> DataFrame:
    """rows (tree, id, parent, order; keys already normalised) to (tree, id, nid, pid); nid is in the order of (tree, id)."""
    one = rows.where(F.col("id").isNotNull()).groupBy("tree", "id").agg(F.min_by("parent", "order").alias("parent"))
    nodes = cut(one.repartitionByRange("tree", "id").sortWithinPartitions("tree", "id").withColumn("nid", F.monotonically_increasing_id()))
    children = nodes.withColumn("link", F.when(F.col("parent").isNotNull(), F.concat_ws("\x1f", "tree", "parent")))
    parents = nodes.select(F.concat_ws("\x1f", "tree", "id").alias("link"), F.col("nid").alias("pid"))
    linked = salted_join(children, parents, "link", F.col("nid"), hot_values(children, "link"), "left")
    return cut(linked.select("tree", "id", "nid", "pid"))


@dataclass
class Peeled:
    """nodes: all of encode's rows. cyclic: (nid, cycle_nid) of the nodes on a cycle or below one."""

    nodes: DataFrame
    cyclic: DataFrame


def peel(nodes: DataFrame) -> Peeled:
    """Split nodes into those whose chain of parents ends and those on or below a cycle.

    Peeling goes down from the roots' side as well as up from the leaves: a node that is no one's parent cannot be on a
    cycle. The peeled leaves below a cycle get their cycle from their parent, layer by layer, at the end.
    """
    alive = nodes.where(F.col("pid").isNotNull()).select("nid", "pid")
    hot_parents = hot_values(alive, "pid", least=LEAST_HOT)
    layers: list[DataFrame] = []
    for _ in range(PEEL_ROUNDS):
        inner = alive.select(F.col("pid").alias("nid")).distinct()
        split = cut(alive.join(inner.withColumn("inner", F.lit(True)), "nid", "left"))
        layers.append(split.where("inner is null").select("nid", "pid"))
        alive = split.where("inner").select("nid", "pid")
    # Pointer doubling over the core. ptr: the ancestor 2^k up, null beyond the end; low: the smallest id passed.
    core = cut(alive.select("nid", F.col("pid").alias("ptr"), F.col("nid").alias("low")))
    (open_before, hot), bound, steps = _open(core, 0), 0, 1
    closed = open_before == 0
    while not closed:
        to = core.select(F.col("nid").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("low").alias("low2"))
        # After k rounds all nodes below an ancestor share few pointers; those are spread.
        ahead = salted_join(core, to, "ptr", F.col("nid"), hot, "inner", nulls=False)
        core = cut(ahead.where("ptr2 is not null").select("nid", F.col("ptr2").alias("ptr"), F.least("low", "low2").alias("low")), core)
        steps *= 2
        open_now, hot = _open(core, open_before)
        # A round that ends no chain proves that no chain is left; then the rest needs windows as long as its cycles.
        if bound == 0 and open_now == open_before:
            bound = max(1, open_now)
        open_before = open_now
        closed = open_now == 0 or (bound > 0 and steps > 2 * bound)
    low_at = core.select(F.col("nid").alias("ptr"), F.col("low").alias("cycle_nid"))
    cyclic = salted_join(core, low_at, "ptr", F.col("nid"), hot, "inner", nulls=False).select("nid", "cycle_nid")
    for layer in reversed(layers):
        above = cyclic.select(F.col("nid").alias("pid"), "cycle_nid")
        cyclic = cut(cyclic.unionByName(salted_join(layer, above, "pid", F.col("nid"), hot_parents, "inner", nulls=False).select("nid", "cycle_nid")))
    return Peeled(nodes, cyclic)


def _open(core: DataFrame, before: int) -> tuple[int, list[int]]:
    """The number of nodes whose pointer is still on its way, and the pointers that very many share, from one pass."""
    per = core.groupBy("ptr").agg(F.count(F.lit(1)).alias("n"))
    many = F.col("n") >= F.lit(max(LEAST_HOT, int(HOT_SHARE * before)))
    r = per.agg(F.sum("n").alias("n"), F.collect_list(F.when(many, F.struct("n", "ptr"))).alias("hot")).first()
    return r["n"] or 0, [x["ptr"] for x in sorted(r["hot"], reverse=True)[: int(2 / HOT_SHARE)]]


def cycles(peeled: Peeled) -> DataFrame:
    """(tree, node_id, cycle_id): every node on a cycle or below one, with the smallest id, as text, on that cycle."""
    name = peeled.nodes.select("tree", "id", "nid")
    smallest = name.select(F.col("nid").alias("cycle_nid"), F.col("id").alias("cycle_id"))
    return peeled.cyclic.join(name, "nid").join(smallest, "cycle_nid").select("tree", F.col("id").alias("node_id"), "cycle_id")


def _siblings(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nid, next sibling) of the tree's non-roots, and (pid, first child)."""
    child = tree.where("pid is not null").withColumn("block", F.shiftright("nid", SIBLING_BITS))
    starts = cut(child.groupBy("pid", "block").agg(F.min("nid").alias("start")))
    across = Window.partitionBy("pid").orderBy("block")
    follow = starts.select("pid", "block", F.lead("start").over(across).alias("next_start"))
    within = Window.partitionBy("pid", "block").orderBy("nid")
    inside = child.withColumn("sib", F.lead("nid").over(within))
    linked = inside.join(follow, ["pid", "block"], "left").select("nid", F.coalesce("sib", "next_start").alias("sib"))
    return linked, starts.groupBy("pid").agg(F.min("start").alias("first"))


def euler(tree: DataFrame, residual: int | None = None) -> DataFrame:
    """(nid, root, entry, exit, depth) of an acyclic forest (nid, pid): list ranking over its Euler tours.

    Element 2*nid enters a node, 2*nid + 1 leaves it; every root heads a list of its own with entry 0. residual: how many
    elements one task may rank (RESIDUAL).
    """
    residual = RESIDUAL if residual is None else residual
    sib, first = _siblings(tree)
    wide = tree.join(first.withColumnRenamed("pid", "nid"), "nid", "left").join(sib, "nid", "left")
    enter, leave = (lambda c: F.col(c) * 2), (lambda c: F.col(c) * 2 + 1)
    after_enter = F.coalesce(enter("first"), leave("nid"))
    after_leave = F.coalesce(enter("sib"), leave("pid"))
    is_root = F.col("pid").isNull()
    elements = wide.select(F.explode(F.array(
        F.struct(enter("nid").alias("e"), after_enter.alias("next"), is_root.alias("head")),
        F.struct(leave("nid").alias("e"), after_leave.alias("next"), F.lit(False).alias("head")),
    )).alias("x")).select("x.*")
    step = F.when(F.col("next").isNull(), 0).when(F.col("next") % 2 == 0, 1).otherwise(-1)
    level = cut(elements.withColumn("w", F.lit(1).cast("long")).withColumn("d", step.cast("long")))
    joined: list[DataFrame] = []
    # A list that is contracted to its head is done; however many there are, they need no ranking.
    done = F.col("head") & F.col("next").isNull()
    while level.where(~done).count() > residual:
        absorbed = cut(_contract(level, len(joined)))
        joined.append(absorbed)
        level = absorbed.select("e", "next", "head", "w", "d")
    zero = F.lit(0).cast("long")
    placed = level.where(~done).groupBy().applyInPandas(_rank_residual, "e long, root long, pos long, depth long")
    placed = placed.unionByName(level.where(done).select("e", F.col("e").alias("root"), zero.alias("pos"), zero.alias("depth")))
    for k, absorbed in enumerate(reversed(joined)):
        both = absorbed.select("e", "taken", "taken_w", "taken_d").join(placed, "e")
        own = F.struct("e", "root", "pos", "depth")
        took = F.struct(F.col("taken").alias("e"), "root", (F.col("pos") + F.col("taken_w")).alias("pos"), (F.col("depth") + F.col("taken_d")).alias("depth"))
        placed = both.select(F.explode(F.when(F.col("taken").isNull(), F.array(own)).otherwise(F.array(own, took))).alias("x")).select("x.*")
        if k % 6 == 5:
            placed = cut(placed)
    entering = F.col("e") % 2 == 0
    return placed.groupBy(F.shiftright("e", 1).alias("nid")).agg(
        F.max(F.shiftright("root", 1)).alias("root"), F.max(F.when(entering, F.col("pos"))).alias("entry"),
        F.max(F.when(~entering, F.col("pos"))).alias("exit"), F.max(F.when(entering, F.col("depth"))).alias("depth"),
    )


def _contract(level: DataFrame, k: int) -> DataFrame:
    """One round of random mates: an element that drew 0 takes in its follower that drew 1; heads always draw 0."""
    draw = F.when(F.col("head"), F.lit(0)).otherwise(F.pmod(F.xxhash64("e", F.lit(k)), F.lit(2)))
    drawn = level.withColumn("draw", draw)
    a = drawn.where("draw = 0").select(F.col("e").alias("ae"), F.col("next").alias("k"), F.col("head").alias("ahead"), F.col("w").alias("aw"), F.col("d").alias("ad"))
    b = drawn.where("draw = 1").select(F.col("e").alias("k"), F.col("e").alias("be"), F.col("next").alias("bnext"), F.col("w").alias("bw"), F.col("d").alias("bd"))
    j = a.join(b, "k", "full")
    pair, alone = F.col("ae").isNotNull() & F.col("be").isNotNull(), F.col("ae").isNull()
    return j.select(
        F.coalesce("ae", "be").alias("e"), F.when(pair | alone, F.col("bnext")).otherwise(F.col("k")).alias("next"), F.coalesce("ahead", F.lit(False)).alias("head"),
        (F.coalesce("aw", F.lit(0)) + F.coalesce("bw", F.lit(0))).alias("w"), (F.coalesce("ad", F.lit(0)) + F.coalesce("bd", F.lit(0))).alias("d"),
        F.when(pair, F.col("be")).alias("taken"), F.when(pair, F.col("aw")).alias("taken_w"), F.when(pair, F.col("ad")).alias("taken_d"),
    )


def _rank_residual(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rank at most RESIDUAL list elements by vectorised pointer doubling from the heads."""
    if pdf.empty:
        return pd.DataFrame({"e": [], "root": [], "pos": [], "depth": []}, dtype="int64")
    e = pdf["e"].to_numpy()
    at = {x: i for i, x in enumerate(e.tolist())}
    n = len(e)
    prev = np.arange(n)
    w, d = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, (nxt, wi, di) in enumerate(zip(pdf["next"].tolist(), pdf["w"].tolist(), pdf["d"].tolist())):
        if nxt == nxt and nxt is not None:
            j = at[int(nxt)]
            prev[j], w[j], d[j] = i, wi, di
    while True:
        up = prev[prev]
        if np.array_equal(up, prev):
            break
        w, d, prev = w + w[prev], d + d[prev], up
    return pd.DataFrame({"e": e, "root": e[prev], "pos": w, "depth": d})


def hierarchy(peeled: Peeled, residual: int | None = None) -> DataFrame:
    """(tree, node_id, parent_id, root_id, depth, path, n_descendants, entry, exit) of every node that reaches a root.

    path: array of ids from the root to the node. Nodes of `cycles` are not in the result.
    """
    tree = cut(peeled.nodes.join(peeled.cyclic.select("nid"), "nid", "left_anti"))
    spans = euler(tree.select("nid", "pid"), residual).join(tree.select("nid", "tree", "id"), "nid")
    spans = cut(spans)
    first, last = F.floor(F.col("entry") / CHUNK), F.floor(F.col("exit") / CHUNK)
    own = spans.select("root", first.alias("chunk"), F.lit(1).alias("kind"), "entry", "exit", "tree", "id", "depth")
    over = spans.where(last > first).select("root", F.explode(F.sequence(first + 1, last)).alias("chunk"), F.lit(0).alias("kind"), "entry", "exit", "tree", "id", "depth")
    rows = own.unionByName(over).repartition("root", "chunk").sortWithinPartitions("root", "chunk", "kind", "entry")
    return rows.mapInPandas(_sweep, "tree string, node_id string, parent_id string, root_id string, depth int, path array<string>, n_descendants long, entry long, exit long")


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk each chunk's intervals in order of entry with the stack of open ancestors."""
    at: tuple = ()
    exits: list[int] = []
    ids: list[str] = []
    for pdf in batches:
        keep, parents, roots, paths = [], [], [], []
        for i, (root, chunk, kind, entry, leave, node) in enumerate(zip(pdf["root"], pdf["chunk"], pdf["kind"], pdf["entry"], pdf["exit"], pdf["id"])):
            if (root, chunk) != at:
                at, exits, ids = (root, chunk), [], []
            while exits and exits[-1] < entry:
                exits.pop()
                ids.pop()
            if kind:
                keep.append(i)
                parents.append(ids[-1] if ids else None)
                paths.append([*ids, node])
                roots.append(paths[-1][0])
            exits.append(leave)
            ids.append(node)
        own = pdf.iloc[keep]
        yield pd.DataFrame({
            "tree": own["tree"].to_numpy(), "node_id": own["id"].to_numpy(), "parent_id": parents, "root_id": roots, "depth": own["depth"].to_numpy(),
            "path": paths, "n_descendants": (own["exit"] - own["entry"]).to_numpy() // 2, "entry": own["entry"].to_numpy(), "exit": own["exit"].to_numpy(),
        })


def descendants(tree: DataFrame) -> DataFrame:
    """(tree, ancestor_id, descendant_id, distance): every proper pair, from the paths of `hierarchy`.

    The pairs grow with the depth of the trees; their compact form are the entries and exits of `hierarchy`: a node's
    descendants are the nodes of its root whose entry lies between its own entry and exit.
    """
    steps = tree.select("tree", F.col("node_id").alias("descendant_id"), "depth", F.posexplode("path").alias("level", "ancestor_id"))
    return steps.where("level < depth").select("tree", "ancestor_id", "descendant_id", (F.col("depth") - F.col("level")).cast("int").alias("distance"))


def links(df: DataFrame, tree: str, node: Column, parent: Column, order: str) -> DataFrame:
    """The (tree, id, parent, order) rows that `encode` takes."""
    return df.select(F.lit(tree).alias("tree"), node.alias("id"), parent.alias("parent"), F.col(order).alias("order"))
