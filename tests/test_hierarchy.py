import random

import pytest
from pyspark.sql import functions as F

from florilege.operators import hierarchy as h

SCHEMA = "tree string, id string, parent string, `order` long"


def brute(parent):
    """(paths of nodes that reach a root, cycle of the others)."""
    paths, cyclic = {}, {}
    for v in parent:
        seen, x = [], v
        while x in parent and x not in seen:
            seen.append(x)
            x = parent[x]
        if x in seen:
            cyclic[v] = min(seen[seen.index(x) :])
        else:
            paths[v] = seen[::-1]
    return paths, cyclic


def run(spark, links, monkeypatch=None):
    df = spark.createDataFrame([("t", a, b, i) for i, (a, b) in enumerate(links)], SCHEMA)
    peeled = h.peel(h.encode(df))
    found = {r["node_id"]: r["cycle_id"] for r in h.cycles(peeled).collect()}
    tree = h.hierarchy(peeled)
    return found, {r["node_id"]: r for r in tree.collect()}, tree


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forest(spark, monkeypatch, seed):
    monkeypatch.setattr(h, "RESIDUAL", 40)
    monkeypatch.setattr(h, "SIBLING_BITS", 3)
    rng = random.Random(seed)
    ids = [f"n{i:03d}" for i in range(300)]
    links = [(v, rng.choice([None, "absent", "n000", rng.choice(ids[: i + 1] or ids), ids[max(0, i - 1)]])) for i, v in enumerate(ids)]
    links += [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("y", "x2"), ("z", "y"), ("self", "self")]
    paths, cyclic = brute({a: b if b in {x for x, _ in links} else "" for a, b in links})
    found, tree, df = run(spark, links)
    assert found == cyclic
    assert {k: r["path"] for k, r in tree.items()} == paths
    size = {v: sum(v in p for p in paths.values()) - 1 for v in paths}
    assert {k: r["n_descendants"] for k, r in tree.items()} == size
    assert all(r["depth"] == len(r["path"]) - 1 and r["root_id"] == r["path"][0] for r in tree.values())
    pairs = {(r["ancestor_id"], r["descendant_id"]) for r in h.descendants(df).collect()}
    assert pairs == {(a, v) for v, p in paths.items() for a in p[:-1]}


def test_chunks_and_long_chains(spark, monkeypatch):
    """Intervals cut into tiny chunks, a chain far longer than the peeling rounds, a cycle longer than any tail."""
    monkeypatch.setattr(h, "CHUNK", 8)
    monkeypatch.setattr(h, "RESIDUAL", 64)
    chain = [(f"c{i:03d}", f"c{i - 1:03d}" if i else None) for i in range(150)]
    ring = [(f"r{i:02d}", f"r{(i + 1) % 70:02d}") for i in range(70)]
    paths, cyclic = brute(dict(chain + ring))
    found, tree, _ = run(spark, chain + ring)
    assert found == cyclic and set(found.values()) == {"r00"}
    assert {k: r["path"] for k, r in tree.items()} == paths


def test_edge_cases(spark):
    links = [("a", None), ("a", None), (None, "a"), ("b", "a"), ("b", "a"), ("c", "gone")]
    found, tree, df = run(spark, links)
    assert found == {} and sorted(tree) == ["a", "b", "c"] and tree["b"]["parent_id"] == "a" and tree["c"]["parent_id"] is None
    empty = spark.createDataFrame([], SCHEMA)
    peeled = h.peel(h.encode(empty))
    assert h.cycles(peeled).collect() == [] and h.hierarchy(peeled).collect() == []


def test_hot_parent(spark, monkeypatch):
    """One parent of nearly all rows goes through the salted join."""
    monkeypatch.setattr(h, "hot_values", lambda df, key, **how: ["t\x1fhub"] if key == "link" else [])
    links = [("hub", None)] + [(f"k{i}", "hub") for i in range(200)]
    _, tree, _ = run(spark, links)
    assert tree["hub"]["n_descendants"] == 200 and all(tree[f"k{i}"]["depth"] == 1 for i in range(200))


def test_links_keeps_only_its_columns(spark):
    df = spark.createDataFrame([("x", "y", 1, "clash")], "node string, up string, seq long, tree string")
    assert h.links(df, "t", F.col("node"), F.col("up"), "seq").collect()[0].asDict() == {"tree": "t", "id": "x", "parent": "y", "order": 1}


def test_hot_pointers_are_spread(spark, monkeypatch):
    """Chains below one ancestor come to share its pointers; with a threshold of three they all go through the salts."""
    monkeypatch.setattr(h, "LEAST_HOT", 3)
    monkeypatch.setattr(h, "HOT_SHARE", 1 / 2000)
    links = [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)] + [(f"c{k}-{i:02d}", f"c{k}-{i - 1:02d}" if i else "r0") for k in range(12) for i in range(20)]
    links += [(f"d{k}-{i:02d}", f"d{k}-{i - 1:02d}" if i else None) for k in range(3) for i in range(30)]
    paths, cyclic = brute(dict(links))
    spread = []
    join = h.salted_join
    monkeypatch.setattr(h, "salted_join", lambda big, small, on, by, hot, how="left", **more: spread.append(len(hot)) or join(big, small, on, by, hot, how, **more))
    found, tree, _ = run(spark, links)
    assert found == cyclic and {k: r["path"] for k, r in tree.items()} == paths
    assert max(spread) > 1
