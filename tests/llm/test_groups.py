import random

import pytest

from florilege.llm import groups as g


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            parent[find(a)] = find(b)
    least = {}
    for x in list(parent):
        least[find(x)] = min(x, least.get(find(x), x))
    return {x: least[find(x)] for x in parent}


def run(spark, edges):
    df = spark.createDataFrame([(a, b, "clash") for a, b in edges], "a string, b string, x string")
    return {r["vertex"]: r["component"] for r in g.components(df).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random(spark, seed):
    rng = random.Random(seed)
    edges = [(f"v{rng.randrange(200):03d}", f"v{rng.randrange(200):03d}") for _ in range(90 + 40 * seed)]
    assert run(spark, edges) == brute(edges)


def test_star_with_long_tail_and_chains(spark):
    star = [("hub", f"s{i:03d}") for i in range(60)]
    tail = [(f"t{i:03d}", f"t{i + 1:03d}") for i in range(200)] + [("s000", "t000")]
    chains = [(f"c{k}-{i:02d}", f"c{k}-{i + 1:02d}") for k in range(5) for i in range(30)]
    edges = star + tail + chains
    assert run(spark, edges) == brute(edges)


def test_edges_of_all_kinds(spark):
    edges = [("a", "b"), ("b", "a"), ("a", "b"), ("c", "c"), (None, "a"), ("d", None)]
    assert run(spark, edges) == {"a": "a", "b": "a"}
    assert run(spark, []) == {} and run(spark, [("x", "x")]) == {}


def test_hot_vertices_are_spread(spark, monkeypatch):
    """With every vertex of three links hot, all joins go through their salts."""
    monkeypatch.setattr(g, "LEAST_HOT", 3)
    monkeypatch.setattr(g, "HOT_SHARE", 1 / 2000)
    edges = [("hub", f"s{i:03d}") for i in range(120)] + [("zhub", f"s{i:03d}") for i in range(60)] + [(f"t{i:03d}", f"t{i + 1:03d}") for i in range(60)] + [("s000", "t000")]
    spread = []
    join = g.salted_join
    monkeypatch.setattr(g, "salted_join", lambda big, small, on, by, hot, how, nulls: spread.append(len(hot)) or join(big, small, on, by, hot, how, nulls))
    assert run(spark, edges) == brute(edges)
    assert sum(k > 0 for k in spread) > len(spread) // 2
