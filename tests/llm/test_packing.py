import random

import pytest

from florilege.llm import packing as p


def slow(sizes, capacity):
    """Sum of squares by trying every level, without arrays and without the final merge."""
    bins, out = [], []
    for s in sizes:
        def cost(level):
            after = [b for b in bins]
            if level:
                after.remove(level)
            after.append(level + s)
            return sum(after.count(h) ** 2 for h in range(1, capacity))

        level = min(sorted({0, *[b for b in bins if 0 < b <= capacity - s]}, reverse=True), key=cost)
        if level:
            bins.remove(level)
        bins.append(level + s)
        out.append(level)
    return out


def levels(sizes, capacity, monkeypatch):
    """The level at which each item was placed, by replaying the containers before the final merge."""
    monkeypatch.setattr(p.bisect, "bisect_left", lambda room, key: len(room))
    fill, out = {}, []
    for s, c in zip(sizes, p.place(sizes, capacity)):
        out.append(fill.get(c, 0))
        fill[c] = fill.get(c, 0) + s
    return out


@pytest.mark.parametrize("seed", range(5))
def test_rule(monkeypatch, seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 12) for _ in range(60)]
    assert levels(sizes, 12, monkeypatch) == slow(sizes, 12)


@pytest.mark.parametrize("capacity", [1, 7, 100, 2048])
def test_no_container_overflows(capacity):
    rng = random.Random(capacity)
    sizes = [rng.randint(1, capacity) for _ in range(3000)]
    fill = {}
    for s, c in zip(sizes, p.place(sizes, capacity)):
        fill[c] = fill.get(c, 0) + s
    assert max(fill.values()) <= capacity and sum(fill.values()) == sum(sizes)
    assert len(fill) <= 1.25 * -(-sum(sizes) // capacity) + 2


def test_pack(spark):
    sizes = [(i, (i * 37) % 230, "clash") for i in range(500)] + [(1000, 0, ""), (1001, 5000, ""), (1002, 100, ""), (1003, 100, "")]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long, run_name string")
    runs = spark.createDataFrame([("a", 100), ("b", 1000), ("bad", 0), (None, 5), ("a", 100)], "run_name string, capacity_tokens int")
    rows = p.pack(df, runs, stream_items=100).collect()
    assert {r["run_name"] for r in rows} == {"a", "b"}
    for run, capacity in (("a", 100), ("b", 1000)):
        mine = [r for r in rows if r["run_name"] == run]
        fill, parts = {}, {}
        for r in mine:
            if r["container"] is not None:
                fill[r["container"]] = fill.get(r["container"], 0) + r["length"]
            parts.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
        assert max(fill.values()) <= capacity
        for doc, n, _ in sizes:
            pieces = sorted(parts[doc])
            assert sum(x[2] for x in pieces) == n and [x[0] for x in pieces] == list(range(len(pieces)))
            assert [x[1] for x in pieces] == [i * capacity for i in range(len(pieces))]
            assert len(pieces) == max(1, -(-n // capacity))
    rep = {r["run_name"]: r for r in p.report(spark.createDataFrame(rows), runs).collect()}
    assert rep["b"]["n_tokens"] == sum(n for _, n, _ in sizes) and rep["b"]["fill"] > 0.9
    assert p.pack(df.where("false"), runs).collect() == [] and p.pack(df, runs.where("false")).collect() == []


def test_verify_finds_what_is_wrong(spark):
    sizes = spark.createDataFrame([(1, 5), (2, 9), (3, 0), (4, 4)], "doc_id long, n_tokens long")
    runs = spark.createDataFrame([("r", 6)], "run_name string, capacity_tokens int")
    good = p.pack(sizes, runs)
    right = {r["run_name"]: r.asDict() for r in p.verify(good, sizes, runs).collect()}["r"]
    assert right == {"run_name": "r", "capacity": 6, "over_full": 0, "cut_without_need": 0, "pieces_out_of_place": 0, "texts_lost": 0}
    schema = good.schema
    bad = spark.createDataFrame([("r", 0, 1, 0, 0, 5), ("r", 0, 4, 0, 0, 2), ("r", 1, 4, 1, 3, 2), ("r", 2, 2, 0, 0, 6)], schema)
    wrong = p.verify(bad, sizes, runs).collect()[0]
    assert (wrong["over_full"], wrong["cut_without_need"], wrong["pieces_out_of_place"], wrong["texts_lost"]) == (1, 1, 1, 2)
