import random

import pytest

from florilege.llm import name_mapping as m

LIST = [(1, "Kortania bellensis", "Mill.", "Species"), (2, "Kortania bellensis subsp. morana", "Mill.", "Subspecies"), (3, "Kortania × hybrida", "L.", "Species"), (4, "Zelmora vanifolia", "Röth", "Species"), (5, "Zelmora vanifolium", "Abc.", "Species"), (6, "Ulbria tarsoides", "L.", "Species")]
CASES = {
    "  kortania  BELLENSIS": 1, "Kortania bellensis Mill. 1834": 1, "Kortania bellenssi": 1, "K. bellensis": 1, "bellensis, Kortania": 1, "Kortania bellensis agg.": 1, "Kortania bellensis s. l. !": 1, "Kortania bellensis auct. non L.": 1,
    "Kortania_bellensis [det. 2011]": 1, "Kortania (K.) bellensis": 1, "Kortania bellensis ssp morana": 2, "Kortania bellensis morana": 2, "Kortania bellensis subsp. zzzzzzz": 0, "kortania x hybrida": 3, "Kortania hybridus": 3, "Zelmora vanifolia": 4, "zelmora vanifolium": 5,
    "Ulbria tarsoïdes": 6, "U1bria tarsoides": 6, "Ulbria": 0, "Ulbria sp.": 0, "Ulbria species 2": 0, "bare ground": 0, "?": 0, "Zelmora tarsoides": 0, "": 0, "   ": 0, "x" * 100_000: 0, "kortania bellensis röth": 1,
}


def run(spark, values, **how):
    v = spark.createDataFrame([(x,) for x in values], "value string")
    refs = spark.createDataFrame([(*x, "clash") for x in [*LIST, LIST[0]]], "ref_id long, name string, authorship string, rank string, value string")
    return {r["value"]: r["ref_id"] for r in m.map_values(v, refs, **how).collect()}


def test_cases(spark):
    assert run(spark, list(CASES)) == CASES


def test_shards_give_the_same(spark):
    assert run(spark, list(CASES), broadcast_entries=2) == CASES


def test_null_and_empty(spark):
    assert run(spark, [None]) == {None: 0} and run(spark, []) == {}
    v = spark.createDataFrame([("a b",)], "value string")
    none = spark.createDataFrame([], "ref_id long, name string, authorship string")
    assert m.map_values(v, none).collect()[0]["ref_id"] == 0


@pytest.mark.parametrize("limit", [0, 1, 2, 3])
def test_tree_returns_every_entry_within(limit):
    rng = random.Random(limit)
    word = lambda: "".join(rng.choice("abcx ") for _ in range(rng.randint(0, 9)))
    names = list(dict.fromkeys([word() for _ in range(300)] + ["y" * 70, "y" * 69 + "z", ""]))
    asked = [word() for _ in range(100)] + ["y" * 70, "q" * 200, ""]
    tree = m.BKTree(names)
    want = [sorted((d, i) for i, n in enumerate(names) if (d := m.plain_distance(a, n)) <= limit) for a in asked]
    assert [sorted(x) for x in tree.within(asked, limit)] == want
    assert m.BKTree([]).within(["a"], 2) == [[]]


def test_asking_in_two_steps_gives_the_winners_of_asking_at_once(monkeypatch):
    """Every candidate within the threshold scored, against radius 0 first."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abeios") for _ in range(rng.randint(3, 7)))
    entries = [(i, f"{word().capitalize()} {word()}" + (f" var. {word()}" if i % 5 == 0 else ""), None) for i in range(200)]
    index = m.Index(entries)
    spoil = lambda x: "".join(rng.choice("abeios") if rng.random() < 0.08 else c for c in x)
    values = [f(e[1]) for e in entries for f in (str, str.upper, spoil, lambda x: x[0] + ". " + x.split(" ", 1)[1])]
    got = index.best(values)
    whole = []
    for v in values:
        scores = {}
        for r in m.readings(v, index.vocabulary):
            tree = index.epithets if r.abbreviated else index.full
            index._score(scores, r, [(d, j) for j, name in enumerate(tree.names) if (d := m.plain_distance(r.key, name)) <= m.THRESHOLD])
        low = min(scores.values(), default=None)
        whole.append([(low, index.ids[j]) for j in sorted(j for j, x in scores.items() if x == low)[:2]] if scores else [])
    assert got == whole
