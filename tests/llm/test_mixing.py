import random

from florilege.llm import mixing as m


def tables(spark, docs, targets):
    return spark.createDataFrame(docs, "doc_id long, source string, n_tokens long, copies string"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_shares(spark):
    rng = random.Random(1)
    docs = [(i, rng.choice(["a", "a", "a", "b", "c", None, "untargeted"]), rng.randint(0, 400), "clash") for i in range(4000)]
    sizes, targets = tables(spark, docs, [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.15, 2), ("absent", 0.05, 4), (None, 0.1, 1)])
    parts = m.plan(sizes, targets)
    mixed = m.mix(sizes, parts)
    copies = {r["doc_id"]: r["copies"] for r in mixed.collect()}
    tokens = {}
    for i, s, n, _ in docs:
        tokens[s] = tokens.get(s, 0) + n * copies.get(i, 0)
    have = {s: sum(n for _, x, n, _ in docs if x == s) for s in "abc"}
    size = min(1 * have["a"] / 0.5, 3 * have["b"] / 0.3, 2 * have["c"] / 0.15)
    for s, share, most in (("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.15, 2)):
        assert abs(tokens[s] - share * size) <= 400
        assert max(copies.get(i, 0) for i, x, _, _ in docs if x == s) <= most
        # A source is used in whole rounds, plus once more for a part of it.
        assert max(copies.get(i, 0) for i, x, _, _ in docs if x == s) - min(copies.get(i, 0) for i, x, _, _ in docs if x == s) <= 1
    assert tokens[None] == 0 and tokens["untargeted"] == 0
    rep = {r["source"]: r for r in m.report(sizes, mixed, targets).collect()}
    total = sum(tokens.values())
    assert rep["absent"]["used_tokens"] == 0 and rep["a"]["used_tokens"] == tokens["a"] and abs(rep["b"]["actual_share"] - tokens["b"] / total) < 1e-12
    assert rep["untargeted"]["target_share"] is None and rep["untargeted"]["actual_share"] == 0


def test_budget_and_refinement(spark, monkeypatch):
    """A budget below the most that is possible; buckets of two bits make every level refine."""
    monkeypatch.setattr(m, "BITS", 2)
    monkeypatch.setattr(m, "LEVELS", 12)
    docs = [(i, "a", 10, "") for i in range(1000)] + [(i, "b", 10, "") for i in range(1000, 2000)]
    sizes, targets = tables(spark, docs, [("a", 0.25, 1), ("b", 0.75, 1)])
    got = {}
    for r in m.mix(sizes, m.plan(sizes, targets, total=4000)).collect():
        got[r["source"]] = got.get(r["source"], 0) + r["n_tokens"] * r["copies"]
    assert abs(got["a"] - 1000) <= 10 and abs(got["b"] - 3000) <= 10


def test_one_source_of_everything_and_nothing(spark):
    sizes, targets = tables(spark, [(1, "a", 5, ""), (2, "a", 7, ""), (2, "a", 7, "")], [("a", 1.0, 2)])
    assert sorted(r["copies"] for r in m.mix(sizes, m.plan(sizes, targets)).collect()) == [2, 2, 2]
    for s, t in ((sizes.where("false"), targets), (sizes, targets.where("false"))):
        mixed = m.mix(s, m.plan(s, t))
        assert mixed.collect() == []
        assert all(r["used_tokens"] == 0 for r in m.report(s, mixed, t).collect())


def test_verify_finds_what_is_wrong(spark):
    docs = [(i, "a" if i % 2 else "b", 10, "") for i in range(100)] + [(200, "c", 10, "")]
    sizes, targets = tables(spark, docs, [("a", 0.5, 1), ("b", 0.5, 2)])
    mixed = m.mix(sizes, m.plan(sizes, targets))
    assert all((r["over_repeats"], r["uneven"], r["off_target"]) == (0, 0, 0) for r in m.verify(sizes, mixed, targets).collect())
    half = mixed.where("source = 'a' and doc_id < 50").unionByName(mixed.where("source = 'b'").selectExpr("doc_id", "source", "n_tokens", "3 AS copies")).unionByName(sizes.where("source = 'c'").selectExpr("doc_id", "source", "n_tokens", "1 AS copies"))
    got = {r["source"]: (r["over_repeats"], r["uneven"], r["off_target"]) for r in m.verify(sizes, half, targets).collect()}
    assert got["a"] == (0, 0, 1) and got["b"] == (50, 0, 1) and got["c"] == (1, 1, 0)
