"""Requests that are refused before anything runs, and those about what does not exist."""

import pytest

from florilege.operators import lookup as lk
from florilege.operators import match as m
from florilege.operators import suggest as sg
from florilege.plans import index as ix


@pytest.fixture(scope="module")
def index(spark, small):
    return ix.index(spark, small)


def test_synonym_lists(spark, index):
    asked = index.concept_name.where("role = 'synonym'").groupBy("concept_id").count().orderBy("count", ascending=False).limit(1).selectExpr("concept_id AS id")
    every = lk.synonym_list(index, asked).collect()
    assert every[0]["total"] == len(every) and [r["position"] for r in sorted(every, key=lambda r: r["position"])] == list(range(1, len(every) + 1))
    one = lk.synonym_list(index, asked, most=1).collect()
    assert len(one) == 1 and one[0]["truncated"] == len(every) - 1 and one[0]["total"] == len(every)
    unknown = lk.synonym_list(index, spark.createDataFrame([("no:concept",)], "id string")).collect()
    assert [(r["found"], r["name_id"], r["total"]) for r in unknown] == [(False, None, 0)]
    for wrong in ({"relevance": "some"}, {"rank": "genus"}, {"most": -1}, {"most": 2001}):
        with pytest.raises(ValueError):
            lk.synonym_list(index, asked, **wrong)


def test_translation(spark, small, index):
    secs, edges, lookup = ix.secs(spark, small), ix.edges(spark, small), ix.lookup(spark, small)
    one = index.concept.where("backbone_id = 'cdm'").select("id").limit(1)
    with pytest.raises(ValueError, match="unknown reference"):
        lk.translate(index, edges, secs, one.selectExpr("id", "'nowhere' AS target_sec"))
    with pytest.raises(ValueError, match="one hop"):
        lk.translate(index, edges, secs, one.selectExpr("id", "'x' AS target_sec"), max_hops=2)
    sec = secs.first()["id"]
    asked = spark.createDataFrame([(1, "no such name at all", sec), (2, None, sec)], "rid int, verbatim string, target_sec string")
    got = lk.translate_verbatim(index, lookup, edges, secs, asked).collect()
    assert sorted((r["rid"], r["match_type"], r["id"], r["requires_review"]) for r in got) == [(1, "unresolvable", None, True), (2, "unresolvable", None, True)]


def test_narrowed_and_spaces(spark, small, index):
    lookup = ix.lookup(spark, small)
    assert {r[0] for r in m.narrowed(lookup, "list").select("backbone_id").distinct().collect()} == {"list"}
    for wrong in (("nowhere", None), (None, "nowhere")):
        with pytest.raises(ValueError):
            m.narrowed(lookup, *wrong)
    with pytest.raises(ValueError, match="unknown name space"):
        m.spellings(ix.space_entries(spark, small), "nowhere")


def test_suggestions(spark, small, index):
    rows, effective = ix.search_rows(spark, small), ix.closure(spark, small)
    asked = spark.createDataFrame([(1, "so"), (2, "x"), (3, "..."), (4, "")], "qid int, q string")
    got = sg.suggest(rows, asked, index, effective, limit=100).collect()
    assert {r["qid"] for r in got} == {1} and max(r["position"] for r in got) <= sg.MOST_LIMIT
    for wrong in ({"ranks": ("TRIBE",)}, {"backbone": "nowhere"}):
        with pytest.raises(ValueError):
            sg.suggest(rows, asked, index, effective, **wrong)


def test_pool(spark, monkeypatch):
    """More rows than the pool holds: ranked in parts, then together, ties by row id."""
    rows = [("q", f"r{i:03d}", float(i % 7), 60) for i in range(60)] + [("few", "r1", 0.5, 1)]
    df = spark.createDataFrame(rows, "qid string, rowid string, score double, n int")
    got = {(r["qid"], r["rowid"]) for r in sg.pool_of(df, 10).collect()}
    assert got == {("few", "r1"), *[("q", r[1]) for r in sorted(rows[:60], key=lambda r: (r[2], r[1]))[:10]]}


def test_many_queries_are_joined(spark, small, monkeypatch):
    rows = ix.search_rows(spark, small)
    asked = spark.createDataFrame([(1, "so"), (2, "ca")], "qid int, q string")
    want = {(r["qid"], r["rowid"], round(r["score"], 9)) for r in sg.matches(rows, asked).collect()}
    monkeypatch.setattr(sg, "BROADCAST_QUERIES", 1)
    assert {(r["qid"], r["rowid"], round(r["score"], 9)) for r in sg.matches(rows, asked).collect()} == want and want
