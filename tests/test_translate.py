"""Translation into every reference: no statement between known concepts may be lost."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from florilege.operators import lookup as lk
from florilege.plans import index as ix


def test_every_statement_comes_out(spark, small):
    concepts = ix.index(spark, small).concept.where("backbone_id = 'cdm'").select("id", "sec_reference").collect()
    sec = {r["id"]: r["sec_reference"] for r in concepts}
    want = sorted((r["id"], sec[r["partner"]], r["partner"], r["relation"], r["outgoing"]) for r in lk.both_ways(ix.edges(spark, small)).collect() if r["id"] in sec and sec.get(r["partner"]))
    rows = entry.queries()["translate_all"](spark, small).collect()
    assert sorted((r["id"], r["target_sec"], r["partner"], r["relation"], r["outgoing"]) for r in rows if r["partner"]) == want
    assert len({r["target_sec"] for r in rows if r["partner"]}) > 1
    secs = {r["id"] for r in ix.secs(spark, small).collect()}
    assert {(r["id"], r["target_sec"]) for r in rows} == {(c, t) for c in sec for t in secs}


def test_names_are_asked_into_every_reference(spark, small):
    i = ix.index(spark, small)
    fold = {r["id"]: r["canonical_fold"] for r in i.name.select("id", "canonical_fold").collect()}
    concepts = {r["id"]: r for r in i.concept.where(F.col("backbone_id") == "cdm").collect()}
    bears = {(r["concept_id"], fold[r["name_id"]]) for r in i.concept_name.collect() if r["concept_id"] in concepts}
    secs = {r["id"] for r in ix.secs(spark, small).collect()}
    want = {(a, concepts[c]["sec_reference"], c) for a in concepts for c, f in bears if c != a and f and f == fold[concepts[a]["accepted_name"]] and concepts[c]["sec_reference"] in secs}
    got = {(r["id"], r["target_sec"], r["candidate"]) for r in entry.queries()["translate_by_name"](spark, small).collect()}
    assert got == want and len({t for _, t, _ in want}) > 1
