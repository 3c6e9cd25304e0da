"""The ten rule sets against a walk of each ladder, and the links that bridge to the index."""

from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as entry
from florilege.functions import names as n
from florilege.operators import ingest as g
from florilege.plans import index as ix
from florilege.plans.analyses import _TEN


def ladders(df):
    return {r["f"]: [(x["key"], x["rule"]) for x in r["l"]] for r in df.select("f", n.ladder("f").alias("l")).distinct().collect()}


def test_ten_sets(spark, small):
    targets = {r["canonical_fold"]: r["n"] for r in g.lookup(ix.index(spark, small)).groupBy("canonical_fold").agg(F.count_distinct("concept_id").alias("n")).collect()}
    rows = [r["f"] for r in ix.name_rows(spark, small).select(n.canonicalize("taxon").alias("f")).collect()]
    ladder = ladders(spark.createDataFrame([(f,) for f in set(rows)], "f string"))
    got = {r["rules"]: r for r in entry.queries()["rule_ablation"](spark, small).collect()}
    assert list(_TEN)[0] == "exact" and len(got) == 10
    for rules, more in _TEN.items():
        count = lambda k: "unmatched" if k is None else "matched" if k == 1 else "ambiguous"
        of = {f: count(next((targets[key] for key, rule in ladder[f] if rule in ("exact", *more) and key in targets), None)) for f in ladder}
        for x, counted in (("rows", Counter(of[f] for f in rows)), ("taxa", Counter(of.values()))):
            for o in ("matched", "unmatched", "ambiguous"):
                assert got[rules][f"{x}_{o}"] == counted[o]
                assert got[rules][f"{x}_{o}_delta"] == counted[o] - got["exact"][f"{x}_{o}"]
    assert got["all"]["rows_matched_delta"] > 0


def test_bridge_links(spark, small):
    known = {r["canonical_fold"] for r in g.lookup(ix.index(spark, small)).select("canonical_fold").distinct().collect()} - {""}
    asked = {r["f"] for r in ix.traits_rows(spark, small).select(n.canonicalize("taxon").alias("f")).collect()}
    pairs = ix.name_rows(spark, small).orderBy("seq").select(n.canonicalize("taxon").alias("f"), n.canonicalize(F.coalesce("accepted_taxon", F.lit(""))).alias("a")).collect()
    links = {r["f"]: r["a"] for r in pairs}
    ladder = ladders(spark.createDataFrame([(f,) for f in asked | set(links.values())], "f string"))
    got = {r["step"]: (r["unresolved"], r["recovered"], r["bridgeable"]) for r in entry.queries()["bridge_links"](spark, small).collect()}
    for step, ok in (("exact", lambda f: f in known), ("ladder", lambda f: any(key in known for key, _ in ladder[f]))):
        missing = {f for f in asked if not ok(f)}
        assert got[step] == (len(missing), len(missing & set(links)), sum(f in links and ok(links[f]) for f in missing))
