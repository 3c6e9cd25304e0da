"""Closed vocabularies and rules against rows that are written out here, not made from the library's own lists."""

import pytest
from pyspark.sql import functions as F

from florilege.functions import names as n
from florilege.functions import vocabulary as v

NOM = {
    "": "absent", None: "absent", " , ": "absent", ", nom. illeg.": "disqualifying", "nom. superfl.": "disqualifying", ", not validly publ.": "disqualifying", "nom. nud.": "disqualifying", "pro syn.": "disqualifying", "orth. var.": "disqualifying",
    "opus utique oppr.": "disqualifying", "without basionym ref.": "disqualifying", "no latin descr.": "disqualifying", "without type": "disqualifying", "nom. rej.": "disqualifying", "contrary to Art. 52": "disqualifying", "nom. provis.": "disqualifying",
    "nom. subnud.": "disqualifying", "comb. not made": "disqualifying", "sphalm.": "disqualifying", "nom. utique rej.": "disqualifying", "not effectively publ.": "disqualifying", "later homonym": "disqualifying", "without diagnostic descr.": "disqualifying",
    "sine descr. lat.": "disqualifying", "combination not valid": "disqualifying", "nom. cons.": "acceptable", "nom. altern.": "acceptable", "nom. alt.": "acceptable", "legitimate homonym": "acceptable", "orth. cons.": "acceptable",
    "nom. illeg.?": "unclassified", "sensu auct.": "unclassified", "tentatively listed as a synonym": "unclassified", "fossil name": "unclassified", "isonym": "unclassified", "nom. cons. prop.": "unclassified", "nom. rej. prop.": "unclassified",
    "nom. utique rej. prop.": "unclassified", "something else": "unclassified", "nom. cons., nom. illeg.": "disqualifying", "sensu auct., nom. nud.": "disqualifying", "sensu auct., nom. cons.": "unclassified", "NOM.  CONS.": "acceptable",
}
RANKS = {"species": "SPECIES", " Genus ": "GENUS", "Subspecies": "SUBSPECIES", "VARIETY": "VARIETY", "nothosubsp.": "OTHER", "proles": None, "": None, None: None, "other": "OTHER"}
LENIENT = {"nothosubsp.": "NOTHOSUBSPECIES", "nothovar.": "NOTHOVARIETY", "Nothof.": "NOTHOFORM", "proles": "OTHER", "": "OTHER", None: "OTHER", "form": "FORM", "Subform": "SUBFORM", "subvariety": "SUBVARIETY", "Family": "FAMILY"}
RELATIONS = {
    "Congruent to": ("congruent", "congruent", True), "not congruent to": ("not_congruent", "not_congruent", False), "Includes": ("includes", "included_in", False), " included in ": ("included_in", "includes", False), "overlaps": ("overlaps", "overlaps", False),
    "included in or includes or overlaps": ("includes_or_included_in_or_overlaps", "includes_or_included_in_or_overlaps", False), "is pro parte synonym for": ("pro_parte", None, False), "is misapplied name for": ("misapplied", None, False), "PRO_PARTE": ("pro_parte", None, False), "like": (None, None, None), None: (None, None, None),
}
LADDERS = {
    "Abies alba": ["exact:abies alba", "hybrid_marker_added:abies × alba"], "Salix ×alba": ["exact:salix ×alba", "hybrid_spacing:salix × alba", "hybrid_marker_dropped:salix alba"], "Mentha x piperita": ["exact:mentha x piperita", "hybrid_spacing:mentha × piperita", "hybrid_marker_dropped:mentha piperita"],
    "Rubus smithii": ["exact:rubus smithii", "hybrid_marker_added:rubus × smithii", "orthography_genitive:rubus smithi"], "Festuca ovina aggr. s. l.": ["exact:festuca ovina aggr. s. l.", "aggregate:festuca ovina aggr.", "aggregate_to_nominate:festuca ovina"],
    "Poa alpina subsp. alpina": ["exact:poa alpina subsp. alpina", "autonym:poa alpina"], "": [],
}


def asked(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "x string")


def test_nomenclatural_status(spark):
    got = {r["x"]: r["j"] for r in asked(spark, NOM).select("x", v.nom_status("x")["judgement"].alias("j")).collect()}
    assert got == NOM


def test_ranks(spark):
    assert {r["x"]: r["r"] for r in asked(spark, RANKS).select("x", v.parse_rank("x").alias("r")).collect()} == {**RANKS, "nothosubsp.": None}
    assert {r["x"]: r["r"] for r in asked(spark, LENIENT).select("x", v.parse_rank_lenient("x").alias("r")).collect()} == LENIENT
    order = ["FAMILY", "GENUS", "SPECIES", "SUBSPECIES", "NOTHOSUBSPECIES", "VARIETY", "SUBVARIETY", "NOTHOVARIETY", "FORM", "SUBFORM", "NOTHOFORM", "OTHER"]
    assert [r["x"] for r in asked(spark, order[::-1]).orderBy(v.rank_order("x")).collect()] == order


def test_relations(spark):
    r = asked(spark, RELATIONS).withColumn("r", v.parse_relation("x"))
    got = {x["x"]: (x["r"], x["i"], x["e"]) for x in r.select("x", "r", v.inverse_relation("r").alias("i"), v.is_equality("r").alias("e")).collect()}
    assert got == RELATIONS


def test_dimensions_and_vocabularies(spark):
    got = asked(spark, ["m", " S ", "Soil_Disturbance", "x", None]).select(v.parse_dimension("x")).collect()
    assert [r[0] for r in got] == ["M", "S", "soil_disturbance", None, None]
    assert [r[0] for r in asked(spark, ["EIVE", "tichy2023", " Midolo2023", "tichy", None]).select(v.parse_vocabulary("x")).collect()] == ["eive", "tichy2023", "midolo2023", None, None]


def test_ladders(spark):
    got = {r["x"]: [f"{k['rule']}:{k['key']}" for k in r["l"]] for r in asked(spark, LADDERS).select("x", n.ladder("x").alias("l")).collect()}
    assert got == LADDERS


@pytest.mark.parametrize("a, b, same", [("abc", "abc", 1.0), ("", "", 1.0), ("", "a", 0.0), ("ä", "a", 0.0), ("abcd", "abce", 0.75)])
def test_similarity(spark, a, b, same):
    assert spark.range(1).select(n.similarity(F.lit(a), F.lit(b))).first()[0] == same


def test_fold(spark):
    got = {r["x"]: r["c"] for r in asked(spark, ["  Ärva  BÖ ", "ßłøđ", "Wéingaertneria", None, ""]).select("x", n.canonicalize("x").alias("c")).collect()}
    assert got == {"  Ärva  BÖ ": "arva bo", "ßłøđ": "ßłøđ", "Wéingaertneria": "weingaertneria", None: None, "": ""}
