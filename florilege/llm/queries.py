"""Queries of the problems on training data and their SQL, over the whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.functions.text import BLANKS, key
from florilege.llm import groups, lookalikes, mixing, name_mapping, packing, reading, tokens
from florilege.session import cut
from florilege.skew import hot_values, salted_join


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- 1: free-entered names ----------------------------------------------------------------------------------------------


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    parts = [_table(spark, sf, t).select(F.lit(t).alias("src"), "row_seq", F.col("taxon").alias("value")) for t in ("eive_sample", "floraveg_sample")]
    return reduce(DataFrame.unionByName, parts).where(F.btrim("value", F.lit(BLANKS)) != "")


def _mapped(spark: SparkSession, sf: str) -> DataFrame:
    """(src, row_seq, value, ref_id) of each row whose value is not blank and not exactly a name of the list."""
    rows, refs = _typed(spark, sf), _table(spark, sf, "taxon_list")
    values = rows.select("value").distinct().join(refs.select(F.col("name").alias("value")), "value", "left_anti")
    return salted_join(rows, name_mapping.map_values(values, refs), "value", F.col("row_seq"), hot_values(rows, "value"), "inner")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mapped(spark, sf).select("src", "row_seq", "ref_id")


def p1_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """(src, value, n_rows): the values that stand for no entry."""
    return _mapped(spark, sf).where("ref_id = 0").groupBy("src", "value").agg(F.count(F.lit(1)).alias("n_rows"))


# --- 3: groups of congruent concepts ------------------------------------------------------------------------------------


def _congruent(spark: SparkSession, sf: str) -> DataFrame:
    relations = _table(spark, sf, "cdm_relations_fixture")
    same = relations.where(key("relation_type", lower=True).isin("congruent to", "congruent"))
    return same.select(key("from_uuid", lower=True).alias("a"), key("to_uuid", lower=True).alias("b"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    labels = groups.components(_congruent(spark, sf))
    return labels.select(F.col("vertex").alias("concept_uuid"), F.col("component").alias("group_uuid"))


def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    """(concept_uuid, group_uuid) of every concept and every end of an edge; one without a partner is its own group."""
    found = p3_found(spark, sf)
    concepts = _table(spark, sf, "cdm_concepts_fixture").select(key("concept_uuid", lower=True).alias("concept_uuid"))
    relations = _table(spark, sf, "cdm_relations_fixture")
    ends = relations.select(F.explode(F.array(key("from_uuid", lower=True), key("to_uuid", lower=True))).alias("concept_uuid"))
    every = concepts.unionByName(ends).where("concept_uuid is not null").distinct()
    return every.join(found, "concept_uuid", "left").select("concept_uuid", F.coalesce("group_uuid", "concept_uuid").alias("group_uuid"))


# --- 5: names that look the same ----------------------------------------------------------------------------------------


def _names(spark: SparkSession, sf: str) -> DataFrame:
    taxa = _table(spark, sf, "wcvp_taxon")
    return taxa.select(key("taxonid").alias("id"), F.col("scientfiicname").alias("name"), F.col("scientfiicnameauthorship").alias("author"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    names = _names(spark, sf)
    written = cut(lookalikes.classes(names))
    found = lookalikes.pairs(written, cut(lookalikes.members(names, written)))
    return found.select(F.col("a").alias("taxonid_a"), F.col("b").alias("taxonid_b"))


def p5_classes(spark: SparkSession, sf: str) -> DataFrame:
    """(taxonid, skeleton, variant, n_members, n_variants, n_links): each taxon whose name is written in several ways that look
    the same, with the size of its class and how many others of it are written differently."""
    names = _names(spark, sf)
    member = cut(lookalikes.members(names, lookalikes.classes(names)))
    return lookalikes.linked(member).select(F.col("id").alias("taxonid"), "skeleton", "variant", "n_members", "n_variants", "n_links")


# --- 7: packing -----------------------------------------------------------------------------------------------------------


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    return cut(tokens.sized(_table(spark, sf, "documents"), ["doc_id", "source"]))


def p7_pack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_sizes(spark, sf), _table(spark, sf, "pack_capacities"))


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return packing.report(p7_pack(spark, sf), _table(spark, sf, "pack_capacities"))


def p7_check(spark: SparkSession, sf: str) -> DataFrame:
    """(run_name, capacity, over_full, cut_without_need, pieces_out_of_place, texts_lost): one row a run, counts of what must not
    be, all 0: documents come back from their pieces."""
    sizes, runs = _sizes(spark, sf), _table(spark, sf, "pack_capacities")
    return packing.verify(packing.pack(sizes, runs), sizes, runs)


# --- 8: mixing ------------------------------------------------------------------------------------------------------------


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    sizes = _sizes(spark, sf)
    return mixing.mix(sizes, mixing.plan(sizes, _table(spark, sf, "mix_targets")))


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    sizes, targets = _sizes(spark, sf), _table(spark, sf, "mix_targets")
    return mixing.report(sizes, mixing.mix(sizes, mixing.plan(sizes, targets)), targets)


def p8_check(spark: SparkSession, sf: str) -> DataFrame:
    """(source, in_target, n_documents, over_repeats, uneven, off_target): one row a source, in SQL's terms where SQL can say
    them: how many documents it has, and whether anything about its part is not as it must be."""
    sizes, targets = _sizes(spark, sf), _table(spark, sf, "mix_targets")
    return mixing.verify(sizes, mixing.mix(sizes, mixing.plan(sizes, targets)), targets)


# --- 9: reading level -----------------------------------------------------------------------------------------------------


def p9_levels(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, source, n_words, score, level) of every document."""
    return reading.levels(_table(spark, sf, "documents"), _table(spark, sf, "reading_labels"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_levels(spark, sf).where("level = 5").select("doc_id")


def p9_profile(spark: SparkSession, sf: str) -> DataFrame:
    """(source, level, n_documents, n_words): how demanding each source's text is."""
    return p9_levels(spark, sf).groupBy("source", "level").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_words").alias("n_words"))


def p9_cross_validation(spark: SparkSession, sf: str) -> DataFrame:
    """(source, n, exact, off): labelled documents by source, the share graded exactly and the mean error, by models and cuts that had not seen the source."""
    measured = cut(reading.features(_table(spark, sf, "documents")))
    rows = reading.training_rows(measured, _table(spark, sf, "reading_labels"))
    grades = reading.validate(rows)
    table = rows.assign(exact=grades == rows["level"].to_numpy(), off=abs(grades - rows["level"])).groupby("source", dropna=False).agg(n=("level", "size"), exact=("exact", "mean"), off=("off", "mean"))
    return spark.createDataFrame(table.reset_index(), "source string, n long, exact double, off double")


QUERIES = {f.__name__: f for f in (
    p1_found, p1_unmatched, p3_found, p3_groups, p5_found, p5_classes, p7_pack, p7_report, p7_check, p8_mix, p8_report, p8_check, p9_found, p9_levels, p9_profile, p9_cross_validation,
)}

_CONGRUENT = """
e AS (
  SELECT DISTINCT lower(trim(from_uuid)) AS a, lower(trim(to_uuid)) AS b FROM cdm_relations_fixture
  WHERE lower(trim(relation_type)) IN ('congruent to', 'congruent') AND trim(from_uuid) <> '' AND trim(to_uuid) <> '' AND lower(trim(from_uuid)) <> lower(trim(to_uuid))
),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS v, a AS w FROM s UNION SELECT r.v, s.b FROM reach r JOIN s ON s.a = r.w)"""

ORACLE = {
    "p3_found": f"WITH RECURSIVE {_CONGRUENT} SELECT v AS concept_uuid, min(w) AS group_uuid FROM reach GROUP BY v",
    "p3_groups": f"""WITH RECURSIVE {_CONGRUENT},
found AS (SELECT v, min(w) AS g FROM reach GROUP BY v),
every AS (SELECT lower(trim(concept_uuid)) AS u FROM cdm_concepts_fixture UNION SELECT lower(trim(from_uuid)) FROM cdm_relations_fixture UNION SELECT lower(trim(to_uuid)) FROM cdm_relations_fixture)
SELECT u AS concept_uuid, coalesce(g, u) AS group_uuid FROM every LEFT JOIN found ON v = u WHERE u <> ''""",
    # What holds of any right packing or mix: no container over its capacity, no document lost or cut without need, no source
    # used more often than it may be, none off its share by more than its largest document.
    "p7_check": "SELECT DISTINCT run_name, capacity_tokens AS capacity, 0 AS over_full, 0 AS cut_without_need, 0 AS pieces_out_of_place, 0 AS texts_lost FROM pack_capacities WHERE run_name IS NOT NULL AND capacity_tokens > 0",
    "p8_check": """SELECT d.source, t.source IS NOT NULL AS in_target, d.n AS n_documents, 0 AS over_repeats, 0 AS uneven, 0 AS off_target FROM (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1) d
LEFT JOIN (SELECT DISTINCT source FROM mix_targets WHERE target_share > 0) t ON t.source = d.source""",
}
