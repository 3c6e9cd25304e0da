"""Files written from the test tables, read by their layouts, and loaded into a store by a manifest."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.functions import names as n
from florilege.operators.load import load
from florilege.operators.store import Store
from florilege.plans import index as ix
from florilege.plans import sql as s
from florilege.plans.reference import _ENTRIES, _WON
from florilege.plans.registry import Registry
from florilege.session import shared_folder
from florilege.sources import delimited as d
from florilege.sources import manifest as mf

registry = Registry()
query, QUERIES, ORACLE = registry.query, registry.queries, registry.oracles

#: Which table each layout's test file is written from.
TABLES = {"taxa": "wcvp_taxon", "distribution": "wcvp_distribution", "traits": "eive_sample", "names": "floraveg_sample", "concepts": "cdm_concepts_fixture", "relations": "cdm_relations_fixture"}


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/florilege-{spark.sparkContext.applicationId}/files-{uuid.uuid4().hex}"


def _written(spark: SparkSession, rows: DataFrame, layout: d.Layout, order: str) -> str:
    """The rows as files of the layout, a header in each, in the order of a column."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cells = [(text(c) if layout.quoted else F.coalesce(n.clean_field(c), F.lit(""))).alias(c) for c in layout.columns]
    path = _folder(spark)
    options = {"sep": "|", "header": "true", "quote": '"' if layout.quoted else "", "escape": '"' if layout.quoted else "", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    rows.sort(order).select(*cells).write.options(**options).csv(path)
    return path


def _of(spark: SparkSession, sf: str, name: str) -> tuple[str, d.Layout]:
    layout = {x.name: x for x in (d.TAXA, d.DISTRIBUTION, d.REPLACEMENTS, d.TRAITS, d.XREFS, d.NAMES, d.CONCEPTS, d.RELATIONS)}[name]
    if name == "replacements":
        t = ix.table(spark, sf, "wcvp_taxon")
        rows = t.select("taxonid", F.col("acceptednameusageid").alias("relatednameusageid"), F.lit("Replaced").alias("relationtype"), F.lit("").alias("remarks"), "row_seq")
    elif name == "xrefs":
        rows = ix.xref_rows(spark, sf).withColumn("wikidata_qid", F.lit("")).withColumn("row_seq", F.col("join_id"))
    else:
        rows = ix.table(spark, sf, TABLES[name])
    return _written(spark, rows, layout, "row_seq"), layout


def _read(name: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        path, layout = _of(spark, sf, name)
        return d.read(spark, path, layout).rows.drop("seq")

    columns = {x.name: x.columns for x in (d.TAXA, d.DISTRIBUTION, d.REPLACEMENTS, d.TRAITS, d.NAMES, d.CONCEPTS, d.RELATIONS)}.get(name, ())
    clean = lambda c: f"""nullif(trim({c}), '') AS {c}"""
    field = lambda c: f"""nullif(trim(translate("{c}", chr(13) || chr(10) || '|', '  /'), ' '), '') AS "{c}\""""
    table = TABLES.get(name)
    oracle = {
        "taxa": f"SELECT * FROM (SELECT {', '.join(map(field, columns))} FROM wcvp_taxon) WHERE dynamicproperties IS NULL OR json_valid(dynamicproperties)",
        "distribution": f"SELECT {', '.join(map(field, columns))} FROM wcvp_distribution",
        "replacements": "SELECT nullif(trim(taxonid), '') AS taxonid, nullif(trim(acceptednameusageid), '') AS relatednameusageid, 'Replaced' AS relationtype, NULL AS remarks FROM wcvp_taxon",
        "traits": "SELECT nullif(trim(taxon), '') AS taxon, nullif(trim(vocab), '') AS vocab, nullif(trim(vocab_version), '') AS vocab_version, nullif(trim(dim), '') AS dim, value, niche_width, n_systems::DOUBLE AS n_systems FROM eive_sample WHERE value IS NOT NULL",
        "names": f"SELECT {', '.join(map(clean, columns))} FROM floraveg_sample WHERE trim(taxon) <> '' AND trim(source_id) <> ''",
        "concepts": f"SELECT {', '.join(map(clean, columns))} FROM {table}",
        "relations": "SELECT nullif(trim(from_uuid), '') AS from_uuid, nullif(trim(to_uuid), '') AS to_uuid, nullif(trim(relation_type), '') AS relation_type, nullif(trim(relation_symbol), '') AS relation_symbol, CASE lower(trim(is_concept_relation)) WHEN 'true' THEN TRUE WHEN 'false' THEN FALSE END AS is_concept_relation, nullif(trim(relationship_uuid), '') AS relationship_uuid FROM cdm_relations_fixture WHERE coalesce(lower(trim(is_concept_relation)), '') IN ('true', 'false', '')",
        "xrefs": s.with_("taxa", "SELECT join_authority, join_id, authority, nullif(trim(ext_id), '') AS ext_id, NULL AS wikidata_qid FROM xrows", _XONLY),
    }[name]
    if name == "traits":
        plain = run
        run = lambda spark, sf: plain(spark, sf).withColumn("n_systems", F.col("n_systems").cast("double"))
    query(oracle, f"read_{name}")(run)


_XONLY = """xrows AS (SELECT 'powo' AS join_authority, powo AS join_id, 'ipni' AS authority, 'urn:' || powo AS ext_id FROM taxa WHERE powo <> ''
  UNION ALL SELECT 'powo', powo, 'place', regexp_extract(coalesce(published_in, ''), '^(.*) \\d+:', 1) FROM taxa WHERE powo <> '' AND regexp_extract(coalesce(published_in, ''), '^(.*) \\d+:', 1) <> '')"""
for _name in (*TABLES, "replacements", "xrefs"):
    _read(_name)


@ix.kept
def load_report(spark: SparkSession, sf: str) -> DataFrame:
    """All files written, and loaded by a manifest into a store of their own: its report."""
    at = {name: _of(spark, sf, name)[0] for name in (*TABLES, "xrefs")}
    null = F.lit(None).cast("string")
    given = ix.table(spark, sf, "taxon_list").withColumn("id", F.col("ref_id").cast("string"))
    filled = {"taxonid": F.col("id"), "scientfiicname": F.col("name"), "scientfiicnameauthorship": F.col("authorship"), "taxonrank": F.col("rank"), "taxonomicstatus": F.lit("Accepted"), "acceptednameusageid": F.col("id")}
    listed = _written(spark, given.select(*[filled.get(c, null).alias(c) for c in d.TAXA.columns], "ref_id"), d.TAXA, "ref_id")
    source = lambda kind: {"version": "1.0" if kind == "eive" else "1", "id": kind, "redistribution": "unknown"}
    data = {
        "backbones": [{**source("wcvp"), "paths": [at["taxa"], at["distribution"]]}, {**source("list"), "path": listed}], "trait_vocabularies": [{**source("eive"), "path": at["traits"]}],
        "xref_sources": [{**source("feed"), "path": at["xrefs"]}], "concept_sources": [{**source("cdm"), "paths": [at["concepts"], at["relations"]]}], "name_spaces": [{**source("floraveg"), "path": at["names"]}],
    }
    return load(spark, mf.parse_text(json.dumps(data), Path("/")), loaded(spark, sf))


def loaded(spark: SparkSession, sf: str) -> Store:
    at = ix.store(spark, sf)
    return Store(spark, f"{at.root}-loaded")


def _table(spark: SparkSession, sf: str, table: str) -> DataFrame:
    load_report(spark, sf)
    return loaded(spark, sf).read(table)


query(s.with_("linked lookup trait_rows trait_keys name_rows xref judged_rels cdm", """SELECT 'trait_vocabularies' AS kind, 'eive' AS source, outcome AS measure, count(*) AS n FROM walked GROUP BY ALL
  UNION ALL SELECT 'concept_sources', 'cdm', outcome, count(*) FROM judged_rels WHERE outcome <> 'unknown_type' AND (SELECT TRUE) GROUP BY ALL UNION ALL SELECT 'concept_sources', 'cdm', 'concepts', count(*) FROM cdm""", s.crosswalk("trait_rows", "taxon", "trait_keys")), "load_counts")(
    lambda spark, sf: load_report(spark, sf).where("kind = 'trait_vocabularies' and measure <> 'set aside' or kind = 'concept_sources' and measure <> 'set aside'")
)
query(s.with_("name", "SELECT * EXCLUDE (nom_status), coalesce(nom_status, '') AS nom_status FROM name"), "load_names")(lambda spark, sf: _table(spark, sf, "name").withColumn("nom_status", F.coalesce("nom_status", F.lit(""))))
query(s.with_("concept", "SELECT * FROM concept"), "load_concepts")(lambda spark, sf: _table(spark, sf, "concept"))
query(s.with_("concept_name", "SELECT * FROM concept_name"), "load_concept_names")(lambda spark, sf: _table(spark, sf, "concept_name"))
query(s.with_("distribution", "SELECT * FROM distribution"), "load_distribution")(lambda spark, sf: _table(spark, sf, "distribution"))
query(s.with_("closure", "SELECT * FROM closure"), "load_closure")(lambda spark, sf: _table(spark, sf, "distribution_effective"))
query(s.with_("edges", "SELECT * FROM edges"), "load_relations")(lambda spark, sf: _table(spark, sf, "concept_relation"))
query(s.with_("trait_keys trait_rows", "SELECT * EXCLUDE (k) FROM won WHERE k = 1", s.crosswalk("trait_rows", "taxon", "trait_keys"), _WON), "load_traits")(lambda spark, sf: _table(spark, sf, "trait_value").withColumn("n_systems", F.col("n_systems").cast("double")))
query(s.with_("lookup name_rows", "SELECT * FROM entries", s.crosswalk("name_rows", "taxon", "lookup"), _ENTRIES), "load_space_entries")(lambda spark, sf: _table(spark, sf, "name_space_entry"))
