"""Catalogues and the area-scoped export."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.operators import bundle as b
from florilege.operators import lookup as lk
from florilege.operators.ingest import closure
from florilege.operators.store import Store
from florilege.plans import index as ix
from florilege.plans import sql as s
from florilege.plans.reference import _ENTRIES, _WON
from florilege.plans.registry import Registry
from florilege.session import shared_folder

registry = Registry()
query, QUERIES, ORACLE = registry.query, registry.queries, registry.oracles


# --- catalogues and exports ---------------------------------------------------------------------------------------------


@query(s.with_("distribution area", "SELECT d.scheme, d.code, coalesce(a.name, '') AS name FROM (SELECT DISTINCT area_scheme AS scheme, area_code AS code FROM distribution) d LEFT JOIN area a ON a.scheme = d.scheme AND a.code = d.code"))
def catalogue_areas(spark: SparkSession, sf: str) -> DataFrame:
    return lk.areas(ix.index(spark, sf))


@query(s.with_("secs", "SELECT * FROM secs"))
def catalogue_secs(spark: SparkSession, sf: str) -> DataFrame:
    return ix.secs(spark, sf)


@query(f"SELECT * FROM (VALUES {', '.join(str(x) for x in ix.SOURCES)}) t(kind, id, version, license, source_url, redistribution)")
def catalogue_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Backbones, trait vocabularies, cross-reference sources, concept sources and name spaces with their licences."""
    return ix.sources(spark)


@query(s.with_("lookup name_rows", "SELECT 'floraveg' AS id, count(*) AS entries, count(DISTINCT concept_id) AS concepts, count(*) FILTER (aggregate) AS aggregates FROM entries", s.crosswalk("name_rows", "taxon", "lookup"), _ENTRIES))
def catalogue_spaces(spark: SparkSession, sf: str) -> DataFrame:
    return lk.spaces(ix.space_entries(spark, sf))


@query(s.with_("trait_keys trait_rows", "SELECT vocab, vocab_version AS version, count(*) AS n_values, count(DISTINCT concept_id) AS concepts, string_agg(DISTINCT dim, ',' ORDER BY dim) AS dims FROM won WHERE k = 1 GROUP BY ALL", s.crosswalk("trait_rows", "taxon", "trait_keys"), _WON))
def catalogue_vocabularies(spark: SparkSession, sf: str) -> DataFrame:
    return lk.vocabularies(ix.trait_values(spark, sf)).withColumn("dims", F.array_join("dims", ","))


_SCOPE = "scope AS (SELECT DISTINCT concept_id AS id FROM distribution WHERE area_code IN ('VMQ', 'KYC', 'BDR'))"
_AREAS = "vmq, KYC,bdr,kyc"


@query(s.with_("distribution concept", "SELECT c.id, c.backbone_id, c.accepted_name, c.rank, c.rank_verbatim, c.status, CASE WHEN p.id IS NOT NULL THEN c.parent_id END AS parent_id, c.sec_reference FROM concept c SEMI JOIN scope s ON s.id = c.id LEFT JOIN scope p ON p.id = c.parent_id", _SCOPE))
def bundle_concepts(spark: SparkSession, sf: str) -> DataFrame:
    i = ix.index(spark, sf)
    return b.export(i, b.scope(i, _AREAS), _AREAS).concept


@query(s.with_("distribution concept concept_name name", """SELECT n.id, n.canonical, n.canonical_fold, n.authorship, n.rank, n.rank_verbatim, n.ipni_id, n.published_in, n.nom_status, CASE WHEN k.id IS NOT NULL THEN n.basionym_id END AS basionym_id FROM name n SEMI JOIN kept s ON s.id = n.id LEFT JOIN kept k ON k.id = n.basionym_id""",
    _SCOPE, "kept AS (SELECT DISTINCT cn.name_id AS id FROM concept_name cn SEMI JOIN scope s ON s.id = cn.concept_id)"))
def bundle_names(spark: SparkSession, sf: str) -> DataFrame:
    i = ix.index(spark, sf)
    return b.export(i, b.scope(i, _AREAS), _AREAS).name


@query(s.with_("distribution", "SELECT d.* FROM distribution d SEMI JOIN scope s ON s.id = d.concept_id WHERE d.area_code IN ('VMQ', 'KYC', 'BDR')", _SCOPE))
def bundle_distribution(spark: SparkSession, sf: str) -> DataFrame:
    i = ix.index(spark, sf)
    return b.export(i, b.scope(i, _AREAS), _AREAS).distribution


_SOURCES = f"""sources AS (SELECT CASE kind WHEN 'concept_sources' THEN 'backbones' ELSE kind END AS kind, CASE kind WHEN 'trait_vocabularies' THEN id || ' ' || version ELSE id END AS id, redistribution
  FROM (VALUES {', '.join(str(x) for x in ix.SOURCES)}) t(kind, id, version, license, source_url, redistribution))"""


@query(s.with_("distribution concept trait_keys trait_rows", """SELECT u.id, max(m.redistribution) AS redistribution FROM (
  SELECT 'backbones' AS kind, c.backbone_id AS id, c.id AS concept_id FROM concept c UNION ALL SELECT 'trait_vocabularies', w.vocab || ' ' || w.vocab_version, w.concept_id FROM won w WHERE k = 1 UNION ALL SELECT 'name_spaces', e.space, e.concept_id FROM entries e) u
  SEMI JOIN scope s ON s.id = u.concept_id JOIN sources m ON m.id = u.id AND m.kind = u.kind WHERE m.redistribution <> 'allowed' GROUP BY u.id""",
    s.crosswalk("trait_rows", "taxon", "trait_keys"), _WON, _SCOPE, _SOURCES, "entries AS (SELECT 'floraveg' AS space, NULL::VARCHAR AS concept_id WHERE FALSE)"))
def bundle_restricted(spark: SparkSession, sf: str) -> DataFrame:
    """The sources that stand in the way of an export of the three areas."""
    c = ix.contents(spark, sf)
    return b.restricted_sources(b.uses(c), b.scope(c.index, _AREAS))


def _exported(name: str, table: str, oracle: str, everywhere: bool) -> None:
    """Register a table of the export: of the three areas, or of all."""
    area = "" if everywhere else _AREAS

    def run(spark: SparkSession, sf: str) -> DataFrame:
        c = ix.contents(spark, sf)
        inside = b.scope(c.index, area)
        if table in c.index.__dataclass_fields__:
            return getattr(b.export(c.index, inside, area), table)
        if table == "distribution_effective":
            return closure(b.export(c.index, inside, area))
        return b.sidecars(c, inside)[table]

    query(oracle, name)(run)


_EXPORTED = {
    "concepts": ("concept", "SELECT c.id, c.backbone_id, c.accepted_name, c.rank, c.rank_verbatim, c.status, CASE WHEN p.id IS NOT NULL THEN c.parent_id END AS parent_id, c.sec_reference FROM concept c SEMI JOIN scope s ON s.id = c.id LEFT JOIN scope p ON p.id = c.parent_id"),
    "names": ("name", "SELECT n.id, n.canonical, n.canonical_fold, n.authorship, n.rank, n.rank_verbatim, n.ipni_id, n.published_in, n.nom_status, CASE WHEN k.id IS NOT NULL THEN n.basionym_id END AS basionym_id FROM name n SEMI JOIN kept s ON s.id = n.id LEFT JOIN kept k ON k.id = n.basionym_id"),
    "concept_names": ("concept_name", "SELECT cn.* FROM concept_name cn SEMI JOIN scope s ON s.id = cn.concept_id"),
    "xrefs": ("xref", "SELECT x.*, NULL AS source FROM xref x SEMI JOIN scope s ON s.id = x.concept_id"),
    "distribution": ("distribution", "SELECT * FROM within"),
    "areas": ("area", "SELECT a.* FROM area a SEMI JOIN within w ON w.area_scheme = a.scheme AND w.area_code = a.code"),
    "effective": ("distribution_effective", """SELECT concept_id, area_scheme, area_code, 'own' AS origin FROM within UNION ALL SELECT DISTINCT c.id, d.area_scheme, d.area_code, 'name' FROM concept c SEMI JOIN scope s ON s.id = c.id JOIN name an ON an.id = c.accepted_name AND an.canonical_fold <> ''
  JOIN name wn ON wn.canonical_fold = an.canonical_fold JOIN concept_name wc ON wc.name_id = wn.id JOIN concept w ON w.id = wc.concept_id AND w.backbone_id = 'wcvp' JOIN within d ON d.concept_id = w.id WHERE NOT EXISTS (SELECT 1 FROM within o WHERE o.concept_id = c.id)"""),
    "traits": ("trait_value", "SELECT w.* EXCLUDE (k) FROM won w SEMI JOIN scope s ON s.id = w.concept_id WHERE k = 1"),
    "relations": ("concept_relation", "SELECT e.* FROM edges e SEMI JOIN scope s ON s.id = e.from_id SEMI JOIN scope z ON z.id = e.to_id"),
    "secs": ("sec_reference", "SELECT t.* FROM secs t SEMI JOIN (SELECT c.sec_reference FROM concept c SEMI JOIN scope s ON s.id = c.id) k ON k.sec_reference = t.id"),
    "space_entries": ("name_space_entry", "SELECT e.* FROM entries e SEMI JOIN scope s ON s.id = e.concept_id"),
}
_NEEDS = {"traits": ("trait_keys trait_rows", (s.crosswalk("trait_rows", "taxon", "trait_keys"), _WON)), "relations": ("edges", ()), "secs": ("secs", ()), "space_entries": ("lookup name_rows", (s.crosswalk("name_rows", "taxon", "lookup"), _ENTRIES))}
_ALL = "scope AS (SELECT id FROM concept)", "within AS (SELECT * FROM distribution)"
_THREE = _SCOPE, "within AS (SELECT * FROM distribution WHERE area_code IN ('VMQ', 'KYC', 'BDR'))"
_KEPT = "kept AS (SELECT DISTINCT cn.name_id AS id FROM concept_name cn SEMI JOIN scope s ON s.id = cn.concept_id)"
for _name, (_table, _main) in _EXPORTED.items():
    _more, _ctes = _NEEDS.get(_name, ("", ()))
    for _prefix, _within, _everywhere in (("bundle_all_", _ALL, True), ("bundle_", _THREE, False)):
        if _prefix + _name not in QUERIES:
            _exported(_prefix + _name, _table, s.with_(f"concept name concept_name xref distribution area {_more}", _main, *_within, _KEPT, *_ctes), _everywhere)


@query(s.with_("concept name concept_name distribution", """SELECT (SELECT count(*) FROM kept) AS names, (SELECT count(*) FROM scope) AS concepts, (SELECT count(DISTINCT area_code) FROM within) AS areas,
  'vmq, KYC,bdr,kyc' AS area, 's1' AS snapshot_version, 'wcvp' AS restricted_sources, 'm' AS source_manifest_sha""", *_THREE, _KEPT))  # fmt: skip
def bundle_written(spark: SparkSession, sf: str) -> DataFrame:
    """The export of the three areas written as a store, with an override of the licence check: its report and its meta row."""
    path = f"{shared_folder(spark)}/florilege-{spark.sparkContext.applicationId}/bundle-{uuid.uuid4().hex}"
    counts = b.write(ix.contents(spark, sf), path, "s1", _AREAS, "m", allow_restricted=True)
    meta = Store(spark, path).read("bundle_meta").drop("created_at")
    return counts.join(meta, F.lit(True))
