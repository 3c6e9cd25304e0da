"""Ingest of the files of a manifest into a store: a transaction for each source, in the order that later sources rely on.

Backbones come first, then trait vocabularies and cross-references (which resolve against backbones), concept sources, name
spaces (which see those too), and at the end what is derived of all: lookup, distribution closure, search rows. A source that
is refused leaves the store as the sources before it made it. What is refused: a missing column, a wrongly quoted name list,
rows of another vocabulary or version than the manifest says, a dimension outside the vocabulary whose taxon resolves, a
relation type outside the vocabulary.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.functions import names as n
from florilege.functions import vocabulary as v
from florilege.functions.text import key
from florilege.operators import ingest as g
from florilege.operators import suggest as sg
from florilege.operators.store import Store, Transaction
from florilege.session import cut
from florilege.sources import delimited as d
from florilege.sources.manifest import Manifest

#: The keys of the tables of the index.
KEYS = {"name": ["id"], "concept": ["id"], "concept_name": ["concept_id", "name_id"], "xref": ["authority", "ext_id"], "distribution": ["concept_id", "area_scheme", "area_code"], "area": ["scheme", "code"]}
SCHEMAS = {
    "name": "id string, canonical string, canonical_fold string, authorship string, rank string, rank_verbatim string, ipni_id string, published_in string, nom_status string, basionym_id string",
    "concept": "id string, backbone_id string, accepted_name string, rank string, rank_verbatim string, status string, parent_id string, sec_reference string",
    "concept_name": "concept_id string, name_id string, role string, homotypic boolean", "xref": "authority string, ext_id string, concept_id string, source string",
    "distribution": "concept_id string, area_scheme string, area_code string", "area": "scheme string, code string, name string",
    "name_space_entry": "space string, ext_id string, concept_id string, name string, aggregate boolean, resolution string, status string",
}


def taxa_of(rows: DataFrame) -> DataFrame:
    """Rows of a checklist file (`delimited.TAXA`, with seq) to the taxa that `ingest.link_taxa` takes, the latest row of each."""
    t = rows.select(
        key("taxonid").alias("taxonid"), F.col("scientfiicname").alias("canonical"), F.coalesce("scientfiicnameauthorship", F.lit("")).alias("authorship"), F.col("taxonrank").alias("rank"),
        F.col("taxonomicstatus").alias("status"), F.coalesce("nomenclaturalstatus", F.lit("")).alias("nom_status"), F.col("namepublishedin").alias("published_in"), n.powo_id("dynamicproperties").alias("powo"),
        key("acceptednameusageid").alias("accepted_id"), key("parentnameusageid").alias("parent_id"), key("originalnameusageid").alias("basionym_id"), "seq",
    )
    return g.latest(t.where("taxonid is not null"), ["taxonid"], "seq")


def concepts_of(rows: DataFrame) -> DataFrame:
    c = rows.select(
        key("concept_uuid", True).alias("uuid"), F.col("scientific_name").alias("canonical"), F.coalesce("authorship", F.lit("")).alias("authorship"), "rank", "status", key("sec_uuid", True).alias("sec"),
        "sec_title", key("parent_uuid", True).alias("parent"), "seq",
    )
    return g.latest(c.where("uuid is not null"), ["uuid"], "seq")


def index_in(spark: SparkSession, held: Store | Transaction, tables: list[str]) -> g.Index:
    """The index in a store; a table that is not there yet is empty."""
    return g.Index(**{t: held.read(t) if t in tables else spark.createDataFrame([], SCHEMAS[t]) for t in KEYS})


def _put(tx: Transaction, index: g.Index) -> None:
    """Names and concepts: the last writer wins; areas and distributions: the first one stays."""
    for table, keys in KEYS.items():
        rows = getattr(index, table).withColumn("_o", F.lit(0))
        (tx.insert if table in ("area", "distribution") else tx.upsert)(table, rows, keys, "_o")


def _register(tx: Transaction, spark: SparkSession, table: str, entry: dict, sha: str, keys: dict[str, str]) -> None:
    row = {**keys, "version": entry["version"], "license": entry.get("license", ""), "source_url": entry.get("source_url", ""), "redistribution": entry["redistribution"], "manifest_sha": sha}
    row = {k: x for i, (k, x) in enumerate(row.items()) if k not in list(row)[:i]}
    df = spark.range(1).select(*[F.lit(x).alias(k) for k, x in row.items()], F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ingested_at"))
    tx.upsert(table, df.withColumn("_o", F.lit(0)), list(keys), "_o")



def load(spark: SparkSession, manifest: Manifest, store: Store) -> DataFrame:
    """Load all sources; (kind, source, measure, n): what was read, set aside and written, by source."""
    report: list[DataFrame] = []

    def note(kind: str, source: str, df: DataFrame, measure: str | None = None) -> None:
        counted = df.agg(F.count(F.lit(1)).alias("n")).withColumn("measure", F.lit(measure)) if measure else df.select(F.col("outcome").alias("measure")).groupBy("measure").agg(F.count(F.lit(1)).alias("n"))
        report.append(cut(counted.select(F.lit(kind).alias("kind"), F.lit(source).alias("source"), "measure", F.col("n").cast("long").alias("n"))))

    steps: list[tuple[str, Callable[[dict], None]]] = [
        ("backbones", lambda e: _backbone(spark, store, manifest, e, note)), ("trait_vocabularies", lambda e: _traits(spark, store, manifest, e, note)),
        ("xref_sources", lambda e: _xrefs(spark, store, manifest, e, note)), ("concept_sources", lambda e: _concepts(spark, store, manifest, e, note)),
        ("name_spaces", lambda e: _names(spark, store, manifest, e, note)),
    ]
    for kind, step in steps:
        for entry in manifest.sources[kind]:
            step(entry)
    derive(spark, store)
    return reduce(DataFrame.unionByName, report)


def derive(spark: SparkSession, store: Store) -> None:
    """What is made of the whole index: lookup, distribution closure, search rows."""
    have = store.tables()
    index = index_in(spark, store, have)
    entries = store.read("name_space_entry") if "name_space_entry" in have else spark.createDataFrame([], SCHEMAS["name_space_entry"])
    with store.begin() as tx:
        tx.write("lookup", g.lookup(index).sort("canonical_fold"))
        tx.write("distribution_effective", g.closure(index))
        tx.write("search_rows", sg.index_rows(index, entries))
    store.vacuum()


def _backbone(spark: SparkSession, store: Store, manifest: Manifest, entry: dict, note: Callable) -> None:
    """Paths: the checklist and, if there is one, its distributions."""
    taxa = d.read(spark, entry["paths"][0], d.TAXA)
    places = d.read(spark, entry["paths"][1], d.DISTRIBUTION) if len(entry["paths"]) > 1 else None
    linked = cut(g.link_taxa(taxa_of(taxa.rows)))
    none = spark.createDataFrame([], "coreid string, locality string, locationid string, seq int")
    there = places.rows.select(key("coreid").alias("coreid"), "locality", key("locationid").alias("locationid"), "seq") if places else none
    with store.begin() as tx:
        _put(tx, g.from_linked(linked, there, entry["id"]))
        _register(tx, spark, "backbone_version", entry, manifest.sha256, {"id": entry["id"]})
    for measure, n_ in g.backbone_report(linked).first().asDict().items():
        note("backbones", entry["id"], spark.range(n_), measure)
    note("backbones", entry["id"], taxa.errors, "set aside")


def _resolved(spark: SparkSession, store: Store, values: DataFrame, concept_sources: bool) -> DataFrame:
    index = index_in(spark, store, store.tables())
    keys = g.lookup(index)
    if not concept_sources:
        keys = keys.where(F.col("sec_reference").isNull())
    return cut(g.crosswalk(values, keys.select("canonical_fold", "concept_id")))


def _traits(spark: SparkSession, store: Store, manifest: Manifest, entry: dict, note: Callable) -> None:
    source = d.read(spark, entry["paths"][0], d.TRAITS)
    rows = source.rows.withColumn("vocab", F.lower("vocab"))
    g.check_vocabulary(rows, entry["id"], entry["version"])
    resolved = _resolved(spark, store, rows.select(F.col("taxon").alias("value")).where("value is not null").distinct(), False)
    hit = rows.join(resolved.where("outcome = 'matched'").select(F.col("value").alias("taxon")), "taxon", "left_semi")
    off = hit.where(v.parse_dimension("dim").isNull()).limit(1).collect()
    if off:
        raise ValueError(f"unknown dimension {off[0]['dim']!r}")
    with store.begin() as tx:
        tx.upsert("trait_value", g.trait_values(rows, resolved).withColumn("_o", F.lit(0)), ["concept_id", "vocab", "vocab_version", "dim"], "_o")
        _register(tx, spark, "trait_vocabulary", entry, manifest.sha256, {"vocab": entry["id"], "version": entry["version"]})
    note("trait_vocabularies", entry["id"], resolved)
    note("trait_vocabularies", entry["id"], source.errors, "set aside")


def _xrefs(spark: SparkSession, store: Store, manifest: Manifest, entry: dict, note: Callable) -> None:
    source = d.read(spark, entry["paths"][0], d.XREFS)
    known = index_in(spark, store, store.tables()).xref
    outcomes = cut(g.xref_outcomes(source.rows.drop("wikidata_qid"), known))
    new = outcomes.where("outcome = 'matched'").select("authority", "ext_id", "concept_id", F.lit(entry["id"]).alias("source"), F.col("seq").alias("_o"))
    with store.begin() as tx:
        tx.upsert("xref", new, KEYS["xref"], "_o")
        _register(tx, spark, "xref_source", entry, manifest.sha256, {"id": entry["id"]})
    note("xref_sources", entry["id"], outcomes)
    note("xref_sources", entry["id"], source.errors, "set aside")


def _concepts(spark: SparkSession, store: Store, manifest: Manifest, entry: dict, note: Callable) -> None:
    """Paths: the concepts and, if there is one, the file of relations."""
    bid = entry["id"]
    source = d.read(spark, entry["paths"][0], d.CONCEPTS)
    concepts = cut(concepts_of(source.rows))
    links = d.read(spark, entry["paths"][1], d.RELATIONS) if len(entry["paths"]) > 1 else None
    made = g.concept_source(concepts, bid)
    outcomes = None
    if links:
        stored = index_in(spark, store, store.tables()).concept.select(F.col("id").alias("concept_id"))
        ends = made.concept.select(F.col("id").alias("concept_id")).unionByName(stored)
        typed = links.rows.where("relation_type is not null").select(key("from_uuid", True).alias("from_uuid"), key("to_uuid", True).alias("to_uuid"), "relation_type")
        outcomes = cut(g.relation_outcomes(typed, ends, bid))
        g.require_known(outcomes)
    secs = g.latest(source.rows.select(key("sec_uuid", True).alias("id"), F.col("sec_title").alias("title"), "seq").where("id is not null"), ["id"], "seq").withColumnRenamed("seq", "_o")
    with store.begin() as tx:
        _put(tx, made)
        tx.upsert("sec_reference", secs, ["id"], "_o")
        if outcomes is not None:
            tx.upsert("concept_relation", g.edges(outcomes, bid).withColumn("_o", F.lit(0)), ["from_id", "to_id", "relation", "source"], "_o")
        _register(tx, spark, "backbone_version", entry, manifest.sha256, {"id": bid})
    note("concept_sources", bid, concepts, "concepts")
    note("concept_sources", bid, source.errors, "set aside")
    if outcomes is not None:
        note("concept_sources", bid, outcomes)


def _names(spark: SparkSession, store: Store, manifest: Manifest, entry: dict, note: Callable) -> None:
    source = d.read(spark, entry["paths"][0], d.NAMES)
    resolved = _resolved(spark, store, source.rows.select(F.col("taxon").alias("value")).distinct(), True)
    entries = g.name_space_entries(source.rows, resolved, entry["id"])
    with store.begin() as tx:
        tx.upsert("name_space_entry", entries.withColumn("_o", F.lit(0)), ["space", "ext_id"], "_o")
        _register(tx, spark, "name_space", entry, manifest.sha256, {"id": entry["id"]})
    note("name_spaces", entry["id"], resolved)
    note("name_spaces", entry["id"], source.errors, "set aside")
