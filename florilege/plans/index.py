"""The index that the reference queries run on, built from the test tables: three backbones, traits, a name space, relations.

Each table is built when it is first asked for and written to a store in the shared folder (`operators.store`), once per
application and data folder; whatever reads it afterwards, in the same query or a later one, reads the stored Parquet.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.functions import names as n
from florilege.functions.text import key
from florilege.operators import bundle as b
from florilege.operators import ingest as g
from florilege.operators import suggest as sg
from florilege.operators.store import Store
from florilege.session import shared_folder


def store(spark: SparkSession, sf: str) -> Store:
    """The store of this application's index over one data folder."""
    name = hashlib.sha256(sf.encode()).hexdigest()[:16]
    return Store(spark, f"{shared_folder(spark)}/florilege-{spark.sparkContext.applicationId}/{name}")


def kept(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The table that `build` makes, from the store; made and committed on first use. `run.build` makes it anew."""

    @functools.wraps(build)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        at, table = store(spark, sf), build.__name__
        if table not in at.tables():
            fresh = build(spark, sf)  # may commit tables of its own
            with at.begin() as tx:
                tx.write(table, fresh)
        return at.read(table)

    run.build = build
    return run


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@kept
def taxa(spark: SparkSession, sf: str) -> DataFrame:
    """The checklist, one row a taxon: of repeated rows the latest."""
    t = table(spark, sf, "wcvp_taxon").select(
        key("taxonid").alias("taxonid"), F.col("scientfiicname").alias("canonical"), F.coalesce("scientfiicnameauthorship", F.lit("")).alias("authorship"), F.col("taxonrank").alias("rank"),
        F.col("taxonomicstatus").alias("status"), F.coalesce("nomenclaturalstatus", F.lit("")).alias("nom_status"), F.col("namepublishedin").alias("published_in"), n.powo_id("dynamicproperties").alias("powo"),
        key("acceptednameusageid").alias("accepted_id"), key("parentnameusageid").alias("parent_id"), key("originalnameusageid").alias("basionym_id"), F.col("row_seq").alias("seq"),
    )
    return g.latest(t.where("taxonid is not null"), ["taxonid"], "seq")


def distributions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "wcvp_distribution").select(key("coreid").alias("coreid"), "locality", key("locationid").alias("locationid"), F.col("row_seq").alias("seq"))


def list_taxa(spark: SparkSession, sf: str) -> DataFrame:
    """The clean list as a backbone in which every name is accepted."""
    null = F.lit(None).cast("string")
    rid = F.col("ref_id").cast("string")
    return table(spark, sf, "taxon_list").select(
        rid.alias("taxonid"), F.col("name").alias("canonical"), F.coalesce("authorship", F.lit("")).alias("authorship"), "rank", F.lit("Accepted").alias("status"), F.lit("").alias("nom_status"),
        null.alias("published_in"), F.lit("").alias("powo"), rid.alias("accepted_id"), null.alias("parent_id"), null.alias("basionym_id"), F.col("ref_id").alias("seq"),
    )


@kept
def concepts(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "cdm_concepts_fixture").select(
        key("concept_uuid", True).alias("uuid"), F.col("scientific_name").alias("canonical"), F.coalesce("authorship", F.lit("")).alias("authorship"), "rank", "status", key("sec_uuid", True).alias("sec"),
        "sec_title", key("parent_uuid", True).alias("parent"), F.col("row_seq").alias("seq"),
    )
    return g.latest(c.where("uuid is not null"), ["uuid"], "seq")


def relations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "cdm_relations_fixture").select(key("from_uuid", True).alias("from_uuid"), key("to_uuid", True).alias("to_uuid"), "relation_type", "row_seq")


@kept
def linked(spark: SparkSession, sf: str) -> DataFrame:
    """The checklist with what its references hit."""
    return g.link_taxa(taxa(spark, sf))


def wcvp(spark: SparkSession, sf: str) -> g.Index:
    return g.from_linked(linked(spark, sf), distributions(spark, sf), "wcvp")


def listed(spark: SparkSession, sf: str) -> g.Index:
    none = distributions(spark, sf).where("false")
    return g.from_linked(g.link_taxa(list_taxa(spark, sf)), none, "list")


def built(spark: SparkSession, sf: str) -> g.Index:
    """All three backbones, as ingest makes them: the checklist, the clean list and the concept source."""
    return wcvp(spark, sf).union(listed(spark, sf)).union(g.concept_source(concepts(spark, sf)))


def _part(table: str) -> Callable[[SparkSession, str], DataFrame]:
    def build(spark: SparkSession, sf: str) -> DataFrame:
        return getattr(built(spark, sf), table)

    build.__name__ = table
    return kept(build)


#: The tables of the index, each from the store.
PARTS = {t: _part(t) for t in g.Index.__dataclass_fields__}


class Stored(g.Index):
    """The index with its tables in the store; one that is not asked for is not built."""

    def __init__(self, spark: SparkSession, sf: str):
        self._at = spark, sf

    def __getattr__(self, table: str) -> DataFrame:  # only called for what is not there yet
        if table not in PARTS:
            raise AttributeError(table)
        self.__dict__[table] = PARTS[table](*self._at)
        return self.__dict__[table]


def index(spark: SparkSession, sf: str) -> g.Index:
    return Stored(spark, sf)


@kept
def lookup(spark: SparkSession, sf: str) -> DataFrame:
    """What names are resolved against, in the order of the folded name, so that files hold ranges of it."""
    return g.lookup(index(spark, sf)).sort("canonical_fold")


@kept
def closure(spark: SparkSession, sf: str) -> DataFrame:
    return g.closure(index(spark, sf))


@kept
def search_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of the text index: the names of all concepts and the collective names of the name space."""
    return sg.index_rows(index(spark, sf), space_entries(spark, sf))


def secs(spark: SparkSession, sf: str) -> DataFrame:
    """(id, title) of the references, the latest title of each."""
    s = table(spark, sf, "cdm_concepts_fixture").select(key("sec_uuid", True).alias("id"), F.col("sec_title").alias("title"), F.col("row_seq").alias("seq"))
    return g.latest(s.where("id is not null"), ["id"], "seq").drop("seq")


#: The manifest of the test tables (kind, id, version, license, source_url, redistribution). Nothing in the
#: tables says how they may be handed on, so these statements are made up to have one of each.
SOURCES = (
    ("backbones", "wcvp", "1", "CC BY 3.0", "", "unknown"), ("backbones", "list", "1", "CC0", "", "allowed"), ("concept_sources", "cdm", "1", "", "", "restricted"),
    ("trait_vocabularies", "eive", "1.0", "", "", "restricted"), ("name_spaces", "floraveg", "1", "CC BY 4.0", "", "allowed"),
)


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SOURCES), "kind string, id string, version string, license string, source_url string, redistribution string")


def contents(spark: SparkSession, sf: str) -> b.Contents:
    """All that an export of the index may hold."""
    s = sources(spark)
    of = lambda *kinds: s.where(F.col("kind").isin(*kinds)).drop("kind")
    vocabularies = of("trait_vocabularies").withColumnRenamed("id", "vocab").withColumn("taxonomy", F.upper("vocab"))
    return b.Contents(index(spark, sf), of("backbones", "concept_sources"), of("xref_sources"), vocabularies, of("name_spaces"), secs(spark, sf), trait_values(spark, sf), space_entries(spark, sf), edges(spark, sf))


@kept
def edges(spark: SparkSession, sf: str) -> DataFrame:
    existing = concepts(spark, sf).select(g.concept_id("cdm", F.col("uuid")).alias("concept_id"))
    return g.edges(g.relation_outcomes(relations(spark, sf), existing), "cdm")


def traits_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "eive_sample")
    return e.select("taxon", F.lower(F.trim("vocab")).alias("vocab"), "vocab_version", "dim", "value", "niche_width", "n_systems", F.col("row_seq").alias("seq")).where("taxon is not null and value is not null")


def name_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the name list with a taxon and a source id (the reader's rule)."""
    r = table(spark, sf, "floraveg_sample").select(F.trim("taxon").alias("taxon"), F.trim("rank").alias("rank"), F.trim("status").alias("status"), F.trim("accepted_taxon").alias("accepted_taxon"), F.trim("source_id").alias("source_id"), F.col("row_seq").alias("seq"))
    return r.where("taxon <> '' and source_id <> ''")


def trait_keys(spark: SparkSession, sf: str) -> DataFrame:
    """(canonical_fold, concept_id): what traits are resolved against, the backbones without the concept source."""
    return lookup(spark, sf).where("backbone_id <> 'cdm'").select("canonical_fold", "concept_id")


@kept
def trait_crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    return g.crosswalk(traits_rows(spark, sf).select(F.col("taxon").alias("value")).distinct(), trait_keys(spark, sf))


def space_crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    keys = lookup(spark, sf).select("canonical_fold", "concept_id")
    return g.crosswalk(name_rows(spark, sf).select(F.col("taxon").alias("value")).distinct(), keys)


@kept
def space_entries(spark: SparkSession, sf: str) -> DataFrame:
    return g.name_space_entries(name_rows(spark, sf), space_crosswalk(spark, sf), "floraveg")


@kept
def trait_values(spark: SparkSession, sf: str) -> DataFrame:
    return g.trait_values(traits_rows(spark, sf), trait_crosswalk(spark, sf))


def xref_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A cross-reference feed: of every accepted taxon with a POWO id its IPNI id, and its place of publication as a key that
    several taxa share, so that conflicts occur."""
    t = taxa(spark, sf).where("powo <> ''")
    base = t.select(F.lit("powo").alias("join_authority"), F.col("powo").alias("join_id"), F.explode(F.array(
        F.struct(F.lit("ipni").alias("authority"), F.concat(F.lit("urn:"), "powo").alias("ext_id")),
        F.struct(F.lit("place").alias("authority"), F.regexp_extract(F.coalesce("published_in", F.lit("")), r"^(.*) \d+:", 1).alias("ext_id")),
    )).alias("x"))
    return base.select("join_authority", "join_id", "x.*").where("ext_id <> ''")


def verbatim(spark: SparkSession, sf: str) -> DataFrame:
    """(id, verbatim): names to resolve, as typed in the trait table and the name list and with authors as in the concept source."""
    traits = table(spark, sf, "eive_sample").select(F.concat(F.lit("e:"), F.col("row_seq").cast("string")).alias("id"), F.col("taxon").alias("verbatim")).where("verbatim is not null")
    typed = name_rows(spark, sf).select(F.concat(F.lit("f:"), F.col("seq").cast("string")).alias("id"), F.col("taxon").alias("verbatim"))
    cited = concepts(spark, sf).select(F.concat(F.lit("c:"), "uuid").alias("id"), n.display_text("canonical", "authorship").alias("verbatim"))
    return traits.unionByName(typed).unionByName(cited)
