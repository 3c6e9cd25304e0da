"""Area-scoped export: what belongs to the concepts of some areas, behind a check of the sources' licences."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.functions import vocabulary as v
from florilege.operators import suggest as sg
from florilege.operators.ingest import SCHEME, Index, closure
from florilege.operators.store import Store


@dataclass
class Contents:
    """All that an export may hold. The catalogues carry version, license, source_url and redistribution of each source."""

    index: Index
    backbones: DataFrame  # id, version, ...
    xref_sources: DataFrame  # id, ...
    vocabularies: DataFrame  # vocab, version, taxonomy, ...
    spaces: DataFrame  # id, ...
    secs: DataFrame  # id, title
    traits: DataFrame  # concept_id, vocab, vocab_version, dim, ...
    entries: DataFrame  # space, ext_id, concept_id, name, aggregate, resolution, status
    relations: DataFrame  # from_id, to_id, relation, source


def area_codes(area: str) -> list[str]:
    """A comma list of areas to its distinct codes in order."""
    return sorted({v.AREA_ALIASES.get(x, x) for a in area.split(",") if (x := a.strip().upper())})


def scope(index: Index, area: str = "") -> DataFrame:
    """(concept_id) of the concepts with an own area among those given; all concepts without areas."""
    codes = area_codes(area)
    if not codes:
        return index.concept.select(F.col("id").alias("concept_id"))
    d = index.distribution.where((F.col("area_scheme") == SCHEME) & F.col("area_code").isin(*codes))
    return d.select("concept_id").distinct()


def severity(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == "restricted", 2).when(c == "unknown", 1).otherwise(0)


def uses(contents: Contents) -> list[tuple[DataFrame, DataFrame]]:
    """The four kinds of source (id, redistribution), each with its use (id, concept_id), as `restricted_sources` takes them."""
    c = contents
    plain = lambda df: df.select("id", "redistribution")
    vocabulary = F.concat_ws(" ", "vocab", F.coalesce("vocab_version", F.lit("")))
    return [
        (plain(c.backbones), c.index.concept.select(F.col("backbone_id").alias("id"), F.col("id").alias("concept_id"))),
        (plain(c.xref_sources), c.index.xref.where("source is not null").select(F.col("source").alias("id"), "concept_id")),
        (c.vocabularies.select(F.concat_ws(" ", "vocab", "version").alias("id"), "redistribution"), c.traits.select(vocabulary.alias("id"), "concept_id")),
        (plain(c.spaces), c.entries.select(F.col("space").alias("id"), "concept_id")),
    ]


def restricted_sources(uses: list[tuple[DataFrame, DataFrame]], inside: DataFrame) -> DataFrame:
    """uses: pairs of sources (id, redistribution) and their use (id, concept_id). (id, redistribution) of those that occur in
    the scope and are not allowed, the severest statement of each id."""
    hits = []
    for sources, use in uses:
        used = use.join(inside, "concept_id", "left_semi").select("id").distinct()
        hits.append(sources.where("redistribution <> 'allowed'").join(used, "id", "left_semi").select("id", "redistribution"))
    return reduce(DataFrame.unionByName, hits).groupBy("id").agg(F.max_by("redistribution", severity("redistribution")).alias("redistribution"))


def _within(df: DataFrame, id_column: str, ref: str) -> DataFrame:
    """Rows whose reference to another row of the same table leads out of it lose that reference."""
    own = df.select(F.col(id_column).alias(ref), F.lit(True).alias("_in"))
    return df.join(own, ref, "left").withColumn(ref, F.when(F.col("_in"), F.col(ref))).drop("_in").select(*df.columns)


def export(index: Index, inside: DataFrame, area: str = "") -> Index:
    """The index of the scope: its concepts and their names, areas trimmed to those given, references that lead out nulled."""
    semi = lambda df, c: df.join(inside.withColumnRenamed("concept_id", c), c, "left_semi")
    concept = _within(semi(index.concept, "id"), "id", "parent_id")
    links = semi(index.concept_name, "concept_id")
    used = links.select(F.col("name_id").alias("id")).unionByName(concept.select(F.col("accepted_name").alias("id"))).distinct()
    name = _within(index.name.join(used, "id", "left_semi"), "id", "basionym_id")
    distribution, areas = semi(index.distribution, "concept_id"), index.area
    if codes := area_codes(area):
        distribution, areas = distribution.where(F.col("area_code").isin(*codes)), areas.where(F.col("code").isin(*codes))
    kept = areas.join(distribution.select(F.col("area_scheme").alias("scheme"), F.col("area_code").alias("code")).distinct(), ["scheme", "code"], "left_semi")
    return Index(name, concept, links, semi(index.xref, "concept_id"), distribution, kept)


def sidecars(contents: Contents, inside: DataFrame) -> dict[str, DataFrame]:
    """The tables of the scope that are not in `Index`.

    Sources of cross-references and vocabularies are copied whole, as they only say where data come from; titles of
    references, name spaces and their entries are content and are kept only where a concept of the scope has them. A
    relation needs both its ends. There are no vernacular names in any source, so the table is empty.
    """
    semi = lambda df, c: df.join(inside.withColumnRenamed("concept_id", c), c, "left_semi")
    c = contents
    concept = semi(c.index.concept, "id")
    entries = semi(c.entries, "concept_id")
    return {
        "backbone_version": c.backbones.join(concept.select(F.col("backbone_id").alias("id")).distinct(), "id", "left_semi"),
        "xref_source": c.xref_sources, "trait_vocabulary": c.vocabularies, "trait_value": semi(c.traits, "concept_id"),
        "sec_reference": c.secs.join(concept.select(F.col("sec_reference").alias("id")).where("id <> ''").distinct(), "id", "left_semi"),
        "name_space": c.spaces.join(entries.select(F.col("space").alias("id")).distinct(), "id", "left_semi"), "name_space_entry": entries,
        "concept_relation": semi(semi(c.relations, "from_id"), "to_id"),
        "vernacular": inside.where("false").select("concept_id", F.lit("").alias("lang"), F.lit("").alias("name"), F.lit(False).alias("preferred")),
    }


def tables(contents: Contents, inside: DataFrame, area: str = "") -> dict[str, DataFrame]:
    """Every table of the export: the index of the scope, what goes with it, and closure and search rows built anew over it."""
    out = export(contents.index, inside, area)
    beside = sidecars(contents, inside)
    return {t: getattr(out, t) for t in out.__dataclass_fields__} | beside | {"distribution_effective": closure(out), "search_rows": sg.index_rows(out, beside["name_space_entry"])}


def report(out: Index) -> DataFrame:
    """One row: the numbers of names, concepts and distinct areas of an export."""
    count = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
    areas = out.distribution.agg(F.count_distinct("area_code").alias("areas"))
    return count(out.name, "names").join(count(out.concept, "concepts"), F.lit(True)).join(areas, F.lit(True))


def write(contents: Contents, path: str, snapshot: str, area: str = "", manifest_sha: str = "", allow_restricted: bool = False, now: Callable[[], str] | None = None) -> DataFrame:
    """Write the export as a store at path and return its `report`; refused, with nothing written, if a source stands in the way.

    All tables appear at once; a run that fails leaves nothing to be read. An existing export is not overwritten.
    """
    spark = contents.index.concept.sparkSession
    inside = scope(contents.index, area)
    found = restricted_sources(uses(contents), inside).agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("ids")).first()["ids"]
    if found and not allow_restricted:
        raise ValueError(f"sources not cleared for redistribution: {found}")
    store = Store(spark, path)
    if store.tables():
        raise ValueError(f"there is an export at {path}")
    created = F.lit(now()) if now else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    meta = spark.range(1).select(F.lit(snapshot).alias("snapshot_version"), F.lit(area).alias("area"), created.alias("created_at"), F.lit(manifest_sha).alias("source_manifest_sha"), F.lit(found).alias("restricted_sources"))
    with store.begin() as tx:
        for table, df in tables(contents, inside, area).items():
            tx.write(table, df)
        tx.write("bundle_meta", meta)
    return report(Index(**{t: store.read(t) for t in Index.__dataclass_fields__}))
