"""Ingest: source rows to the tables of the index, as joins and aggregations (no row loops).

Rows of one key are taken once, the latest by the given order (`latest`), or the earliest where the first one wins (`first`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.functions import names as n
from florilege.functions import vocabulary as v
from florilege.skew import hot_values_of, salted_join

#: The scheme of all area codes, and (in `Index`) the columns of the tables and the shapes of their ids.
SCHEME = "wgsrpd_l3"


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keyed upsert: of each key the row with the greatest order. Aggregates before the shuffle, unlike a window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert if absent: of each key the row with the smallest order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


@dataclass
class Index:
    """The tables of the index. All ids are text; homotypic is true or null, never false."""

    name: DataFrame  # id, canonical, canonical_fold, authorship, rank, rank_verbatim, ipni_id, published_in, nom_status, basionym_id
    concept: DataFrame  # id, backbone_id, accepted_name, rank, rank_verbatim, status, parent_id, sec_reference
    concept_name: DataFrame  # concept_id, name_id, role, homotypic
    xref: DataFrame  # authority, ext_id, concept_id, source
    distribution: DataFrame  # concept_id, area_scheme, area_code
    area: DataFrame  # scheme, code, name

    def union(self, other: "Index") -> "Index":
        return Index(*[getattr(self, t).unionByName(getattr(other, t)) for t in self.__dataclass_fields__])


def name_id(backbone: str, taxon: Column) -> Column:
    return F.concat(F.lit(f"{backbone}:name:"), taxon)


def concept_id(backbone: str, taxon: Column) -> Column:
    return F.concat(F.lit(f"{backbone}:concept:"), taxon)


def link_taxa(taxa: DataFrame) -> DataFrame:
    """taxa (taxonid, ..., accepted_id, parent_id, basionym_id) with what the references hit: present basionyms, accepted targets.

    Adds accepted (own id), basionym (null unless present), target_accepted, target_basionym, parent_accepted.
    """
    t = taxa.withColumn("accepted", F.coalesce(F.col("accepted_id") == F.col("taxonid"), F.lit(False)))
    hot = hot_values_of(taxa, ["basionym_id", "accepted_id", "parent_id"])
    present = taxa.select(F.col("taxonid").alias("basionym_id"), F.lit(True).alias("has_basionym"))
    own = F.col("taxonid")
    t = salted_join(t, present, "basionym_id", own, hot["basionym_id"]).withColumn("basionym", F.when(F.col("has_basionym"), F.col("basionym_id")))
    target = t.where("accepted").select(F.col("taxonid").alias("accepted_id"), F.lit(True).alias("target_accepted"), F.col("basionym").alias("target_basionym"))
    parent = t.where("accepted").select(F.col("taxonid").alias("parent_id"), F.lit(True).alias("parent_accepted"))
    t = salted_join(t, target, "accepted_id", own, hot["accepted_id"])
    return salted_join(t, parent, "parent_id", own, hot["parent_id"])


def homotypic(taxon: Column, basionym: Column, target: Column, target_basionym: Column) -> Column:
    """True where the basionyms prove one type for both names, else null (unknown)."""
    proven = (basionym == target) | (basionym == target_basionym) | (target_basionym == taxon)
    return F.when(F.coalesce(proven, F.lit(False)), F.lit(True))


def from_linked(t: DataFrame, distributions: DataFrame, bid: str) -> Index:
    """t: `link_taxa` of taxa (taxonid, canonical, authorship, rank, status, nom_status, published_in, powo, accepted_id, parent_id,
    basionym_id; one row a key), written once as five tables are made of it; distributions (coreid, locality, locationid, seq).
    The index of one backbone."""
    rank, verbatim = v.parse_rank_lenient("rank"), v.rank_verbatim("rank")
    name = t.select(
        name_id(bid, F.col("taxonid")).alias("id"), "canonical", n.canonicalize("canonical").alias("canonical_fold"), "authorship", rank.alias("rank"), verbatim.alias("rank_verbatim"),
        F.nullif("powo", F.lit("")).alias("ipni_id"), "published_in", "nom_status", name_id(bid, F.col("basionym")).alias("basionym_id"),
    )
    accepted = t.where("accepted")
    concept = accepted.select(
        concept_id(bid, F.col("taxonid")).alias("id"), F.lit(bid).alias("backbone_id"), name_id(bid, F.col("taxonid")).alias("accepted_name"), rank.alias("rank"), verbatim.alias("rank_verbatim"),
        v.parse_status("status").alias("status"), F.when(F.col("parent_accepted"), concept_id(bid, F.col("parent_id"))).alias("parent_id"), F.lit(None).cast("string").alias("sec_reference"),
    )
    roles = accepted.select(concept_id(bid, F.col("taxonid")).alias("concept_id"), name_id(bid, F.col("taxonid")).alias("name_id"), F.lit("accepted").alias("role"), F.lit(None).cast("boolean").alias("homotypic"))
    synonyms = t.where(~F.col("accepted") & F.col("target_accepted")).select(
        concept_id(bid, F.col("accepted_id")).alias("concept_id"), name_id(bid, F.col("taxonid")).alias("name_id"), F.lit("synonym").alias("role"),
        homotypic(F.col("taxonid"), F.col("basionym"), F.col("accepted_id"), F.col("target_basionym")).alias("homotypic"),
    )
    xref = accepted.where("powo <> ''").groupBy(F.lit("powo").alias("authority"), F.col("powo").alias("ext_id")).agg(F.max(concept_id(bid, F.col("taxonid"))).alias("concept_id")).withColumn("source", F.lit(None).cast("string"))
    code = F.regexp_replace("locationid", "^TDWG:", "")
    own = distributions.select(F.col("coreid").alias("taxonid"), code.alias("area_code")).where("area_code is not null").distinct()
    distribution = own.join(accepted.select("taxonid"), "taxonid", "left_semi").select(concept_id(bid, F.col("taxonid")).alias("concept_id"), F.lit(SCHEME).alias("area_scheme"), "area_code")
    named = distributions.where("locality is not null and locality <> ''").select(F.lit(SCHEME).alias("scheme"), code.alias("code"), F.col("locality").alias("name"), "seq")
    area = first(named.where("code is not null"), ["scheme", "code"], "seq").drop("seq")
    return Index(name, concept, roles.unionByName(synonyms), xref, distribution, area)


def backbone_report(linked: DataFrame) -> DataFrame:
    """linked: `link_taxa`. One row: names, concepts, synonyms, orphaned, other_ranks and the nomenclatural verdicts of the names that are not accepted."""
    t = linked.withColumn("judgement", v.nom_status("nom_status")["judgement"])
    syn = ~F.col("accepted")
    count = lambda c: F.count_if(c)
    return t.agg(
        F.count(F.lit(1)).alias("names"), count(F.col("accepted")).alias("concepts"), count(syn & F.col("target_accepted")).alias("synonyms"), count(syn & F.col("target_accepted").isNull()).alias("orphaned"),
        count(v.parse_rank_lenient("rank") == "OTHER").alias("other_ranks"), *[count(syn & (F.col("judgement") == j)).alias(f"nom_{j}") for j in ("absent", "acceptable", "disqualifying", "unclassified")],
    )


def top_counts(df: DataFrame, column: str, n_rows: int = 20) -> DataFrame:
    """The most frequent texts of a column: count descending, text ascending."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(column)).limit(n_rows)


def sorted_sample(df: DataFrame, column: str, n_rows: int = 20) -> DataFrame:
    """The first distinct texts of a column in order."""
    return df.select(column).distinct().orderBy(column).limit(n_rows)


def lookup(index: Index) -> DataFrame:
    """(canonical_fold, concept_id, name_id, canonical, authorship, role, homotypic, backbone_id, sec_reference): what names are resolved against."""
    c = index.concept.select(F.col("id").alias("concept_id"), "backbone_id", "sec_reference")
    nm = index.name.select(F.col("id").alias("name_id"), "canonical_fold", "canonical", "authorship")
    return index.concept_name.join(nm, "name_id").join(c, "concept_id")


# --- crosswalk ----------------------------------------------------------------------------------------------------------


def crosswalk(values: DataFrame, keys: DataFrame, rules: tuple[str, ...] = n.RULES) -> DataFrame:
    """values (value) and keys (canonical_fold, concept_id) to (value, canon, rule, concept_id, outcome).

    The first key of the ladder that any name answers to decides: matched when its names belong to one concept, ambiguous
    when they belong to several (a later key does not help), unmatched when no key answers. Each folded value is resolved once.
    """
    canon = values.select(n.canonicalize("value").alias("canon")).where("canon is not null").distinct()
    rungs = canon.withColumn("r", F.explode(n.ladder("canon"))).select("canon", "r.ord", "r.key", "r.rule").where(F.col("rule").isin(*rules))
    targets = keys.groupBy("canonical_fold").agg(F.count_distinct("concept_id").alias("n"), F.min("concept_id").alias("concept_id"))
    hits = rungs.join(targets, rungs["key"] == targets["canonical_fold"])
    best = hits.groupBy("canon").agg(F.min_by(F.struct("rule", "n", "concept_id"), "ord").alias("b")).select("canon", "b.*")
    full = values.withColumn("canon", n.canonicalize("value")).join(best, "canon", "left")
    outcome = F.when(F.col("n") == 1, "matched").when(F.col("n") > 1, "ambiguous").otherwise("unmatched")
    one = F.col("n") == 1
    return full.withColumn("outcome", outcome).withColumn("concept_id", F.when(one, F.col("concept_id"))).withColumn("rule", F.when(one, F.col("rule"))).drop("n")


def trait_values(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """rows (taxon, vocab, vocab_version, dim, value, niche_width, n_systems, seq) with their winner per concept and dimension.

    resolved: `crosswalk` of the distinct taxa. The lowest rule wins, then the first row; resolution is null for exact names.
    """
    hit = resolved.where("outcome = 'matched'").select(F.col("value").alias("taxon"), "concept_id", "rule")
    r = rows.join(hit, "taxon").withColumn("dim", v.parse_dimension("dim")).where("dim is not null").withColumn("rank", n.rule_rank("rule"))
    fields = ["vocab", "vocab_version", "value", "niche_width", "n_systems", "rule"]
    best = r.groupBy("concept_id", "dim").agg(F.min_by(F.struct(*fields), F.struct("rank", "seq")).alias("b")).select("concept_id", "dim", "b.*")
    return best.withColumn("resolution", F.when(F.col("rule") != "exact", F.col("rule"))).drop("rule")


def check_vocabulary(rows: DataFrame, vocab: str, version: str) -> None:
    """Refuse a file whose rows name another vocabulary or version, before anything is written."""
    off = rows.where(~(F.col("vocab").eqNullSafe(vocab) & F.col("vocab_version").eqNullSafe(version))).limit(1).collect()
    if off:
        raise ValueError(f"rows of {off[0]['vocab']} {off[0]['vocab_version']} in a file of {vocab} {version}")


def name_space_entries(rows: DataFrame, resolved: DataFrame, space: str) -> DataFrame:
    """rows (taxon, status, source_id, seq) to (space, ext_id, concept_id, name, aggregate, resolution, status).

    Of rows with one source id the first that resolves is kept.
    """
    hit = resolved.where("outcome = 'matched'").select(F.col("value").alias("taxon"), "concept_id", "rule")
    e = rows.join(hit, "taxon").select(
        F.lit(space).alias("space"), F.col("source_id").alias("ext_id"), "concept_id", F.col("taxon").alias("name"), n.is_aggregate("taxon").alias("aggregate"),
        F.when(F.col("rule") != "exact", F.col("rule")).alias("resolution"), F.coalesce("status", F.lit("")).alias("status"), "seq",
    )
    return first(e, ["space", "ext_id"], "seq").drop("seq")


def crosswalk_report(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """(outcome, rule, n_rows, n_taxa) over rows (taxon)."""
    r = rows.join(resolved.select(F.col("value").alias("taxon"), "outcome", "rule"), "taxon")
    return r.groupBy("outcome", "rule").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("taxon").alias("n_taxa"))


# --- cross-references ---------------------------------------------------------------------------------------------------


def xref_outcomes(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (join_authority, join_id, authority, ext_id) with concept_id and outcome: matched, unmatched or conflicting.

    known: the index's xref. All rows of an (authority, ext_id) that would get several concepts, its present owner included,
    are conflicting.
    """
    by = known.select(F.col("authority").alias("join_authority"), F.col("ext_id").alias("join_id"), "concept_id")
    r = rows.join(by, ["join_authority", "join_id"], "left")
    claims = r.where("concept_id is not null").select("authority", "ext_id", "concept_id")
    touched = claims.select("authority", "ext_id").distinct()
    owners = known.select("authority", "ext_id", "concept_id").join(touched, ["authority", "ext_id"], "left_semi")
    contested = claims.unionByName(owners).groupBy("authority", "ext_id").agg(F.count_distinct("concept_id").alias("k")).where("k > 1").select("authority", "ext_id", F.lit(True).alias("contested"))
    outcome = F.when(F.col("concept_id").isNull(), "unmatched").when(F.col("contested"), "conflicting").otherwise("matched")
    return r.join(contested, ["authority", "ext_id"], "left").withColumn("outcome", outcome).drop("contested")


# --- concept sources ----------------------------------------------------------------------------------------------------


def concept_source(concepts: DataFrame, bid: str = "cdm") -> Index:
    """concepts (uuid, canonical, authorship, rank, status, sec, parent; one row a key) to an index; parents only where present."""
    rank, verbatim = v.parse_rank_lenient("rank"), v.rank_verbatim("rank")
    null = F.lit(None).cast("string")
    name = concepts.select(
        name_id(bid, F.col("uuid")).alias("id"), "canonical", n.canonicalize("canonical").alias("canonical_fold"), "authorship", rank.alias("rank"), verbatim.alias("rank_verbatim"),
        null.alias("ipni_id"), null.alias("published_in"), null.alias("nom_status"), null.alias("basionym_id"),
    )
    up = concepts.select(F.col("uuid").alias("parent"), F.lit(True).alias("has_parent"))
    c = salted_join(concepts, up, "parent", F.col("uuid"), hot_values_of(concepts, ["parent"])["parent"])
    concept = c.select(
        concept_id(bid, F.col("uuid")).alias("id"), F.lit(bid).alias("backbone_id"), name_id(bid, F.col("uuid")).alias("accepted_name"), rank.alias("rank"), verbatim.alias("rank_verbatim"),
        v.parse_status("status").alias("status"), F.when(F.col("has_parent"), concept_id(bid, F.col("parent"))).alias("parent_id"), F.col("sec").alias("sec_reference"),
    )
    roles = concepts.select(concept_id(bid, F.col("uuid")).alias("concept_id"), name_id(bid, F.col("uuid")).alias("name_id"), F.lit("accepted").alias("role"), F.lit(None).cast("boolean").alias("homotypic"))
    spark = concepts.sparkSession
    none = lambda schema: spark.createDataFrame([], schema)
    return Index(name, concept, roles, none("authority string, ext_id string, concept_id string, source string"), none("concept_id string, area_scheme string, area_code string"), none("scheme string, code string, name string"))


def relation_outcomes(relations: DataFrame, existing: DataFrame, bid: str = "cdm") -> DataFrame:
    """relations (from_uuid, to_uuid, relation_type) with relation and outcome: written, name_assertion (misapplied), unresolved or unknown_type.

    existing: (concept_id) of this run and of the index. Types outside the vocabulary are never guessed: `require_known` refuses them.
    """
    ends = existing.select("concept_id").distinct()
    side = lambda c: ends.select(F.col("concept_id").alias(c), F.lit(True).alias(f"has_{c}"))
    r = relations.withColumn("from_id", concept_id(bid, F.col("from_uuid"))).withColumn("to_id", concept_id(bid, F.col("to_uuid"))).withColumn("relation", v.parse_relation("relation_type"))
    r = r.join(side("from_id"), "from_id", "left").join(side("to_id"), "to_id", "left")
    outcome = (
        F.when(F.col("relation").isNull(), "unknown_type").when(~v.is_concept_relation("relation"), "name_assertion")
        .when(F.col("has_from_id") & F.col("has_to_id"), "written").otherwise("unresolved")
    )
    return r.withColumn("outcome", F.coalesce(outcome, F.lit("unresolved"))).drop("has_from_id", "has_to_id")


def require_known(outcomes: DataFrame) -> None:
    """Refuse a file with a relation type outside the vocabulary, before anything is written."""
    off = outcomes.where("outcome = 'unknown_type'").limit(1).collect()
    if off:
        raise ValueError(f"unknown relation type {off[0]['relation_type']!r}")


def edges(outcomes: DataFrame, source: str) -> DataFrame:
    """(from_id, to_id, relation, source), each once, of the relations to be written."""
    return outcomes.where("outcome = 'written'").select("from_id", "to_id", "relation", F.lit(source).alias("source")).distinct()


# --- closure ------------------------------------------------------------------------------------------------------------


def closure(index: Index, donor: str = "wcvp") -> DataFrame:
    """(concept_id, area_scheme, area_code, origin): own areas, and for concepts without any those of the donor backbone's
    concepts that bear the same folded name."""
    own = index.distribution.withColumn("origin", F.lit("own"))
    nm = index.name.select(F.col("id").alias("name_id"), "canonical_fold").where("canonical_fold <> ''")
    bare = index.concept.join(index.distribution.select(F.col("concept_id").alias("id")).distinct(), "id", "left_anti")
    asking = bare.join(nm, bare["accepted_name"] == nm["name_id"]).select(F.col("id").alias("concept_id"), "canonical_fold")
    giving = index.concept.where(F.col("backbone_id") == donor).select(F.col("id").alias("donor_id"))
    bearers = index.concept_name.join(nm, "name_id").select("canonical_fold", F.col("concept_id").alias("donor_id")).join(giving, "donor_id").distinct()
    areas = index.distribution.withColumnRenamed("concept_id", "donor_id")
    by_name = bearers.join(areas, "donor_id").select("canonical_fold", "area_scheme", "area_code").distinct()
    named = asking.join(by_name, "canonical_fold").select("concept_id", "area_scheme", "area_code").distinct()
    return own.unionByName(named.withColumn("origin", F.lit("name")))

