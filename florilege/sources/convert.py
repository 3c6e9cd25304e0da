"""Converters from the shapes in which sources publish to the shapes that are ingested."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.functions import names as n
from florilege.operators.analysis import seed_union

#: The properties of harvested items and the authorities they stand for; of the two of gbif the first goes first.
GBIF = ("P14607", "P846")
PROPERTIES = {"P10585": "colxr", "P12380": "euromed", "P12100": "floraveg", "P7715": "wfo", "P3151": "inat"}


def wide_traits(wide: DataFrame, taxon: str, dims: dict[str, str], vocab: str, version: str, widths: dict[str, str] | None = None, systems: dict[str, str] | None = None) -> DataFrame:
    """One row a taxon with a column a dimension to one row a taxon and dimension; missing values (empty, x, NA) are left out."""
    null = F.lit(None).cast("double")
    of = lambda table, d: n.parse_value(F.col(table[d]).cast("string")) if table and d in table else null
    cells = F.array(*[F.struct(F.lit(d).alias("dim"), n.parse_value(F.col(c).cast("string")).alias("value"), of(widths, d).alias("niche_width"), of(systems, d).cast("int").alias("n_systems")) for d, c in dims.items()])
    long = wide.select(F.col(taxon).alias("taxon"), F.explode(cells).alias("x")).select("taxon", F.lit(vocab).alias("vocab"), F.lit(version).alias("vocab_version"), "x.*")
    return long.where("value is not null and taxon <> ''")


def name_list(rows: DataFrame, taxon: str, source_id: str, rank: str | None = None, status: str | None = None, synonym: str | None = None, accepted: str | None = None) -> DataFrame:
    """A published name list to (taxon, rank, status, accepted_taxon, source_id), rows without a taxon left out.

    status: a column of words, taken in lower case; synonym: a column that is true for synonyms instead; with neither every
    name is accepted. Only names that are not accepted have an accepted taxon.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c else F.lit("")
    word = F.lower(F.trim(text(status))) if status else F.when(F.coalesce(F.col(synonym).cast("boolean"), F.lit(False)), "synonym").otherwise("accepted") if synonym else F.lit("accepted")
    return rows.where(text(taxon) != "").select(
        text(taxon).alias("taxon"), text(rank).alias("rank"), word.alias("status"), F.when(word == "accepted", F.lit("")).otherwise(text(accepted)).alias("accepted_taxon"), text(source_id).alias("source_id"),
    )


def harvest(spark: SparkSession, first: str, second: str, enriched: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three files of a harvest, an object a line: two seeds (item, v) and the enriched items (item, a column a property)."""
    seed = "item string, v string"
    wide = "item string, " + ", ".join(f"{p} string" for p in (*GBIF, *PROPERTIES))
    return spark.read.schema(seed).json(first), spark.read.schema(seed).json(second), spark.read.schema(wide).json(enriched)


def identifier_rows(first: DataFrame, second: DataFrame, enriched: DataFrame, joinable: DataFrame | None = None) -> DataFrame:
    """A harvest to cross-reference rows (join_authority, join_id, authority, ext_id, wikidata_qid).

    Items that neither id makes joinable are left out. Of two differing ids the first is the join id, unless only the second
    one joins. Every item gives itself, its gbif id from the first property that has one, and the simple authorities.
    """
    seeds = seed_union(first, second, joinable)
    b = n.lsid_id("second_id")
    if joinable is None:
        keyed = seeds.select("item", F.coalesce(F.nullif("first_id", F.lit("")), b).alias("join_id"))
    else:
        known = joinable.select("id").distinct()
        flag = lambda c: known.select(F.col("id").alias(c), F.lit(True).alias(f"{c}_ok"))
        s = seeds.withColumn("bare", b).join(flag("first_id"), "first_id", "left").join(flag("bare"), "bare", "left")
        no = F.lit(False)
        keyed = s.select("item", n.pick_join_id(F.col("first_id"), F.col("bare"), F.coalesce("first_id_ok", no), F.coalesce("bare_ok", no)).alias("join_id"))
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    cells = [(F.col("item"), "wikidata"), (F.coalesce(*[filled(p) for p in GBIF]), "gbif"), *[(filled(p), a) for p, a in PROPERTIES.items()]]
    last = enriched.groupBy("item").agg(*[F.max(p).alias(p) for p in (*GBIF, *PROPERTIES)])
    long = keyed.join(last, "item", "left").select("item", "join_id", F.explode(F.array(*[F.struct(F.lit(a).alias("authority"), c.alias("ext_id")) for c, a in cells])).alias("x"))
    return long.where("x.ext_id is not null").select(F.lit("powo").alias("join_authority"), "join_id", "x.authority", "x.ext_id", F.col("item").alias("wikidata_qid"))


def assemble_relations(halves: DataFrame) -> DataFrame:
    """halves (relationship, holder, end: 'from' or 'to') to (relationship, from_uuid, to_uuid); a third holder is refused."""
    g = halves.groupBy("relationship").agg(
        F.max(F.when(F.col("end") == "from", F.col("holder"))).alias("from_uuid"), F.max(F.when(F.col("end") == "to", F.col("holder"))).alias("to_uuid"), F.count_distinct("holder").alias("holders")
    )
    third = g.where("holders > 2").limit(1).collect()
    if third:
        raise ValueError(f"relationship {third[0]['relationship']} has more than two holders")
    return g.drop("holders")


def pick_classification(nodes: DataFrame) -> DataFrame:
    """nodes (concept, node, classification, status, sec_classification) to one row a concept: the node in the reference's own
    classification first, else the smallest node; the smallest status."""
    own = F.when(F.col("classification") == F.col("sec_classification"), 0).otherwise(1)
    return nodes.groupBy("concept").agg(F.min_by(F.struct("node", "classification"), F.struct(own, "node")).alias("n"), F.min("status").alias("status")).select("concept", "n.*", "status")
