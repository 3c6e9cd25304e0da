"""Reads of the index for batches of concepts: detail, classification, traits, synonyms, translation, catalogues.

Requests are DataFrames; an unknown concept keeps its row with found = false, a known one without content has found = true.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from florilege.functions import names as n
from florilege.functions import vocabulary as v
from florilege.operators import match as mt
from florilege.operators.ingest import Index
from florilege.session import cut

MAX_DEPTH = 10
#: What may be asked for in a list of synonyms, and the longest list that may be asked for.
RELEVANCE = ("all", "publication")
PUBLICATION_RANKS = {"": (), "species": v.EXCLUDED_RANKS}
MOST_SYNONYMS = 2000
#: The notes to a translation.
NOTE_NO_RELATION = "Keine erfasste Relation in den Zielreferenzraum. Das bedeutet NICHT, dass keine Beziehung besteht — nur, dass keine Quelle eine erfasst hat."
NOTE_NOT_EQUAL = "Keine Gleichsetzung: Diese Relation sagt nicht, dass es sich um dasselbe Taxon handelt."
NOTE_UNCERTAIN = "Unbestimmt: Die Quelle legt sich nicht fest, ob enthalten in, enthält oder überlappt — keine Gleichsetzung."
NOTE_NAMES = "Namensgleiche Konzepte im Zielraum — KEINE Übersetzung: keine Quelle behauptet eine Beziehung zwischen ihnen. Nur zur manuellen Prüfung."
NOTE_NO_INVERSE = "Gerichtete Aussage über den Namen der Gegenseite; keine Umkehrrichtung definiert."


def wide(index: Index) -> DataFrame:
    """Every concept with its accepted name; null text as '', the verbatim rank only where the rank is OTHER."""
    nm = index.name.select(F.col("id").alias("accepted_name"), "canonical", "authorship")
    c = index.concept.join(nm, "accepted_name")
    text = lambda x: F.coalesce(x, F.lit(""))
    return c.select(
        "id", "backbone_id", "canonical", text("authorship").alias("authorship"), n.display_text("canonical", text("authorship")).alias("display"), "rank",
        F.when(F.col("rank") == "OTHER", text("rank_verbatim")).otherwise("").alias("rank_verbatim"), "status", text("parent_id").alias("parent_id"), text("sec_reference").alias("sec_reference"),
    )


def classification(index: Index, asked: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """asked (id) to (id, level, ancestor_id, canonical, rank): ancestors root first (level 0), at most `depth` of them.

    The walk ends at a missing ancestor; a cycle is cut by the depth. One join of the open walks a level, as many as there are.
    """
    up = index.concept.where("parent_id is not null").select(F.col("id").alias("at"), F.col("parent_id").alias("to"))
    known = index.concept.select(F.col("id").alias("to"))
    step = cut(up.join(known, "to"))
    walk = asked.join(index.concept.select("id"), "id").select("id", F.col("id").alias("at"), F.lit(0).alias("up"))
    out = None
    for i in range(1, depth + 1):
        walk = cut(walk.join(step, "at").select("id", F.col("to").alias("at"), F.lit(i).alias("up")))
        out = walk if out is None else out.unionByName(walk)
        if not walk.limit(1).collect():
            break
    top = out.groupBy("id").agg(F.max("up").alias("top"))
    shown = wide(index).select(F.col("id").alias("at"), "canonical", "rank")
    return out.join(top, "id").join(shown, "at").select("id", (F.col("top") - F.col("up")).alias("level"), F.col("at").alias("ancestor_id"), "canonical", "rank")


def detail(index: Index, asked: DataFrame) -> DataFrame:
    """asked (id) to one row a concept: its names, cross-references, areas, and whether it is known."""
    syn = index.concept_name.where("role = 'synonym'").join(index.name.select(F.col("id").alias("name_id"), "canonical"), "name_id")
    synonyms = syn.groupBy(F.col("concept_id").alias("id")).agg(F.array_sort(F.collect_list("canonical")).alias("synonyms"))
    areas = index.distribution.groupBy(F.col("concept_id").alias("id")).agg(F.array_sort(F.collect_set("area_code")).alias("areas"))
    xrefs = index.xref.groupBy(F.col("concept_id").alias("id")).agg(F.array_sort(F.collect_list(F.concat_ws(":", "authority", "ext_id"))).alias("xrefs"))
    c = asked.join(wide(index), "id", "left").withColumn("found", F.col("backbone_id").isNotNull())
    return c.join(synonyms, "id", "left").join(areas, "id", "left").join(xrefs, "id", "left")


def context(index: Index, secs: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (id) to (id, sec_title, classification: array of (level, ancestor_id, canonical, rank), root first).

    A concept without ancestors has an empty classification, one whose reference has no title the title ''.
    """
    lines = classification(index, asked).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("level", "ancestor_id", "canonical", "rank"))).alias("classification"))
    titles = secs.select(F.col("id").alias("sec_reference"), F.col("title").alias("sec_title"))
    c = asked.join(index.concept.select("id", "sec_reference"), "id").join(titles, "sec_reference", "left").join(lines, "id", "left")
    none = F.array().cast(lines.schema["classification"].dataType)
    return c.select("id", F.coalesce("sec_title", F.lit("")).alias("sec_title"), F.coalesce("classification", none).alias("classification"))


def by_xref(index: Index, asked: DataFrame) -> DataFrame:
    """asked (authority, ext_id) to those columns and the `detail` of the concept that bears it; found is false for unknown ids."""
    hit = asked.join(index.xref.select("authority", "ext_id", F.col("concept_id").alias("id")), ["authority", "ext_id"], "left")
    full = detail(index, hit.where("id is not null").select("id").distinct())
    return hit.join(full, "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def xrefs_by_authority(index: Index) -> DataFrame:
    """(concept_id, xrefs: map authority -> ids)."""
    lists = index.xref.groupBy("concept_id", "authority").agg(F.array_sort(F.collect_list("ext_id")).alias("ids"))
    return lists.groupBy("concept_id").agg(F.map_from_entries(F.collect_list(F.struct("authority", "ids"))).alias("xrefs"))


def traits(index: Index, values: DataFrame, vocabularies: DataFrame, asked: DataFrame, vocabs: tuple[str, ...] = ()) -> DataFrame:
    """asked (id) to (id, found, vocab, version, dim, value, niche_width, n_systems, resolution, taxonomy, least, greatest, normalized)."""
    if vocabs:
        values = values.where(F.col("vocab").isin(*vocabs))
    of = vocabularies.select("vocab", F.col("version").alias("vocab_version"), "taxonomy")
    t = values.join(of, ["vocab", "vocab_version"], "left").withColumn("s", v.scale(F.col("vocab"), F.col("dim")))
    t = t.select(F.col("concept_id").alias("id"), "vocab", F.col("vocab_version").alias("version"), "dim", "value", "niche_width", "n_systems", "resolution", "taxonomy", "s.*")
    known = asked.join(index.concept.select("id", F.lit(True).alias("found")), "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return known.join(t, "id", "left")


def synonyms(index: Index, ranks: tuple[str, ...] = v.EXCLUDED_RANKS) -> DataFrame:
    """Every synonym of every concept, judged: (concept_id, name_id, canonical, rank, typification, is_basionym, judgement,
    publishable, exclusion, reason, sort keys)."""
    syn = index.concept_name.where("role = 'synonym'").join(index.name.select(F.col("id").alias("name_id"), "canonical", "rank", "nom_status"), "name_id")
    base = index.concept.join(index.name.select(F.col("id").alias("accepted_name"), "basionym_id"), "accepted_name").select(F.col("id").alias("concept_id"), "basionym_id")
    s = syn.join(base, "concept_id").withColumn("is_basionym", F.coalesce(F.col("basionym_id") == F.col("name_id"), F.lit(False))).withColumn("verdict", v.nom_status("nom_status"))
    judgement = F.col("verdict.judgement")
    exclusion = F.when(judgement == "disqualifying", "nom_status").when(judgement == "unclassified", "unclassified_nom_status").when(F.col("rank").isin(*ranks), "rank").otherwise("")
    why = v.nom_status_reason("nom_status", F.col("verdict"))
    kind = v.typification("homotypic")
    reason = (
        F.when(exclusion == "nom_status", why).when(exclusion == "unclassified_nom_status", F.concat(F.lit("withheld for review: "), why))
        .when(exclusion == "rank", F.concat(F.lit("rank "), "rank", F.lit(" excluded by the caller"))).otherwise(F.concat(kind, F.lit(", "), why))
    )
    return s.select(
        "concept_id", "name_id", "canonical", "rank", kind.alias("typification"), "is_basionym", judgement.alias("judgement"), (exclusion == "").alias("publishable"), exclusion.alias("exclusion"),
        reason.alias("reason"), v.normalize_nom_status("nom_status").alias("status_text"), v.typification_order("homotypic").alias("order"),
    )


def synonym_order() -> WindowSpec:
    """The order of a concept's synonyms."""
    return Window.partitionBy("concept_id").orderBy(F.desc("publishable"), "order", F.desc("is_basionym"), "name_id")


def synonym_list(index: Index, asked: DataFrame, relevance: str = "all", rank: str = "", most: int = 0) -> DataFrame:
    """asked (id) to (id, found, name_id, ..., position, truncated, total): each concept's judged synonyms in order.

    relevance: all, or publication for the publishable ones; rank: species leaves lower ranks out of what is publishable;
    most: 0 for no limit, at most MOST_SYNONYMS; truncated counts those beyond it, total those of every verdict. A concept
    without synonyms keeps a row without name. Other values are refused.
    """
    relevance, rank = relevance.strip().lower() or "all", rank.strip().lower()
    if relevance not in RELEVANCE:
        raise ValueError(f"unknown relevance: {relevance}")
    if rank not in PUBLICATION_RANKS:
        raise ValueError(f"unsupported rank: {rank}")
    if not 0 <= most <= MOST_SYNONYMS:
        raise ValueError(f"max is not in 0 to {MOST_SYNONYMS}: {most}")
    judged = synonyms(index, PUBLICATION_RANKS[rank])
    totals = judged.groupBy(F.col("concept_id").alias("id")).agg(F.count(F.lit(1)).alias("total"), F.count_if("publishable").alias("able"))
    listed = judged.where("publishable") if relevance == "publication" else judged
    listed = listed.withColumn("position", F.row_number().over(synonym_order())).drop("order").withColumnRenamed("concept_id", "id")
    listed = listed.where(F.col("position") <= most) if most else listed
    known = asked.join(index.concept.select("id", F.lit(True).alias("found")), "id", "left").join(totals, "id", "left")
    have = F.coalesce("able" if relevance == "publication" else "total", F.lit(0))
    cut_off = F.greatest(have - most, F.lit(0)) if most else F.lit(0).cast("long")
    known = known.select("id", F.coalesce("found", F.lit(False)).alias("found"), cut_off.cast("long").alias("truncated"), F.coalesce("total", F.lit(0)).alias("total"))
    return known.join(listed, "id", "left")


def synonym_summary(judged: DataFrame) -> DataFrame:
    """One row a concept: total, publishable, absent among them, excluded by reason, distinct unclassified texts in order."""
    return judged.groupBy("concept_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("publishable").alias("publishable"), F.count_if(F.col("publishable") & (F.col("judgement") == "absent")).alias("absent"),
        *[F.count_if(F.col("exclusion") == e).alias(f"excluded_{e}") for e in ("nom_status", "unclassified_nom_status", "rank")],
        F.array_sort(F.collect_set(F.when(F.col("judgement") == "unclassified", F.col("status_text")))).alias("unclassified"),
    )


def both_ways(edges: DataFrame) -> DataFrame:
    """(id, partner, relation, source, outgoing): each edge from both its ends, self-loops left out."""
    out = edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("partner"), "relation", "source", F.lit(True).alias("outgoing"))
    back = edges.select(F.col("to_id").alias("id"), F.col("from_id").alias("partner"), "relation", "source", F.lit(False).alias("outgoing"))
    return out.unionByName(back).where("id <> partner")


def translate(index: Index, edges: DataFrame, secs: DataFrame, asked: DataFrame, max_hops: int = 1) -> DataFrame:
    """asked (id, target_sec) to typed candidates in the target reference; a concept without any keeps one row with a note.

    Unknown concepts have no row; an unknown reference is refused. Only direct statements are followed (max_hops 1; more is refused). relation_from_source reads the statement from the
    source's side, null where it has no inverse.
    """
    if max_hops not in (0, 1):
        raise ValueError("only one hop is supported")
    require_secs(secs, asked)
    c = index.concept.select(F.col("id").alias("partner"), F.col("sec_reference").alias("target_sec"))
    e = both_ways(edges).join(c, "partner")
    known = asked.join(index.concept.select("id"), "id").join(secs.select(F.col("id").alias("target_sec"), F.col("title").alias("target_title")), "target_sec", "left")
    j = known.join(e, ["id", "target_sec"], "left")
    seen = F.when(F.col("outgoing"), F.col("relation")).otherwise(v.inverse_relation("relation"))
    note = (
        F.when(F.col("partner").isNull(), NOTE_NO_RELATION).when(~F.col("outgoing") & v.inverse_relation("relation").isNull(), NOTE_NO_INVERSE).when(v.is_equality("relation"), "")
        .when(F.col("relation") == "includes_or_included_in_or_overlaps", NOTE_UNCERTAIN).otherwise(NOTE_NOT_EQUAL)
    )
    return j.select("id", "target_sec", "target_title", "partner", "relation", "outgoing", seen.alias("relation_from_source"), F.coalesce(v.is_equality("relation"), F.lit(False)).alias("is_equality"), "source", note.alias("note"))


def require_secs(secs: DataFrame, asked: DataFrame) -> None:
    """Refuse requests into a reference that does not exist, before anything is translated."""
    off = asked.select("target_sec").distinct().join(secs.select(F.col("id").alias("target_sec")), "target_sec", "left_anti").limit(1).collect()
    if off:
        raise ValueError(f"unknown reference: {off[0]['target_sec']}")


def translate_verbatim(index: Index, lookup: DataFrame, edges: DataFrame, secs: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (rid, verbatim, target_sec) to (rid, verbatim, match_type, confidence, requires_review, ...): names as typed,
    resolved by `match.match` and translated from the concept they stand for.

    A name that does not resolve keeps one row a target with match_type unresolvable and no concept; one that resolves
    by likeness only requires review. Each distinct name is resolved once.
    """
    require_secs(secs, asked)
    texts = asked.select("verbatim").distinct().withColumn("id", F.sha2(F.coalesce("verbatim", F.lit("")), 256))
    entry = mt.match(texts.select("id", "verbatim"), lookup).select("id", "match_type", "confidence", "concept_id", F.col("requires_review").alias("entry_review"))
    read = texts.join(entry, "id", "left").drop("id")
    read = read.withColumnRenamed("verbatim", "text")
    reached = cut(asked.join(read, F.col("verbatim").eqNullSafe(F.col("text")), "left").select("rid", "verbatim", "target_sec", "match_type", "confidence", F.col("concept_id").alias("id"), "entry_review"))
    out = translate(index, edges, secs, reached.where("id is not null").select("id", "target_sec").distinct())
    j = reached.join(out, ["id", "target_sec"], "left")
    return j.withColumn("requires_review", F.coalesce("entry_review", F.lit(True))).drop("entry_review")


def with_name_candidates(index: Index, translated: DataFrame) -> DataFrame:
    """translated with name_candidates (concepts of the target that merely bear the same name, in order) and requires_review.

    They are looked for only where there is no statement, are no translation, and always require review.
    """
    open_ = translated.where("partner is null").select("id", "target_sec").distinct()
    bear = name_candidates(index, open_).groupBy("id", "target_sec").agg(F.array_sort(F.collect_set("candidate")).alias("name_candidates"))
    j = translated.join(bear, ["id", "target_sec"], "left").withColumn("name_candidates", F.coalesce(F.when(F.col("partner").isNull(), F.col("name_candidates")), F.array().cast("array<string>")))
    some = F.size("name_candidates") > 0
    return j.withColumn("note", F.when(some, F.concat_ws(" ", "note", F.lit(NOTE_NAMES))).otherwise(F.col("note"))).withColumn("requires_review", some)


def name_candidates(index: Index, asked: DataFrame) -> DataFrame:
    """asked (id, target_sec) to (id, target_sec, candidate): concepts of the target that merely bear the same folded name."""
    fold = index.name.select(F.col("id").alias("accepted_name"), F.col("canonical_fold"))
    own = index.concept.join(fold, "accepted_name").select("id", "canonical_fold")
    bearers = index.concept_name.join(index.name.select(F.col("id").alias("name_id"), "canonical_fold"), "name_id").join(index.concept.select(F.col("id").alias("concept_id"), F.col("sec_reference").alias("target_sec")), "concept_id")
    pairs = asked.join(own, "id").where("canonical_fold <> ''").join(bearers.select("canonical_fold", "target_sec", F.col("concept_id").alias("candidate")), ["canonical_fold", "target_sec"])
    return pairs.where("candidate <> id").select("id", "target_sec", "candidate").distinct()


def areas(index: Index) -> DataFrame:
    """(scheme, code, name) of every area that occurs, its name where known."""
    used = index.distribution.select(F.col("area_scheme").alias("scheme"), F.col("area_code").alias("code")).distinct()
    return used.join(index.area, ["scheme", "code"], "left").select("scheme", "code", F.coalesce("name", F.lit("")).alias("name"))


def spaces(entries: DataFrame) -> DataFrame:
    """(id, entries, concepts, aggregates) of every name space."""
    return entries.groupBy(F.col("space").alias("id")).agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("concept_id").alias("concepts"), F.count_if("aggregate").alias("aggregates"))


def vocabularies(values: DataFrame) -> DataFrame:
    """(vocab, version, n_values, concepts, dims) of every trait vocabulary that has values."""
    return values.groupBy("vocab", F.col("vocab_version").alias("version")).agg(F.count(F.lit(1)).alias("n_values"), F.count_distinct("concept_id").alias("concepts"), F.array_sort(F.collect_set("dim")).alias("dims"))
