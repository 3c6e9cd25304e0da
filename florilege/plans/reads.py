"""Queries that read the index for requests: suggestions, details, traits, synonyms, translation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from florilege.functions import vocabulary as v
from florilege.operators import ingest as g
from florilege.operators import lookup as lk
from florilege.operators import suggest as sg
from florilege.plans import index as ix
from florilege.plans import sql as s
from florilege.plans.reference import _ENTRIES, _SPELLED, _WON, _match_sql
from florilege.plans.registry import Registry

registry = Registry()
query, QUERIES, ORACLE = registry.query, registry.queries, registry.oracles


# --- suggestions --------------------------------------------------------------------------------------------------------

#: The beginnings that are asked for, one of them of two words, one with a collective mark.
PREFIXES = ("ca", "so", "sol", "solquenthria", "kan", "dun", "bor", "ma", "rinum", "fe", "tel agg.", "solquenthria b", "ze", "vor", "xx", "a")
_TOK = "list_filter(regexp_split_to_array({}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, q) for i, q in enumerate(PREFIXES)], "qid int, q string")


_SUGGEST = f"""
irows AS (SELECT cn.concept_id || '|' || cn.name_id AS rowid, cn.concept_id, 0 AS is_aggregate, {_TOK.format('n.canonical_fold')} AS tokens FROM concept_name cn JOIN name n ON n.id = cn.name_id
  UNION ALL SELECT concept_id || '|' || space || '|' || ext_id, concept_id, 1, {_TOK.format(s.fold('name'))} FROM entries WHERE aggregate),
stats AS (SELECT count(*) AS nn, avg(len(tokens)) AS mean FROM irows),
asked AS (SELECT * FROM (VALUES {', '.join(f"({i}, {s.q(x)})" for i, x in enumerate(PREFIXES))}) t(qid, q)),
texts AS (SELECT qid, CASE WHEN {s.strip('f')} <> '' THEN {s.strip('f')} ELSE f END AS t FROM (SELECT qid, {s.fold('q')} AS f FROM asked)),
qs AS (SELECT qid, {_TOK.format('t')} AS words FROM texts WHERE length(t) >= 2),
occ AS (SELECT q.qid, r.rowid, r.concept_id, r.is_aggregate, len(r.tokens) AS len, unnest(range(1, len(r.tokens) - len(q.words) + 2)) AS pos, r.tokens, q.words FROM qs q JOIN irows r ON len(r.tokens) >= len(q.words) WHERE len(q.words) > 0),
hit AS (SELECT qid, rowid, concept_id, is_aggregate, len, count(*) AS f FROM occ WHERE tokens[pos:pos + len(words) - 2] = words[1:len(words) - 1] AND starts_with(tokens[pos + len(words) - 1], words[-1]) GROUP BY ALL),
per AS (SELECT qid, count(*) AS n FROM hit GROUP BY qid),
m AS (SELECT h.qid, h.rowid, h.concept_id, h.is_aggregate, -greatest(ln((s.nn - p.n + 0.5) / (p.n + 0.5)), 1e-6) * h.f * 2.2 / (h.f + 1.2 * (0.25 + 0.75 * h.len / s.mean)) AS score FROM hit h JOIN per p ON p.qid = h.qid, stats s)"""


@query(s.with_("lookup name_rows", "SELECT qid, rowid, concept_id, is_aggregate, round(score, 9) AS score FROM m", s.crosswalk("name_rows", "taxon", "lookup"), _ENTRIES, _SUGGEST))
def suggest_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Every index row that a beginning matches, with its BM25 score."""
    rows = ix.search_rows(spark, sf)
    return sg.matches(rows, _asked(spark)).drop("n").withColumn("score", F.round("score", 9))


def _suggest_sql(area: str, rank: str) -> str:
    order = " ".join(f"WHEN '{r}' THEN {i}" for r, i in v.RANK_ORDER.items())
    where = f"WHERE c.rank = '{rank}'" if rank else ""
    return f"""
pool AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, rowid) AS k FROM m) WHERE k <= 5000),
there AS (SELECT DISTINCT concept_id FROM closure WHERE area_code = '{area}'),
cand AS (SELECT * FROM pool UNION ALL SELECT m.qid, m.rowid, m.concept_id, m.is_aggregate, 1e18 FROM m SEMI JOIN there t ON t.concept_id = m.concept_id ANTI JOIN pool p ON p.qid = m.qid AND p.rowid = m.rowid),
each AS (SELECT x.qid, x.concept_id, min(x.score) AS score, max(x.is_aggregate) AS aggregate FROM cand x GROUP BY ALL),
full_ AS (SELECT e.*, an.canonical, an.rank, c.status, coalesce(c.sec_reference, '') AS sec_reference, (t.concept_id IS NOT NULL) AS in_area FROM each e JOIN concept c ON c.id = e.concept_id JOIN name an ON an.id = c.accepted_name LEFT JOIN there t ON t.concept_id = e.concept_id {where}),
fetched AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY in_area DESC, score, concept_id) AS f FROM full_) WHERE f <= 40),
placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY in_area DESC, (status = 'ACCEPTED') DESC, CASE rank {order} ELSE 11 END, score, f) AS position FROM fetched)"""


def _suggest_main(area: str, rank: str = "") -> str:
    return s.with_("lookup name_rows closure", "SELECT qid, position, concept_id, canonical, rank, status, round(score, 9) AS score, in_area, aggregate, sec_reference FROM placed WHERE position <= 10", s.crosswalk("name_rows", "taxon", "lookup"), _ENTRIES, _SUGGEST, _suggest_sql(area, rank))


def _suggest(spark: SparkSession, sf: str, area: str, ranks: tuple[str, ...] = ()) -> DataFrame:
    i = ix.index(spark, sf)
    rows = ix.search_rows(spark, sf)
    return sg.suggest(rows, _asked(spark), i, ix.closure(spark, sf), area=area, ranks=ranks).withColumn("score", F.round("score", 9))


@query(_suggest_main(""))
def suggest_plain(spark: SparkSession, sf: str) -> DataFrame:
    return _suggest(spark, sf, "")


@query(_suggest_main("VMQ"))
def suggest_in_area(spark: SparkSession, sf: str) -> DataFrame:
    return _suggest(spark, sf, "vmq")


@query(s.with_("lookup name_rows closure", f"""SELECT p.qid, p.position, p.concept_id, p.canonical, p.rank, p.status, round(p.score, 9) AS score, p.in_area, p.aggregate, p.sec_reference,
  coalesce(CASE WHEN {s.is_aggregate('a.q')} THEN z.of_aggregate ELSE coalesce(z.of_plain, z.of_any) END, '') AS target_space_name FROM placed p JOIN asked a ON a.qid = p.qid LEFT JOIN spelled z ON z.concept_id = p.concept_id WHERE position <= 10""",
    s.crosswalk("name_rows", "taxon", "lookup"), _ENTRIES, _SUGGEST, _suggest_sql("VMQ", ""), _SPELLED))
def suggest_in_space(spark: SparkSession, sf: str) -> DataFrame:
    """Suggestions with the spelling that the name space has for each concept."""
    return sg.in_space(_suggest(spark, sf, "vmq"), _asked(spark), ix.space_entries(spark, sf), "floraveg")


@query(s.with_("concept", "SELECT backbone_id AS id, count(*) AS concepts, count(*) FILTER (rank = 'GENUS') AS genera FROM concept GROUP BY 1"))
def catalogue_backbones(spark: SparkSession, sf: str) -> DataFrame:
    """The backbones that a suggestion can come from, and how much of it they hold."""
    c = ix.index(spark, sf).concept
    return c.groupBy(F.col("backbone_id").alias("id")).agg(F.count(F.lit(1)).alias("concepts"), F.count_if(F.col("rank") == "GENUS").alias("genera"))


@query(_suggest_main("VMQ", "GENUS"))
def suggest_genera(spark: SparkSession, sf: str) -> DataFrame:
    return _suggest(spark, sf, "VMQ", ("GENUS",))


@query(s.with_("lookup name_rows", "SELECT qid, count(*) AS index_rows, count(DISTINCT m.concept_id) AS concepts, count(DISTINCT m.concept_id) FILTER (c.rank = 'GENUS') AS genera, count(DISTINCT score) AS scores, round(min(score), 9) AS best, count(*) FILTER (score = low) AS at_best FROM (SELECT *, min(score) OVER (PARTITION BY qid) AS low FROM m) m JOIN concept c ON c.id = m.concept_id GROUP BY qid", s.crosswalk("name_rows", "taxon", "lookup"), _ENTRIES, _SUGGEST))
def suggest_composition(spark: SparkSession, sf: str) -> DataFrame:
    """What the beginnings match: rows, concepts, genera, distinct scores, ties at the best."""
    i = ix.index(spark, sf)
    m = sg.matches(ix.search_rows(spark, sf), _asked(spark)).join(i.concept.select(F.col("id").alias("concept_id"), "rank"), "concept_id")
    low = m.withColumn("low", F.min("score").over(Window.partitionBy("qid")))
    return low.groupBy("qid").agg(
        F.count(F.lit(1)).alias("index_rows"), F.count_distinct("concept_id").alias("concepts"), F.count_distinct(F.when(F.col("rank") == "GENUS", F.col("concept_id"))).alias("genera"),
        F.count_distinct("score").alias("scores"), F.round(F.min("score"), 9).alias("best"), F.count_if(F.col("score") == F.col("low")).alias("at_best"),
    )


_BEGINNINGS = "asked AS (SELECT DISTINCT q AS qid, q FROM (SELECT unnest(list_transform(range(1, len(w) + 1), lambda i: array_to_string(w[1:i], ' '))) AS q FROM (SELECT list_filter(string_split(taxon, ' '), lambda x: x <> '') AS w FROM name_rows))),\n"
_SUGGEST_TYPED = _SUGGEST[: _SUGGEST.index("asked AS")] + _BEGINNINGS + _SUGGEST[_SUGGEST.index("texts AS") :]


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    """Every beginning of every typed name that ends with a word: its first word, its first two and so on, each once."""
    w = ix.name_rows(spark, sf).select(F.filter(F.split("taxon", " "), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    q = w.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.array_join(F.slice("w", F.lit(1), i), " "))).alias("q")).distinct()
    return q.select(F.col("q").alias("qid"), "q")


@query(s.with_("lookup name_rows", "SELECT qid, rowid, concept_id, is_aggregate, round(score, 9) AS score FROM m", s.crosswalk("name_rows", "taxon", "lookup"), _ENTRIES, _SUGGEST_TYPED))
def suggest_typed_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Every index row that a beginning of a typed name matches."""
    rows = ix.search_rows(spark, sf)
    return sg.matches(rows, _typed(spark, sf)).drop("n").withColumn("score", F.round("score", 9))


def _suggest_typed_main(area: str, rank: str = "") -> str:
    return s.with_("lookup name_rows closure", "SELECT qid, position, concept_id, canonical, rank, status, round(score, 9) AS score, in_area, aggregate, sec_reference FROM placed WHERE position <= 10", s.crosswalk("name_rows", "taxon", "lookup"), _ENTRIES, _SUGGEST_TYPED, _suggest_sql(area, rank))


def _suggest_typed(spark: SparkSession, sf: str, area: str, ranks: tuple[str, ...] = ()) -> DataFrame:
    i = ix.index(spark, sf)
    rows = ix.search_rows(spark, sf)
    return sg.suggest(rows, _typed(spark, sf), i, ix.closure(spark, sf), area=area, ranks=ranks).withColumn("score", F.round("score", 9))


@query(_suggest_typed_main(""))
def suggest_typed_plain(spark: SparkSession, sf: str) -> DataFrame:
    return _suggest_typed(spark, sf, "")


@query(_suggest_typed_main("VMQ"))
def suggest_typed_in_area(spark: SparkSession, sf: str) -> DataFrame:
    return _suggest_typed(spark, sf, "vmq")


@query(_suggest_typed_main("VMQ", "GENUS"))
def suggest_typed_genera(spark: SparkSession, sf: str) -> DataFrame:
    return _suggest_typed(spark, sf, "VMQ", ("GENUS",))


@query(s.with_("lookup name_rows", "SELECT qid, count(*) AS index_rows, count(DISTINCT m.concept_id) AS concepts, count(DISTINCT m.concept_id) FILTER (c.rank = 'GENUS') AS genera, count(DISTINCT score) AS scores, round(min(score), 9) AS best, count(*) FILTER (score = low) AS at_best FROM (SELECT *, min(score) OVER (PARTITION BY qid) AS low FROM m) m JOIN concept c ON c.id = m.concept_id GROUP BY qid", s.crosswalk("name_rows", "taxon", "lookup"), _ENTRIES, _SUGGEST_TYPED))
def suggest_typed_composition(spark: SparkSession, sf: str) -> DataFrame:
    """What the beginnings of typed names match: rows, concepts, genera, distinct scores, ties at the best."""
    i = ix.index(spark, sf)
    m = sg.matches(ix.search_rows(spark, sf), _typed(spark, sf)).join(i.concept.select(F.col("id").alias("concept_id"), "rank"), "concept_id")
    low = m.withColumn("low", F.min("score").over(Window.partitionBy("qid")))
    return low.groupBy("qid").agg(
        F.count(F.lit(1)).alias("index_rows"), F.count_distinct("concept_id").alias("concepts"), F.count_distinct(F.when(F.col("rank") == "GENUS", F.col("concept_id"))).alias("genera"),
        F.count_distinct("score").alias("scores"), F.round(F.min("score"), 9).alias("best"), F.count_if(F.col("score") == F.col("low")).alias("at_best"),
    )


# --- details ------------------------------------------------------------------------------------------------------------

_WIDE = """wide AS (SELECT c.id, c.backbone_id, n.canonical, coalesce(n.authorship, '') AS authorship, n.canonical || CASE WHEN coalesce(n.authorship, '') <> '' THEN ' ' || n.authorship ELSE '' END AS display, c.rank,
  CASE WHEN c.rank = 'OTHER' THEN coalesce(c.rank_verbatim, '') ELSE '' END AS rank_verbatim, c.status, coalesce(c.parent_id, '') AS parent_id, coalesce(c.sec_reference, '') AS sec_reference FROM concept c JOIN name n ON n.id = c.accepted_name)"""
_ASK = "ask AS (SELECT id FROM concept UNION ALL SELECT 'wcvp:concept:none')"


def _ask(index: g.Index, spark: SparkSession) -> DataFrame:
    return index.concept.select("id").unionByName(spark.createDataFrame([("wcvp:concept:none",)], "id string"))


@query(s.with_("concept name", "SELECT * FROM wide", _WIDE))
def concept_wide(spark: SparkSession, sf: str) -> DataFrame:
    return lk.wide(ix.index(spark, sf))


@query(s.with_("concept name concept_name distribution xref", """SELECT a.id, w.* EXCLUDE (id), (w.id IS NOT NULL) AS found, y.synonyms, d.areas, x.xrefs FROM ask a LEFT JOIN wide w ON w.id = a.id
LEFT JOIN (SELECT concept_id, array_to_string(list(n.canonical ORDER BY n.canonical), '|') AS synonyms FROM concept_name cn JOIN name n ON n.id = cn.name_id WHERE role = 'synonym' GROUP BY 1) y ON y.concept_id = a.id
LEFT JOIN (SELECT concept_id, array_to_string(list(DISTINCT area_code ORDER BY area_code), '|') AS areas FROM distribution GROUP BY 1) d ON d.concept_id = a.id
LEFT JOIN (SELECT concept_id, array_to_string(list(authority || ':' || ext_id ORDER BY authority || ':' || ext_id), '|') AS xrefs FROM xref GROUP BY 1) x ON x.concept_id = a.id""", _WIDE, _ASK))
def concept_detail(spark: SparkSession, sf: str) -> DataFrame:
    i = ix.index(spark, sf)
    d = lk.detail(i, _ask(i, spark))
    return d.withColumns({c: F.when(F.col(c).isNotNull(), F.array_join(c, "|")) for c in ("synonyms", "areas", "xrefs")})


@query(s.with_("concept name", "SELECT k.id, top - up AS level, k.node AS ancestor_id, n.canonical, c.rank FROM (SELECT *, max(up) OVER (PARTITION BY id) AS top FROM walk WHERE up > 0) k JOIN concept c ON c.id = k.node JOIN name n ON n.id = c.accepted_name",
    "walk AS (SELECT id, id AS node, 0 AS up FROM concept UNION ALL SELECT w.id, p.id, w.up + 1 FROM walk w JOIN concept c ON c.id = w.node JOIN concept p ON p.id = c.parent_id WHERE w.up < 10)", recursive=True))
def concept_classification(spark: SparkSession, sf: str) -> DataFrame:
    i = ix.index(spark, sf)
    return lk.classification(i, i.concept.select("id"))


@query(s.with_("xref concept", "SELECT x.authority, x.ext_id, c.id, c.rank, c.status FROM xref x JOIN concept c ON c.id = x.concept_id"))
def xref_reverse(spark: SparkSession, sf: str) -> DataFrame:
    i = ix.index(spark, sf)
    return lk.by_xref(i, i.xref.select("authority", "ext_id")).select("authority", "ext_id", "id", "rank", "status")


@query(s.with_("concept name secs", f"""SELECT c.id, coalesce(t.title, '') AS sec_title, coalesce(w.path, '') AS classification FROM concept c LEFT JOIN secs t ON t.id = c.sec_reference
  LEFT JOIN (SELECT k.id, string_agg(n.canonical, ' > ' ORDER BY k.up DESC) AS path FROM walk k JOIN concept p ON p.id = k.node JOIN name n ON n.id = p.accepted_name WHERE k.up > 0 GROUP BY k.id) w ON w.id = c.id""",
    "walk AS (SELECT id, id AS node, 0 AS up FROM concept UNION ALL SELECT w.id, p.id, w.up + 1 FROM walk w JOIN concept c ON c.id = w.node JOIN concept p ON p.id = c.parent_id WHERE w.up < 10)", recursive=True))
def concept_context(spark: SparkSession, sf: str) -> DataFrame:
    """The rest of a concept's detail: the title of its reference and its classification from the root down."""
    i = ix.index(spark, sf)
    c = lk.context(i, ix.secs(spark, sf), i.concept.select("id"))
    return c.select("id", "sec_title", F.array_join(F.transform("classification", lambda x: x["canonical"]), " > ").alias("classification"))


@query(s.with_("xref", "SELECT concept_id, string_agg(authority || '=' || ids, ';' ORDER BY authority) AS xrefs FROM (SELECT concept_id, authority, string_agg(ext_id, ',' ORDER BY ext_id) AS ids FROM xref GROUP BY ALL) GROUP BY 1"))
def concept_xrefs(spark: SparkSession, sf: str) -> DataFrame:
    """Each concept's cross-references as a map from authority to ids."""
    x = lk.xrefs_by_authority(ix.index(spark, sf))
    entries = F.transform(F.array_sort(F.map_entries("xrefs")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")))
    return x.select("concept_id", F.array_join(entries, ";").alias("xrefs"))


@query(s.with_("concept trait_keys trait_rows", """SELECT a.id, (c.id IS NOT NULL) AS found, w.vocab, w.vocab_version AS version, w.dim, w.value, w.niche_width, w.n_systems, w.resolution, CASE WHEN w.vocab IS NOT NULL THEN 'EIVE' END AS taxonomy,
  CASE WHEN w.vocab IS NOT NULL THEN 0.0 END::DOUBLE AS least, CASE WHEN w.vocab IS NOT NULL THEN 10.0 END::DOUBLE AS greatest, CASE WHEN w.vocab IS NOT NULL THEN TRUE END AS normalized
  FROM ask a LEFT JOIN concept c ON c.id = a.id LEFT JOIN (SELECT * FROM won WHERE k = 1) w ON w.concept_id = a.id""", s.crosswalk("trait_rows", "taxon", "trait_keys"), _WON, _ASK))  # fmt: skip
def concept_traits(spark: SparkSession, sf: str) -> DataFrame:
    i = ix.index(spark, sf)
    vocabularies = spark.createDataFrame([("eive", "1.0", "EIVE")], "vocab string, version string, taxonomy string")
    t = lk.traits(i, ix.trait_values(spark, sf), vocabularies, _ask(i, spark))
    return t.withColumn("n_systems", F.col("n_systems").cast("double"))


_SYN = f"""syn AS (SELECT cn.concept_id, n.id AS name_id, n.canonical, n.rank, CASE WHEN cn.homotypic THEN 'homotypic' WHEN cn.homotypic IS NULL THEN 'unknown' ELSE 'heterotypic' END AS typification, coalesce(an.basionym_id = n.id, FALSE) AS is_basionym,
  {s.nom_judgement('n.nom_status')} AS judgement, {s.nom_text('n.nom_status')} AS status_text, CASE WHEN cn.homotypic THEN 0 WHEN cn.homotypic IS NULL THEN 1 ELSE 2 END AS ord
  FROM concept_name cn JOIN name n ON n.id = cn.name_id JOIN concept c ON c.id = cn.concept_id JOIN name an ON an.id = c.accepted_name WHERE cn.role = 'synonym'),
judged AS (SELECT *, CASE WHEN judgement = 'disqualifying' THEN 'nom_status' WHEN judgement = 'unclassified' THEN 'unclassified_nom_status' WHEN rank IN ('VARIETY', 'SUBVARIETY', 'FORM', 'SUBFORM') THEN 'rank' ELSE '' END AS exclusion FROM syn)"""


@query(s.with_("concept_name name concept", "SELECT concept_id, name_id, canonical, rank, typification, is_basionym, judgement, exclusion = '' AS publishable, exclusion, row_number() OVER (PARTITION BY concept_id ORDER BY (exclusion = '') DESC, ord, is_basionym DESC, name_id) AS position FROM judged", _SYN))
def synonyms_ranked(spark: SparkSession, sf: str) -> DataFrame:
    j = lk.synonyms(ix.index(spark, sf))
    return j.withColumn("position", F.row_number().over(lk.synonym_order())).drop("reason", "status_text", "order")


@query(s.with_("concept_name name concept", """SELECT concept_id, count(*) AS total, count(*) FILTER (exclusion = '') AS publishable, count(*) FILTER (exclusion = '' AND judgement = 'absent') AS absent, count(*) FILTER (exclusion = 'nom_status') AS excluded_nom_status,
  count(*) FILTER (exclusion = 'unclassified_nom_status') AS excluded_unclassified_nom_status, count(*) FILTER (exclusion = 'rank') AS excluded_rank, coalesce(array_to_string(list(DISTINCT status_text ORDER BY status_text) FILTER (judgement = 'unclassified'), '|'), '') AS unclassified FROM judged GROUP BY 1""", _SYN))  # fmt: skip
def synonyms_summary(spark: SparkSession, sf: str) -> DataFrame:
    return lk.synonym_summary(lk.synonyms(ix.index(spark, sf))).withColumn("unclassified", F.array_join("unclassified", "|"))


_NOM_WHY = f"""CASE WHEN judgement = 'absent' THEN 'no nom_status recorded (not the same as verified clean)' WHEN len(matched) = 0 THEN 'nom_status ' || {s.quoted('raw')} || ' matches no known token'
  ELSE 'nom_status ' || {s.quoted('raw')} || ': ' || judgement || ' (' || array_to_string(list_transform(matched, lambda x: {s.quoted('x')}), ', ') || ')' END"""


@query(s.with_("concept_name name concept", f"""SELECT concept_id, name_id, exclusion, CASE exclusion WHEN 'nom_status' THEN why WHEN 'unclassified_nom_status' THEN 'withheld for review: ' || why WHEN 'rank' THEN 'rank ' || rank || ' excluded by the caller' ELSE typification || ', ' || why END AS reason
  FROM (SELECT *, {_NOM_WHY} AS why FROM (SELECT j.*, coalesce(n.nom_status, '') AS raw, {s.nom_matched('n.nom_status')} AS matched FROM judged j JOIN name n ON n.id = j.name_id))""", _SYN))  # fmt: skip
def synonyms_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return lk.synonyms(ix.index(spark, sf)).select("concept_id", "name_id", "exclusion", "reason")


@query(s.with_("concept_name name concept", """SELECT c.id, TRUE AS found, p.name_id, p.canonical, p.position::DOUBLE AS position, (coalesce(t.n, 0) - least(coalesce(t.n, 0), 2))::BIGINT AS truncated, coalesce(t.total, 0)::BIGINT AS total FROM concept c
  LEFT JOIN (SELECT concept_id, count(*) FILTER (exclusion = '') AS n, count(*) AS total FROM judged GROUP BY 1) t ON t.concept_id = c.id
  LEFT JOIN (SELECT concept_id, name_id, canonical, row_number() OVER (PARTITION BY concept_id ORDER BY ord, is_basionym DESC, name_id) AS position FROM judged WHERE exclusion = '') p ON p.concept_id = c.id AND p.position <= 2
  UNION ALL SELECT 'wcvp:concept:none', FALSE, NULL, NULL, NULL, 0, 0""", _SYN))  # fmt: skip
def synonyms_to_publish(spark: SparkSession, sf: str) -> DataFrame:
    """At most two synonyms of every concept that may be published, species rank asked for, and how many more there are."""
    i = ix.index(spark, sf)
    return lk.synonym_list(i, _ask(i, spark), relevance="publication", rank="species", most=2).select("id", "found", "name_id", "canonical", F.col("position").cast("double").alias("position"), "truncated", "total")


# --- translation --------------------------------------------------------------------------------------------------------

_BOTH = "both_ways AS (SELECT from_id AS id, to_id AS partner, relation, source, TRUE AS outgoing FROM edges WHERE from_id <> to_id UNION ALL SELECT to_id, from_id, relation, source, FALSE FROM edges WHERE from_id <> to_id)"
_INV = s.case("k.relation", v.INVERSE)
_EVERY_PAIR = "pairs AS (SELECT c.id, t.id AS target_sec, t.title AS target_title FROM concept c CROSS JOIN secs t WHERE c.backbone_id = 'cdm')"


def _into_every(spark: SparkSession, sf: str, index: g.Index) -> DataFrame:
    """Every concept of the concept source, asked into every reference, its own included."""
    targets = ix.secs(spark, sf).select(F.col("id").alias("target_sec"))
    return index.concept.where("backbone_id = 'cdm'").select("id").join(targets, F.lit(True))  # as many rows as are asked for


@query(s.with_("concept edges secs", f"""SELECT p.id, p.target_sec, p.target_title, k.partner, k.relation, k.outgoing, CASE WHEN k.outgoing THEN k.relation ELSE {_INV} END AS relation_from_source, coalesce(k.relation = 'congruent', FALSE) AS is_equality, k.source,
  CASE WHEN k.partner IS NULL THEN {s.q(lk.NOTE_NO_RELATION)} WHEN NOT k.outgoing AND {_INV} IS NULL THEN {s.q(lk.NOTE_NO_INVERSE)} WHEN k.relation = 'congruent' THEN '' WHEN k.relation = 'includes_or_included_in_or_overlaps' THEN {s.q(lk.NOTE_UNCERTAIN)} ELSE {s.q(lk.NOTE_NOT_EQUAL)} END AS note
  FROM pairs p LEFT JOIN (SELECT b.*, c.sec_reference FROM both_ways b JOIN concept c ON c.id = b.partner) k ON k.id = p.id AND k.sec_reference = p.target_sec""", _BOTH, _EVERY_PAIR))  # fmt: skip
def translate_all(spark: SparkSession, sf: str) -> DataFrame:
    i = ix.index(spark, sf)
    return lk.translate(i, ix.edges(spark, sf), ix.secs(spark, sf), _into_every(spark, sf, i))


@query(s.with_("concept name lookup secs", "SELECT DISTINCT p.id, p.target_sec, l.concept_id AS candidate FROM pairs p JOIN concept c ON c.id = p.id JOIN name n ON n.id = c.accepted_name AND n.canonical_fold <> '' JOIN lookup l ON l.canonical_fold = n.canonical_fold AND l.sec_reference = p.target_sec WHERE l.concept_id <> p.id", _EVERY_PAIR))
def translate_by_name(spark: SparkSession, sf: str) -> DataFrame:
    i = ix.index(spark, sf)
    return lk.name_candidates(i, _into_every(spark, sf, i))


_TYPED_IN = """typed AS (SELECT 'f:' || seq AS rid, taxon AS verbatim FROM name_rows),
hit AS (SELECT t.rid, d.match_type, d.concept_id FROM typed t JOIN decided d ON d.id = t.rid WHERE d.concept_id IS NOT NULL)"""


@query(s.with_("name_rows verbatim lookup concept edges secs", f"""SELECT h.rid, h.match_type, h.concept_id AS id, t.id AS target_sec, k.partner, k.relation, k.outgoing, FALSE AS requires_review,
  CASE WHEN k.partner IS NULL THEN {s.q(lk.NOTE_NO_RELATION)} WHEN NOT k.outgoing AND {_INV} IS NULL THEN {s.q(lk.NOTE_NO_INVERSE)} WHEN k.relation = 'congruent' THEN '' WHEN k.relation = 'includes_or_included_in_or_overlaps' THEN {s.q(lk.NOTE_UNCERTAIN)} ELSE {s.q(lk.NOTE_NOT_EQUAL)} END AS note
  FROM hit h CROSS JOIN secs t LEFT JOIN (SELECT b.*, c.sec_reference FROM both_ways b JOIN concept c ON c.id = b.partner) k ON k.id = h.concept_id AND k.sec_reference = t.id""", _match_sql(), _TYPED_IN, _BOTH))  # fmt: skip
def translate_typed(spark: SparkSession, sf: str) -> DataFrame:
    """The names of the name list that resolve for sure, translated into every reference."""
    i = ix.index(spark, sf)
    asked = ix.name_rows(spark, sf).select(F.concat(F.lit("f:"), F.col("seq").cast("string")).alias("rid"), F.col("taxon").alias("verbatim"))
    each = asked.join(ix.secs(spark, sf).select(F.col("id").alias("target_sec")), F.lit(True))
    t = lk.translate_verbatim(i, ix.lookup(spark, sf), ix.edges(spark, sf), ix.secs(spark, sf), each)
    return t.where("match_type not in ('fuzzy', 'unresolvable')").select("rid", "match_type", "id", "target_sec", "partner", "relation", "outgoing", "requires_review", "note")


@query(s.with_("concept name lookup edges secs", f"""SELECT p.id, p.target_sec, count(DISTINCT b.candidate) AS n_candidates, count(DISTINCT b.candidate) > 0 AS requires_review,
  CASE WHEN count(DISTINCT b.candidate) > 0 THEN {s.q(lk.NOTE_NO_RELATION + ' ' + lk.NOTE_NAMES)} ELSE {s.q(lk.NOTE_NO_RELATION)} END AS note FROM pairs p
  ANTI JOIN (SELECT b.id, c.sec_reference FROM both_ways b JOIN concept c ON c.id = b.partner) k ON k.id = p.id AND k.sec_reference = p.target_sec
  LEFT JOIN (SELECT c.id, l.sec_reference, l.concept_id AS candidate FROM concept c JOIN name n ON n.id = c.accepted_name AND n.canonical_fold <> '' JOIN lookup l ON l.canonical_fold = n.canonical_fold WHERE l.concept_id <> c.id) b ON b.id = p.id AND b.sec_reference = p.target_sec
  GROUP BY p.id, p.target_sec""", _BOTH, _EVERY_PAIR))  # fmt: skip
def translate_hints(spark: SparkSession, sf: str) -> DataFrame:
    """Where no statement leads into a reference: how many of its concepts merely bear the same name, to be reviewed."""
    i = ix.index(spark, sf)
    asked = _into_every(spark, sf, i)
    t = lk.translate(i, ix.edges(spark, sf), ix.secs(spark, sf), asked)
    return lk.with_name_candidates(i, t).where("partner is null").select("id", "target_sec", F.size("name_candidates").cast("long").alias("n_candidates"), "requires_review", "note")
