"""Queries over the index: one callable and, where SQL can say it, one DuckDB oracle each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from florilege.functions import names as n
from florilege.functions import vocabulary as v
from florilege.operators import ingest as g
from florilege.operators import match as m
from florilege.plans import index as ix
from florilege.plans import sql as s
from florilege.plans.registry import Registry

registry = Registry()
query, QUERIES, ORACLE = registry.query, registry.queries, registry.oracles


_TYPED = "typed AS (SELECT taxon AS x FROM eive_sample UNION SELECT taxon FROM floraveg_sample UNION SELECT accepted_taxon FROM floraveg_sample UNION SELECT scientfiicname FROM wcvp_taxon UNION SELECT scientific_name FROM cdm_concepts_fixture)"


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    parts = [("eive_sample", "taxon"), ("floraveg_sample", "taxon"), ("floraveg_sample", "accepted_taxon"), ("wcvp_taxon", "scientfiicname"), ("cdm_concepts_fixture", "scientific_name")]
    out = None
    for t, c in parts:
        one = ix.table(spark, sf, t).select(F.col(c).alias("x"))
        out = one if out is None else out.union(one)
    return out.distinct()


# --- scalar functions ---------------------------------------------------------------------------------------------------


@query(f"WITH {_TYPED}, c AS (SELECT x, {s.fold('x')} AS canon FROM typed WHERE x IS NOT NULL) SELECT x, canon, {s.canonical_part('x')} AS canonical_part, {s.author_part('x')} AS author_part, {s.is_aggregate('x')} AS aggregate FROM c")
def name_parts(spark: SparkSession, sf: str) -> DataFrame:
    canonical, author = n.split_verbatim("x")
    return _typed(spark, sf).where("x is not null").select("x", n.canonicalize("x").alias("canon"), canonical.alias("canonical_part"), author.alias("author_part"), n.is_aggregate("x").alias("aggregate"))


@query(
    f"WITH {_TYPED}, c AS (SELECT DISTINCT {s.fold('x')} AS canon FROM typed WHERE x IS NOT NULL), h AS (SELECT canon, {s.hybrid_spaced('canon')} AS sp FROM c) "
    f"SELECT canon, sp AS hybrid_spaced, {s.hybrid_dropped('sp')} AS hybrid_dropped, {s.hybrid_added('sp')} AS hybrid_added, {s.genitive('canon')} AS genitive, {s.autonym('canon')} AS autonym FROM h"
)
def name_variants(spark: SparkSession, sf: str) -> DataFrame:
    h = _typed(spark, sf).where("x is not null").select(n.canonicalize("x").alias("canon")).distinct().withColumn("hybrid_spaced", n.hybrid_spaced("canon"))
    return h.select("canon", "hybrid_spaced", n.hybrid_dropped("hybrid_spaced").alias("hybrid_dropped"), n.hybrid_added("hybrid_spaced").alias("hybrid_added"), n.genitive_variant("canon").alias("genitive"), n.autonym_base("canon").alias("autonym"))


@query(f"WITH {_TYPED}, {s.ladder('typed', 'x')} SELECT canon, ord, key, rule, {s.rule_rank('rule')}::INTEGER AS rule_rank, rule IN ('aggregate_to_nominate', 'autonym') AS flagged FROM rungs")
def name_ladder(spark: SparkSession, sf: str) -> DataFrame:
    canon = _typed(spark, sf).where("x is not null").select(n.canonicalize("x").alias("canon")).distinct()
    return canon.select("canon", F.explode(n.ladder("canon")).alias("r")).select("canon", "r.*", n.rule_rank("r.rule").alias("rule_rank"), n.rule_flagged("r.rule").alias("flagged"))


@query(f"SELECT DISTINCT scientfiicnameauthorship AS a, {s.author('scientfiicnameauthorship')} AS author FROM wcvp_taxon WHERE scientfiicnameauthorship IS NOT NULL")
def author_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return ix.table(spark, sf, "wcvp_taxon").select(F.col("scientfiicnameauthorship").alias("a")).where("a is not null").distinct().withColumn("author", n.normalize_author("a"))


@query(f"""WITH r AS (SELECT DISTINCT taxonrank AS x FROM wcvp_taxon UNION SELECT DISTINCT rank FROM cdm_concepts_fixture UNION SELECT rank FROM rank_list)
SELECT x, {s.rank('x')} AS rank, {s.rank_verbatim('x')} AS verbatim, {s.case(s.rank('x'), v.RANK_ORDER, '11')}::INTEGER AS rank_order FROM r""")
def rank_parsed(spark: SparkSession, sf: str) -> DataFrame:
    parts = [ix.table(spark, sf, t).select(F.col(c).alias("x")) for t, c in (("wcvp_taxon", "taxonrank"), ("cdm_concepts_fixture", "rank"), ("rank_list", "rank"))]
    x = parts[0].union(parts[1]).union(parts[2]).distinct()
    return x.select("x", v.parse_rank_lenient("x").alias("rank"), v.rank_verbatim("x").alias("verbatim"), v.rank_order(v.parse_rank_lenient("x")).alias("rank_order"))


@query(f"SELECT DISTINCT taxonomicstatus AS x, {s.status('taxonomicstatus')} AS status FROM wcvp_taxon")
def status_parsed(spark: SparkSession, sf: str) -> DataFrame:
    return ix.table(spark, sf, "wcvp_taxon").select(F.col("taxonomicstatus").alias("x")).distinct().withColumn("status", v.parse_status("x"))


@query(f"""WITH r AS (SELECT DISTINCT relation_type AS x, {s.relation('relation_type')} AS relation FROM cdm_relations_fixture)
SELECT x, relation, {s.case('relation', v.INVERSE)} AS inverse, relation = 'congruent' AS equality, relation <> 'misapplied' AS concept_relation FROM r""")
def relation_parsed(spark: SparkSession, sf: str) -> DataFrame:
    r = ix.table(spark, sf, "cdm_relations_fixture").select(F.col("relation_type").alias("x")).distinct().withColumn("relation", v.parse_relation("x"))
    return r.select("x", "relation", v.inverse_relation("relation").alias("inverse"), v.is_equality("relation").alias("equality"), v.is_concept_relation("relation").alias("concept_relation"))


@query(f"SELECT DISTINCT nomenclaturalstatus AS x, {s.nom_text('nomenclaturalstatus')} AS text, {s.nom_judgement('nomenclaturalstatus')} AS judgement FROM wcvp_taxon")
def nom_status_judged(spark: SparkSession, sf: str) -> DataFrame:
    x = ix.table(spark, sf, "wcvp_taxon").select(F.col("nomenclaturalstatus").alias("x")).distinct()
    return x.select("x", v.normalize_nom_status("x").alias("text"), v.nom_status("x")["judgement"].alias("judgement"))


_SCALES = """SELECT v.vocab, d.dim, coalesce(s.least, 0)::DOUBLE AS least, coalesce(s.greatest, 0)::DOUBLE AS greatest, coalesce(s.normalized, FALSE) AS normalized
FROM (VALUES ('eive'), ('tichy2023'), ('midolo2023')) v(vocab) CROSS JOIN (VALUES ('M'), ('N'), ('R'), ('L'), ('T'), ('S'), ('disturbance_severity'), ('disturbance_frequency'), ('mowing_frequency'), ('grazing_pressure'), ('soil_disturbance')) d(dim)
LEFT JOIN (VALUES ('eive', 'M', 0, 10, TRUE), ('eive', 'N', 0, 10, TRUE), ('eive', 'R', 0, 10, TRUE), ('eive', 'L', 0, 10, TRUE), ('eive', 'T', 0, 10, TRUE), ('tichy2023', 'L', 1, 9, FALSE), ('tichy2023', 'T', 1, 12, FALSE),
  ('tichy2023', 'M', 1, 12, FALSE), ('tichy2023', 'R', 1, 9, FALSE), ('tichy2023', 'N', 1, 9, FALSE), ('tichy2023', 'S', 0, 9, FALSE)) s(vocab, dim, least, greatest, normalized) ON s.vocab = v.vocab AND s.dim = d.dim"""


@query(_SCALES)
def trait_scales(spark: SparkSession, sf: str) -> DataFrame:
    """The scale of every dimension in every vocabulary, asked for in capitals."""
    every = spark.range(1).select(F.explode(F.array(*[F.lit(x.upper()) for x in v.VOCABULARIES])).alias("v")).select("v", F.explode(F.array(*[F.lit(x.upper()) for x in v.DIMENSIONS])).alias("d"))
    d = every.select(v.parse_vocabulary("v").alias("vocab"), v.parse_dimension("d").alias("dim"))
    return d.withColumn("s", v.scale(F.col("vocab"), F.col("dim"))).select("vocab", "dim", "s.*")


@query(
    "SELECT DISTINCT dynamicproperties AS p, CASE WHEN json_valid(dynamicproperties) THEN coalesce(dynamicproperties ->> '$.powoid', '') ELSE '' END AS powo, scientificnameid AS sid, regexp_replace(trim(scientificnameid), '^urn:lsid:ipni\\.org:names:', '') AS lsid, "
    "trim(translate(namepublishedin, chr(13) || chr(10) || '|', '  /')) AS field FROM wcvp_taxon"
)
def identifiers(spark: SparkSession, sf: str) -> DataFrame:
    t = ix.table(spark, sf, "wcvp_taxon")
    return t.select(F.col("dynamicproperties").alias("p"), n.powo_id("dynamicproperties").alias("powo"), F.col("scientificnameid").alias("sid"), n.lsid_id("scientificnameid").alias("lsid"), n.clean_field("namepublishedin").alias("field")).distinct()


# --- ingest -------------------------------------------------------------------------------------------------------------


@query(s.with_("name", "SELECT * FROM name"))
def ingest_names(spark: SparkSession, sf: str) -> DataFrame:
    return ix.built(spark, sf).name


@query(s.with_("concept", "SELECT * FROM concept"))
def ingest_concepts(spark: SparkSession, sf: str) -> DataFrame:
    return ix.built(spark, sf).concept


@query(s.with_("concept_name", "SELECT * FROM concept_name"))
def ingest_concept_names(spark: SparkSession, sf: str) -> DataFrame:
    return ix.built(spark, sf).concept_name


@query(s.with_("distribution", "SELECT * FROM distribution"))
def ingest_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return ix.built(spark, sf).distribution


@query(s.with_("area", "SELECT * FROM area"))
def ingest_areas(spark: SparkSession, sf: str) -> DataFrame:
    return ix.built(spark, sf).area


@query(s.with_("xref", "SELECT authority, ext_id, concept_id FROM xref"))
def ingest_xrefs(spark: SparkSession, sf: str) -> DataFrame:
    return ix.built(spark, sf).xref.drop("source")


@query(s.with_("linked", f"""SELECT count(*) AS names, count(*) FILTER (accepted) AS concepts, count(*) FILTER (NOT accepted AND target_accepted) AS synonyms, count(*) FILTER (NOT accepted AND NOT target_accepted) AS orphaned, count(*) FILTER ({s.rank('rank')} = 'OTHER') AS other_ranks,
  {', '.join(f"count(*) FILTER (NOT accepted AND {s.nom_judgement('nom_status')} = '{j}') AS nom_{j}" for j in ('absent', 'acceptable', 'disqualifying', 'unclassified'))} FROM linked"""))
def ingest_report(spark: SparkSession, sf: str) -> DataFrame:
    return g.backbone_report(ix.linked(spark, sf))


@query(s.with_("linked", f"SELECT {s.rank_verbatim('rank')} AS verbatim, count(*) AS n FROM linked WHERE {s.rank('rank')} = 'OTHER' GROUP BY 1 ORDER BY n DESC, verbatim LIMIT 20"))
def ingest_other_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return g.top_counts(ix.taxa(spark, sf).select(v.rank_verbatim("rank").alias("verbatim")).where("verbatim is not null"), "verbatim")


@query(s.with_("closure", "SELECT * FROM closure"))
def distribution_closure(spark: SparkSession, sf: str) -> DataFrame:
    return g.closure(ix.index(spark, sf))


@query(s.with_("trait_keys trait_rows", "SELECT value, canon, rule, concept_id, outcome FROM walked", s.crosswalk("trait_rows", "taxon", "trait_keys")))
def trait_crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    return ix.trait_crosswalk.build(spark, sf)


_WON = f"""won AS (SELECT w.concept_id, upper(trim(r.dim)) AS dim, r.vocab, r.vocab_version, r.value, r.niche_width, r.n_systems::DOUBLE AS n_systems, CASE WHEN w.rule <> 'exact' THEN w.rule END AS resolution,
  row_number() OVER (PARTITION BY w.concept_id, upper(trim(r.dim)) ORDER BY {s.rule_rank('w.rule')}, r.seq) AS k FROM trait_rows r JOIN walked w ON w.value = r.taxon AND w.outcome = 'matched')"""


@query(s.with_("trait_keys trait_rows", "SELECT * EXCLUDE (k) FROM won WHERE k = 1", s.crosswalk("trait_rows", "taxon", "trait_keys"), _WON))
def ingest_traits(spark: SparkSession, sf: str) -> DataFrame:
    return ix.trait_values.build(spark, sf).withColumn("n_systems", F.col("n_systems").cast("double"))


@query(s.with_("trait_keys trait_rows", "SELECT w.outcome, w.rule, count(*) AS n_rows, count(DISTINCT r.taxon) AS n_taxa FROM trait_rows r JOIN walked w ON w.value = r.taxon GROUP BY ALL", s.crosswalk("trait_rows", "taxon", "trait_keys")))
def trait_report(spark: SparkSession, sf: str) -> DataFrame:
    return g.crosswalk_report(ix.traits_rows(spark, sf), ix.trait_crosswalk(spark, sf))


@query(s.with_("trait_keys trait_rows", "SELECT DISTINCT value FROM walked WHERE outcome = 'unmatched' ORDER BY value LIMIT 20", s.crosswalk("trait_rows", "taxon", "trait_keys")))
def trait_unmatched_sample(spark: SparkSession, sf: str) -> DataFrame:
    return g.sorted_sample(ix.trait_crosswalk(spark, sf).where("outcome = 'unmatched'"), "value")


_ENTRIES = f"""entries AS (SELECT * EXCLUDE (k) FROM (SELECT 'floraveg' AS space, r.source_id AS ext_id, w.concept_id, r.taxon AS name, {s.is_aggregate('r.taxon')} AS aggregate, CASE WHEN w.rule <> 'exact' THEN w.rule END AS resolution, coalesce(r.status, '') AS status,
  row_number() OVER (PARTITION BY r.source_id ORDER BY r.seq) AS k FROM name_rows r JOIN walked w ON w.value = r.taxon AND w.outcome = 'matched') WHERE k = 1)"""


@query(s.with_("lookup name_rows", "SELECT * FROM entries", s.crosswalk("name_rows", "taxon", "lookup"), _ENTRIES))
def ingest_name_space(spark: SparkSession, sf: str) -> DataFrame:
    return ix.space_entries.build(spark, sf)


_XROWS = """xrows AS (SELECT 'powo' AS join_authority, powo AS join_id, 'ipni' AS authority, 'urn:' || powo AS ext_id FROM taxa WHERE powo <> ''
  UNION ALL SELECT 'powo', powo, 'place', regexp_extract(coalesce(published_in, ''), '^(.*) \\d+:', 1) FROM taxa WHERE powo <> '' AND regexp_extract(coalesce(published_in, ''), '^(.*) \\d+:', 1) <> ''),
xr AS (SELECT r.*, x.concept_id FROM xrows r LEFT JOIN xref x ON x.authority = r.join_authority AND x.ext_id = r.join_id),
claims AS (SELECT authority, ext_id, concept_id FROM xr WHERE concept_id IS NOT NULL UNION ALL SELECT x.authority, x.ext_id, x.concept_id FROM xref x SEMI JOIN (SELECT authority, ext_id FROM xr WHERE concept_id IS NOT NULL) t ON t.authority = x.authority AND t.ext_id = x.ext_id),
bad AS (SELECT authority, ext_id FROM claims GROUP BY ALL HAVING count(DISTINCT concept_id) > 1)"""
_XOUT = "SELECT xr.*, CASE WHEN xr.concept_id IS NULL THEN 'unmatched' WHEN bad.ext_id IS NOT NULL THEN 'conflicting' ELSE 'matched' END AS outcome FROM xr LEFT JOIN bad ON bad.authority = xr.authority AND bad.ext_id = xr.ext_id"


@query(s.with_("xref", _XOUT, _XROWS))
def xref_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return g.xref_outcomes(ix.xref_rows(spark, sf), ix.wcvp(spark, sf).xref)


@query(s.with_("xref", f"SELECT outcome, authority, count(*) AS n_rows, count(DISTINCT concept_id) AS n_concepts FROM ({_XOUT}) GROUP BY ALL", _XROWS))
def xref_report(spark: SparkSession, sf: str) -> DataFrame:
    return xref_outcomes(spark, sf).groupBy("outcome", "authority").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("concept_id").alias("n_concepts"))


@query(s.with_("judged_rels", "SELECT from_id, to_id, relation_type, relation, row_seq, outcome FROM judged_rels"))
def relation_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    existing = ix.concepts(spark, sf).select(g.concept_id("cdm", F.col("uuid")).alias("concept_id"))
    return g.relation_outcomes(ix.relations(spark, sf), existing).select("from_id", "to_id", "relation_type", "relation", "row_seq", "outcome")


@query(s.with_("edges", "SELECT * FROM edges"))
def ingest_relations(spark: SparkSession, sf: str) -> DataFrame:
    return ix.edges.build(spark, sf)


# --- resolution ---------------------------------------------------------------------------------------------------------

#: Characters outside ASCII become one byte each for DuckDB's byte-wise distance.
_BYTES = "translate({}, '×абекоруьстлыіѕхмвнгдзичшщэюяйжцфп', '*ABEKOPYbCTLWISXMVHGDZUQ()[]{{}}JFNR')"


def _match_sql(only: str = "") -> str:
    """The decision table in SQL over `verbatim`, exact steps and the fuzzy step."""
    return f"""
req AS (SELECT id, verbatim, {s.fold(s.canonical_part('verbatim'))} AS canon, {s.author(s.author_part('verbatim'))} AS author, {s.is_aggregate(s.canonical_part('verbatim'))} AS aggregate FROM verbatim WHERE verbatim IS NOT NULL),
b1 AS (SELECT id, author, aggregate, canon, CASE WHEN aggregate THEN {s.strip('canon')} ELSE '' END AS s1 FROM req),
b2 AS (SELECT *, {s.strip('s1')} AS s2 FROM b1), b3 AS (SELECT *, {s.strip('s2')} AS s3 FROM b2),
probes AS (
  SELECT id, 0 AS ord, canon AS key, CASE WHEN aggregate THEN '' ELSE author END AS author, aggregate FROM b3
  UNION ALL SELECT id, 1, s1, '', aggregate FROM b3 WHERE s1 <> '' UNION ALL SELECT id, 2, s2, '', aggregate FROM b3 WHERE s2 <> '' UNION ALL SELECT id, 3, s3, '', aggregate FROM b3 WHERE s3 <> ''
),
ans AS (SELECT p.*, l.concept_id, l.name_id, l.canonical, l.role, l.homotypic, CASE WHEN p.author = '' THEN 'exact' WHEN p.author = {s.author("coalesce(l.authorship, '')")} THEN 'exact_author' END AS kind FROM probes p JOIN lookup l ON l.canonical_fold = p.key WHERE p.key <> ''),
dec AS (
  SELECT id, ord, aggregate, key, max(kind) AS kind, count(DISTINCT concept_id) AS n_any, min(concept_id) AS any_id, count(DISTINCT concept_id) FILTER (kind IS NOT NULL) AS n_won, min(concept_id) FILTER (kind IS NOT NULL) AS won_id,
    count(DISTINCT concept_id) FILTER (kind IS NOT NULL AND role = 'accepted') AS n_acc, min(concept_id) FILTER (kind IS NOT NULL AND role = 'accepted') AS acc_id,
    count(DISTINCT concept_id) FILTER (kind IS NOT NULL AND homotypic) AS n_hom, min(concept_id) FILTER (kind IS NOT NULL AND homotypic) AS hom_id,
    list(canonical ORDER BY concept_id, name_id, canonical) AS all_names, list(canonical ORDER BY concept_id, name_id, canonical) FILTER (kind IS NOT NULL) AS won_names
  FROM ans GROUP BY ALL
),
sole AS (SELECT *, CASE WHEN n_won = 1 THEN won_id WHEN n_acc = 1 THEN acc_id WHEN n_acc = 0 AND n_hom = 1 THEN hom_id END AS sole_id FROM dec),
exact AS (
  SELECT id, ord, aggregate, kind, n_won,
    CASE WHEN NOT aggregate THEN CASE WHEN sole_id IS NOT NULL THEN kind ELSE 'unresolvable' END WHEN ord = 0 THEN CASE WHEN n_any = 1 THEN 'aggregate_alias' ELSE 'unresolvable' END
      WHEN {s.is_aggregate('key')} THEN 'aggregate_alias' ELSE 'aggregate_nominate' END AS match_type,
    CASE WHEN aggregate AND ord = 0 THEN CASE WHEN n_any = 1 THEN any_id END ELSE sole_id END AS concept_id,
    CASE WHEN NOT aggregate THEN CASE WHEN n_won = 0 THEN all_names WHEN sole_id IS NULL THEN won_names ELSE [] END WHEN ord = 0 AND n_any > 1 THEN all_names ELSE [] END AS candidates
  FROM sole WHERE NOT (aggregate AND ord > 0 AND sole_id IS NULL)
),
decided AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS k FROM exact) WHERE k = 1)"""


@query(s.with_("verbatim lookup", """SELECT r.id, d.match_type, d.concept_id, array_to_string(d.candidates, '|') AS candidates FROM req r JOIN decided d ON d.id = r.id""", _match_sql()))
def match_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The requests that the exact steps decide."""
    res = m.match(ix.verbatim(spark, sf), ix.lookup(spark, sf))
    exact = res.where("match_type <> 'fuzzy' and (match_type <> 'unresolvable' or note in ({}))".format(", ".join(f"'{x}'" for x in (m.NOTE_AMBIGUOUS,))) + f" or (note = '{m.NOTE_UNRESOLVABLE}' and size(candidates) > 0)")
    return exact.select("id", "match_type", "concept_id", F.array_join("candidates", "|").alias("candidates"))


_FUZZY = f"""
open AS (SELECT r.id, r.canon, r.aggregate FROM req r ANTI JOIN decided d ON d.id = r.id),
near AS (
  SELECT * FROM (SELECT o.id, o.canon, o.aggregate, l.name_id, l.canonical_fold, row_number() OVER (PARTITION BY o.id ORDER BY abs(length(l.canonical_fold) - length(o.canon)), l.canonical_fold, l.name_id) AS k
    FROM open o JOIN (SELECT DISTINCT name_id, canonical_fold FROM lookup WHERE canonical_fold <> '') l ON substr(l.canonical_fold, 1, 1) = substr(o.canon, 1, 1) AND abs(length(l.canonical_fold) - length(o.canon)) <= 3 WHERE o.canon <> '') WHERE k <= 20
),
scored AS (SELECT a.id, a.aggregate, l.name_id, l.canonical, l.concept_id, 1 - levenshtein({_BYTES.format('a.canon')}, {_BYTES.format('a.canonical_fold')}) / greatest(length(a.canon), length(a.canonical_fold))::DOUBLE AS score FROM near a JOIN lookup l ON l.name_id = a.name_id),
top AS (SELECT *, max(score) OVER (PARTITION BY id) AS best FROM scored WHERE score >= 0.70)"""


@query(s.with_("verbatim lookup", """SELECT id, round(max(best), 9) AS best, CASE WHEN max(best) < 0.85 THEN 'near_miss' WHEN count(DISTINCT concept_id) FILTER (score = best) = 1 THEN 'fuzzy' ELSE 'ambiguous' END AS outcome,
  CASE WHEN max(best) >= 0.85 AND count(DISTINCT concept_id) FILTER (score = best) = 1 THEN min(concept_id) FILTER (score = best) END AS concept_id, count(DISTINCT canonical) AS n_shown FROM top GROUP BY id""", _match_sql(), _FUZZY))
def match_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    """The requests that go through the fuzzy step and find a candidate worth showing."""
    lookup = ix.lookup(spark, sf)
    rows = ix.verbatim(spark, sf).where("verbatim is not null")
    done = match_exact(spark, sf).select("id")
    open_ = m.requests(rows).join(done, "id", "left_anti").select("id", "canon")
    scored = m.fuzzy_candidates(open_, lookup).withColumn("score", n.similarity("canon", "canonical_fold")).where(F.col("score") >= m.SHOWN_FROM)
    best = scored.withColumn("best", F.max("score").over(Window.partitionBy("id")))
    top = F.col("score") == F.col("best")
    one = F.min(F.when(top, F.col("concept_id"))) == F.max(F.when(top, F.col("concept_id")))
    a = best.groupBy("id").agg(F.round(F.max("best"), 9).alias("best"), one.alias("one"), F.min(F.when(top, F.col("concept_id"))).alias("cid"), F.count_distinct("canonical").alias("n_shown"))
    sure = F.col("best") >= m.FUZZY_FROM
    return a.select("id", "best", F.when(~sure, "near_miss").when(F.col("one"), "fuzzy").otherwise("ambiguous").alias("outcome"), F.when(sure & F.col("one"), F.col("cid")).alias("concept_id"), "n_shown")


_BATCH = f"""
shown AS (SELECT id, list(canonical ORDER BY score DESC, canonical) AS names FROM (SELECT id, canonical, max(score) AS score FROM top GROUP BY ALL) GROUP BY id),
fz AS (SELECT id, max(best) AS best, count(DISTINCT concept_id) FILTER (score = best) AS n, min(concept_id) FILTER (score = best) AS cid, list(canonical ORDER BY concept_id, name_id, canonical) FILTER (score = best) AS names FROM top GROUP BY id),
res AS (
  SELECT id, match_type, CASE match_type WHEN 'exact_author' THEN 0.99 WHEN 'exact' THEN 0.90 WHEN 'aggregate_alias' THEN 0.95 WHEN 'aggregate_nominate' THEN 0.88 END AS confidence, concept_id, match_type = 'unresolvable' AS requires_review,
    CASE match_type WHEN 'aggregate_alias' THEN {s.q(m.NOTE_AGGREGATE)} WHEN 'aggregate_nominate' THEN {s.q(m.NOTE_NOMINATE)} WHEN 'unresolvable' THEN CASE WHEN NOT aggregate AND n_won = 0 THEN {s.q(m.NOTE_UNRESOLVABLE)} ELSE {s.q(m.NOTE_AMBIGUOUS)} END END AS note, candidates FROM decided
  UNION ALL SELECT o.id, CASE WHEN f.best >= 0.85 AND f.n = 1 THEN 'fuzzy' ELSE 'unresolvable' END, CASE WHEN f.best >= 0.85 AND f.n = 1 THEN f.best END, CASE WHEN f.best >= 0.85 AND f.n = 1 THEN f.cid END, TRUE,
    CASE WHEN f.id IS NULL THEN CASE WHEN o.aggregate THEN {s.q(m.NOTE_AGGREGATE_OPEN)} ELSE {s.q(m.NOTE_UNRESOLVABLE)} END
      ELSE CASE WHEN o.aggregate THEN {s.q(m.AGGREGATE_PREFIX)} ELSE '' END || CASE WHEN f.best < 0.85 THEN {s.q(m.NOTE_NEAR_MISS)} WHEN f.n = 1 THEN {s.q(m.NOTE_FUZZY)} ELSE {s.q(m.NOTE_FUZZY_AMBIGUOUS)} END END,
    CASE WHEN f.id IS NULL THEN [] WHEN f.best < 0.85 THEN w.names ELSE f.names END FROM open o LEFT JOIN fz f ON f.id = o.id LEFT JOIN shown w ON w.id = o.id
)"""


#: The spelling of each concept in the name space.
_SPELLED = """spelled AS (SELECT concept_id, arg_min(name, (status <> 'accepted', ext_id)) FILTER (aggregate) AS of_aggregate, arg_min(name, (status <> 'accepted', ext_id)) FILTER (NOT aggregate) AS of_plain, arg_min(name, ext_id) AS of_any FROM entries GROUP BY concept_id)"""


@query(s.with_("verbatim lookup name_rows", """SELECT r.id, r.match_type, round(r.confidence, 9)::DOUBLE AS confidence, r.concept_id, r.requires_review, r.note, array_to_string(r.candidates, '|') AS candidates,
  CASE WHEN r.concept_id IS NOT NULL THEN coalesce(CASE WHEN q.aggregate THEN z.of_aggregate ELSE coalesce(z.of_plain, z.of_any) END, '') END AS target_space_name,
  CASE WHEN r.concept_id IS NOT NULL THEN CASE WHEN NOT q.aggregate THEN '' WHEN z.of_aggregate IS NOT NULL THEN 'known' ELSE 'unresolvable' END END AS aggregate_policy
  FROM res r JOIN req q ON q.id = r.id LEFT JOIN spelled z ON z.concept_id = r.concept_id""", _match_sql(), _FUZZY, _BATCH, s.crosswalk("name_rows", "taxon", "lookup"), _ENTRIES, _SPELLED))  # fmt: skip
def match_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Every request with its result, in the spelling of the name space."""
    rows = ix.verbatim(spark, sf)
    out = m.in_space(m.match(rows, ix.lookup(spark, sf)), rows, ix.space_entries(spark, sf), "floraveg")
    return out.withColumn("candidates", F.array_join("candidates", "|")).withColumn("confidence", F.round("confidence", 9))


@query(s.with_("verbatim lookup concept", """SELECT r.id, d.match_type, d.concept_id FROM req r JOIN decided d ON d.id = r.id WHERE d.concept_id IS NOT NULL""", _match_sql().replace("JOIN lookup l ON l.canonical_fold = p.key", "JOIN (SELECT * FROM lookup WHERE backbone_id = 'cdm' AND sec_reference = (SELECT min(sec_reference) FROM lookup)) l ON l.canonical_fold = p.key")))
def match_in_reference(spark: SparkSession, sf: str) -> DataFrame:
    """The requests that names of one backbone and one reference decide for sure."""
    sec = ix.secs(spark, sf).agg(F.min("id")).first()[0]
    res = m.match(ix.verbatim(spark, sf), m.narrowed(ix.lookup(spark, sf), "cdm", sec))
    return res.where("concept_id is not null and match_type <> 'fuzzy'").select("id", "match_type", "concept_id")
