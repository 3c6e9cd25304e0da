"""Analyses over the whole index: statistics, ambiguity, rule sets, bridges, winners, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from florilege.functions import names as n
from florilege.functions import vocabulary as v
from florilege.operators import analysis as an
from florilege.operators import ingest as g
from florilege.operators import suggest as sg
from florilege.plans import index as ix
from florilege.plans import sql as s
from florilege.plans.reference import _ENTRIES, _WON, _XOUT, _XROWS
from florilege.plans.reads import _SUGGEST, _asked, _suggest, _suggest_sql
from florilege.plans.registry import Registry
from florilege.session import cut

registry = Registry()
query, QUERIES, ORACLE = registry.query, registry.queries, registry.oracles


# --- analyses -----------------------------------------------------------------------------------------------------------


_STATS = """SELECT 'name' AS table_name, 'rows' AS measure, '' AS part, count(*) AS n FROM name UNION ALL SELECT 'concept', 'rows', '', count(*) FROM concept UNION ALL SELECT 'distribution', 'rows', '', count(*) FROM distribution
UNION ALL SELECT 'xref', 'rows', '', count(*) FROM xref UNION ALL SELECT 'search', 'rows', '', count(*) FROM irows UNION ALL SELECT 'trait', 'rows', '', count(*) FROM won WHERE k = 1 UNION ALL SELECT 'trait', 'concepts', '', count(DISTINCT concept_id) FROM won WHERE k = 1
UNION ALL SELECT 'distribution', 'areas', '', count(DISTINCT area_code) FROM distribution UNION ALL SELECT 'distribution', 'by area_code', area_code, count(DISTINCT concept_id) FROM distribution GROUP BY ALL
UNION ALL SELECT 'name', 'by rank', rank, count(*) FROM name GROUP BY ALL UNION ALL SELECT 'concept', 'by rank', rank, count(*) FROM concept GROUP BY ALL UNION ALL SELECT 'concept', 'by backbone_id', backbone_id, count(*) FROM concept GROUP BY ALL
UNION ALL SELECT 'concept_name', 'by role', role, count(*) FROM concept_name GROUP BY ALL UNION ALL SELECT 'trait', 'by vocab', vocab, count(DISTINCT concept_id) FROM won WHERE k = 1 GROUP BY ALL
UNION ALL SELECT 'trait', 'by vocabularies', v, count(*) FROM (SELECT concept_id, string_agg(DISTINCT vocab, '+' ORDER BY vocab) AS v FROM won WHERE k = 1 GROUP BY 1) GROUP BY ALL"""
_IROWS = """irows AS (SELECT cn.concept_id FROM concept_name cn JOIN name n ON n.id = cn.name_id UNION ALL SELECT concept_id FROM entries WHERE aggregate)"""


@query(s.with_("name concept concept_name distribution xref lookup name_rows trait_keys trait_rows", _STATS, s.crosswalk("name_rows", "taxon", "lookup"), _ENTRIES, s.crosswalk("trait_rows", "taxon", "trait_keys", "2"), _WON.replace("walked", "walked2"), _IROWS))
def index_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return an.statistics(ix.index(spark, sf), ix.trait_values(spark, sf), ix.search_rows(spark, sf))


@query(s.with_("trait_keys trait_rows", "SELECT vocab, coalesce(resolution, 'exact') AS resolution, count(DISTINCT concept_id) AS concepts FROM won WHERE k = 1 GROUP BY ALL", s.crosswalk("trait_rows", "taxon", "trait_keys"), _WON))
def trait_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return ix.trait_values(spark, sf).groupBy("vocab", F.coalesce("resolution", F.lit("exact")).alias("resolution")).agg(F.count_distinct("concept_id").alias("concepts"))


@query(s.with_("lookup", """SELECT 'all' AS filter, count(*) AS folds, count(*) FILTER (k > 1) AS ambiguous, max(k) AS most FROM (SELECT canonical_fold, count(DISTINCT concept_id) AS k FROM lookup GROUP BY 1)
UNION ALL SELECT 'wcvp', count(*), count(*) FILTER (k > 1), max(k) FROM (SELECT canonical_fold, count(DISTINCT concept_id) AS k FROM lookup WHERE backbone_id = 'wcvp' GROUP BY 1)"""))  # fmt: skip
def ambiguity(spark: SparkSession, sf: str) -> DataFrame:
    """Folded names that several concepts bear, before and after a backbone is chosen."""
    l = ix.lookup(spark, sf)

    def count(df: DataFrame, label: str) -> DataFrame:
        k = df.groupBy("canonical_fold").agg(F.count_distinct("concept_id").alias("k"))
        return k.agg(F.count(F.lit(1)).alias("folds"), F.count_if(F.col("k") > 1).alias("ambiguous"), F.max("k").alias("most")).select(F.lit(label).alias("filter"), "folds", "ambiguous", "most")

    return count(l, "all").unionByName(count(l.where("backbone_id = 'wcvp'"), "wcvp"))


_HYBRID = ("hybrid_spacing", "hybrid_marker_dropped", "hybrid_marker_added")
#: The measured sets of rules, the first is what the others are compared with.
_TEN = {
    "exact": (), "hybrid_spacing": _HYBRID[:1], "hybrid_marker_dropped": _HYBRID[1:2], "hybrid_marker_added": _HYBRID[2:], "hybrid": _HYBRID, "aggregate_marked": ("aggregate",),
    "aggregate": ("aggregate", "aggregate_to_nominate"), "autonym": ("autonym",), "orthography_genitive": ("orthography_genitive",), "all": n.RULES[1:],
}
_COUNTED = [f"{x}_{o}" for x in ("rows", "taxa") for o in ("matched", "unmatched", "ambiguous")]


@query(s.with_("lookup name_rows", f"""SELECT *, {', '.join(f"{c} - max({c}) FILTER (rules = 'exact') OVER () AS {c}_delta" for c in _COUNTED)} FROM (
  SELECT s.rules, {', '.join(f"coalesce(sum({'t.rows' if c[0] == 'r' else '1'}) FILTER ({ {'matched': 'b.n = 1', 'unmatched': 'b.n IS NULL', 'ambiguous': 'b.n > 1'}[c[5:]] }), 0)::BIGINT AS {c}" for c in _COUNTED)}
  FROM (SELECT {s.fold('taxon')} AS canon, count(*) AS rows FROM name_rows GROUP BY 1) t CROSS JOIN (SELECT DISTINCT rules FROM sets) s
  LEFT JOIN (SELECT rules, canon, n FROM (SELECT x.rules, r.canon, t.n, row_number() OVER (PARTITION BY x.rules, r.canon ORDER BY r.ord) AS k FROM rungs r JOIN sets x ON x.rule = r.rule JOIN targets t ON t.canonical_fold = r.key) WHERE k = 1) b ON b.canon = t.canon AND b.rules = s.rules GROUP BY s.rules)""",
    s.crosswalk("name_rows", "taxon", "lookup"), "sets AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{r}')" for k, rs in _TEN.items() for r in ("exact", *rs)) + ") v(rules, rule))"))
def rule_ablation(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes of the name list under the ten measured sets of ladder rules, by row and by name, and their distance to exact names alone."""
    rows = ix.name_rows(spark, sf).groupBy(n.canonicalize("taxon").alias("canon")).agg(F.count(F.lit(1)).alias("rows"))
    targets = ix.lookup(spark, sf).groupBy("canonical_fold").agg(F.count_distinct("concept_id").alias("n"))
    rungs = rows.select("canon", "rows", F.explode(n.ladder("canon")).alias("r"))
    hits = rungs.join(targets, F.col("r.key") == F.col("canonical_fold")).select("canon", "rows", "r.ord", "r.rule", "n")
    sets = F.explode(F.array(*[F.struct(F.lit(k).alias("rules"), F.array(*[F.lit(r) for r in ("exact", *rs)]).alias("allowed")) for k, rs in _TEN.items()]))
    by_set = hits.withColumn("x", sets).where(F.array_contains("x.allowed", F.col("rule"))).groupBy("x.rules", "canon").agg(F.min_by("n", "ord").alias("n"), F.first("rows").alias("rows"))
    one, several = F.col("n") == 1, F.col("n") > 1
    counted = by_set.groupBy("rules").agg(
        F.sum(F.when(one, F.col("rows"))).alias("rows_matched"), F.sum(F.when(several, F.col("rows"))).alias("rows_ambiguous"), F.count_if(one).alias("taxa_matched"), F.count_if(several).alias("taxa_ambiguous"),
    )
    every = rows.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("taxa")).withColumn("rules", F.explode(F.array(*[F.lit(k) for k in _TEN])))
    out = every.join(counted, "rules", "left").na.fill(0)
    out = out.withColumns({f"{x}_unmatched": F.col(x) - F.col(f"{x}_matched") - F.col(f"{x}_ambiguous") for x in ("rows", "taxa")})
    together = Window.partitionBy(F.lit(1))  # ten rows
    return out.select("rules", *_COUNTED, *[(F.col(c) - F.max(F.when(F.col("rules") == "exact", F.col(c))).over(together)).alias(f"{c}_delta") for c in _COUNTED])


@query(s.with_("concept edges", "SELECT c.sec_reference, count(*) AS isolated FROM concept c WHERE c.backbone_id = 'cdm' AND c.id NOT IN (SELECT from_id FROM edges) AND c.id NOT IN (SELECT to_id FROM edges) GROUP BY 1"))
def isolated_concepts(spark: SparkSession, sf: str) -> DataFrame:
    e = ix.edges(spark, sf)
    ends = e.select(F.col("from_id").alias("id")).unionByName(e.select(F.col("to_id").alias("id"))).distinct()
    return ix.index(spark, sf).concept.where("backbone_id = 'cdm'").join(ends, "id", "left_anti").groupBy("sec_reference").agg(F.count(F.lit(1)).alias("isolated"))


@query(s.with_("concept secs", "SELECT c.sec_reference, t.title, count(*) AS concepts FROM concept c LEFT JOIN secs t ON t.id = c.sec_reference WHERE c.backbone_id = 'cdm' GROUP BY ALL"))
def concepts_per_sec(spark: SparkSession, sf: str) -> DataFrame:
    c = ix.index(spark, sf).concept.where("backbone_id = 'cdm'").groupBy("sec_reference").agg(F.count(F.lit(1)).alias("concepts"))
    return c.join(ix.secs(spark, sf).withColumnRenamed("id", "sec_reference"), "sec_reference", "left").select("sec_reference", "title", "concepts")


@query(s.with_("concept_name name", "SELECT cn.role, n.rank, cn.homotypic, count(*) AS n, count(*) FILTER (coalesce(n.nom_status, '') <> '') AS with_status FROM concept_name cn JOIN name n ON n.id = cn.name_id GROUP BY ALL"))
def synonym_histogram(spark: SparkSession, sf: str) -> DataFrame:
    i = ix.index(spark, sf)
    j = i.concept_name.join(i.name.select(F.col("id").alias("name_id"), "rank", "nom_status"), "name_id")
    return j.groupBy("role", "rank", "homotypic").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("nom_status", F.lit("")) != "").alias("with_status"))


@query(s.with_("concept name edges", """SELECT n.canonical_fold, count(DISTINCT c.id) AS concepts FROM concept c JOIN name n ON n.id = c.accepted_name WHERE n.canonical_fold IN (SELECT n2.canonical_fold FROM concept c2 JOIN name n2 ON n2.id = c2.accepted_name WHERE c2.id IN (SELECT from_id FROM edges UNION SELECT to_id FROM edges)) GROUP BY 1"""))
def edge_reach(spark: SparkSession, sf: str) -> DataFrame:
    """Folded names of concepts with an edge, and how many concepts of any backbone bear each as accepted name."""
    i, e = ix.index(spark, sf), ix.edges(spark, sf)
    folded = i.concept.join(i.name.select(F.col("id").alias("accepted_name"), "canonical_fold"), "accepted_name").select("id", "canonical_fold")
    ends = e.select(F.col("from_id").alias("id")).unionByName(e.select(F.col("to_id").alias("id"))).distinct()
    reached = folded.join(ends, "id", "left_semi").select("canonical_fold").distinct()
    return folded.join(reached, "canonical_fold", "left_semi").groupBy("canonical_fold").agg(F.count_distinct("id").alias("concepts"))


@query(s.with_("lookup trait_rows name_rows cdm", f"""SELECT (SELECT count(DISTINCT f) FROM open) AS unresolved, (SELECT count(DISTINCT f) FROM open WHERE f IN (SELECT f FROM l1)) AS by_name_list, (SELECT count(DISTINCT f) FROM open WHERE f IN (SELECT f FROM l2)) AS by_concepts,
  (SELECT count(DISTINCT f) FROM open WHERE f IN (SELECT f FROM l1 UNION SELECT f FROM l2)) AS by_any, (SELECT count(DISTINCT f) FROM open WHERE f IN (SELECT f FROM l1) AND f NOT IN (SELECT f FROM l2)) AS by_name_list_only,
  (SELECT count(DISTINCT f) FROM open WHERE f IN (SELECT f FROM l2) AND f NOT IN (SELECT f FROM l1)) AS by_concepts_only""",
    f"l1 AS (SELECT DISTINCT {s.fold('taxon')} AS f FROM name_rows), l2 AS (SELECT DISTINCT {s.fold('canonical')} AS f FROM cdm WHERE canonical IS NOT NULL), open AS (SELECT DISTINCT {s.fold('taxon')} AS f FROM trait_rows WHERE {s.fold('taxon')} NOT IN (SELECT canonical_fold FROM lookup WHERE canonical_fold IS NOT NULL))"))
def bridge(spark: SparkSession, sf: str) -> DataFrame:
    """Trait names that the index does not know, and how many of them other lists do."""
    fold = lambda df, c: df.select(n.canonicalize(c).alias("f")).where("f is not null").distinct()
    known = ix.lookup(spark, sf).select(F.col("canonical_fold").alias("f")).distinct()
    open_ = fold(ix.traits_rows(spark, sf), "taxon").join(known, "f", "left_anti")
    lists = fold(ix.name_rows(spark, sf), "taxon").withColumn("l", F.lit(1)).unionByName(fold(ix.concepts(spark, sf), "canonical").withColumn("l", F.lit(2)))
    sources = lists.groupBy("f").agg(F.bit_or("l").alias("l"))
    j = open_.join(sources, "f", "left")
    bit = lambda k: F.col("l").bitwiseAND(k) != 0
    return j.agg(F.count(F.lit(1)).alias("unresolved"), F.count_if(bit(1)).alias("by_name_list"), F.count_if(bit(2)).alias("by_concepts"), F.count_if(F.col("l").isNotNull()).alias("by_any"), F.count_if(F.col("l") == 1).alias("by_name_list_only"), F.count_if(F.col("l") == 2).alias("by_concepts_only"))


@query(s.with_("lookup trait_rows name_rows", """SELECT step, count(*) AS unresolved, count(l.f) AS recovered, count(*) FILTER (CASE step WHEN 'exact' THEN l.acc IN (SELECT f FROM known) ELSE l.acc IN (SELECT canon FROM answered) END) AS bridgeable
  FROM (SELECT 'exact' AS step, f FROM asked WHERE f NOT IN (SELECT f FROM known) UNION ALL SELECT 'ladder', f FROM asked WHERE f NOT IN (SELECT canon FROM answered)) o LEFT JOIN links l ON l.f = o.f GROUP BY 1""",
    f"asked AS (SELECT DISTINCT {s.fold('taxon')} AS f FROM trait_rows), links AS (SELECT {s.fold('taxon')} AS f, arg_max({s.fold("coalesce(accepted_taxon, '')")}, seq) AS acc FROM name_rows GROUP BY 1), known AS (SELECT DISTINCT canonical_fold AS f FROM lookup WHERE canonical_fold <> '')",
    "both_sides AS (SELECT f AS v FROM asked UNION SELECT acc FROM links)", s.ladder("both_sides", "v"), "answered AS (SELECT DISTINCT canon FROM rungs WHERE key IN (SELECT f FROM known))"))
def bridge_links(spark: SparkSession, sf: str) -> DataFrame:
    """Trait names that the index does not know, those that the name list has, and those whose accepted name there the index knows:
    by equality, and by the ladder on both sides. Of several rows of a name the last one's link counts."""
    known = ix.lookup(spark, sf).where("canonical_fold <> ''").select(F.col("canonical_fold").alias("key")).distinct()
    asked = ix.traits_rows(spark, sf).select(n.canonicalize("taxon").alias("f")).distinct()
    acc = n.canonicalize(F.coalesce("accepted_taxon", F.lit("")))
    links = ix.name_rows(spark, sf).groupBy(n.canonicalize("taxon").alias("f")).agg(F.max_by(acc, "seq").alias("acc"))
    names = asked.unionByName(links.select(F.col("acc").alias("f"))).distinct()
    rungs = names.select("f", F.explode(n.ladder("f")).alias("r")).select("f", "r.key", "r.rule").join(known, "key")
    answered = cut(rungs.groupBy("f").agg(F.bool_or(F.col("rule") == "exact").alias("exact")))
    j = asked.join(answered, "f", "left").join(links, "f", "left").join(answered.select(F.col("f").alias("acc"), F.col("exact").alias("acc_exact")), "acc", "left")
    steps = F.array(F.struct(F.lit("exact").alias("step"), F.coalesce("exact", F.lit(False)).alias("known"), F.coalesce("acc_exact", F.lit(False)).alias("linked")), F.struct(F.lit("ladder").alias("step"), F.col("exact").isNotNull().alias("known"), F.col("acc_exact").isNotNull().alias("linked")))
    o = j.select("acc", F.explode(steps).alias("x")).where("not x.known")
    return o.groupBy("x.step").agg(F.count(F.lit(1)).alias("unresolved"), F.count("acc").alias("recovered"), F.count_if("x.linked").alias("bridgeable"))


@query(s.with_("trait_keys trait_rows", f"""SELECT count(*) AS slots, count(*) FILTER (n > 1) AS contested, count(*) FILTER (a <> z) AS changed FROM (
  SELECT w.concept_id, upper(trim(r.dim)) AS dim, count(*) AS n, arg_min(r.seq, {s.rule_rank('w.rule')} * 1000000000000 + r.seq) AS a, max(r.seq) AS z FROM trait_rows r JOIN walked w ON w.value = r.taxon AND w.outcome = 'matched' GROUP BY 1, 2)""", s.crosswalk("trait_rows", "taxon", "trait_keys")))  # fmt: skip
def winner_policies(spark: SparkSession, sf: str) -> DataFrame:
    """Slots of concept and dimension: contested ones, and those where the last row would win instead of the best rule."""
    hit = ix.trait_crosswalk(spark, sf).where("outcome = 'matched'").select(F.col("value").alias("taxon"), "concept_id", "rule")
    r = ix.traits_rows(spark, sf).join(hit, "taxon").withColumn("dim", v.parse_dimension("dim")).withColumn("rank", n.rule_rank("rule"))
    slots = r.groupBy("concept_id", "dim").agg(F.count(F.lit(1)).alias("n"), F.min_by("seq", F.struct("rank", "seq")).alias("a"), F.max("seq").alias("z"))
    return slots.agg(F.count(F.lit(1)).alias("slots"), F.count_if(F.col("n") > 1).alias("contested"), F.count_if(F.col("a") != F.col("z")).alias("changed"))


@query("""WITH d AS (SELECT DISTINCT taxon FROM eive_sample WHERE taxon IS NOT NULL), r AS (SELECT taxon, row_number() OVER (ORDER BY taxon) - 1 AS i, count(*) OVER () AS n FROM d)
SELECT taxon FROM r WHERE i % greatest(1, n // 20) = 0 AND i // greatest(1, n // 20) < 20""")
def systematic_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Every k-th of the distinct names in order, twenty of them."""
    names = ix.table(spark, sf, "eive_sample").select("taxon").where("taxon is not null").distinct()
    at = an.positions(names, [], ["taxon"])
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 20))
    return at.where((F.col("position") % step == 0) & (F.floor(F.col("position") / step) < 20)).select("taxon")


@query("SELECT dim, list_sort(list(value))[1 + floor(0.5 * (count(*) - 1))::INTEGER] AS p50, list_sort(list(value))[1 + floor(0.95 * (count(*) - 1))::INTEGER] AS p95, min(value) AS least, max(value) AS greatest, count(niche_width) / count(*)::DOUBLE AS filled FROM eive_sample WHERE value IS NOT NULL GROUP BY dim")
def value_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Lower nearest-rank quantiles, ranges and fill rate of the measured values of each dimension."""
    e = ix.table(spark, sf, "eive_sample").where("value is not null").select("dim", "value", F.col("niche_width").isNotNull().alias("wide"))
    p = an.positions(e, ["dim"], ["value"])
    at = lambda share: F.min(F.when(F.col("position") == F.floor(F.lit(share) * (F.col("n") - 1)), F.col("value")))
    return p.groupBy("dim").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.min("value").alias("least"), F.max("value").alias("greatest"), (F.count_if("wide") / F.count(F.lit(1))).alias("filled"))


# --- evidence, histograms, coverage --------------------------------------------------------------------------------------


@query(s.with_("name_rows", f"""SELECT {s.fold('taxon')} AS key, coalesce(arg_max({s.fold('accepted_taxon')}, seq) FILTER ({s.fold("coalesce(accepted_taxon, '')")} <> ''), '') AS value FROM name_rows WHERE {s.fold('taxon')} <> '' GROUP BY 1"""))
def accepted_links(spark: SparkSession, sf: str) -> DataFrame:
    """The name list as a map from folded names to folded accepted names."""
    return an.key_values(ix.name_rows(spark, sf), "taxon", "accepted_taxon", "seq")


_CANON = "spelled AS (SELECT DISTINCT canonical AS name FROM name WHERE canonical <> '')"


@query(s.with_("name trait_keys trait_rows", f"""SELECT o.name, coalesce(g.n, 0) AS same_genus, coalesce((SELECT string_agg(name, '; ' ORDER BY name) FROM (SELECT c.name FROM spelled c WHERE starts_with(c.name, o.genus || ' ' || substr(o.epithet, 1, 5)) AND split_part(c.name, ' ', 1) = o.genus ORDER BY c.name LIMIT 3)), '') AS near
  FROM (SELECT value AS name, split_part(value, ' ', 1) AS genus, split_part(value, ' ', 2) AS epithet FROM walked WHERE outcome = 'unmatched') o LEFT JOIN (SELECT split_part(name, ' ', 1) AS genus, count(*) AS n FROM spelled GROUP BY 1) g ON g.genus = o.genus""",
    s.crosswalk("trait_rows", "taxon", "trait_keys"), _CANON))
def unmatched_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """What the index has near each trait name that it does not resolve."""
    open_ = ix.trait_crosswalk(spark, sf).where("outcome = 'unmatched'").select(F.col("value").alias("name"))
    names = ix.index(spark, sf).name.select(F.col("canonical").alias("name")).where("name <> ''").distinct()
    return an.evidence(open_, names).withColumn("near", F.array_join("near", "; "))


_HIST = "lookup name_rows closure", s.crosswalk("name_rows", "taxon", "lookup"), _ENTRIES, _SUGGEST, _suggest_sql("VMQ", "")


@query(s.with_(_HIST[0], "SELECT qid, rank, count(*) AS n, " + s.case("rank", v.RANK_ORDER, "11") + "::INTEGER AS \"order\" FROM placed WHERE position <= 10 GROUP BY qid, rank", *_HIST[1:]))
def suggest_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """The ranks among the ten suggestions of each beginning."""
    return an.rank_histogram(_suggest(spark, sf, "vmq"))


@query(s.with_(_HIST[0], "SELECT qid, count(*) AS candidates, (min(k) FILTER (rank = 'GENUS'))::DOUBLE AS first_genus FROM (SELECT qid, rank, row_number() OVER (PARTITION BY qid ORDER BY score, concept_id) AS k FROM full_) GROUP BY qid", *_HIST[1:]))
def suggest_first_genus(spark: SparkSession, sf: str) -> DataFrame:
    """Where among all candidates of a beginning the first genus stands by score."""
    i = ix.index(spark, sf)
    m = sg.pool_of(sg.matches(ix.search_rows(spark, sf), _asked(spark)))
    ranks = i.concept.join(i.name.select(F.col("id").alias("accepted_name"), F.col("rank").alias("name_rank")), "accepted_name").select(F.col("id").alias("concept_id"), F.col("name_rank").alias("rank"))
    return an.first_genus(m.groupBy("qid", "concept_id").agg(F.min("score").alias("score")).join(ranks, "concept_id")).withColumn("first_genus", F.col("first_genus").cast("double"))


@query(s.with_("xref", f"""SELECT authority, count(*) AS concepts, count(*) FILTER (k > 1) AS several, max(k) AS most FROM (SELECT authority, concept_id, count(DISTINCT ext_id) AS k FROM good GROUP BY ALL UNION ALL SELECT NULL, concept_id, count(*) FROM good GROUP BY concept_id) GROUP BY authority""",
    _XROWS, f"good AS (SELECT authority, ext_id, concept_id FROM xref UNION SELECT authority, ext_id, concept_id FROM ({_XOUT}) WHERE outcome = 'matched')"))
def xref_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Concepts with cross-references, own and fed, by authority: any, several, most."""
    own = ix.index(spark, sf).xref.select("authority", "ext_id", "concept_id")
    fed = g.xref_outcomes(ix.xref_rows(spark, sf), ix.index(spark, sf).xref).where("outcome = 'matched'").select("authority", "ext_id", "concept_id")
    return an.xref_coverage(own.unionByName(fed).distinct())


@query(s.with_("concept edges", "SELECT e.relation, count(*) AS edges, count(*) FILTER (a.backbone_id <> 'cdm' OR b.backbone_id <> 'cdm') AS leaving FROM edges e JOIN concept a ON a.id = e.from_id JOIN concept b ON b.id = e.to_id GROUP BY 1"))
def edge_backbones(spark: SparkSession, sf: str) -> DataFrame:
    return an.cross_backbone_edges(ix.index(spark, sf), ix.edges(spark, sf))


@query(s.with_("lookup", "SELECT canonical_fold, backbone_id, role, coalesce(authorship, '') AS authorship, count(DISTINCT concept_id) AS concepts FROM lookup WHERE canonical_fold IN (SELECT canonical_fold FROM lookup GROUP BY 1 HAVING count(DISTINCT concept_id) > 1) GROUP BY ALL"))
def name_bearers(spark: SparkSession, sf: str) -> DataFrame:
    """Backbones, roles and authors under which each name of several concepts occurs."""
    return an.bearers(ix.lookup(spark, sf))


@query(s.with_("taxa", "SELECT taxonid, rank FROM taxa WHERE upper(trim(rank)) IN ('GENUS', 'SPECIES') ORDER BY seq LIMIT 50"))
def ranked_head(spark: SparkSession, sf: str) -> DataFrame:
    """The first fifty genera and species of the checklist, in the order of delivery."""
    return an.head(an.ranked(ix.taxa(spark, sf), ("Genus", "Species")), "seq", 50).select("taxonid", "rank")


@query("""WITH RECURSIVE kids AS (SELECT lower(trim(concept_uuid)) AS node, nullif(lower(trim(parent_uuid)), '') AS parent, row_number() OVER (PARTITION BY lower(trim(concept_uuid)) ORDER BY row_seq DESC) AS k FROM cdm_concepts_fixture WHERE trim(concept_uuid) <> ''),
t AS (SELECT node, parent FROM kids WHERE k = 1), walk AS (SELECT node, NULL::VARCHAR AS parent, node AS root, 0 AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.node, w.node, w.root, w.depth + 1 FROM walk w JOIN t ON t.parent = w.node) SELECT * FROM walk""")
def tree_parents(spark: SparkSession, sf: str) -> DataFrame:
    """Parent, root and depth of every concept that a concept without any parent leads to."""
    c = ix.concepts(spark, sf).select(F.col("uuid").alias("node"), "parent")
    return an.traverse(c.where("parent is not null"), c.where("parent is null").select("node"))


_FEEDS = """feed AS (SELECT taxonid, 'Q' || seq AS item, nullif(powo, '') AS first_id, seq FROM taxa), ids AS (SELECT DISTINCT ext_id FROM xref)"""


@query(s.with_("taxa xref", "SELECT item, first_id, 'urn:lsid:ipni.org:names:' || first_id AS second_id FROM feed WHERE first_id IN (SELECT ext_id FROM ids)", _FEEDS))
def feed_union(spark: SparkSession, sf: str) -> DataFrame:
    """Two feeds of identifiers made of the checklist, united by item, those that can be joined."""
    f = ix.taxa(spark, sf).select(F.concat(F.lit("Q"), F.col("seq").cast("string")).alias("item"), F.nullif("powo", F.lit("")).alias("v")).where("v is not null")
    long_ids = f.select("item", F.concat(F.lit("urn:lsid:ipni.org:names:"), "v").alias("v"))
    return an.seed_union(f, long_ids, ix.index(spark, sf).xref.select(F.col("ext_id").alias("id")))


@query(s.with_("taxa", "SELECT t.taxonid AS item, nullif(t.powo, '') AS powo, t.published_in FROM taxa t WHERE t.taxonid NOT IN (SELECT taxonid FROM taxa WHERE accepted_id = taxonid)"))
def feed_enriched(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of the checklist when accepted taxa are done, each with the last statement of two properties."""
    t = ix.taxa(spark, sf)
    todo = an.remaining(t.select(F.col("taxonid").alias("item")), t.where("accepted_id = taxonid").select(F.col("taxonid").alias("item")))
    cells = F.explode(F.array(F.struct(F.lit("powo").alias("property"), F.nullif("powo", F.lit("")).alias("v")), F.struct(F.lit("published_in").alias("property"), F.col("published_in").alias("v"))))
    said = t.select(F.col("taxonid").alias("item"), "seq", cells.alias("x")).select("item", "seq", "x.*").where("v is not null")
    return an.enrich(todo, said, ("powo", "published_in"))
