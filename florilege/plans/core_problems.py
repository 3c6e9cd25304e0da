"""Queries of the general problems: hierarchies (2), references (4), records (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.functions.text import BLANKS, key, period
from florilege.operators import hierarchy as h
from florilege.operators import records as rec
from florilege.operators import references as ref


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _peeled(spark: SparkSession, sf: str) -> h.Peeled:
    taxa, concepts = _table(spark, sf, "wcvp_taxon"), _table(spark, sf, "cdm_concepts_fixture")
    rows = h.links(taxa, "wcvp_taxon", key("taxonid"), key("parentnameusageid"), "row_seq").unionByName(
        h.links(concepts, "cdm_concepts_fixture", key("concept_uuid", lower=True), key("parent_uuid", lower=True), "row_seq")
    )
    return h.peel(h.encode(rows))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return h.cycles(_peeled(spark, sf))


def p2_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    tree = h.hierarchy(_peeled(spark, sf))
    return tree.withColumn("path", F.array_join("path", ">"))


def p2_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return h.descendants(h.hierarchy(_peeled(spark, sf)))


def _broken(spark: SparkSession, sf: str) -> DataFrame:
    taxa, relations = _table(spark, sf, "wcvp_taxon"), _table(spark, sf, "cdm_relations_fixture")
    concepts, gone = _table(spark, sf, "cdm_concepts_fixture"), _table(spark, sf, "deletions")
    own = ["acceptednameusageid", "originalnameusageid"]
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), key(f).alias("key")) for f in own])).alias("x")
    refs = taxa.select(F.lit("wcvp_taxon").alias("src"), F.lit("wcvp_taxon").alias("target"), "row_seq", period("loaded_at").alias("period"), fields).select(
        "src", "x.field", "target", "row_seq", "x.key", "period"
    )
    refs = refs.unionByName(relations.select(
        F.lit("cdm_relations_fixture").alias("src"), F.lit("to_uuid").alias("field"), F.lit("cdm_concepts_fixture").alias("target"), "row_seq",
        key("to_uuid", lower=True).alias("key"), period("loaded_at").alias("period"),
    ))
    targets = taxa.select(F.lit("wcvp_taxon").alias("target"), key("taxonid").alias("key"), period("loaded_at").alias("period")).unionByName(
        concepts.select(F.lit("cdm_concepts_fixture").alias("target"), key("concept_uuid", lower=True).alias("key"), period("loaded_at").alias("period"))
    )
    src = key("src", lower=True)
    withdrawn = gone.select(src.alias("target"), F.when(src == "cdm_concepts_fixture", key("record_key", lower=True)).otherwise(key("record_key")).alias("key"))
    return ref.broken(refs, targets, withdrawn)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _broken(spark, sf)


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return ref.report(_broken(spark, sf))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return rec.failures(_table(spark, sf, "raw_records"), _table(spark, sf, "rank_list")).select("record_id", "reason")


def p6_errors(spark: SparkSession, sf: str) -> DataFrame:
    found = rec.failures(_table(spark, sf, "raw_records"), _table(spark, sf, "rank_list"))
    return found.select("record_id", F.explode("errors").alias("e")).select("record_id", "e.reason", "e.column", "e.value")


def p6_valid_floraveg(spark: SparkSession, sf: str) -> DataFrame:
    return rec.typed(rec.check(_table(spark, sf, "raw_records"), _table(spark, sf, "rank_list"), rec.FLORAVEG), rec.FLORAVEG)


def p6_valid_wcvp(spark: SparkSession, sf: str) -> DataFrame:
    return rec.typed(rec.check(_table(spark, sf, "raw_records"), _table(spark, sf, "rank_list"), rec.WCVP), rec.WCVP)


QUERIES = {f.__name__: f for f in (p2_found, p2_hierarchy, p2_descendants, p4_found, p4_report, p6_found, p6_errors, p6_valid_floraveg, p6_valid_wcvp)}

_NODES = """
raw AS (
  SELECT 'wcvp_taxon' AS tree, trim(taxonid) AS id, nullif(trim(parentnameusageid), '') AS parent, row_seq FROM wcvp_taxon
  UNION ALL
  SELECT 'cdm_concepts_fixture', lower(trim(concept_uuid)), nullif(lower(trim(parent_uuid)), ''), row_seq FROM cdm_concepts_fixture
),
firsts AS (SELECT tree, id, first(parent ORDER BY row_seq) AS parent FROM raw WHERE id <> '' GROUP BY ALL),
nodes AS (SELECT n.tree, n.id, p.id AS parent FROM firsts n LEFT JOIN firsts p ON p.tree = n.tree AND p.id = n.parent),
walk AS (
  SELECT tree, id, id AS root, 0 AS depth, [id] AS path, NULL::VARCHAR AS parent FROM nodes WHERE parent IS NULL
  UNION ALL
  SELECT n.tree, n.id, w.root, w.depth + 1, list_append(w.path, n.id), w.id FROM walk w JOIN nodes n ON n.tree = w.tree AND n.parent = w.id
)"""

_REFS = """
refs AS (
  SELECT 'wcvp_taxon' AS src, 'acceptednameusageid' AS field, 'wcvp_taxon' AS target, row_seq, nullif(trim(acceptednameusageid), '') AS k, strftime(loaded_at, '%Y-%m') AS period FROM wcvp_taxon
  UNION ALL
  SELECT 'wcvp_taxon', 'originalnameusageid', 'wcvp_taxon', row_seq, nullif(trim(originalnameusageid), ''), strftime(loaded_at, '%Y-%m') FROM wcvp_taxon
  UNION ALL
  SELECT 'cdm_relations_fixture', 'to_uuid', 'cdm_concepts_fixture', row_seq, nullif(lower(trim(to_uuid)), ''), strftime(loaded_at, '%Y-%m') FROM cdm_relations_fixture
),
targets AS (
  SELECT 'wcvp_taxon' AS target, trim(taxonid) AS k, min(strftime(loaded_at, '%Y-%m')) AS first FROM wcvp_taxon GROUP BY 2
  UNION ALL
  SELECT 'cdm_concepts_fixture', lower(trim(concept_uuid)), min(strftime(loaded_at, '%Y-%m')) FROM cdm_concepts_fixture GROUP BY 2
),
gone AS (SELECT DISTINCT src AS target, lower(trim(record_key)) AS k FROM deletions),
judged AS (
  SELECT r.src, r.field, r.row_seq, CASE WHEN g.k IS NOT NULL THEN 'deleted' WHEN t.k IS NULL THEN 'missing' WHEN t.first > r.period THEN 'late' END AS kind, r.period
  FROM refs r LEFT JOIN gone g ON g.target = r.target AND g.k = r.k LEFT JOIN targets t ON t.target = r.target AND t.k = r.k WHERE r.k IS NOT NULL
)"""

ORACLE = {
    "p2_found": f"""WITH RECURSIVE {_NODES},
stuck AS (SELECT n.* FROM nodes n LEFT JOIN walk w ON w.tree = n.tree AND w.id = n.id WHERE w.id IS NULL),
reach AS (
  SELECT tree, id, parent AS up FROM stuck
  UNION
  SELECT r.tree, r.id, s.parent FROM reach r JOIN stuck s ON s.tree = r.tree AND s.id = r.up
),
ring AS (SELECT DISTINCT tree, id FROM reach WHERE up = id)
SELECT r.tree, r.id AS node_id, min(r.up) AS cycle_id FROM reach r JOIN ring o ON o.tree = r.tree AND o.id = r.up GROUP BY r.tree, r.id""",
    "p2_hierarchy": f"""WITH RECURSIVE {_NODES},
below AS (SELECT tree, a AS id, count(*) - 1 AS n FROM (SELECT tree, unnest(path) AS a FROM walk) GROUP BY tree, a),
ordered AS (SELECT w.*, b.n, row_number() OVER (PARTITION BY w.tree, w.root ORDER BY w.path) - 1 AS pre FROM walk w JOIN below b ON b.tree = w.tree AND b.id = w.id)
SELECT tree, id AS node_id, parent AS parent_id, root AS root_id, depth::INTEGER AS depth, array_to_string(path, '>') AS path, n AS n_descendants,
  2 * pre - depth AS entry, 2 * pre - depth + 2 * n + 1 AS exit FROM ordered""",
    "p2_descendants": f"""WITH RECURSIVE {_NODES},
steps AS (SELECT tree, id, depth, unnest(path) AS a, unnest(range(0, len(path))) AS level FROM walk)
SELECT tree, a AS ancestor_id, id AS descendant_id, (depth - level)::INTEGER AS distance FROM steps WHERE level < depth""",
    "p4_found": f"WITH {_REFS} SELECT src, field, row_seq, kind, period FROM judged WHERE kind IS NOT NULL",
    "p4_report": f"WITH {_REFS} SELECT src, field, period, kind, count(*) AS n_rows FROM judged WHERE kind IS NOT NULL GROUP BY ALL",
}

#: Strict JSON as a regular expression, to the depth that the test records have.
_STRING = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"'
_SCALAR = rf"(?:{_STRING}|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)"
_S = r"[ \t\n\r]*"


def _json_object(depth: int) -> str:
    value = _SCALAR if depth == 0 else rf"(?:{_SCALAR}|{_json_object(depth - 1)}|\[{_S}(?:{_SCALAR}{_S}(?:,{_S}{_SCALAR}{_S})*)?\])"
    pair = rf"{_STRING}{_S}:{_S}{value}{_S}"
    return rf"\{{{_S}(?:{pair}(?:,{_S}{pair})*)?\}}"


_B = f"'{BLANKS}'"
_W = "[" + "".join(rf"\x{{{ord(c):x}}}" for c in BLANKS) + "]"
_FIELD = rf'(?:{_W}*"(?:[^"]|"")*"{_W}*|{_W}*[^"|\n\r]*{_W}*)'


def _bare(x: str) -> str:
    return f"trim({x}, {_B})"


def _unquoted(x: str) -> str:
    f = _bare(x)
    return f"""CASE WHEN starts_with({f}, '"') AND ends_with({f}, '"') AND length({f}) > 1 THEN replace(substr({f}, 2, length({f}) - 2), '""', '"') ELSE {f} END"""


def _column(name: str) -> str:
    return f'"{name}"'


_RECORDS = f"""
lines AS (SELECT record_id, {_bare('feed')} AS feed, line_no, replace(regexp_replace(coalesce(line, ''), '\\r\\z', ''), chr(0), chr(65533)) AS line FROM raw_records),
flo_split AS (SELECT *, regexp_full_match(line, '{_FIELD}(?:\\|{_FIELD})*', 's') AS quoting_ok,
  string_split(array_to_string(list_transform(string_split(line, '"'), lambda x, i: CASE WHEN i % 2 = 1 THEN replace(x, '|', chr(1)) ELSE x END), '"'), chr(1)) AS f FROM lines WHERE feed = 'floraveg_sample'),
flo AS (SELECT record_id, feed, line_no, quoting_ok, len(f) AS n_fields, {', '.join(f"nullif({_bare(_unquoted(f'f[{i + 1}]'))}, '') AS {_column(c)}" for i, c in enumerate(rec.FLORAVEG.columns))} FROM flo_split),
wcv_split AS (SELECT *, string_split(line, '|') AS f FROM lines WHERE feed = 'wcvp_taxon'),
wcv AS (SELECT record_id, feed, line_no, len(f) AS n_fields, {', '.join(f"nullif({_bare(f'f[{i + 1}]')}, '') AS {_column(c)}" for i, c in enumerate(rec.WCVP.columns))} FROM wcv_split),
ranks AS (SELECT DISTINCT {_bare('feed')} AS feed, {_bare('rank')} AS rank FROM rank_list),
errs AS (
  SELECT record_id, 1 AS o, 'quoting' AS reason, NULL::VARCHAR AS "column", NULL::VARCHAR AS value FROM flo WHERE NOT quoting_ok
  UNION ALL SELECT record_id, 2, 'columns', NULL, NULL FROM flo WHERE n_fields <> 5
  UNION ALL SELECT record_id, 3, 'value', 'taxon', taxon FROM flo WHERE taxon IS NULL
  UNION ALL SELECT record_id, 4, 'value', 'rank', rank FROM flo WHERE rank NOT IN (SELECT rank FROM ranks WHERE feed = 'floraveg_sample')
  UNION ALL SELECT record_id, 5, 'value', 'accepted_taxon', accepted_taxon FROM flo WHERE NOT (regexp_full_match(accepted_taxon, '(?:[\\p{{L}}.\\-×()&,]|''|{_W})*') AND regexp_matches(accepted_taxon, '\\p{{L}}'))
  UNION ALL SELECT record_id, 6, 'value', 'source_id', source_id FROM flo WHERE source_id IS NULL OR NOT regexp_full_match(source_id, '[0-9]+')
  UNION ALL SELECT record_id, 2, 'columns', NULL, NULL FROM wcv WHERE n_fields <> 18
  UNION ALL SELECT record_id, 3, 'value', 'taxonid', taxonid FROM wcv WHERE taxonid IS NULL OR NOT regexp_full_match(taxonid, '[0-9]{{8}}')
  UNION ALL SELECT record_id, 4, 'value', 'taxonrank', taxonrank FROM wcv WHERE lower(taxonrank) NOT IN (SELECT lower(rank) FROM ranks WHERE feed = 'wcvp_taxon')
  UNION ALL SELECT record_id, 5, 'value', 'dynamicproperties', dynamicproperties FROM wcv WHERE NOT regexp_full_match(dynamicproperties, '{_S}{_json_object(1)}{_S}', 's')
)"""

ORACLE |= {
    "p6_found": f"WITH {_RECORDS} SELECT record_id, arg_min(reason, o) AS reason FROM errs GROUP BY 1 UNION ALL SELECT record_id, 'columns' FROM lines WHERE feed IS NULL OR feed NOT IN ('floraveg_sample', 'wcvp_taxon')",
    "p6_errors": f'WITH {_RECORDS} SELECT record_id, reason, "column", value FROM errs',
    "p6_valid_floraveg": f"WITH {_RECORDS} SELECT * EXCLUDE (quoting_ok, n_fields), TRY_CAST(source_id AS BIGINT) AS source_number FROM flo WHERE record_id NOT IN (SELECT record_id FROM errs)",
    "p6_valid_wcvp": f"WITH {_RECORDS} SELECT * EXCLUDE (n_fields), taxonid::INTEGER AS taxon_number FROM wcv WHERE record_id NOT IN (SELECT record_id FROM errs)",
}
