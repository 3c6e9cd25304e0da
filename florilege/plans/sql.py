"""DuckDB SQL for the oracles: expressions for the name functions and named sub-queries that build the same index."""

from __future__ import annotations

import re

from florilege.functions import names as n
from florilege.functions import vocabulary as v

WS = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def spaced(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'), ' ')"


def fold(x: str) -> str:
    return f"translate(lower({spaced(x)}), '{n.FOLD_FROM}', '{n.FOLD_TO}')"


def author(x: str) -> str:
    return f"regexp_replace(replace({spaced(x)}, ' .', '.'), ' *& *', ' & ', 'g')"


def _split(x: str, k: int) -> str:
    return rf"regexp_extract({spaced(x)}, '^(\S+(?: [^(A-Z ]\S*)*)(?: (.*))?$', {k})"


def canonical_part(x: str) -> str:
    return _split(x, 1)


def author_part(x: str) -> str:
    return _split(x, 2)


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def hybrid_spaced(c: str) -> str:
    glued = f"starts_with(w, '{n.HYBRID}') AND w <> '{n.HYBRID}'"
    return f"array_to_string(flatten(list_transform({words(c)}, lambda w, i: CASE WHEN {glued} THEN ['{n.HYBRID}', substr(w, 2)] WHEN w = 'x' AND i > 1 THEN ['{n.HYBRID}'] ELSE [w] END)), ' ')"


def hybrid_dropped(c: str) -> str:
    kept = f"list_filter({words(c)}, lambda w: w <> '{n.HYBRID}')"
    return f"CASE WHEN len({kept}) < len({words(c)}) AND len({kept}) > 0 THEN array_to_string({kept}, ' ') END"


def hybrid_added(c: str) -> str:
    return f"CASE WHEN len({words(c)}) = 2 AND NOT list_contains({words(c)}, '{n.HYBRID}') THEN array_to_string({words(c)}, ' {n.HYBRID} ') END"


def strip(c: str) -> str:
    """One mark of a collective species taken off, '' when there is none."""
    return f"CASE WHEN regexp_extract({c}, '{n.AGGREGATE_PAIR}', 1) <> '' THEN regexp_extract({c}, '{n.AGGREGATE_PAIR}', 1) ELSE regexp_extract({c}, '{n.AGGREGATE_WORD}', 1) END"


def is_aggregate(x: str) -> str:
    return f"(regexp_matches({fold(x)}, '{n.AGGREGATE_PAIR}') OR regexp_matches({fold(x)}, '{n.AGGREGATE_WORD}'))"


def autonym(c: str) -> str:
    marks = ", ".join(q(m) for m in n.INFRASPECIFIC)
    w = words(c)
    return f"CASE WHEN len({w}) = 4 AND {w}[3] IN ({marks}) AND {w}[2] = {w}[4] THEN {w}[1] || ' ' || {w}[2] END"


def genitive(c: str) -> str:
    last = f"string_split({c}, ' ')[-1]"
    stem = f"regexp_replace({last}, 'i+$', '')"
    head = f"substr({c}, 1, length({c}) - length({last}))"
    able = f"NOT contains({last}, '.') AND length({stem}) >= 3"
    tail = f"length({last}) - length({stem})"
    return f"CASE WHEN {able} AND {tail} = 2 THEN {head} || {stem} || 'i' WHEN {able} AND {tail} = 1 THEN {head} || {stem} || 'ii' END"


def ladder(source: str, value: str) -> str:
    """Sub-queries up to `rungs` (canon, ord, key, rule) over the distinct values of a sub-query; marks are stripped up to five times."""
    return f"""
canons AS (SELECT DISTINCT {fold(value)} AS canon FROM {source} WHERE {value} IS NOT NULL),
l0 AS (SELECT canon, {hybrid_spaced('canon')} AS sp, {strip('canon')} AS b1 FROM canons WHERE canon <> ''),
l1 AS (SELECT *, {strip('b1')} AS b2 FROM l0),
l2 AS (SELECT *, {strip('b2')} AS b3 FROM l1),
l3 AS (SELECT *, {strip('b3')} AS b4 FROM l2),
l4 AS (SELECT *, CASE WHEN b1 = '' THEN 0 WHEN b2 = '' THEN 1 WHEN b3 = '' THEN 2 WHEN b4 = '' THEN 3 ELSE 4 END AS nb FROM l3),
l5 AS (
  SELECT canon, 0 AS o, canon AS key, 'exact' AS rule FROM l4
  UNION ALL SELECT canon, 1, sp, 'hybrid_spacing' FROM l4 WHERE sp <> canon
  UNION ALL SELECT canon, 2, {hybrid_dropped('sp')}, 'hybrid_marker_dropped' FROM l4
  UNION ALL SELECT canon, 3, {hybrid_added('sp')}, 'hybrid_marker_added' FROM l4
  UNION ALL SELECT canon, 4, {genitive('canon')}, 'orthography_genitive' FROM l4
  UNION ALL SELECT canon, 5, b1, CASE WHEN nb = 1 THEN 'aggregate_to_nominate' ELSE 'aggregate' END FROM l4 WHERE nb >= 1
  UNION ALL SELECT canon, 6, b2, CASE WHEN nb = 2 THEN 'aggregate_to_nominate' ELSE 'aggregate' END FROM l4 WHERE nb >= 2
  UNION ALL SELECT canon, 7, b3, CASE WHEN nb = 3 THEN 'aggregate_to_nominate' ELSE 'aggregate' END FROM l4 WHERE nb >= 3
  UNION ALL SELECT canon, 8, b4, 'aggregate_to_nominate' FROM l4 WHERE nb >= 4
  UNION ALL SELECT canon, 9, {autonym('canon')}, 'autonym' FROM l4
),
l6 AS (SELECT *, row_number() OVER (PARTITION BY canon, key ORDER BY o) AS again FROM l5 WHERE key IS NOT NULL AND key <> ''),
rungs AS (SELECT canon, (row_number() OVER (PARTITION BY canon ORDER BY o) - 1)::INTEGER AS ord, key, rule FROM l6 WHERE again = 1)"""


def crosswalk(source: str, value: str, keys: str, suffix: str = "") -> str:
    """Sub-queries up to `walked` (value, canon, rule, concept_id, outcome); a suffix tells a second crosswalk apart."""
    made = _crosswalk(source, value, keys)
    return re.sub(r"\b(canons|l[0-6]|rungs|targets|hits|walked)\b", rf"\g<1>{suffix}", made) if suffix else made


def _crosswalk(source: str, value: str, keys: str) -> str:
    return f"""{ladder(source, value)},
targets AS (SELECT canonical_fold, count(DISTINCT concept_id) AS n, min(concept_id) AS concept_id FROM {keys} GROUP BY 1),
hits AS (SELECT r.canon, r.rule, t.n, t.concept_id, row_number() OVER (PARTITION BY r.canon ORDER BY r.ord) AS k FROM rungs r JOIN targets t ON t.canonical_fold = r.key),
walked AS (
  SELECT s.value, {fold('s.value')} AS canon, CASE WHEN h.n = 1 THEN h.rule END AS rule, CASE WHEN h.n = 1 THEN h.concept_id END AS concept_id,
    CASE WHEN h.n = 1 THEN 'matched' WHEN h.n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS outcome
  FROM (SELECT DISTINCT {value} AS value FROM {source} WHERE {value} IS NOT NULL) s LEFT JOIN hits h ON h.canon = {fold('s.value')} AND h.k = 1
)"""


def case(x: str, table: dict, default: str = "NULL") -> str:
    lit = lambda y: q(y) if isinstance(y, str) else str(y)
    return f"CASE {x} " + " ".join(f"WHEN {lit(k)} THEN {lit(y)}" for k, y in table.items()) + f" ELSE {default} END"


def rank(x: str) -> str:
    known = {**v.RANK_SPELLINGS, **{r: r for r in v.RANK_ORDER}}
    return case(f"upper(trim({x}))", known, "'OTHER'")


def rank_verbatim(x: str) -> str:
    return f"CASE WHEN {rank(x)} = 'OTHER' THEN trim(coalesce({x}, '')) END"


def status(x: str) -> str:
    return case(f"upper(trim({x}))", {s: s for s in v.STATUSES}, "'UNKNOWN'")


def relation(x: str) -> str:
    return case(f"lower(trim({x}))", {**v.RELATIONS, **{r: r for r in v.RELATIONS.values()}})


def rule_rank(x: str) -> str:
    return case(x, {r: i for i, r in enumerate(n.RULES)})


def nom_text(x: str) -> str:
    return f"coalesce(regexp_replace(lower({spaced(x)}), '^[, ]+', ''), '')"


def nom_judgement(x: str) -> str:
    text = nom_text(x)
    rest = text
    for guard in v.GUARDS:
        rest = f"replace({rest}, {q(guard)}, ' ')"
    guarded_parts, now = [], text
    for guard in v.GUARDS:
        guarded_parts.append(f"contains({now}, {q(guard)})")
        now = f"replace({now}, {q(guard)}, ' ')"
    bad = " OR ".join(f"contains({rest}, {q(f)})" for f in v.DISQUALIFYING)
    good = " OR ".join(f"contains({rest}, {q(f)})" for f in v.ACCEPTABLE)
    return f"CASE WHEN {text} = '' THEN 'absent' WHEN contains({text}, '?') THEN 'unclassified' WHEN {bad} THEN 'disqualifying' WHEN {' OR '.join(guarded_parts)} THEN 'unclassified' WHEN {good} THEN 'acceptable' ELSE 'unclassified' END"


def nom_matched(x: str) -> str:
    """The list of tokens that were found, in the order of the rules."""
    now, found = nom_text(x), [f"CASE WHEN contains({nom_text(x)}, '?') THEN '?' END"]
    for guard in v.GUARDS:
        found.append(f"CASE WHEN contains({now}, {q(guard)}) THEN {q(guard)} END")
        now = f"replace({now}, {q(guard)}, ' ')"
    found += [f"CASE WHEN contains({now}, {q(f)}) THEN {q(f)} END" for f in (*v.DISQUALIFYING, *v.ACCEPTABLE)]
    return f"list_filter([{', '.join(found)}], lambda x: x IS NOT NULL)"


def quoted(x: str) -> str:
    return f"""'"' || replace(replace({x}, '\\', '\\\\'), '"', '\\"') || '"'"""


#: Named sub-queries in the order in which they may use each other.
CTES: dict[str, str] = {
    "taxa": """SELECT * FROM (
  SELECT trim(taxonid) AS taxonid, scientfiicname AS canonical, coalesce(scientfiicnameauthorship, '') AS authorship, taxonrank AS rank, taxonomicstatus AS status, coalesce(nomenclaturalstatus, '') AS nom_status,
    namepublishedin AS published_in, CASE WHEN json_valid(dynamicproperties) THEN coalesce(dynamicproperties ->> '$.powoid', '') ELSE '' END AS powo, nullif(trim(acceptednameusageid), '') AS accepted_id,
    nullif(trim(parentnameusageid), '') AS parent_id, nullif(trim(originalnameusageid), '') AS basionym_id, row_seq AS seq, row_number() OVER (PARTITION BY trim(taxonid) ORDER BY row_seq DESC) AS k
  FROM wcvp_taxon WHERE trim(taxonid) <> '') WHERE k = 1""",
    "dist": "SELECT trim(coreid) AS coreid, locality, nullif(trim(locationid), '') AS locationid, row_seq AS seq FROM wcvp_distribution",
    "linked": """SELECT t.*, coalesce(t.accepted_id = t.taxonid, FALSE) AS accepted, b.taxonid AS basionym, (a.taxonid IS NOT NULL) AS target_accepted, ab.taxonid AS target_basionym, (p.taxonid IS NOT NULL) AS parent_accepted
  FROM taxa t LEFT JOIN taxa b ON b.taxonid = t.basionym_id LEFT JOIN taxa a ON a.taxonid = t.accepted_id AND a.accepted_id = a.taxonid LEFT JOIN taxa ab ON ab.taxonid = a.basionym_id
  LEFT JOIN taxa p ON p.taxonid = t.parent_id AND p.accepted_id = p.taxonid""",
    "cdm": """SELECT * FROM (
  SELECT lower(trim(concept_uuid)) AS uuid, scientific_name AS canonical, coalesce(authorship, '') AS authorship, rank, status, nullif(lower(trim(sec_uuid)), '') AS sec, sec_title, nullif(lower(trim(parent_uuid)), '') AS parent, row_seq AS seq,
    row_number() OVER (PARTITION BY lower(trim(concept_uuid)) ORDER BY row_seq DESC) AS k FROM cdm_concepts_fixture WHERE trim(concept_uuid) <> '') WHERE k = 1""",
    "name": f"""SELECT 'wcvp:name:' || taxonid AS id, canonical, {fold('canonical')} AS canonical_fold, authorship, {rank('rank')} AS rank, {rank_verbatim('rank')} AS rank_verbatim, nullif(powo, '') AS ipni_id, published_in, nom_status, 'wcvp:name:' || basionym AS basionym_id FROM linked
  UNION ALL SELECT 'list:name:' || ref_id, name, {fold('name')}, coalesce(authorship, ''), {rank('rank')}, {rank_verbatim('rank')}, NULL, NULL, '', NULL FROM taxon_list
  UNION ALL SELECT 'cdm:name:' || uuid, canonical, {fold('canonical')}, authorship, {rank('rank')}, {rank_verbatim('rank')}, NULL, NULL, NULL, NULL FROM cdm""",
    "concept": f"""SELECT 'wcvp:concept:' || taxonid AS id, 'wcvp' AS backbone_id, 'wcvp:name:' || taxonid AS accepted_name, {rank('rank')} AS rank, {rank_verbatim('rank')} AS rank_verbatim, {status('status')} AS status,
    CASE WHEN parent_accepted THEN 'wcvp:concept:' || parent_id END AS parent_id, NULL::VARCHAR AS sec_reference FROM linked WHERE accepted
  UNION ALL SELECT 'list:concept:' || ref_id, 'list', 'list:name:' || ref_id, {rank('rank')}, {rank_verbatim('rank')}, 'ACCEPTED', NULL, NULL FROM taxon_list
  UNION ALL SELECT 'cdm:concept:' || c.uuid, 'cdm', 'cdm:name:' || c.uuid, {rank('c.rank')}, {rank_verbatim('c.rank')}, {status('c.status')}, 'cdm:concept:' || p.uuid, c.sec FROM cdm c LEFT JOIN cdm p ON p.uuid = c.parent""",
    "concept_name": """SELECT 'wcvp:concept:' || taxonid AS concept_id, 'wcvp:name:' || taxonid AS name_id, 'accepted' AS role, NULL::BOOLEAN AS homotypic FROM linked WHERE accepted
  UNION ALL SELECT 'wcvp:concept:' || accepted_id, 'wcvp:name:' || taxonid, 'synonym', CASE WHEN coalesce(basionym = accepted_id, FALSE) OR coalesce(basionym = target_basionym, FALSE) OR coalesce(target_basionym = taxonid, FALSE) THEN TRUE END FROM linked WHERE NOT accepted AND target_accepted
  UNION ALL SELECT 'list:concept:' || ref_id, 'list:name:' || ref_id, 'accepted', NULL FROM taxon_list
  UNION ALL SELECT 'cdm:concept:' || uuid, 'cdm:name:' || uuid, 'accepted', NULL FROM cdm""",
    "distribution": "SELECT DISTINCT 'wcvp:concept:' || d.coreid AS concept_id, 'wgsrpd_l3' AS area_scheme, regexp_replace(d.locationid, '^TDWG:', '') AS area_code FROM dist d JOIN linked t ON t.taxonid = d.coreid AND t.accepted WHERE d.locationid IS NOT NULL",
    "area": "SELECT 'wgsrpd_l3' AS scheme, code, first(locality ORDER BY seq) AS name FROM (SELECT regexp_replace(locationid, '^TDWG:', '') AS code, locality, seq FROM dist WHERE locality <> '' AND locationid IS NOT NULL) GROUP BY code",
    "xref": "SELECT 'powo' AS authority, powo AS ext_id, max('wcvp:concept:' || taxonid) AS concept_id FROM linked WHERE accepted AND powo <> '' GROUP BY powo",
    "lookup": "SELECT cn.concept_id, cn.name_id, cn.role, cn.homotypic, n.canonical_fold, n.canonical, n.authorship, c.backbone_id, c.sec_reference FROM concept_name cn JOIN name n ON n.id = cn.name_id JOIN concept c ON c.id = cn.concept_id",
    "secs": "SELECT id, arg_max(sec_title, row_seq) AS title FROM (SELECT nullif(lower(trim(sec_uuid)), '') AS id, sec_title, row_seq FROM cdm_concepts_fixture) WHERE id IS NOT NULL GROUP BY id",
    "rels": f"SELECT 'cdm:concept:' || nullif(lower(trim(from_uuid)), '') AS from_id, 'cdm:concept:' || nullif(lower(trim(to_uuid)), '') AS to_id, relation_type, {relation('relation_type')} AS relation, row_seq FROM cdm_relations_fixture",
    "judged_rels": "SELECT r.*, CASE WHEN r.relation IS NULL THEN 'unknown_type' WHEN r.relation = 'misapplied' THEN 'name_assertion' WHEN a.uuid IS NOT NULL AND b.uuid IS NOT NULL THEN 'written' ELSE 'unresolved' END AS outcome FROM rels r LEFT JOIN cdm a ON 'cdm:concept:' || a.uuid = r.from_id LEFT JOIN cdm b ON 'cdm:concept:' || b.uuid = r.to_id",
    "edges": "SELECT DISTINCT from_id, to_id, relation, 'cdm' AS source FROM judged_rels WHERE outcome = 'written'",
    "trait_rows": "SELECT taxon, lower(trim(vocab)) AS vocab, vocab_version, dim, value, niche_width, n_systems, row_seq AS seq FROM eive_sample WHERE taxon IS NOT NULL AND value IS NOT NULL",
    "name_rows": "SELECT trim(taxon) AS taxon, trim(rank) AS rank, trim(status) AS status, trim(accepted_taxon) AS accepted_taxon, trim(source_id) AS source_id, row_seq AS seq FROM floraveg_sample WHERE trim(taxon) <> '' AND trim(source_id) <> ''",
    "trait_keys": "SELECT canonical_fold, concept_id FROM lookup WHERE backbone_id <> 'cdm'",
    "verbatim": "SELECT 'e:' || row_seq AS id, taxon AS verbatim FROM eive_sample WHERE taxon IS NOT NULL UNION ALL SELECT 'f:' || seq, taxon FROM name_rows UNION ALL SELECT 'c:' || uuid, canonical || CASE WHEN authorship <> '' THEN ' ' || authorship ELSE '' END FROM cdm",
    "closure": """SELECT concept_id, area_scheme, area_code, 'own' AS origin FROM distribution
  UNION ALL SELECT DISTINCT c.id, d.area_scheme, d.area_code, 'name' FROM concept c JOIN name an ON an.id = c.accepted_name AND an.canonical_fold <> '' JOIN name wn ON wn.canonical_fold = an.canonical_fold JOIN concept_name wc ON wc.name_id = wn.id
  JOIN concept w ON w.id = wc.concept_id AND w.backbone_id = 'wcvp' JOIN distribution d ON d.concept_id = w.id WHERE NOT EXISTS (SELECT 1 FROM distribution o WHERE o.concept_id = c.id)""",
}
#: What each sub-query uses.
NEEDS = {
    "linked": ["taxa"], "name": ["linked", "cdm"], "concept": ["linked", "cdm"], "concept_name": ["linked", "cdm"], "distribution": ["dist", "linked"], "area": ["dist"], "xref": ["linked"],
    "lookup": ["concept_name", "name", "concept"], "judged_rels": ["rels", "cdm"], "edges": ["judged_rels"], "trait_keys": ["lookup"], "verbatim": ["name_rows", "cdm"], "closure": ["distribution", "concept", "name", "concept_name"],
}


def with_(needs: str, main: str, *more: str, recursive: bool = False) -> str:
    """WITH the named sub-queries (and all they use), then `more` sub-queries as text, then the main query."""
    wanted: set[str] = set()
    todo = needs.split()
    while todo:
        x = todo.pop()
        if x not in wanted:
            wanted.add(x)
            todo += NEEDS.get(x, [])
    parts = [f"{name} AS MATERIALIZED ({sql})" for name, sql in CTES.items() if name in wanted] + [m.strip() for m in more]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {main}" if parts else main
