"""Suggestions for batches of typed beginnings: a phrase-prefix search over name tokens, BM25 scores, area and rank order.

The phrase may start at any word of a name; its last word is a beginning. Postings carry a word as it is with the next one's first
character, and its own first two, so a query joins on one short key and is verified against the row's words. Up to
`BROADCAST_QUERIES` queries are sent to the postings, which then are not shuffled; more are joined with them on that key.
Ties at every cut are decided by the row id, which makes results the same in every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from florilege.functions import names as n
from florilege.functions import vocabulary as v
from florilege.operators.ingest import SCHEME, Index
from florilege.operators.match import spellings
from florilege.session import cut

#: Rows that are ranked at most, how many are fetched for a limit, and the score of rows beyond the pool.
POOL, LEAST_FETCH, FETCH_FACTOR = 5000, 20, 4
DEFAULT_LIMIT, MOST_LIMIT = 10, 50
BEYOND_POOL = 1e18
MIN_QUERY = 2
#: Batches of up to this many queries (a few MB) are broadcast.
BROADCAST_QUERIES = 50_000
#: The rows of a query are ranked in this many parts before the best of them are ranked together.
PARTS = 32


def tokens(c):  # noqa: ANN001, ANN201
    """The words of a folded text: runs of letters and digits."""
    return F.filter(F.split(n.canonicalize(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def index_rows(index: Index, aliases: DataFrame | None = None) -> DataFrame:
    """(rowid, concept_id, is_aggregate, tokens) of every name of every concept, and of the collective names of name spaces."""
    named = index.concept_name.join(index.name.select(F.col("id").alias("name_id"), "canonical"), "name_id")
    rows = named.select(F.concat_ws("|", "concept_id", "name_id").alias("rowid"), "concept_id", F.lit(0).alias("is_aggregate"), tokens("canonical").alias("tokens"))
    if aliases is None:
        return rows
    a = aliases.where("aggregate").select(F.concat_ws("|", "concept_id", "space", "ext_id").alias("rowid"), "concept_id", F.lit(1).alias("is_aggregate"), tokens("name").alias("tokens"))
    return rows.unionByName(a)


def queries(asked: DataFrame) -> DataFrame:
    """asked (qid, q) to (qid, q, words, k, anchor); beginnings of less than two characters ask for nothing."""
    text = n.strip_aggregate(n.canonicalize("q"))
    r = asked.withColumn("text", text).where(F.length("text") >= MIN_QUERY).withColumn("words", tokens("text")).where(F.size("words") > 0)
    head = F.get("words", F.lit(0))
    anchor = F.when(F.size("words") > 1, F.concat(F.lit("="), head, F.lit(" "), F.substring(F.get("words", F.lit(1)), 1, 1))).when(F.length(head) > 1, F.concat(F.lit("2"), F.substring(head, 1, 2))).otherwise(F.concat(F.lit("1"), head))
    return r.select("qid", "q", "words", F.size("words").alias("k"), anchor.alias("anchor"))


def matches(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, rowid, concept_id, is_aggregate, score, n): every row that a query's phrase occurs in; lower scores are better,
    n is how many rows the query has.

    rows: `index_rows`, written once beforehand. score: minus idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * words / mean words)),
    idf = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6.
    """
    q = queries(asked)
    size = F.size("tokens")
    if q.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES:
        q = F.broadcast(q)
    posted = rows.select("rowid", "concept_id", "is_aggregate", "tokens", F.posexplode("tokens").alias("pos", "t"))
    follows = F.substring(F.get("tokens", F.col("pos") + 1), 1, 1)  # null behind the last word, which starts no phrase of several
    keys = F.array(F.concat(F.lit("="), "t", F.lit(" "), follows), F.concat(F.lit("2"), F.substring("t", 1, 2)), F.concat(F.lit("1"), F.substring("t", 1, 1)))
    postings = posted.withColumn("anchor", F.explode(keys)).drop("t")
    last = F.get("words", F.col("k") - 1)
    whole = F.slice("tokens", F.col("pos") + 1, F.greatest(F.col("k") - 1, F.lit(0))) == F.slice("words", F.lit(1), F.col("k") - 1)
    ending = F.get("tokens", F.col("pos") + F.col("k") - 1)
    hit = postings.join(q, "anchor").where(whole & ending.isNotNull() & F.startswith(ending, last))
    per = cut(hit.groupBy("qid", "rowid").agg(F.count(F.lit(1)).alias("f"), F.first("concept_id").alias("concept_id"), F.first("is_aggregate").alias("is_aggregate"), F.first(size).alias("len")))
    found = per.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    n_rows, mean = rows.agg(F.count(F.lit(1)), F.avg(size)).first()
    idf = F.greatest(F.log((F.lit(n_rows) - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    norm = F.col("f") + 1.2 * (0.25 + 0.75 * F.col("len") / F.lit(mean))
    return per.join(found, "qid").select("qid", "rowid", "concept_id", "is_aggregate", (-idf * F.col("f") * 2.2 / norm).alias("score"), "n")


def pool_of(m: DataFrame, most: int = POOL) -> DataFrame:
    """The `most` best rows of every query of `matches`. Only queries with more rows are ranked: in parts first, so that no
    query of very many rows is sorted in one task."""
    def best(df: DataFrame, *by: str) -> DataFrame:
        return df.withColumn("k", F.row_number().over(Window.partitionBy("qid", *by).orderBy("score", "rowid"))).where(F.col("k") <= most).drop("k")

    parted = m.where(F.col("n") > most).withColumn("part", F.pmod(F.xxhash64("rowid"), F.lit(PARTS)))
    return m.where(F.col("n") <= most).unionByName(best(best(parted, "part").drop("part"))).drop("n")


def limit_of(limit: int) -> int:
    return DEFAULT_LIMIT if limit <= 0 else min(limit, MOST_LIMIT)


def suggest(rows: DataFrame, asked: DataFrame, index: Index, effective: DataFrame, area: str = "", ranks: tuple[str, ...] = (), backbone: str = "", limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(qid, position, concept_id, canonical, rank, status, score, in_area, aggregate, sec_reference): ranked suggestions of every query.

    rows: `index_rows`, written once beforehand; effective: `ingest.closure`. Rank and backbone filter what the pool holds (not
    before), as the order of cuts is part of the result. One area only; unknown ranks and backbones are refused.
    """
    unknown = [r for r in ranks if r not in (*v.RANK_ORDER, "OTHER")]
    if unknown:
        raise ValueError(f"unknown rank: {unknown[0]}")
    if backbone and not index.concept.where(F.col("backbone_id") == backbone).limit(1).collect():
        raise ValueError(f"unknown backbone: {backbone}")
    limit = limit_of(limit)
    m = matches(rows, asked)
    pool = pool_of(m)
    code = v.AREA_ALIASES.get(area.strip().upper(), area.strip().upper())
    there = effective.where((F.col("area_scheme") == SCHEME) & (F.col("area_code") == code)).select("concept_id", F.lit(True).alias("in_area")).distinct()
    if code:
        outside = m.where(F.col("n") > POOL).drop("n").join(there.drop("in_area"), "concept_id", "left_semi").join(pool.select("qid", "rowid"), ["qid", "rowid"], "left_anti")
        pool = pool.unionByName(outside.withColumn("score", F.lit(BEYOND_POOL)))
    named = index.concept.join(index.name.select(F.col("id").alias("accepted_name"), "canonical", F.col("rank").alias("name_rank")), "accepted_name")
    c = named.select(F.col("id").alias("concept_id"), "canonical", F.col("rank").alias("concept_rank"), "name_rank", "status", "backbone_id", F.coalesce("sec_reference", F.lit("")).alias("sec_reference"))
    if ranks:
        c = c.where(F.col("concept_rank").isin(*ranks))
    if backbone:
        c = c.where(F.col("backbone_id") == backbone)
    each = pool.groupBy("qid", "concept_id").agg(F.min("score").alias("score"), F.max("is_aggregate").alias("aggregate")).join(c, "concept_id").join(there, "concept_id", "left")
    each = each.withColumn("in_area", F.coalesce("in_area", F.lit(False)) if code else F.lit(False))
    fetch = each.withColumn("fetched", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("in_area"), "score", "concept_id")))
    fetch = fetch.where(F.col("fetched") <= max(FETCH_FACTOR * limit, LEAST_FETCH))
    order = Window.partitionBy("qid").orderBy(F.desc("in_area"), F.desc(F.col("status") == "ACCEPTED"), v.rank_order("name_rank"), "score", "fetched")
    top = fetch.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    return top.select("qid", "position", "concept_id", "canonical", F.col("name_rank").alias("rank"), "status", "score", "in_area", "aggregate", "sec_reference")


def in_space(suggested: DataFrame, asked: DataFrame, entries: DataFrame, space: str) -> DataFrame:
    """suggested with target_space_name: the spelling that a name space uses for each concept, '' where it has none.

    Whether a collective species is asked for comes from the query, not from the row that was hit. An unknown space is refused.
    """
    spelled = spellings(entries, space)
    kind = asked.select("qid", n.is_aggregate("q").alias("asks_aggregate"))
    j = suggested.join(kind, "qid").join(spelled, "concept_id", "left")
    name = F.when(F.col("asks_aggregate"), F.col("of_aggregate")).otherwise(F.coalesce("of_plain", "of_any"))
    return j.select(*suggested.columns, F.coalesce(name, F.lit("")).alias("target_space_name"))
