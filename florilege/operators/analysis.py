"""Analyses over whole tables: statistics, evidence, histograms, unions of feeds, what is left to do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.functions import names as n
from florilege.functions import vocabulary as v
from florilege.operators import hierarchy as h
from florilege.operators.ingest import Index
from florilege.session import cut


def statistics(index: Index, traits: DataFrame, search_rows: DataFrame) -> DataFrame:
    """(table_name, measure, part, n): rows of each table, distinct keys, and counts by rank, role, backbone and area.

    For traits also how many concepts each vocabulary reaches and how many each set of vocabularies has in common.
    """
    def whole(df: DataFrame, table: str, measure: str = "rows", value: Column | None = None) -> DataFrame:
        return df.agg((F.count(F.lit(1)) if value is None else F.count_distinct(value)).alias("n")).select(F.lit(table).alias("table_name"), F.lit(measure).alias("measure"), F.lit("").alias("part"), "n")

    def split(df: DataFrame, table: str, by: str, value: Column | None = None) -> DataFrame:
        return df.groupBy(by).agg((F.count(F.lit(1)) if value is None else F.count_distinct(value)).alias("n")).select(F.lit(table).alias("table_name"), F.lit(f"by {by}").alias("measure"), F.col(by).alias("part"), "n")

    parts = [whole(getattr(index, t), t) for t in ("name", "concept", "distribution", "xref")] + [whole(search_rows, "search"), whole(traits, "trait"), whole(traits, "trait", "concepts", F.col("concept_id"))]
    parts += [whole(index.distribution, "distribution", "areas", F.col("area_code")), split(index.distribution, "distribution", "area_code", F.col("concept_id"))]
    parts += [split(index.name, "name", "rank"), split(index.concept, "concept", "rank"), split(index.concept, "concept", "backbone_id"), split(index.concept_name, "concept_name", "role"), split(traits, "trait", "vocab", F.col("concept_id"))]
    sets = traits.groupBy("concept_id").agg(F.array_join(F.array_sort(F.collect_set("vocab")), "+").alias("vocabularies"))
    return reduce(DataFrame.unionByName, [*parts, split(sets, "trait", "vocabularies")])


def positions(df: DataFrame, group: list[str], order: list[str], size: str = "n") -> DataFrame:
    """df with position (from 0) of each row in its group's order and the size of the group; nulls are a group of their own.

    Rows are sorted in ranges, whatever the sizes of the groups; only the counts of each range and group are summed up.
    """
    ranged = cut(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33).alias("_part")
    counts = ranged.groupBy(*group, part).agg(F.min("_m").alias("_start"), F.count(F.lit(1)).alias("_size"))
    together = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_size").over(together.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = counts.withColumn("_before", before).withColumn("_all", F.sum("_size").over(together)).drop("_size")
    keyed = ranged.withColumn("_p", part)
    same = [keyed[g].eqNullSafe(spans[g]) for g in group]
    j = keyed.join(spans, [F.col("_p") == F.col("_part"), *same])
    return j.select(*[keyed[c] for c in df.columns], (F.col("_m") - F.col("_start") + F.col("_before")).alias("position"), F.col("_all").alias(size))


def key_values(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): each folded key once with its latest value that is not empty, also folded; '' when it never has one."""
    r = rows.select(n.canonicalize(key).alias("key"), F.coalesce(n.canonicalize(value), F.lit("")).alias("value"), F.col(order).alias("_order")).where("key is not null and key <> ''")
    return r.groupBy("key").agg(F.coalesce(F.max_by(F.when(F.col("value") != "", F.col("value")), F.when(F.col("value") != "", F.col("_order"))), F.lit("")).alias("value"))


def ranked(rows: DataFrame, ranks: tuple[str, ...], column: str = "rank") -> DataFrame:
    """The rows of some ranks, whatever their case."""
    return rows.where(F.upper(F.trim(F.col(column))).isin(*[r.upper() for r in ranks]))


def head(rows: DataFrame, order: str, k: int) -> DataFrame:
    """The first k rows of a source in its order."""
    return rows.orderBy(order).limit(k)


#: Letters of an epithet that a neighbour shares, and how many neighbours are shown.
NEAR_LETTERS, NEAR_SHOWN = 5, 3


def evidence(sample: DataFrame, names: DataFrame) -> DataFrame:
    """sample (name) and names (name: distinct) to (name, same_genus, near): how many names have its genus, and the first
    three in order that begin with the genus and the first letters of the epithet."""
    genus, epithet = F.split("name", " ")[0], F.coalesce(F.get(F.split("name", " "), F.lit(1)), F.lit(""))
    asked = sample.select("name", genus.alias("genus"), F.concat_ws(" ", genus, F.substring(epithet, 1, NEAR_LETTERS)).alias("beginning"))
    known = names.select(F.col("name").alias("other"), genus.alias("genus"))
    # A genus is counted before it is joined; only neighbours are joined as rows.
    counted = asked.join(known.groupBy("genus").agg(F.count(F.lit(1)).alias("same_genus")), "genus", "left")
    near = asked.join(known, "genus").where(F.startswith("other", "beginning"))
    top = near.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("other"))).where(F.col("k") <= NEAR_SHOWN)
    lists = top.groupBy("name").agg(F.array_sort(F.collect_list("other")).alias("near"))
    return counted.join(lists, "name", "left").select("name", F.coalesce("same_genus", F.lit(0)).alias("same_genus"), F.coalesce("near", F.array().cast("array<string>")).alias("near"))


def rank_histogram(suggested: DataFrame) -> DataFrame:
    """`suggest` to (qid, rank, n, order): the ranks among each query's suggestions, in the order of the ranks."""
    return suggested.groupBy("qid", "rank").agg(F.count(F.lit(1)).alias("n")).withColumn("order", v.rank_order("rank"))


def first_genus(candidates: DataFrame) -> DataFrame:
    """candidates (qid, concept_id, rank, score) to (qid, candidates, first_genus): where by score the first genus stands, null
    without one. Counted from the best genus's score, without sorting any query's candidates."""
    key = F.struct("score", "concept_id")
    best = candidates.where("rank = 'GENUS'").groupBy("qid").agg(F.min(key).alias("best"))
    j = candidates.join(best, "qid", "left")
    ahead = F.count_if(F.struct("score", "concept_id") < F.col("best"))
    return j.groupBy("qid").agg(F.count(F.lit(1)).alias("candidates"), F.when(F.max("best").isNotNull(), ahead + 1).alias("first_genus"))


def xref_coverage(xref: DataFrame) -> DataFrame:
    """(authority, concepts, several, most): concepts with an id, with several, and the most ids of one; authority null is any."""
    each = xref.groupBy("authority", "concept_id").agg(F.count_distinct("ext_id").alias("k"))
    any_ = xref.groupBy("concept_id").agg(F.count(F.lit(1)).alias("k")).withColumn("authority", F.lit(None).cast("string"))
    return each.unionByName(any_).groupBy("authority").agg(F.count(F.lit(1)).alias("concepts"), F.count_if(F.col("k") > 1).alias("several"), F.max("k").alias("most"))


def cross_backbone_edges(index: Index, edges: DataFrame, home: str = "cdm") -> DataFrame:
    """(relation, edges, leaving): edges by relation, and how many have an end outside the home backbone."""
    of = lambda c: index.concept.select(F.col("id").alias(c), (F.col("backbone_id") != home).alias(f"{c}_out"))
    j = edges.join(of("from_id"), "from_id").join(of("to_id"), "to_id")
    return j.groupBy("relation").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("from_id_out") | F.col("to_id_out")).alias("leaving"))


def bearers(lookup: DataFrame) -> DataFrame:
    """(canonical_fold, backbone_id, role, authorship, concepts): who bears each name that several concepts bear."""
    several = lookup.groupBy("canonical_fold").agg((F.min("concept_id") < F.max("concept_id")).alias("several")).where("several").select("canonical_fold")
    return lookup.join(several, "canonical_fold", "left_semi").groupBy("canonical_fold", "backbone_id", "role", F.coalesce("authorship", F.lit("")).alias("authorship")).agg(F.count_distinct("concept_id").alias("concepts"))


# --- feeds --------------------------------------------------------------------------------------------------------------


def seed_union(first: DataFrame, second: DataFrame, joinable: DataFrame | None = None) -> DataFrame:
    """Two feeds (item, v) to (item, first_id, second_id), items that either of the ids makes joinable, ordered by their number.

    Of several values of an item in one feed the greatest is taken. Without `joinable` (id) every item is kept.
    """
    one = lambda df, c: df.groupBy("item").agg(F.max("v").alias(c))
    both = one(first, "first_id").join(one(second, "second_id"), "item", "full")
    if joinable is not None:
        known = joinable.select(F.col("id")).distinct()
        ids = both.select("item", F.explode(F.array("first_id", n.lsid_id("second_id"))).alias("id")).where("id is not null")
        both = both.join(ids.join(known, "id", "left_semi").select("item").distinct(), "item", "left_semi")
    return both.orderBy(F.substring("item", 2, 20).try_cast("long"), "item")


def remaining(targets: DataFrame, done: DataFrame, key: str = "item") -> DataFrame:
    """What is still to be done: targets whose key is not among those done."""
    return targets.join(done.select(key).distinct(), key, "left_anti")


def enrich(targets: DataFrame, statements: DataFrame, properties: tuple[str, ...]) -> DataFrame:
    """targets (item) and statements (item, property, v, seq) to a row an item with a column a property; items without any
    statement are kept, of repeated statements the last one counts."""
    last = [F.max_by(F.when(F.col("property") == p, F.col("v")), F.when(F.col("property") == p, F.col("seq"))).alias(p) for p in properties]
    return targets.join(statements.groupBy("item").agg(*last), "item", "left")


def traverse(children: DataFrame, roots: DataFrame) -> DataFrame:
    """children (node, parent) and roots (node) to (node, parent, root, depth) of every node that a root reaches.

    A node that is listed under several parents keeps the smallest one; cycles are never reached.
    """
    named = roots.select(F.lit("t").alias("tree"), F.col("node").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit("").alias("order"))
    rows = children.select(F.lit("t").alias("tree"), F.col("node").alias("id"), "parent", F.concat(F.lit("p"), "parent").alias("order")).unionByName(named)
    tree = h.hierarchy(h.peel(h.encode(rows)))
    reached = tree.join(roots.select(F.col("node").alias("root_id")).distinct(), "root_id", "left_semi")
    return reached.select(F.col("node_id").alias("node"), F.col("parent_id").alias("parent"), F.col("root_id").alias("root"), "depth")
