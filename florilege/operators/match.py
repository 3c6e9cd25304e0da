"""Name resolution for whole batches: exact, author-aware, collective-species and fuzzy, in a fixed order of decisions.

All requests go through each step together. Winners are told apart with min and max of the concept id (equal: one concept),
so every step is a plain aggregation that combines before its shuffle. The fuzzy step never joins requests with all names of
a letter: which 20 candidates a request gets depends only on its first character and length, so the first 20 names of every
(character, length) are taken once and a request looks into seven of these short lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.functions import names as n
from florilege.session import cut

#: How sure a match is, from which similarity a fuzzy match counts and from which a candidate is shown.
CONFIDENCE = {"exact_author": 0.99, "exact": 0.90, "aggregate_alias": 0.95, "aggregate_nominate": 0.88}
FUZZY_FROM, SHOWN_FROM = 0.85, 0.70
LENGTH_WINDOW, CANDIDATES = 3, 20
#: The notes to a result.
NOTE_AGGREGATE = "Aggregat, keine Kleinartauflösung"
NOTE_AGGREGATE_OPEN = "Aggregat ohne aufgelöstes Sammelart-Konzept"
NOTE_NOMINATE = "Aggregat: keine Sammelart im Index, aufgelöst auf das Nominal-Konzept — deckt weniger ab als die Anfrage"
NOTE_UNRESOLVABLE = "Kein eindeutiger Treffer, keine Fuzzy-Auflösung in dieser SP"
NOTE_NEAR_MISS = "Nicht aufgelöst: kein Treffer über der Ähnlichkeitsschwelle. Die gelisteten Kandidaten sind die nächstliegenden Namen im Index, zur manuellen Prüfung — KEINE Auflösung"
NOTE_AMBIGUOUS = "Mehrdeutiger Treffer: mehrere Konzepte mit gleicher Übereinstimmungsstärke, manuelle Prüfung nötig"
NOTE_FUZZY = "Fuzzy-Treffer: Ähnlichkeit über Schwellenwert, manuelle Prüfung erforderlich"
NOTE_FUZZY_AMBIGUOUS = "Mehrdeutiger Fuzzy-Treffer: mehrere Konzepte mit gleicher Ähnlichkeit, manuelle Prüfung nötig"
AGGREGATE_PREFIX = "Aggregat: "


def narrowed(lookup: DataFrame, backbone: str | None = None, sec: str | None = None) -> DataFrame:
    """The lookup of one backbone and/or reference; unknown ones are refused."""
    for column, value in (("backbone_id", backbone), ("sec_reference", sec)):
        if value:
            lookup = lookup.where(F.col(column) == value)
            if not lookup.limit(1).collect():
                raise ValueError(f"unknown {column}: {value}")
    return lookup


def requests(rows: DataFrame) -> DataFrame:
    """rows (id, verbatim) read: canonical part and author, their comparison keys, and whether it names a collective species."""
    canonical, author = n.split_verbatim("verbatim")
    r = rows.select("id", "verbatim", F.coalesce(canonical, F.lit("")).alias("canonical"), F.coalesce(author, F.lit("")).alias("author_part"))
    return r.select("id", "verbatim", n.canonicalize("canonical").alias("canon"), n.normalize_author("author_part").alias("author"), n.is_aggregate("canonical").alias("aggregate"))


def _decide(answers: DataFrame) -> DataFrame:
    """Per (id, ord): n candidates, their names, and the concept of the sole winner, or several."""
    kind = n.classify_match(F.col("key"), F.col("author"), F.col("canonical_fold"), n.normalize_author(F.coalesce("authorship", F.lit(""))))
    a = answers.withColumn("kind", kind)
    won = F.col("kind").isNotNull()
    accepted, same_type = won & (F.col("role") == "accepted"), won & F.coalesce("homotypic", F.lit(False))
    bound = lambda cond, name: [f(F.when(cond, F.col("concept_id"))).alias(f"{name}_{f.__name__}") for f in (F.min, F.max)]
    named = F.struct("concept_id", "name_id", "canonical")
    d = a.groupBy("id", "ord").agg(
        *bound(F.lit(True), "any"), *bound(won, "won"), *bound(accepted, "acc"), *bound(same_type, "hom"), F.max("kind").alias("kind"),
        F.array_sort(F.collect_list(named)).alias("all_names"), F.array_sort(F.collect_list(F.when(won, named))).alias("won_names"),
    )
    one = lambda t: F.col(f"{t}_min") == F.col(f"{t}_max")
    sole = F.when(one("won"), F.col("won_min")).when(F.col("acc_min").isNotNull(), F.when(one("acc"), F.col("acc_min"))).when(one("hom"), F.col("hom_min"))
    texts = lambda c: F.transform(c, lambda x: x["canonical"])
    return d.select(
        "id", "ord", "kind", sole.alias("sole"), F.when(one("any"), F.col("any_min")).alias("only"), F.col("won_min").isNotNull().alias("has_winner"),
        texts("all_names").alias("all_names"), texts("won_names").alias("won_names"),
    )


def result(match_type: Column, confidence: Column, concept: Column, review: Column, note: Column, candidates: Column) -> Column:
    return F.struct(
        match_type.cast("string").alias("match_type"), confidence.cast("double").alias("confidence"), concept.cast("string").alias("concept_id"),
        review.cast("boolean").alias("requires_review"), note.cast("string").alias("note"), F.coalesce(candidates, F.array().cast("array<string>")).alias("candidates"),
    )


def match(rows: DataFrame, lookup: DataFrame) -> DataFrame:
    """rows (id: unique, verbatim) to (id, match_type, confidence, concept_id, requires_review, note, candidates).

    lookup: `ingest.lookup`, possibly `narrowed`. A match_type of unresolvable has no concept; a blank verbatim is unresolvable.
    """
    r = requests(rows)
    probes = r.select("id", "author", "aggregate", F.posexplode(F.concat(F.array("canon"), F.when(F.col("aggregate"), n.aggregate_bases("canon")).otherwise(F.array().cast("array<string>")))).alias("ord", "key"))
    probes = probes.withColumn("author", F.when(F.col("aggregate"), F.lit("")).otherwise(F.col("author")))
    answers = probes.where("key <> ''").join(lookup.where("canonical_fold <> ''"), F.col("key") == F.col("canonical_fold"))
    decided = _decide(answers)
    keyed = decided.join(probes.select("id", "ord", "key", "aggregate"), ["id", "ord"])
    null, none, no, yes = F.lit(None), F.array().cast("array<string>"), F.lit(False), F.lit(True)
    # Plain names: the one probe decides. Collective species: the marked name, else the outermost base that resolves.
    sure = F.when(F.col("kind") == "exact_author", CONFIDENCE["exact_author"]).otherwise(CONFIDENCE["exact"])
    plain = (
        F.when(~F.col("has_winner"), result(null, null, null, yes, F.lit(NOTE_UNRESOLVABLE), F.col("all_names")))
        .when(F.col("sole").isNotNull(), result(F.col("kind"), sure, F.col("sole"), no, null, none))
        .otherwise(result(null, null, null, yes, F.lit(NOTE_AMBIGUOUS), F.col("won_names")))
    )
    marked = F.when(F.col("only").isNotNull(), result(F.lit("aggregate_alias"), F.lit(CONFIDENCE["aggregate_alias"]), F.col("only"), no, F.lit(NOTE_AGGREGATE), none)).otherwise(
        result(null, null, null, yes, F.lit(NOTE_AMBIGUOUS), F.col("all_names"))
    )
    still = n.is_aggregate("key")
    base = F.when(F.col("sole").isNotNull() & still, result(F.lit("aggregate_alias"), F.lit(CONFIDENCE["aggregate_alias"]), F.col("sole"), no, F.lit(NOTE_AGGREGATE), none)).when(
        F.col("sole").isNotNull(), result(F.lit("aggregate_nominate"), F.lit(CONFIDENCE["aggregate_nominate"]), F.col("sole"), no, F.lit(NOTE_NOMINATE), none)
    )
    outcome = F.when(~F.col("aggregate"), plain).when(F.col("ord") == 0, marked).otherwise(base)
    exact = keyed.withColumn("res", outcome).where("res is not null").groupBy("id").agg(F.min_by("res", "ord").alias("res"))
    known = cut(r.join(exact, "id", "left"))
    open_ = known.where("res is null")
    near = fuzzy(open_.select("id", "canon"), lookup)
    missed = F.when(F.col("aggregate"), F.lit(NOTE_AGGREGATE_OPEN)).otherwise(F.lit(NOTE_UNRESOLVABLE))
    prefixed = F.struct(*[F.when(F.col("aggregate"), F.concat(F.lit(AGGREGATE_PREFIX), F.col("near.note"))).otherwise(F.col("near.note")).alias("note") if f == "note" else F.col(f"near.{f}").alias(f) for f in ("match_type", "confidence", "concept_id", "requires_review", "note", "candidates")])
    rest = open_.drop("res").join(near, "id", "left").withColumn("res", F.when(F.col("near").isNull(), result(null, null, null, yes, missed, none)).otherwise(prefixed))
    out = known.where("res is not null").select("id", "res").unionByName(rest.select("id", "res"))
    return out.select("id", F.coalesce("res.match_type", F.lit("unresolvable")).alias("match_type"), "res.confidence", "res.concept_id", "res.requires_review", "res.note", "res.candidates")


def fuzzy_candidates(open_: DataFrame, lookup: DataFrame) -> DataFrame:
    """open_ (id, canon) to (id, canon, name_id, canonical, canonical_fold, concept_id): the rows of the 20 nearest names in length.

    Names begin with the same character and are at most three characters longer or shorter; nearest length, then folded name,
    then name id decide.
    """
    size, head = F.length("canonical_fold"), F.substring("canonical_fold", 1, 1)
    listed = lookup.where("canonical_fold <> ''").select("name_id", "canonical_fold").distinct().select("name_id", "canonical_fold", head.alias("head"), size.alias("size"))
    by_list = Window.partitionBy("head", "size").orderBy("canonical_fold", "name_id")
    short = listed.withColumn("k", F.row_number().over(by_list)).where(F.col("k") <= CANDIDATES).drop("k")
    length = F.length("canon")
    asked = open_.where("canon <> ''").select("id", "canon", F.substring("canon", 1, 1).alias("head"), F.explode(F.sequence(length - LENGTH_WINDOW, length + LENGTH_WINDOW)).alias("size"))
    by_request = Window.partitionBy("id").orderBy(F.abs(F.col("size") - length), "canonical_fold", "name_id")
    near = asked.join(short, ["head", "size"]).withColumn("k", F.row_number().over(by_request)).where(F.col("k") <= CANDIDATES).select("id", "canon", "name_id")
    return near.join(lookup.select("name_id", "canonical", "canonical_fold", "concept_id"), "name_id")


def fuzzy(open_: DataFrame, lookup: DataFrame) -> DataFrame:
    """open_ (id, canon) to (id, near: result struct), for those that have a candidate worth showing."""
    scored = fuzzy_candidates(open_, lookup).withColumn("score", n.similarity("canon", "canonical_fold"))
    scored = scored.where(F.col("score") >= SHOWN_FROM)
    best = scored.withColumn("best", F.max("score").over(Window.partitionBy("id")))
    top = F.col("score") == F.col("best")
    g = best.groupBy("id").agg(
        F.max("best").alias("best"), F.min(F.when(top, F.col("concept_id"))).alias("low"), F.max(F.when(top, F.col("concept_id"))).alias("high"),
        F.array_sort(F.collect_list(F.when(top, F.struct("concept_id", "name_id", "canonical")))).alias("winners"), F.collect_set(F.struct((-F.col("score")).alias("s"), "canonical")).alias("shown"),
    )
    null, yes = F.lit(None), F.lit(True)
    names = F.transform("winners", lambda x: x["canonical"])
    # Of equal names with several scores the best counts.
    ordered = F.array_sort("shown")
    shown = F.transform(F.filter(ordered, lambda x, i: ~F.exists(F.slice(ordered, F.lit(1), i), lambda y: y["canonical"] == x["canonical"])), lambda x: x["canonical"])
    res = (
        F.when(F.col("best") < FUZZY_FROM, result(null, null, null, yes, F.lit(NOTE_NEAR_MISS), shown))
        .when(F.col("low") == F.col("high"), result(F.lit("fuzzy"), F.col("best"), F.col("low"), yes, F.lit(NOTE_FUZZY), names))
        .otherwise(result(null, null, null, yes, F.lit(NOTE_FUZZY_AMBIGUOUS), names))
    )
    return g.select("id", res.alias("near"))


def spellings(entries: DataFrame, space: str) -> DataFrame:
    """(concept_id, of_aggregate, of_plain, of_any): the spellings of a name space; an unknown space is refused.

    Accepted spellings go first, then the order of the external ids; of_any is the first entry whatever it is.
    """
    e = entries.where(F.col("space") == space)
    if not e.limit(1).collect():
        raise ValueError(f"unknown name space: {space}")
    order = F.struct((F.col("status") != "accepted").alias("later"), "ext_id")
    return e.groupBy("concept_id").agg(
        F.min_by(F.when(F.col("aggregate"), F.col("name")), F.when(F.col("aggregate"), order)).alias("of_aggregate"),
        F.min_by(F.when(~F.col("aggregate"), F.col("name")), F.when(~F.col("aggregate"), order)).alias("of_plain"), F.min_by("name", "ext_id").alias("of_any"),
    )


def in_space(results: DataFrame, rows: DataFrame, entries: DataFrame, space: str) -> DataFrame:
    """results of `match` with target_space_name and aggregate_policy: the spelling that a name space uses for the concept.

    A query for a collective species takes only such a spelling (policy known, else unresolvable); any other query takes a
    plain spelling, else the first entry.
    """
    spelled = spellings(entries, space)
    asks = rows.select("id", n.is_aggregate(n.split_verbatim("verbatim")[0]).alias("asks_aggregate"))
    j = results.join(asks, "id").join(spelled, "concept_id", "left")
    resolved = F.col("concept_id").isNotNull()
    name = F.when(F.col("asks_aggregate"), F.col("of_aggregate")).otherwise(F.coalesce("of_plain", "of_any"))
    policy = F.when(F.col("asks_aggregate"), F.when(F.col("of_aggregate").isNotNull(), "known").otherwise("unresolvable")).otherwise("")
    return j.select(*results.columns, F.when(resolved, F.coalesce(name, F.lit(""))).alias("target_space_name"), F.when(resolved, policy).alias("aggregate_policy"))
