"""Closed vocabularies: ranks, statuses, relations, trait dimensions and scales, areas, nomenclatural status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranks in their order; the three nothotaxon ranks have spellings of their own.
RANK_ORDER = {"FAMILY": 0, "GENUS": 1, "SPECIES": 2, "SUBSPECIES": 3, "NOTHOSUBSPECIES": 4, "VARIETY": 5, "SUBVARIETY": 6, "NOTHOVARIETY": 7, "FORM": 8, "SUBFORM": 9, "NOTHOFORM": 10}
RANK_SPELLINGS = {"NOTHOSUBSP.": "NOTHOSUBSPECIES", "NOTHOVAR.": "NOTHOVARIETY", "NOTHOF.": "NOTHOFORM"}
STATUSES = ("ACCEPTED", "SYNONYM", "UNPLACED")
#: Relation labels of the source and their names here, and the relation seen from the other side.
RELATIONS = {
    "congruent to": "congruent", "not congruent to": "not_congruent", "includes": "includes", "included in": "included_in", "overlaps": "overlaps",
    "included in or includes or overlaps": "includes_or_included_in_or_overlaps", "is pro parte synonym for": "pro_parte", "is misapplied name for": "misapplied",
}
INVERSE = {"congruent": "congruent", "not_congruent": "not_congruent", "overlaps": "overlaps", "includes_or_included_in_or_overlaps": "includes_or_included_in_or_overlaps", "includes": "included_in", "included_in": "includes"}
#: The scales of the indicator values, by vocabulary and dimension: least, greatest, normalised.
SCALES = {
    ("eive", "M"): (0.0, 10.0, True), ("eive", "N"): (0.0, 10.0, True), ("eive", "R"): (0.0, 10.0, True), ("eive", "L"): (0.0, 10.0, True), ("eive", "T"): (0.0, 10.0, True),
    ("tichy2023", "L"): (1.0, 9.0, False), ("tichy2023", "T"): (1.0, 12.0, False), ("tichy2023", "M"): (1.0, 12.0, False), ("tichy2023", "R"): (1.0, 9.0, False),
    ("tichy2023", "N"): (1.0, 9.0, False), ("tichy2023", "S"): (0.0, 9.0, False),
}
VOCABULARIES = ("eive", "tichy2023", "midolo2023")
DIMENSIONS = ("M", "N", "R", "L", "T", "S", "disturbance_severity", "disturbance_frequency", "mowing_frequency", "grazing_pressure", "soil_disturbance")
AREA_ALIASES = {"DE": "GER", "AT": "AUT", "CH": "SWI"}
#: Ranks that are left out of a list of names to publish.
EXCLUDED_RANKS = ("VARIETY", "SUBVARIETY", "FORM", "SUBFORM")

#: Fragments of a nomenclatural status. A question mark overrides all; guards are masked out before the rest.
UNCERTAIN = "?"
GUARDS = ("sensu auct.", "tentatively listed as a synonym", "fossil name", "isonym", "nom. cons. prop.", "nom. utique rej. prop.", "nom. rej. prop.")
DISQUALIFYING = (
    "illeg", "not validly publ", "superfl", "nom. nud.", "pro syn", "orth. var.", "opus utique", "basionym", "latin descr", "type", "nom. rej", "contrary to art", "nom. provis",
    "nom. subnud", "comb. not", "sphalm", "nom. utique rej", "not effectively publ", "describing the collection", "later homonym", "combination not", "without diagnostic descr", "sine descr. lat.",
)
ACCEPTABLE = ("nom. cons.", "nom. altern.", "nom. alt.", "legitimate homonym", "orth. cons.")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mapped(c: Column, table: dict[str, str] | dict[str, int], default: object = None) -> Column:
    """A closed table as a chain of comparisons (stays inside generated code)."""
    chain = None
    for k, v in table.items():
        chain = (F if chain is None else chain).when(c == k, F.lit(v))
    return chain.otherwise(F.lit(default))


def parse_rank(c: Column | str) -> Column:
    """A rank of the vocabulary, null for anything else (the strict reading)."""
    up = F.upper(F.trim(_col(c)))
    return F.when(up.isin(*RANK_ORDER, "OTHER"), up)


def parse_rank_lenient(c: Column | str) -> Column:
    """A rank of the vocabulary; anything else, also '' and null, is OTHER."""
    up = F.upper(F.trim(_col(c)))
    return F.coalesce(mapped(up, RANK_SPELLINGS), parse_rank(c), F.lit("OTHER"))


def rank_verbatim(c: Column | str) -> Column:
    """The spelling as it came, trimmed, where the rank is OTHER, else null."""
    return F.when(parse_rank_lenient(c) == "OTHER", F.trim(F.coalesce(_col(c), F.lit(""))))


def rank_order(rank: Column | str) -> Column:
    return mapped(_col(rank), RANK_ORDER, 11)


def parse_status(c: Column | str) -> Column:
    up = F.upper(F.trim(_col(c)))
    return F.when(up.isin(*STATUSES), up).otherwise("UNKNOWN")


def parse_relation(c: Column | str) -> Column:
    """A relation by its label or its name, null for anything else (callers refuse such rows, they never guess)."""
    low = F.lower(F.trim(_col(c)))
    return F.coalesce(mapped(low, RELATIONS), F.when(low.isin(*RELATIONS.values()), low))


def inverse_relation(c: Column | str) -> Column:
    """The relation in the other direction; null where the source's statement has none."""
    return mapped(_col(c), INVERSE)


def is_equality(c: Column | str) -> Column:
    return _col(c) == "congruent"


def is_concept_relation(c: Column | str) -> Column:
    return _col(c) != "misapplied"


def parse_flag(c: Column | str) -> Column:
    """true, false, or null for empty; anything else is null too and belongs into quarantine."""
    low = F.lower(F.trim(_col(c)))
    return F.when(low == "true", True).when(low == "false", False)


def parse_dimension(c: Column | str) -> Column:
    low = F.lower(F.trim(_col(c)))
    return mapped(low, {d.lower(): d for d in DIMENSIONS})


def parse_vocabulary(c: Column | str) -> Column:
    """A trait vocabulary whatever its case, null for anything else."""
    low = F.lower(F.trim(_col(c)))
    return F.when(low.isin(*VOCABULARIES), low)


def scale(vocab: Column, dim: Column) -> Column:
    """struct(least, greatest, normalized) of a dimension; 0, 0, false where none is defined."""
    chain = None
    of = lambda s: F.struct(F.lit(s[0]).alias("least"), F.lit(s[1]).alias("greatest"), F.lit(s[2]).alias("normalized"))
    for (v, d), s in SCALES.items():
        chain = (F if chain is None else chain).when((vocab == v) & (dim == d), of(s))
    return chain.otherwise(of((0.0, 0.0, False)))


def area_code(c: Column | str) -> Column:
    """One area as typed to the code it stands for; unknown codes pass through in upper case."""
    up = F.upper(F.trim(_col(c)))
    return F.coalesce(mapped(up, AREA_ALIASES), up)


def normalize_nom_status(c: Column | str) -> Column:
    """Lower case, single blanks, without commas and blanks at the front."""
    s = F.lower(F.btrim(F.regexp_replace(_col(c), r"(?U)\s+", " "), F.lit(" ")))
    return F.coalesce(F.regexp_replace(s, "^[, ]+", ""), F.lit(""))


def nom_status(c: Column | str) -> Column:
    """struct(judgement, matched) of a nomenclatural status; judgement is absent, acceptable, disqualifying or unclassified."""
    text = normalize_nom_status(c)
    matched: list[Column] = [F.when(text.contains(UNCERTAIN), UNCERTAIN)]
    rest = text
    guarded = F.lit(False)
    for g in GUARDS:
        here = rest.contains(g)
        matched.append(F.when(here, g))
        guarded = guarded | here
        rest = F.replace(rest, F.lit(g), F.lit(" "))
    bad, good = [rest.contains(f) for f in DISQUALIFYING], [rest.contains(f) for f in ACCEPTABLE]
    matched += [F.when(h, f) for h, f in zip([*bad, *good], [*DISQUALIFYING, *ACCEPTABLE])]
    either = lambda flags: F.exists(F.array(*flags), lambda x: x)
    judgement = (
        F.when(text == "", "absent").when(text.contains(UNCERTAIN), "unclassified").when(either(bad), "disqualifying")
        .when(guarded, "unclassified").when(either(good), "acceptable").otherwise("unclassified")
    )
    return F.struct(judgement.alias("judgement"), F.array_compact(F.array(*matched)).alias("matched"))


def nom_status_reason(raw: Column | str, status: Column) -> Column:
    """The verdict as one sentence."""
    quoted = lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    text = quoted(F.coalesce(_col(raw), F.lit("")))
    tokens = F.array_join(F.transform(status["matched"], quoted), ", ")
    return (
        F.when(status["judgement"] == "absent", "no nom_status recorded (not the same as verified clean)")
        .when(F.size(status["matched"]) == 0, F.concat(F.lit("nom_status "), text, F.lit(" matches no known token")))
        .otherwise(F.concat(F.lit("nom_status "), text, F.lit(": "), status["judgement"], F.lit(" ("), tokens, F.lit(")")))
    )


def typification(homotypic: Column | str) -> Column:
    h = _col(homotypic)
    return F.when(h.isNull(), "unknown").when(h, "homotypic").otherwise("heterotypic")


def typification_order(homotypic: Column | str) -> Column:
    h = _col(homotypic)
    return F.when(h.isNull(), 1).when(h, 0).otherwise(2)
