"""Name functions as Column expressions: folding, authors, hybrid and aggregate markers, the candidate ladder, similarity.

Every function maps null to null; an empty or blank text folds to ''. Words are separated by any Unicode white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters that folding makes plain, and what they become. ß, ł, ø and đ are letters of their own.
FOLD_FROM = "àáâãäåāăąèéêëēĕėęěìíîïĩīĭįòóôõöōŏőùúûüũūŭůűųýÿñńņňçćĉċčśŝşšźżžĺļľřŕŗďťţğģ"
FOLD_TO = "aaaaaaaaaeeeeeeeeeiiiiiiiioooooooouuuuuuuuuuyynnnncccccsssszzzlllrrrdttgg"
#: The marks of hybrids, of collective species, and of ranks below species.
HYBRID = "×"
AGGREGATE_PAIR = r"^(.+) s\. (?:l|lat)\.$"
AGGREGATE_WORD = r"^(.+) (?:agg\.|aggr\.|s\.l\.|s\.lat\.|sl\.)$"
INFRASPECIFIC = ("subsp.", "ssp.", "var.", "f.", "subf.", "subvar.")
#: The ladder's rules in the order of their rank; the last two are flagged.
RULES = ("exact", "hybrid_spacing", "hybrid_marker_dropped", "hybrid_marker_added", "orthography_genitive", "aggregate", "aggregate_to_nominate", "autonym")
FLAGGED = ("aggregate_to_nominate", "autonym")

LADDER = "array<struct<ord:int,key:string,rule:string>>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def spaced(c: Column | str) -> Column:
    """White space at the ends removed, elsewhere one blank."""
    return F.btrim(F.regexp_replace(_col(c), r"(?U)\s+", " "), F.lit(" "))


def canonicalize(c: Column | str) -> Column:
    """The key by which names are compared: one blank between words, lower case, accents of FOLD_FROM removed."""
    return F.translate(F.lower(spaced(c)), FOLD_FROM, FOLD_TO)


def normalize_author(c: Column | str) -> Column:
    """An author citation with single blanks, no blank before a full stop and one blank around each ampersand."""
    s = F.replace(spaced(c), F.lit(" ."), F.lit("."))
    return F.regexp_replace(s, r" *& *", " & ")


def split_verbatim(c: Column | str) -> tuple[Column, Column]:
    """(canonical part, author part): the author starts at the first later word that begins with ( or A to Z."""
    s = spaced(c)
    pattern = r"^(\S+(?: [^(A-Z ]\S*)*)(?: (.*))?$"
    return F.regexp_extract(s, pattern, 1), F.regexp_extract(s, pattern, 2)


def _words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def hybrid_spaced(canon: Column | str) -> Column:
    """A hybrid mark that is glued to a word, or typed as x behind the first word, as a word of its own."""

    def one(w: Column, i: Column) -> Column:
        glued = w.startswith(HYBRID) & (w != HYBRID)
        return F.when(glued, F.array(F.lit(HYBRID), F.substring(w, F.lit(2), F.length(w)))).when((w == "x") & (i > 0), F.array(F.lit(HYBRID))).otherwise(F.array(w))

    return F.array_join(F.flatten(F.transform(_words(_col(canon)), one)), " ")


def hybrid_dropped(canon: Column | str) -> Column:
    """Without hybrid marks; null when there is none or nothing else."""
    words = _words(_col(canon))
    kept = F.filter(words, lambda w: w != HYBRID)
    return F.when((F.size(kept) < F.size(words)) & (F.size(kept) > 0), F.array_join(kept, " "))


def hybrid_added(canon: Column | str) -> Column:
    """A mark between the two words of a name of two words without one, else null."""
    words = _words(_col(canon))
    return F.when((F.size(words) == 2) & ~F.array_contains(words, HYBRID), F.array_join(words, f" {HYBRID} "))


def aggregate_bases(canon: Column | str) -> Column:
    """The successive names that are left as marks of a collective species are taken off the end; the innermost is last."""
    c = _col(canon)

    def strip(s: Column) -> Column:
        pair, word = F.regexp_extract(s, AGGREGATE_PAIR, 1), F.regexp_extract(s, AGGREGATE_WORD, 1)
        return F.when(pair != "", pair).otherwise(word)

    start = F.struct(c.alias("cur"), F.array().cast("array<string>").alias("bases"))

    def step(state: Column, _: Column) -> Column:
        base = strip(state["cur"])
        more = F.struct(base.alias("cur"), F.concat(state["bases"], F.array(base)).alias("bases"))
        return F.when(base != "", more).otherwise(state)

    return F.aggregate(F.split(c, " "), start, step, lambda state: state["bases"])


def is_aggregate(name: Column | str) -> Column:
    canon = canonicalize(name)
    return canon.rlike(AGGREGATE_PAIR) | canon.rlike(AGGREGATE_WORD)


def strip_aggregate(canon: Column | str) -> Column:
    """The innermost base, or the name itself."""
    return F.coalesce(F.try_element_at(aggregate_bases(canon), F.lit(-1)), _col(canon))


def autonym_base(canon: Column | str) -> Column:
    """Genus and species of an autonym (a name whose last epithet repeats the species), else null."""
    w = _words(_col(canon))
    at = lambda i: F.get(w, F.lit(i))
    return F.when((F.size(w) == 4) & at(2).isin(*INFRASPECIFIC) & (at(1) == at(3)), F.concat_ws(" ", at(0), at(1)))


def genitive_variant(canon: Column | str) -> Column:
    """The other spelling of a last word in -i or -ii with a stem of three letters or more, else null."""
    c = _col(canon)
    last = F.substring_index(c, " ", -1)
    stem = F.regexp_replace(last, "i+$", "")
    tail = F.length(last) - F.length(stem)
    head = F.substring(c, F.lit(1), F.length(c) - F.length(last))
    able = ~last.contains(".") & (F.length(stem) >= 3)
    return F.when(able & (tail == 2), F.concat(head, stem, F.lit("i"))).when(able & (tail == 1), F.concat(head, stem, F.lit("ii")))


def ladder(name: Column | str) -> Column:
    """The keys under which a name is looked up, in order, each once: array of (ord, key, rule); empty for a blank name."""
    canon = canonicalize(name)
    sp = hybrid_spaced(canon)
    step = lambda key, rule: F.struct(key.alias("key"), F.lit(rule).alias("rule"))
    bases = aggregate_bases(canon)
    last = F.size(bases) - 1
    of_bases = F.transform(bases, lambda b, i: F.struct(b.alias("key"), F.when(i == last, F.lit("aggregate_to_nominate")).otherwise(F.lit("aggregate")).alias("rule")))
    fixed = F.array(step(canon, "exact"), step(F.when(sp != canon, sp), "hybrid_spacing"), step(hybrid_dropped(sp), "hybrid_marker_dropped"), step(hybrid_added(sp), "hybrid_marker_added"), step(genitive_variant(canon), "orthography_genitive"))
    every = F.filter(F.concat(fixed, of_bases, F.array(step(autonym_base(canon), "autonym"))), lambda x: x["key"].isNotNull() & (x["key"] != ""))
    once = F.filter(every, lambda x, i: ~F.exists(F.slice(every, F.lit(1), i), lambda y: y["key"] == x["key"]))
    numbered = F.transform(once, lambda x, i: F.struct(i.cast("int").alias("ord"), x["key"].alias("key"), x["rule"].alias("rule")))
    return F.when(canon == "", F.array().cast(LADDER)).otherwise(numbered)


def rule_rank(rule: Column | str) -> Column:
    """The place of a rule in RULES."""
    return F.array_position(F.array(*[F.lit(r) for r in RULES]), _col(rule)).cast("int") - 1


def rule_flagged(rule: Column | str) -> Column:
    return _col(rule).isin(*FLAGGED)


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 minus the edit distance over the longer length; two empty texts are alike, an empty and another are not."""
    a, b = _col(a), _col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def classify_match(canon: Column, author: Column, other_canon: Column, other_author: Column) -> Column:
    """exact_author, exact, or null; authors are normalised texts, '' when not given."""
    return F.when(canon != other_canon, F.lit(None)).when(author == "", F.lit("exact")).when(author == other_author, F.lit("exact_author"))


def display_text(canonical: Column | str, authorship: Column | str) -> Column:
    """The name followed by its authors, when there are any."""
    return F.concat_ws(" ", _col(canonical), F.nullif(_col(authorship), F.lit("")))


def powo_id(properties: Column | str) -> Column:
    """The powoid of a record's JSON properties, '' when absent or not JSON."""
    return F.coalesce(F.get_json_object(_col(properties), "$.powoid"), F.lit(""))


def parse_value(text: Column | str) -> Column:
    """A measured value; empty, x, NA and what is no number are missing."""
    t = F.trim(_col(text))
    return F.when(~F.lower(t).isin("", "x", "na", "nan", "inf", "-inf", "infinity", "-infinity"), t.try_cast("double"))


def clean_field(text: Column | str) -> Column:
    """A text that fits one field of a bar-separated file: line ends become blanks, bars slashes."""
    return F.trim(F.translate(_col(text), "\r\n|", "  /"))


def lsid_id(text: Column | str) -> Column:
    """The local part of a name identifier that may come with its life-science prefix."""
    return F.regexp_replace(F.trim(_col(text)), r"^urn:lsid:ipni\.org:names:", "")


def pick_join_id(first: Column, second: Column, first_joinable: Column, second_joinable: Column) -> Column:
    """Of two identifiers of one item: the first, unless both differ and only the second one joins; else whichever is there."""
    a, b = F.nullif(first, F.lit("")), F.nullif(second, F.lit(""))
    return F.when(a.isNotNull() & b.isNotNull() & (a != b) & ~first_joinable & second_joinable, b).otherwise(F.coalesce(a, b))
