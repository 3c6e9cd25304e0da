"""Visually identical text: confusables skeletons.

A skeleton is made as Unicode's security mechanisms describe it: decompose, replace every character by its prototype from a
look-alike table, decompose again. The table is not written out here: its pairs are asked of ICU (part of Spark's own
distribution) and of Unicode's compatibility decompositions, and adapted to what shows in print here:

* what has no ink is dropped (format characters, soft hyphens, variation selectors), blanks at the ends as well;
* full-width, joined and other compatibility letters become their usual letters, every single blank or hyphen the usual one;
* a letter becomes the first one of those it looks like, of the same letter case: the ASCII letter if there is one, else the
  one with the smallest code, whatever its script; what it looks like goes before what it is short for (a lunate sigma is a c);
* accents, letter case and punctuation stay: `l`, `I` and `1`, `0` and `O`, `m` and `rn` stay apart.

Null looks like null, and like empty text, as string columns hold either for the same thing.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from florilege.session import cut

#: Kinds of hyphen and of blank that are not covered by a category. The minus and the dashes are longer and show.
HYPHENS = "‐‑⁃﹣－"


def _is_blank(c: str) -> bool:
    return unicodedata.category(c) == "Zs" or c in "\t\n\r\x0b\x0c\x85  "


def _no_ink(c: str) -> bool:
    o = ord(c)
    return (unicodedata.category(c) in ("Cf", "Cc") and not _is_blank(c)) or c in "͏ᅟᅠㅤﾠ឴឵⠀" or 0x180B <= o <= 0x180F or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF


def letters() -> list[str]:
    """All letters that stand in a line of text: without raised and lowered ones, and without syllables of joined parts."""
    out = []
    for o in range(33, sys.maxunicode + 1):
        c = chr(o)
        raised = unicodedata.decomposition(c).startswith(("<super>", "<sub>"))
        if unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lo") and not raised and not _no_ink(c) and not 0xAC00 <= o < 0xD7A4 and not 0x3400 <= o < 0xA000 and o < 0x20000:
            out.append(c)
    return out


def shapes(spark: SparkSession, texts: list[str]) -> list[str]:
    """ICU's confusables skeleton of each text; the texts hold no line ends."""
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    out = checker.getSkeleton("\n".join(texts)).split("\n")
    if len(out) != len(texts):
        raise ValueError("ICU's skeleton does not keep line ends apart")
    return out


def case_of(c: str) -> str:
    """Capital, or not: letters without case are written like small ones."""
    return "Lu" if unicodedata.category(c) in ("Lu", "Lt") else "Ll"


def build_table(spark: SparkSession) -> dict[str, str]:
    """The look-alike table: letter to prototype (decomposed), asked of ICU once on the driver (some 25,000 letters).

    A shape that stands for several marks (l, I, 1 and |) is split by letter case. Prototypes are fixed points of the table.
    """
    every = letters()
    by_shape: dict[tuple[str, str], list[str]] = {}
    for c, shape in zip(every, shapes(spark, every)):
        by_shape.setdefault((shape, case_of(c)), []).append(c)
    table = {}
    for alike in by_shape.values():
        # A composed letter that looks like a plain one shows an accent less than it has, so it is left as it is.
        first = next((c for c in alike if c.isascii()), alike[0])
        for c in alike:
            if c != first and unicodedata.normalize("NFD", c) == c:
                table[c] = unicodedata.normalize("NFD", first)
    for _ in range(4):
        table = {c: unicodedata.normalize("NFD", "".join((table.get(x) or _prototype(x)) if x != c else x for x in to)) for c, to in table.items()}
    return {c: to for c, to in table.items() if to != c}


@lru_cache(maxsize=1 << 16)
def _prototype(c: str) -> str:
    if _no_ink(c):
        return ""
    if _is_blank(c):
        return " "
    if c in HYPHENS:
        return "-"
    # Compatibility forms: full-width, ligatures, presentation forms, roman numerals; not accents as stand-alone marks.
    wide = unicodedata.decomposition(c)
    if wide.startswith(("<wide>", "<narrow>", "<compat>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>", "<noBreak>", "<square>")):
        k = unicodedata.normalize("NFKC", c)
        if not k.startswith(" "):
            return k
    return c


def skeleton(text: str | None, table: dict[str, str]) -> str:
    """The form by which two texts are the same to the eye; None gives ''."""
    if not text:
        return ""
    if text.isascii() and text.isprintable():
        return text.strip(" ")
    for _ in range(2):
        text = "".join([table.get(c) or _prototype(c) for c in unicodedata.normalize("NFD", text)])
    return unicodedata.normalize("NFD", text).strip(" ")


def with_skeletons(df: DataFrame, columns: list[str], prefix: str = "skeleton_") -> DataFrame:
    """df with a skeleton column for each of the text columns."""
    shared = df.sparkSession.sparkContext.broadcast(build_table(df.sparkSession))

    @F.pandas_udf(T.StringType())
    def skeletons(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: skeleton(t, shared.value))

    return df.withColumns({prefix + c: skeletons(c) for c in columns})


def classes(rows: DataFrame) -> DataFrame:
    """rows (id, name, author) to (skeleton, variant, name, author): the ways of writing of skeletons that have several.

    A variant is one way of writing name and author in characters (null as ''). Skeletons are made once per distinct pair
    of texts, however many rows have it.
    """
    texts = rows.select(F.coalesce("name", F.lit("")).alias("name"), F.coalesce("author", F.lit("")).alias("author")).distinct()
    shaped = with_skeletons(texts, ["name", "author"]).withColumn("skeleton", F.concat_ws("\x1f", "skeleton_name", "skeleton_author"))
    several = shaped.groupBy("skeleton").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("skeleton")
    return shaped.join(several, "skeleton").select("skeleton", F.xxhash64("name", "author").alias("variant"), "name", "author")


def members(rows: DataFrame, written: DataFrame) -> DataFrame:
    """(id, skeleton, variant, name, author), distinct: every id in a class of `classes` (null and blank ids are left out)."""
    keyed = rows.where("id is not null and id <> ''").select("id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("author", F.lit("")).alias("author"))
    return keyed.join(written, ["name", "author"]).select("id", "skeleton", "variant", "name", "author").distinct()


def linked(member: DataFrame) -> DataFrame:
    """member with n_members and n_links: the ids of its class, and how many of them are written in another way than it.

    An id that is written in several ways itself has a row for each. This is the form of the result that grows with the rows,
    not with their pairs.
    """
    in_class = member.groupBy("skeleton").agg(F.count_distinct("id").alias("n_members"), F.count_distinct("variant").alias("n_variants"))
    alike = member.groupBy("skeleton", "variant").agg(F.count_distinct("id").alias("n_alike"))
    # Ids of several ways of writing are counted once in n_members but in n_alike of each way.
    return member.join(alike, ["skeleton", "variant"]).join(in_class, "skeleton").withColumn("n_links", F.col("n_members") - F.col("n_alike")).drop("n_alike")


def pairs(written: DataFrame, member: DataFrame) -> DataFrame:
    """(a, b), a < b: two ids that look the same and are written differently. Built from pairs of variants, then members."""
    left = written.select("skeleton", F.col("variant").alias("va"))
    right = written.select("skeleton", F.col("variant").alias("vb"))
    differ = left.join(right, "skeleton").where("va <> vb")
    of = member.select("skeleton", "id", "variant")
    one, other = of.select("skeleton", F.col("id").alias("a"), F.col("variant").alias("va")), of.select("skeleton", F.col("id").alias("b"), F.col("variant").alias("vb"))
    return differ.join(one, ["skeleton", "va"]).join(other, ["skeleton", "vb"]).where("a < b").select("a", "b").distinct()
