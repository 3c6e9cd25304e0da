"""Rows that fail to parse: nullable text columns, vectorised rules into error arrays, split by empty arrays.

A received line is cut into fields as text (`fields`), every rule of its feed is evaluated over all rows at once into an
array of errors (`check`), and rows with an empty array are the valid ones (`valid`), the others are reported with every
error and with the first reason in the order quoting, columns, value (`failures`).

The splitter is no regular expression over the line, so that very long or many-quoted lines cannot exhaust a stack: the
line is cut at the quotes; pieces with an even index lie outside quotes. NUL serves as the separator inside, so a NUL in a
line comes out as U+FFFD. A null line is an empty line; a line of an unknown feed fails with `columns`.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from florilege.functions.text import BLANKS

SEP = "\0"
#: Rank lists up to this size are broadcast.
BROADCAST_ROWS = 10_000


@dataclass(frozen=True)
class Feed:
    """One feed's layout; `quoted` says whether a double quote can enclose a field."""

    name: str
    columns: tuple[str, ...]
    quoted: bool


#: The columns of the two feeds.
FLORAVEG = Feed("floraveg_sample", ("taxon", "rank", "status", "accepted_taxon", "source_id"), True)
WCVP = Feed("wcvp_taxon", (
    "taxonid", "family", "genus", "specificepithet", "infraspecificepithet", "scientfiicname", "scientfiicnameauthorship", "taxonrank", "taxonomicstatus",
    "acceptednameusageid", "parentnameusageid", "originalnameusageid", "namepublishedin", "nomenclaturalstatus", "taxonremarks", "scientificnameid", "dynamicproperties", "references",
), False)
FEEDS = (FLORAVEG, WCVP)


def _blank(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def quoted_fields(line: Column) -> tuple[Column, Column]:
    """(whether the quoting is right, the fields as text) of lines whose fields may be enclosed in quotes."""
    # Lambdas below use nothing but their arguments: what they name from outside would be computed anew for every piece.
    pieces = F.split(line, '"', -1)
    n = F.size(pieces)

    def no_break(x: Column) -> Column:
        """No line end inside a field that is not enclosed."""
        inside = lambda f: _blank(f).contains("\n") | _blank(f).contains("\r")
        return ~(x.contains("\n") | x.contains("\r")) | F.forall(F.split(x, r"\|", -1), lambda f: ~inside(f))

    before = lambda x: _blank(F.substring_index(x, "|", 1)) == ""
    after = lambda x: _blank(F.substring_index(x, "|", -1)) == ""
    # Between two quoted parts: nothing (a doubled quote), or a bar with only blanks next to the quotes.
    middle = lambda x: (x == "") | (x.contains("|") & before(x) & after(x))
    between = F.transform(F.slice(pieces, F.lit(2), F.greatest(n - 2, F.lit(0))), lambda x, i: (i % 2 == 0) | (middle(x) & no_break(x)))
    first, last = F.get(pieces, F.lit(0)), F.substring_index(line, '"', -1)
    enclosed = (n % 2 == 1) & after(first) & before(last) & no_break(first) & no_break(last) & F.forall(between, lambda ok: ok)
    right = F.when(n == 1, no_break(line)).otherwise(enclosed)
    joined = F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 0, F.replace(x, F.lit("|"), F.lit(SEP))).otherwise(x)), '"')
    return right, F.split(joined, SEP, -1)


def unquote(field: Column) -> Column:
    f = _blank(field)
    enclosed = (F.length(f) >= 2) & f.startswith('"') & f.endswith('"')
    return F.when(enclosed, F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)


def fields(raw: DataFrame, feed: Feed) -> DataFrame:
    """raw (record_id, feed, line, ...) of one feed, with `quoting_ok`, `n_fields` and each column of the feed as nullable text.

    Columns of raw that are named like a column of the feed are left out; record_id, feed and line_no stay.
    """
    line = F.replace(F.regexp_replace(F.coalesce(F.col("line"), F.lit("")), r"\r\z", ""), F.lit(SEP), F.lit("�"))
    if feed.quoted:
        right, parts = quoted_fields(line)
        clean = unquote
    else:
        right, parts, clean = F.lit(True), F.split(line, r"\|", -1), _blank
    kept = [c for c in ("record_id", "feed", "line_no") if c in raw.columns]
    mine = raw.where(_blank(F.col("feed")) == feed.name).select(*kept, right.alias("quoting_ok"), parts.alias("_parts"))
    values = [F.nullif(_blank(clean(F.get("_parts", F.lit(i)))), F.lit("")).alias(c) for i, c in enumerate(feed.columns)]
    return mine.select(*kept, "quoting_ok", F.size("_parts").alias("n_fields"), *values)


@F.pandas_udf(T.BooleanType())
def is_json_object(texts: pd.Series) -> pd.Series:
    """Whether a text is one strict JSON object: no NaN, no trailing text, any depth; null gives null."""
    return texts.map(lambda t: None if t is None else _strict_object(t))


def _strict_object(text: str) -> bool:
    def refuse(name: str) -> None:
        raise ValueError(name)

    try:
        return isinstance(json.loads(text, parse_constant=refuse, parse_int=str, parse_float=str), dict)
    except RecursionError:
        return _deep_object(text)
    except ValueError:
        return False


def _deep_object(text: str) -> bool:
    """Strictness of very deeply nested JSON: scalars go through json, brackets over an explicit stack."""
    decoder = json.JSONDecoder(parse_constant=lambda name: (_ for _ in ()).throw(ValueError(name)), parse_int=str, parse_float=str)
    stack: list[str] = []
    i, n, want = 0, len(text), "value"
    try:
        while True:
            while i < n and text[i] in " \t\n\r":
                i += 1
            if i == n:
                return want == "end"
            c = text[i]
            if want in ("value", "value or ]") and c in "{[":
                if not stack and c != "{":
                    return False
                stack.append(c)
                want, i = ("key or }" if c == "{" else "value or ]"), i + 1
            elif want in ("key", "key or }") and c == '"':
                _, i = decoder.raw_decode(text, i)
                want = ":"
            elif want == ":" and c == ":":
                want, i = "value", i + 1
            elif c in "}]" and want in (", or end", "key or }" if c == "}" else "value or ]"):
                if not stack or {"{": "}", "[": "]"}[stack.pop()] != c:
                    return False
                want, i = (", or end" if stack else "end"), i + 1
            elif want == ", or end" and c == ",":
                want, i = ("key" if stack[-1] == "{" else "value"), i + 1
            elif want in ("value", "value or ]") and stack:
                _, i = decoder.raw_decode(text, i)
                want = ", or end"
            else:
                return False
    except (ValueError, StopIteration, IndexError):
        return False


def _rank_known(rows: DataFrame, feed: Feed, ranks: DataFrame, column: str, any_case: bool) -> DataFrame:
    fold = (lambda c: F.lower(c)) if any_case else (lambda c: c)
    known = ranks.where(_blank(F.col("feed")) == feed.name).select(fold(_blank(F.col("rank"))).alias("_rank")).where("_rank <> ''").distinct()
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    return rows.join(known, fold(F.col(column)) == F.col("_rank"), "left").withColumn("rank_ok", F.col(column).isNull() | F.col("_rank").isNotNull()).drop("_rank")


def check(raw: DataFrame, ranks: DataFrame, feed: Feed) -> DataFrame:
    """`fields` of one feed with `errors`: array<struct<reason, column, value>>, empty when the row is valid."""
    rows = fields(raw, feed)

    def error(reason: str, column: str | None, bad: Column) -> Column:
        value = F.col(column) if column else F.lit(None).cast("string")
        return F.when(bad, F.struct(F.lit(reason).alias("reason"), F.lit(column).cast("string").alias("column"), value.alias("value")))

    if feed.name == FLORAVEG.name:
        rows = _rank_known(rows, feed, ranks, "rank", any_case=False)
        accepted = F.col("accepted_taxon")
        rules = [
            error("value", "taxon", F.col("taxon").isNull()),
            error("value", "rank", ~F.col("rank_ok")),
            error("value", "accepted_taxon", accepted.isNotNull() & ~(accepted.rlike(r"\A[\p{L}\s  -  　.\-×()&,']*+\z") & accepted.rlike(r"\p{L}"))),
            error("value", "source_id", ~F.coalesce(F.col("source_id").rlike(r"\A[0-9]++\z"), F.lit(False))),
        ]
    else:
        rows = _rank_known(rows, feed, ranks, "taxonrank", any_case=True)
        properties = F.col("dynamicproperties")
        rules = [
            error("value", "taxonid", ~F.coalesce(F.col("taxonid").rlike(r"\A[0-9]{8}\z") & F.col("taxonid").try_cast("int").isNotNull(), F.lit(False))),
            error("value", "taxonrank", ~F.col("rank_ok")),
            error("value", "dynamicproperties", properties.isNotNull() & ~is_json_object(properties)),
        ]
    shape = [error("quoting", None, ~F.col("quoting_ok")), error("columns", None, F.col("n_fields") != len(feed.columns))]
    return rows.withColumn("errors", F.array_compact(F.array(*shape, *rules))).drop("rank_ok")


def valid(checked: DataFrame) -> DataFrame:
    """The rows without errors, without the bookkeeping columns."""
    return checked.where(F.size("errors") == 0).drop("errors", "quoting_ok", "n_fields")


#: The numbers that keys are cast to, by feed: column, name and type of the number. A number of more digits is null.
NUMBERS = {FLORAVEG.name: ("source_id", "source_number", "bigint"), WCVP.name: ("taxonid", "taxon_number", "int")}


def typed(checked: DataFrame, feed: Feed) -> DataFrame:
    """The valid rows with their key as a number next to its text."""
    column, number, kind = NUMBERS[feed.name]
    return valid(checked).withColumn(number, F.col(column).try_cast(kind))


def failures(raw: DataFrame, ranks: DataFrame) -> DataFrame:
    """(record_id, reason, errors) of every record that fails; reason is the first of quoting, columns, value."""
    bad = [check(raw, ranks, f).where(F.size("errors") > 0).select("record_id", F.col("errors")[0]["reason"].alias("reason"), "errors") for f in FEEDS]
    known = [f.name for f in FEEDS]
    shape = bad[0].schema["errors"].dataType
    stray = raw.where(F.col("feed").isNull() | ~_blank(F.col("feed")).isin(known)).select("record_id", F.lit("columns").alias("reason"), F.array().cast(shape).alias("errors"))
    return reduce(DataFrame.unionByName, [*bad, stray])
