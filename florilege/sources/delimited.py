"""Bar-separated source files with a header: explicit schemas, typed columns, and broken rows set aside with their reason.

Files are read as lines, so they split like any text, and every line is cut into nullable text fields (`records`). Columns are
found by their name in the header, in any order; a missing one is refused before any job over the rows, a row may have more
fields than the header. A line that does not parse by itself is put together with the broken lines next to it, as a quoted
field may hold line ends; what still does not parse is set aside line by line, so a stray quote costs its own line only.
`Source` pairs the good rows with those that were set aside. An empty file has no header and is refused.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from florilege.functions import vocabulary as v
from florilege.operators.analysis import positions
from florilege.operators.records import WCVP, is_json_object, quoted_fields, unquote
from florilege.session import cut

#: A record may span this many lines; longer runs of broken lines are set aside line by line.
MOST_LINES = 1000
#: More files of one source than this are refused (their headers are read one by one).
MOST_FILES = 10_000


@dataclass(frozen=True)
class Layout:
    """One kind of file. typed: columns that must parse; required: columns that must not be empty; quoted: quotes enclose."""

    name: str
    columns: tuple[str, ...]
    typed: dict[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    quoted: bool = False
    #: A quote inside a field that does not begin with one is a character like others; without this it is an error.
    lazy: bool = False
    #: A wrongly quoted row is no row error but refuses the file.
    fatal: bool = False
    #: Columns that are empty or a JSON object.
    json: tuple[str, ...] = ()


#: The columns of the source files.
TAXA = Layout("taxa", WCVP.columns, json=("dynamicproperties",))
DISTRIBUTION = Layout("distribution", ("coreid", "locality", "establishmentmeans", "locationid", "occurrencestatus", "threatstatus"))
REPLACEMENTS = Layout("replacements", ("taxonid", "relatednameusageid", "relationtype", "remarks"))
TRAITS = Layout("traits", ("taxon", "vocab", "vocab_version", "dim", "value", "niche_width", "n_systems"), {"value": "double", "niche_width": "double", "n_systems": "int"}, ("value",), quoted=True, lazy=True)
XREFS = Layout("xrefs", ("join_authority", "join_id", "authority", "ext_id", "wikidata_qid"), quoted=True, lazy=True)
NAMES = Layout("names", ("taxon", "rank", "status", "accepted_taxon", "source_id"), required=("taxon", "source_id"), quoted=True, lazy=True, fatal=True)
CONCEPTS = Layout("concepts", ("concept_uuid", "scientific_name", "authorship", "rank", "status", "sec_uuid", "sec_title", "classification_uuid", "parent_uuid"), quoted=True)
RELATIONS = Layout("relations", ("from_uuid", "to_uuid", "relation_type", "relation_symbol", "is_concept_relation", "relationship_uuid"), {"is_concept_relation": "boolean"}, quoted=True)


@dataclass
class Source:
    rows: DataFrame  # the layout's columns, and seq: the place in the source
    errors: DataFrame  # reason, line


def headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The header of every file at path (a file, a folder or a pattern)."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(conf)
    found = files.globStatus(at) or []
    statuses = [s for f in found for s in (files.listStatus(f.getPath()) if f.isDirectory() else [f]) if not s.getPath().getName().startswith(("_", "."))]
    if len(statuses) > MOST_FILES:
        raise ValueError(f"{path}: more than {MOST_FILES} files")
    out = {}
    for s in statuses:
        stream = files.open(s.getPath())
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        line = reader.readLine()
        reader.close()
        out[s.getPath().toString()] = [c.strip().strip('"').lower() for c in (line or "").lstrip("﻿").split("|")]
    return out


def read(spark: SparkSession, path: str, layout: Layout) -> Source:
    """The file's rows in the layout's columns and types; short rows, unparsable values and empty required fields set aside."""
    every = headers(spark, path)
    if not every:
        raise ValueError(f"{path}: no file")
    names = next(iter(every.values()))
    for file, other in every.items():
        missing = [c for c in layout.columns if c not in other]
        if missing:
            raise ValueError(f"{file}: column {missing[0]} is missing")
        if other != names:
            raise ValueError(f"{file}: its header differs from that of the other files")
    lines = _lines(spark, path)
    records = _records(lines, layout) if layout.quoted else lines.select("file", "n", "line", F.split("line", r"\|", -1).alias("f"), F.lit(True).alias("ok"))
    least = max(names.index(c) for c in layout.columns) + 1 if layout.quoted else len(layout.columns)
    text = {c: F.nullif(F.trim(unquote(F.get("f", F.lit(names.index(c)))) if layout.quoted else F.get("f", F.lit(names.index(c)))), F.lit("")) for c in layout.columns}
    cells = records.select("file", "n", "line", "ok", F.size("f").alias("n_fields"), *[text[c].alias(c) for c in layout.columns])
    wrong = [F.when(~F.col("ok"), F.lit("quoting")), F.when(F.col("n_fields") < least, F.lit("columns"))]
    wrong += [F.when(F.col(c).isNotNull() & _parsed(F.col(c), t).isNull(), F.lit(f"{c} is no {t}")) for c, t in layout.typed.items()]
    wrong += [F.when(F.col(c).isNull(), F.lit(f"{c} is empty")) for c in layout.required]
    wrong += [F.when(F.col(c).isNotNull() & ~is_json_object(F.col(c)), F.lit(f"{c} is no JSON object")) for c in layout.json]
    judged = cells.withColumn("_reason", F.coalesce(*wrong))
    errors = judged.where("_reason is not null").select(F.col("_reason").alias("reason"), "line")
    if layout.fatal:
        off = errors.where("reason = 'quoting'").limit(1).collect()
        if off:
            raise ValueError(f"{path}: wrongly quoted: {off[0]['line'][:100]}")
    good = judged.where("_reason is null")
    return Source(good.select(*[(_parsed(F.col(c), layout.typed[c]) if c in layout.typed else F.col(c)).alias(c) for c in layout.columns], F.struct("file", "n").alias("seq")), errors)


def _parsed(text: Column, kind: str) -> Column:
    return v.parse_flag(text) if kind == "boolean" else text.try_cast(kind)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line) of every line but headers and empty ones, n in the order of the file; a CR at the end is no part of it.

    Lines are numbered by their split and their place in it, which orders them without counting the lines before.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"))
    n = F.struct("block", "m")
    first = raw.where("block = 0").groupBy("file").agg(F.min("m").alias("head"))
    kept = raw.join(F.broadcast(first.limit(MOST_FILES + 1)), "file").where(~((F.col("block") == 0) & (F.col("m") == F.col("head"))))
    return kept.select("file", n.alias("n"), F.regexp_replace("value", r"\r\z", "").alias("line")).where("line <> ''")


def _cut(line: Column, lazy: bool) -> tuple[Column, Column, Column]:
    """(whether the line may be right by itself, whether it surely is, its fields)."""
    right, parts = quoted_fields(line)
    if not lazy:
        return right, right, parts
    plain = F.split(line, r"\|", -1)
    bare = ~F.exists(plain, lambda f: F.ltrim(f).startswith('"'))
    # An odd quote may also close a field that was opened in a line before.
    return right | bare, right | (bare & ((F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 0)), F.when(bare, plain).otherwise(parts)


def _records(lines: DataFrame, layout: Layout) -> DataFrame:
    """(file, n, line, f, ok) of every record: lines that parse, and runs of lines that do together.

    Only broken lines are sorted and put together; in a file of sound lines there are none.
    """
    _, ok, parts = _cut(F.col("line"), layout.lazy)
    judged = lines.select("file", "n", "line", ok.alias("ok"), parts.alias("f"))
    broken = cut(judged.where("not ok").select("file", "n", "line"))
    sound = judged.where("ok")
    if not broken.limit(1).collect():
        return sound
    # Neighbours: among all lines a broken one has a number, and those with consecutive numbers are one run.
    numbered = positions(lines.select("file", "n"), ["file"], ["n"], "of").select("file", "n", F.col("position").alias("at"))
    ranked = positions(broken.join(numbered, ["file", "n"]), ["file"], ["n"], "of").withColumn("run", F.col("at") - F.col("position"))
    long_ = F.floor(F.col("position") / MOST_LINES)  # a run beyond the limit is cut
    runs = ranked.groupBy("file", "run", long_.alias("part")).agg(F.min("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"))
    joined = runs.select("file", "n", F.explode(_join_lines(F.transform("lines", lambda x: x["line"]))).alias("line"))
    ok, _, parts = _cut(F.col("line"), layout.lazy)
    return sound.unionByName(joined.select("file", "n", "line", ok.alias("ok"), parts.alias("f")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _join_lines(runs: pd.Series) -> pd.Series:
    """Each run of broken lines as records: a line with a field that is left open takes in the following ones up to the one
    that closes it; if none does, it stands alone."""
    return runs.map(lambda lines: _joined(list(lines)))


def _joined(lines: list[str]) -> list[str]:
    out, i = [], 0
    odd = [line.count('"') % 2 for line in lines]
    while i < len(lines):
        opens = odd[i] and any(f.lstrip().startswith('"') for f in lines[i].split("|"))
        end = next((j for j in range(i + 1, len(lines)) if odd[j]), None) if opens else None
        out.append("\n".join(lines[i : end + 1]) if end is not None else lines[i])
        i = end + 1 if end is not None else i + 1
    return out
