import json

import pytest

from florilege.sources import convert as c
from florilege.sources import delimited as d
from florilege.sources import manifest as m
from florilege.streaming.events import windowed


def write(tmp_path, text):
    path = tmp_path / "f.csv"
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_traits(spark, tmp_path):
    path = write(tmp_path, "vocab|taxon|vocab_version|dim|value|niche_width|n_systems\neive|A b|1.0|M|3.5||2\neive|A b|1.0|N|x||\neive|A b|1.0|N|||\neive|short\n")
    s = d.read(spark, path, d.TRAITS)
    assert [r.asDict() for r in s.rows.drop("seq").collect()] == [{"taxon": "A b", "vocab": "eive", "vocab_version": "1.0", "dim": "M", "value": 3.5, "niche_width": None, "n_systems": 2}]
    assert sorted(r["reason"] for r in s.errors.collect()) == ["columns", "value is empty", "value is no double"]


def test_names_and_flags(spark, tmp_path):
    s = d.read(spark, write(tmp_path, 'taxon|rank|status|accepted_taxon|source_id\n"A | b"|SPE|accepted||1\n|SPE|x||2\nA b||x||\n'), d.NAMES)
    assert [r["taxon"] for r in s.rows.collect()] == ["A | b"] and s.errors.count() == 2
    s = d.read(spark, write(tmp_path, "from_uuid|to_uuid|relation_type|relation_symbol|is_concept_relation|relationship_uuid\na|b|Congruent to||true|r\na|b|x||maybe|s\na|b|x|||t\n"), d.RELATIONS)
    assert sorted((r["relationship_uuid"], r["is_concept_relation"]) for r in s.rows.collect()) == [("r", True), ("t", None)] and s.errors.collect()[0]["reason"] == "is_concept_relation is no boolean"


def test_quotes_and_lines(spark, tmp_path):
    """Fields over several lines, a stray quote that costs only its own line, bare quotes, extra fields, CRLF, a BOM."""
    head = "\ufefftaxon|vocab|vocab_version|dim|value|niche_width|n_systems\r\n"
    body = '"A\nb"|eive|1|M|1||\r\nC d|eive|1|M|2|||extra\r\n"stray|eive|1|M|3||\r\nE "f" g|eive|1|M|4||\r\n\r\nH|eive|1|M|5||\r\n"x\n\n""y"" z"|eive|1|M|6||\r\n'
    s = d.read(spark, write(tmp_path, head + body), d.TRAITS)
    got = {r["value"]: r["taxon"] for r in s.rows.collect()}
    assert got == {1.0: "A\nb", 2.0: "C d", 4.0: 'E "f" g', 5.0: "H", 6.0: 'x\n"y" z'}
    assert [(r["reason"], r["line"][:6]) for r in s.errors.collect()] == [("quoting", '"stray')]
    order = [r["value"] for r in s.rows.orderBy("seq").collect()]
    assert order == sorted(order)


def test_strict_and_fatal(spark, tmp_path):
    columns = "|".join(d.CONCEPTS.columns)
    s = d.read(spark, write(tmp_path, f'{columns}\nu|A "b"|x|s|a|||k|\nv|A b|x|s|a|||k|\nw|short\n'), d.CONCEPTS)
    assert [r["concept_uuid"] for r in s.rows.collect()] == ["v"] and sorted(r["reason"] for r in s.errors.collect()) == ["columns", "quoting"]
    with pytest.raises(ValueError, match="wrongly quoted"):
        d.read(spark, write(tmp_path, 'taxon|rank|status|accepted_taxon|source_id\n"A|b|c|d|1\n'), d.NAMES)


def test_taxa_and_folders(spark, tmp_path):
    columns = "|".join(d.TAXA.columns)
    row = lambda i, p: "|".join([str(i), *["x"] * 15, p, "r"])
    for k in range(2):
        (tmp_path / f"t{k}.csv").write_text(f"{columns}\n{row(2 * k, '')}\n{row(2 * k + 1, chr(123) + chr(125))}\n{row(9, 'no json')}\n")
    s = d.read(spark, str(tmp_path), d.TAXA)
    assert sorted(r["taxonid"] for r in s.rows.collect()) == ["0", "1", "2", "3"] and {r["reason"] for r in s.errors.collect()} == {"dynamicproperties is no JSON object"}
    (tmp_path / "t2.csv").write_text("taxonid|x\n")
    with pytest.raises(ValueError, match="missing"):
        d.read(spark, str(tmp_path), d.TAXA)


def test_missing_column(spark, tmp_path):
    with pytest.raises(ValueError, match="accepted_taxon"):
        d.read(spark, write(tmp_path, "taxon|rank|status|source_id\nA|b|c|d\n"), d.NAMES)


def test_manifest(tmp_path):
    good = {"backbones": [{"id": "wcvp", "version": "1", "path": "x", "redistribution": "allowed"}]}
    path = tmp_path / "m.json"

    def parse(data):
        path.write_text(json.dumps(data))
        return m.parse(str(path))

    out = parse(good)
    assert out.sources["backbones"][0]["paths"] == [str(tmp_path / "x")] and len(out.sha256) == 64
    for bad in ({}, {"backbones": []}, {**good, "extra": 1}, {"backbones": [{"id": "w", "version": "1", "path": "x"}]}, {"backbones": [{**good["backbones"][0], "redistribution": "maybe"}]}, {"backbones": [{**good["backbones"][0], "colour": 1}]}):
        with pytest.raises(ValueError):
            parse(bad)


def test_converters(spark):
    wide = spark.createDataFrame([("A b", "1.5", "x", "2"), ("C d", "NA", "", None)], "t string, m string, n string, w string")
    assert [tuple(r) for r in c.wide_traits(wide, "t", {"M": "m", "N": "n"}, "eive", "1.0", {"M": "w"}).collect()] == [("A b", "eive", "1.0", "M", 1.5, 2.0, None)]
    halves = [("r", "a", "from"), ("r", "b", "to"), ("s", "a", "to")]
    assert sorted(tuple(r) for r in c.assemble_relations(spark.createDataFrame(halves, "relationship string, holder string, end string")).collect()) == [("r", "a", "b"), ("s", None, "a")]
    with pytest.raises(ValueError):
        c.assemble_relations(spark.createDataFrame([*halves, ("r", "c", "to")], "relationship string, holder string, end string"))
    nodes = spark.createDataFrame([("x", "n1", "k1", "b", "k2"), ("x", "n2", "k2", "a", "k2"), ("y", "n4", "k1", "c", None), ("y", "n3", "k1", "d", None)], "concept string, node string, classification string, status string, sec_classification string")
    assert sorted(tuple(r) for r in c.pick_classification(nodes).collect()) == [("x", "n2", "k2", "a"), ("y", "n3", "k1", "c")]


def test_stream_equals_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    batch = {tuple(r) for r in windowed(events).select("window_start", "event_type", "n").collect()}
    stream = windowed(spark.readStream.schema(events.schema).parquet(f"{small}/events.parque[t]"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windowed_events").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("select window_start, event_type, n from windowed_events").collect()} == batch


def test_name_lists(spark):
    rows = spark.createDataFrame([(1, "A b", "Species", " Accepted ", "x", False), (2, "C d", None, "Synonym", "A b", True), (3, "", None, None, None, None)], "id int, t string, r string, s string, a string, syn boolean")
    tuples = lambda df: [tuple(r) for r in df.collect()]
    assert tuples(c.name_list(rows, "t", "id", "r", status="s", accepted="a")) == [("A b", "Species", "accepted", "", "1"), ("C d", "", "synonym", "A b", "2")]
    assert tuples(c.name_list(rows, "t", "id", synonym="syn", accepted="a")) == [("A b", "", "accepted", "", "1"), ("C d", "", "synonym", "A b", "2")]
    assert tuples(c.name_list(rows, "t", "id")) == [("A b", "", "accepted", "", "1"), ("C d", "", "accepted", "", "2")]


def test_harvest(spark, tmp_path):
    lines = {"a": [{"item": "Q2", "v": "1-1"}, {"item": "Q10", "v": "5-5"}], "b": [{"item": "Q2", "v": "urn:lsid:ipni.org:names:2-2"}, {"item": "Q3", "v": "9-9"}], "e": [{"item": "Q2", "P14607": "g1", "P846": "g2", "P7715": "w"}, {"item": "Q10", "P846": "g3"}]}
    for name, rows in lines.items():
        (tmp_path / name).write_text("\n".join(map(json.dumps, rows)))
    first, second, enriched = c.harvest(spark, *[str(tmp_path / x) for x in "abe"])
    ids = spark.createDataFrame([("2-2",), ("5-5",)], "id string")
    got = {tuple(r) for r in c.identifier_rows(first, second, enriched, ids).collect()}
    assert got == {("powo", "2-2", "wikidata", "Q2", "Q2"), ("powo", "2-2", "gbif", "g1", "Q2"), ("powo", "2-2", "wfo", "w", "Q2"), ("powo", "5-5", "wikidata", "Q10", "Q10"), ("powo", "5-5", "gbif", "g3", "Q10")}
    every = c.identifier_rows(first, second, enriched).where("authority = 'wikidata'").collect()
    assert {(r["join_id"], r["ext_id"]) for r in every} == {("1-1", "Q2"), ("9-9", "Q3"), ("5-5", "Q10")}
