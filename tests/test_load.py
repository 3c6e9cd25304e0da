"""Loading a manifest's files into a store: what is refused leaves the store as it was."""

import json

import pytest

from florilege.operators.load import load
from florilege.operators.store import Store
from florilege.sources import delimited as d
from florilege.sources import manifest as m

TAXA = {"1": ("Abies alba", "Mill.", "Species", "1"), "2": ("Pinus picea", "L.", "Species", "1"), "3": ("Picea abies", "(L.) H.Karst.", "Species", "3")}


def files(tmp_path, **changed):
    taxon = lambda i, r: "|".join({"taxonid": i, "scientfiicname": r[0], "scientfiicnameauthorship": r[1], "taxonrank": r[2], "taxonomicstatus": "Accepted", "acceptednameusageid": r[3], "dynamicproperties": f'{{"powoid":"{i}-1"}}'}.get(c, "") for c in d.TAXA.columns)
    text = {
        "taxa": "\n".join(["|".join(d.TAXA.columns), *[taxon(i, r) for i, r in TAXA.items()], "short"]), "places": "|".join(d.DISTRIBUTION.columns) + "\n1|Germany||TDWG:GER||\n1|Germany||TDWG:GER||\n",
        "traits": "|".join(d.TRAITS.columns) + "\nAbies alba|eive|1.0|M|3.5||2\nPinus picea|eive|1.0|M|9||\nNo name|eive|1.0|Q|1||\n", "xrefs": "|".join(d.XREFS.columns) + "\npowo|1-1|gbif|77|Q1\npowo|9-9|gbif|78|Q2\n",
        "concepts": "|".join(d.CONCEPTS.columns) + "\nU1|Abies alba|Mill.|Species|Accepted|S1|Flora|k|\nu2|Abies alba|Mill.|Species|Accepted|s2|List|k|u1\n",
        "relations": "|".join(d.RELATIONS.columns) + "\nu1|U2|Congruent to||true|r1\nu2|u9|includes||true|r2\n", "names": "|".join(d.NAMES.columns) + "\nAbies alba agg.||accepted||5\nPicea abies||accepted||6\n|x|||7\n", **changed,
    }
    for name, content in text.items():
        (tmp_path / name).write_text(content)
    s = lambda i, *paths: {"id": i, "version": "1.0", "redistribution": "allowed", "paths": list(paths)}
    data = {"backbones": [s("wcvp", "taxa", "places")], "trait_vocabularies": [s("eive", "traits")], "xref_sources": [s("wd", "xrefs")], "concept_sources": [s("cdm", "concepts", "relations")], "name_spaces": [s("fv", "names")]}
    return m.parse_text(json.dumps(data), tmp_path)


def test_all_sources(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    report = {(r["kind"], r["measure"]): r["n"] for r in load(spark, files(tmp_path), store).collect()}
    assert report["backbones", "names"] == 3 and report["backbones", "synonyms"] == 1 and report["backbones", "set aside"] == 1
    assert report["trait_vocabularies", "matched"] == 2 and report["trait_vocabularies", "unmatched"] == 1 and report["xref_sources", "unmatched"] == 1 and report["concept_sources", "written"] == 1 and report["name_spaces", "set aside"] == 1
    assert [(r["concept_id"], r["value"]) for r in store.read("trait_value").collect()] == [("wcvp:concept:1", 3.5)]
    assert {(r["authority"], r["ext_id"], r["source"]) for r in store.read("xref").collect()} == {("powo", "1-1", None), ("powo", "3-1", None), ("gbif", "77", "wd")}
    assert store.read("distribution").count() == 1 and {r["origin"] for r in store.read("distribution_effective").collect()} == {"own", "name"}
    assert [r["ext_id"] for r in store.read("name_space_entry").collect()] == ["6"] and store.read("backbone_version").count() == 2
    # Loading again changes nothing but what came later.
    before = {t: store.read(t).count() for t in store.tables()}
    load(spark, files(tmp_path), store)
    assert {t: store.read(t).count() for t in store.tables()} == before


@pytest.mark.parametrize("name, text, said, there", [
    ("traits", "|".join(d.TRAITS.columns) + "\nAbies alba|eive|2.0|M|3.5||2\n", "eive 2.0", {"name"}), ("traits", "|".join(d.TRAITS.columns) + "\nAbies alba|eive|1.0|Q|3.5||2\n", "dimension", {"name"}),
    ("relations", "|".join(d.RELATIONS.columns) + "\nu1|u2|is like||true|r1\n", "is like", {"name", "trait_value"}), ("names", "|".join(d.NAMES.columns) + '\n"open||accepted||5\n', "wrongly quoted", {"name", "concept_relation"}), ("taxa", "taxonid\n1\n", "missing", set()),
])
def test_refused(spark, tmp_path, name, text, said, there):
    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError, match=said):
        load(spark, files(tmp_path, **{name: text}), store)
    assert there <= set(store.tables()) and "lookup" not in store.tables()
    if name == "relations":
        assert "sec_reference" not in store.tables() and store.read("concept").where("backbone_id = 'cdm'").count() == 0


def test_transactions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    one = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), (None, 3, 1)], "k string, v int, o int")
    with store.begin() as tx:
        tx.upsert("t", one, ["k"], "o")
        assert store.tables() == []
    assert {(r["k"], r["v"]) for r in store.read("t").collect()} == {("a", 2), (None, 3)}
    with pytest.raises(KeyError), store.begin() as tx:
        tx.write("t", one)
        raise KeyError
    with store.begin() as tx:
        tx.insert("t", spark.createDataFrame([("a", 9, 1), ("b", 8, 2), ("b", 7, 1)], "k string, v int, o int"), ["k"], "o")
    assert {(r["k"], r["v"]) for r in store.read("t").collect()} == {("a", 2), (None, 3), ("b", 7)}
    late = store.begin()
    late.write("u", one)
    with store.begin() as tx:
        tx.write("w", one)
    with pytest.raises(RuntimeError):
        late.commit()
    assert store.tables() == ["t", "w"]
    store.vacuum()
    assert len(list((tmp_path / "s" / "tables").iterdir())) == 2
    with pytest.raises(ValueError):
        store.read("u")
