"""The export over all areas, and every table of it registered."""

import pytest

import __spark_entry__ as entry
from florilege.operators import bundle as b
from florilege.operators.store import Store
from florilege.plans import index as ix

TABLES = ("concepts", "names", "concept_names", "xrefs", "distribution", "areas", "effective", "traits", "relations", "secs", "space_entries")


def test_every_table_is_registered():
    assert {f"bundle_{x}{t}" for t in TABLES for x in ("", "all_")} <= set(entry.queries())


def test_no_area_is_left_out(spark, small):
    own = {tuple(r) for r in ix.index(spark, small).distribution.select("concept_id", "area_code").collect()}
    got = entry.queries()["bundle_all_distribution"](spark, small).select("concept_id", "area_code").collect()
    assert len(got) == len(own) and {tuple(r) for r in got} == own and len({c for _, c in own}) > 3


def test_write(spark, small, tmp_path, monkeypatch):
    """Refused while a source is not cleared; written whole, once; nothing to be read of a run that failed."""
    c, area = ix.contents(spark, small), ""
    path = str(tmp_path / "out")
    with pytest.raises(ValueError, match="cdm,eive 1.0,wcvp"):
        b.write(c, path, "s1", area)
    assert not (tmp_path / "out" / "CURRENT").exists()
    broken = dict(b.tables(c, b.scope(c.index, area), area)) | {"zz": spark.sql("select raise_error('stop') as x")}
    with monkeypatch.context() as m, pytest.raises(Exception, match="stop"):
        m.setattr(b, "tables", lambda *_: broken)
        b.write(c, path, "s1", area, allow_restricted=True)
    assert Store(spark, path).tables() == []
    counts = b.write(c, path, "s1", area, "sha", allow_restricted=True, now=lambda: "2024-01-01T00:00:00Z").first()
    store = Store(spark, path)
    assert {"name", "concept", "concept_name", "xref", "distribution", "area", "backbone_version", "xref_source", "trait_vocabulary", "trait_value", "sec_reference", "name_space", "name_space_entry", "concept_relation", "vernacular", "distribution_effective", "search_rows", "bundle_meta"} == set(store.tables())
    assert counts["names"] == store.read("name").count() and counts["concepts"] == store.read("concept").count()
    assert store.read("bundle_meta").first().asDict() == {"snapshot_version": "s1", "area": "", "created_at": "2024-01-01T00:00:00Z", "source_manifest_sha": "sha", "restricted_sources": "cdm,eive 1.0,wcvp"}
    with pytest.raises(ValueError, match="there is an export"):
        b.write(c, path, "s2", area, allow_restricted=True)
