"""Requests come from the name list, all of it."""

import __spark_entry__ as entry
from florilege.plans import index as ix
from florilege.plans.reads import _typed


def test_every_typed_name_is_asked_for(spark, small):
    names = [r["taxon"].split(" ") for r in ix.name_rows(spark, small).collect()]
    names = [[w for w in name if w] for name in names]
    want = {" ".join(name[:k]) for name in names for k in range(1, len(name) + 1)}
    got = [r["q"] for r in _typed(spark, small).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    answered = {r["qid"] for r in entry.queries()["suggest_typed_composition"](spark, small).collect()}
    assert len(answered) > 16 and answered <= want
