"""Authors written out that the list never cites, and rank words behind the author."""

import pytest

from florilege.llm import name_mapping as m
from test_mapping import LIST, run

CASES = {
    "Kortania bellensis Linnaeus": 1, "Kortania bellensis Linnaeus 1753": 1, "Zelmora vanifolia Linnaeus & Gray": 4, "K. bellensis Linnaeus": 1, "Kortania bellensis L. subsp. morana": 2, "Kortania bellensis L. ssp. morana Mill.": 2,
    "Kortania bellensis Linnaeus subsp. morana": 2, "Kortania bellensis (L.) Gray subsp. morana (L.) Mill.": 2, "Kortania bellensis L. f. subsp. morana": 2, "Kortania bellensis L. subsp. zzzzzzz": 0, "Kortania bellensis Linnaeus subsp. zzzzzzz": 0, "Kortania bellensis L. f. zzzzzzz": 0,
    "Kortania bellensis Hook. f. Thomson": 1, "Kortania bellensis Hook. f. ex Thomson": 1, "kortania bellensis hook. f. thomson": 1, "Kortania bellensis Morana": 2, "KORTANIA BELLENSIS MORANA": 2, "Kortania bellensis linnaeus": 0,
}


def test_cases(spark):
    assert run(spark, list(CASES)) == CASES


def test_shards_give_the_same(spark):
    assert run(spark, list(CASES), broadcast_entries=2) == CASES


@pytest.mark.parametrize("name", [n for _, n, _, _ in LIST])
def test_names_of_the_list_have_one_reading(name):
    assert len(m.readings(name, frozenset())) == 1
