from itertools import combinations

import pytest

from florilege.llm import lookalikes as k

SAME = [("Abies alba", "Аbies аlbа"), ("Abies alba", "Ａｂｉｅｓ　ａｌｂａ"), ("Abies alba", "Abies​ al­ba"), ("Abies alba", " Abies alba "), ("é", "é"), ("ﬁcus", "ficus"), ("a-b", "a‑b"), ("ο", "o"), ("Ρinus", "Pinus"), (None, ""), ("ⅼaⅰ", "lai"), ("x‍", "x"), ("ӕ", "æ"), ("ҫ", "ç"), ("Г", "Γ"), ("Ϸ", "Þ"), ("ϲ", "c"), ("Ϲ", "C"), ("ʋ", "υ"), ("𝐚", "a"), ("ᴎ", "и"), ("ά", "á")]
APART = [("Abies alba", "abies alba"), ("é", "e"), ("l", "I"), ("0", "O"), ("rn", "m"), ("a b", "ab"), ("a-b", "a b"), ("a.", "a"), ("a–b", "a-b"), ("ß", "ss"), ("Ж", "K"), ("a  b", "a b")]


@pytest.fixture(scope="module")
def table(spark):
    return k.build_table(spark)


@pytest.mark.parametrize("a, b", SAME)
def test_same(table, a, b):
    assert k.skeleton(a, table) == k.skeleton(b, table)


@pytest.mark.parametrize("a, b", APART)
def test_apart(table, a, b):
    assert k.skeleton(a, table) != k.skeleton(b, table)


def test_every_letter_against_icu(spark, table):
    """Two letters have one skeleton where ICU says that they look the same, except for case, and accents that are composed."""
    import unicodedata

    every = k.letters()
    shape = dict(zip(every, k.shapes(spark, every)))
    plain = [c for c in every if unicodedata.normalize("NFKD", c) == c]
    groups = {}
    for c in plain:
        groups.setdefault((shape[c], k.case_of(c)), set()).add(k.skeleton(c, table))
    apart = {key: g for key, g in groups.items() if key[0] and len(g) > 1}  # ICU has no shape for fillers
    assert not apart
    # The other way round, what is one skeleton is one shape up to case (ICU knows no case: l and I are one shape).
    back = {}
    for c in plain:
        back.setdefault(k.skeleton(c, table), set()).add(shape[c])
    assert not {key: g for key, g in back.items() if len(g) > 1}
    # No skeleton of a letter is changed by making it again.
    assert all(k.skeleton(k.skeleton(c, table), table) == k.skeleton(c, table) for c in every)


def test_links_are_counted(spark, table):
    rows = [("1", "Abies alba", "M"), ("2", "Аbies alba", "M"), ("3", "Abies alba", "M"), ("4", "Abies аlba", "M"), ("5", "Tilia", "M")]
    df = spark.createDataFrame(rows, "id string, name string, author string")
    member = k.members(df, k.classes(df))
    got = {r["id"]: (r["n_members"], r["n_variants"], r["n_links"]) for r in k.linked(member).collect()}
    assert got == {"1": (4, 3, 2), "2": (4, 3, 3), "3": (4, 3, 2), "4": (4, 3, 3)}
    assert sum(x[2] for x in got.values()) == 2 * k.pairs(k.classes(df), member).count()


def test_skeleton_of_a_skeleton(table):
    for a, b in SAME + APART:
        for x in (a, b):
            once = k.skeleton(x, table)
            assert k.skeleton(once, table) == once


def test_pairs_against_brute_force(spark, table):
    rows = [("1", "Abies alba", "Mill."), ("2", "Аbies alba", "Mill."), ("3", "Abies alba", "Mill."), ("4", "Abies alba", "Mіll."), ("5", "Abies alba", None), ("6", "Abies аlba", ""), ("7", None, None), ("8", "", None), ("1", "Abies alba", "Mill."), (None, "Abies аlba", "Mill."), ("9", "x" * 100_000, "y")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id string, name string, author string, skeleton string")
    written = k.classes(df)
    got = {(r["a"], r["b"]) for r in k.pairs(written, k.members(df, written)).collect()}
    plain = {(i, n or "", a or "") for i, n, a in rows if i}
    look = lambda r: (k.skeleton(r[1], table), k.skeleton(r[2], table))
    want = {tuple(sorted((x[0], y[0]))) for x, y in combinations(plain, 2) if x[0] != y[0] and look(x) == look(y) and x[1:] != y[1:]}
    assert got == want and ("1", "2") in got and ("1", "3") not in got
    assert k.pairs(k.classes(df.where("false")), k.members(df.where("false"), k.classes(df.where("false")))).collect() == []
