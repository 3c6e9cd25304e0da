import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from florilege.functions import bitmap
from florilege.operators import references as r

members = st.sets(st.integers(0, bitmap.RANGE - 1), max_size=300)


@given(members, members)
def test_bitmap_algebra(a, b):
    x, y = bitmap.encode(np.array(sorted(a), np.int64)), bitmap.encode(np.array(sorted(b), np.int64))
    assert set(bitmap.decode(x)) == a
    assert set(bitmap.decode(bitmap.and_not(x, y))) == a - b
    assert set(bitmap.decode(bitmap.intersect(x, y))) == a & b
    assert set(bitmap.decode(bitmap.union(x, y))) == a | b
    assert set(bitmap.decode(bitmap.and_not(x, None))) == a and set(bitmap.decode(bitmap.intersect(x, None))) == set()


def test_dense_bitmap():
    dense = np.arange(0, bitmap.RANGE, 2)
    c = bitmap.encode(dense)
    assert c[:1] == b"B" and np.array_equal(bitmap.decode(c), dense)
    assert np.array_equal(bitmap.decode(bitmap.and_not(c, bitmap.encode(dense[:10]))), dense[10:])


def tables(spark, refs, targets, gone):
    return (
        spark.createDataFrame(refs, "src string, field string, target string, row_seq long, key string, period string"),
        spark.createDataFrame(targets, "target string, key string, period string"), spark.createDataFrame(gone, "target string, key string"),
    )


def test_kinds(spark):
    refs = [("s", "f", "t", 1, "a", "2023-01"), ("s", "f", "t", 2, "a", "2023-03"), ("s", "f", "t", 3, "none", "2023-01"), ("s", "f", "t", 4, "gone", "2023-01"), ("s", "f", "t", 5, None, "2023-01"),
            ("s", "f", "t", 6, "a", None), ("s", "g", "t", 6, "none", "2023-02"), ("s", "f", "t", 3, "none", "2023-01"), ("s", "f", "u", 7, "a", "2023-05"), ("s", "f", "t", 8, "timeless", "2023-01")]
    targets = [("t", "a", "2023-02"), ("t", "a", "2023-04"), ("t", "gone", "2023-01"), ("t", "timeless", None)]
    got = sorted((x["field"], x["row_seq"], x["kind"]) for x in r.broken(*tables(spark, refs, targets, [("t", "gone"), ("t", "gone"), ("t", "never"), ("t", None)])).collect())
    assert got == [("f", 1, "late"), ("f", 3, "missing"), ("f", 3, "missing"), ("f", 4, "deleted"), ("f", 7, "missing"), ("g", 6, "missing")]


def test_hot_key(spark, monkeypatch):
    monkeypatch.setattr(r, "LEAST_HOT", 10)
    refs = [("s", "f", "t", i, "none", "2023-01") for i in range(50)] + [("s", "f", "t", 99, "other", "2023-01")]
    found = r.broken(*tables(spark, refs, [], []))
    assert found.count() == 51 and r.report(found).collect()[0]["n_rows"] == 51


def test_empty(spark):
    assert r.broken(*tables(spark, [], [], [])).collect() == []
