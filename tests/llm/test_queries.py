"""What must hold of the results of the queries that SQL cannot say, on the tables of scale 0.01."""

import pytest
from pyspark.sql import functions as F

from florilege.llm import queries as q


@pytest.fixture(scope="module")
def run(spark, middle):
    kept = {}

    def result(name):
        if name not in kept:
            kept[name] = q.QUERIES[name](spark, middle).toPandas()
        return kept[name]

    return result


def test_names(spark, middle, run):
    refs = spark.read.parquet(f"{middle}/taxon_list.parquet").toPandas()
    want = set()
    for t in ("eive_sample", "floraveg_sample"):
        rows = spark.read.parquet(f"{middle}/{t}.parquet").where(F.col("taxon").rlike(r"\S")).select("row_seq", "taxon").collect()
        want |= {(t, r["row_seq"]) for r in rows if r["taxon"] not in set(refs["name"])}
    found, open_ = run("p1_found"), run("p1_unmatched")
    assert len(found) == len(want) and set(zip(found["src"], found["row_seq"])) == want
    assert set(found["ref_id"]) <= {0, *refs["ref_id"]} and open_["n_rows"].sum() == (found["ref_id"] == 0).sum()


def test_look_alikes(run):
    found, classes = run("p5_found"), run("p5_classes")
    assert (found["taxonid_a"] < found["taxonid_b"]).all() and not found.duplicated().any()
    assert set(found["taxonid_a"]) | set(found["taxonid_b"]) == set(classes.loc[classes["n_links"] > 0, "taxonid"])
    assert classes.drop_duplicates("taxonid")["n_links"].sum() == 2 * len(found)


def test_containers(spark, middle, run):
    report, packed = run("p7_report").set_index("run_name"), run("p7_pack")
    assert (report["fill"] > 0.9).all() and (report["fullest"] <= report["capacity"]).all()
    n = spark.read.parquet(f"{middle}/documents.parquet").count()
    assert (packed.groupby("run_name")["doc_id"].nunique() == n).all()


def test_shares(run):
    report = run("p8_report").set_index("source")
    able = report[(report["n_tokens"] > 0) & report["target_share"].notna()]
    share = able["target_share"] / able["target_share"].sum()
    assert (abs(able["actual_share"] - share) < 0.05).all() and (able["most_copies"] <= able["max_repeats"]).all()
    assert run("p8_mix")["n_tokens"].mul(run("p8_mix")["copies"]).sum() == report["used_tokens"].sum()


def test_levels(spark, middle, run):
    levels, found, profile = run("p9_levels"), run("p9_found"), run("p9_profile")
    assert len(levels) == spark.read.parquet(f"{middle}/documents.parquet").count() and set(levels["level"].dropna()) == {1, 2, 3, 4, 5}
    assert sorted(found["doc_id"]) == sorted(levels.loc[levels["level"] == 5, "doc_id"])
    assert profile["n_documents"].sum() == len(levels)
    labels = spark.read.parquet(f"{middle}/reading_labels.parquet").dropDuplicates(["doc_id"]).toPandas()
    both = labels.merge(levels, on="doc_id", suffixes=("_is", ""))
    assert (both["level"] == both["level_is"]).mean() > 0.9
    assert (run("p9_cross_validation")["n"]).sum() == levels.merge(labels, on="doc_id")["level_x"].notna().sum()
