import hashlib

import pytest
from pyspark.sql import functions as F

from editwarden.operators import sampling as L


def place(key, seed=42):
    return hashlib.md5(f"{seed}|{key}".encode()).hexdigest(), key


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(3000).select(F.format_string("e%04d", "id").alias("ck"), (F.col("id") % 3 == 0).cast("int").alias("label"))


def ordered(rows, label):
    return [k for _, k in sorted(place(r["ck"]) for r in rows.collect() if r["label"] == label)]


def test_realistic_split_takes_the_first_rows_in_hash_order(rows):
    found = {r["ck"]: r["split"] for r in L.realistic_split(rows, "ck", test=500, val=200, ratio=0.2).collect()}
    for label, (val, test) in {1: (40, 100), 0: (160, 400)}.items():
        keys = ordered(rows, label)
        assert {found[k] for k in keys[:val]} == {"val"}
        assert {found[k] for k in keys[val:val + test]} == {"test"}
        assert {found[k] for k in keys[val + test:]} == {"train"}


def test_splits_do_not_depend_on_partitioning(rows):
    a = L.meta_split(rows, "ck", 0.5, 0.1, 0.45)
    b = L.meta_split(rows.repartition(17, "label"), "ck", 0.5, 0.1, 0.45)
    assert sorted(a.collect()) == sorted(b.collect())
    sizes = {(r["label"], r["split"]): r["count"] for r in a.groupBy("label", "split").count().collect()}
    # half of 1000, a tenth of that, 0.45 of the remaining 450 rounded half up
    assert sizes[(1, "train")] == 500 and sizes[(1, "val")] == 50 and sizes[(1, "test_meta")] == 203 and sizes[(1, "test")] == 247


def test_larger_sizes_than_rows(rows):
    found = L.realistic_split(rows, "ck", test=9000, val=1000, ratio=0.2).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in found} == {"val": 1000, "test": 2000}


def test_balance_and_groups(rows):
    kept = L.balance(rows, "ck", "label")
    assert {r["label"]: r["count"] for r in kept.groupBy("label").count().collect()} == {0: 1000, 1: 1000}
    sample, rest = L.sample_per_group(rows.withColumn("g", F.col("label")), "g", "ck", 50, skip=10)
    assert sorted(r["ck"] for r in sample.where("g = 1").collect()) == sorted(ordered(rows, 1)[10:60])
    assert sample.count() + rest.count() == 3000


def test_folds_differ_by_one_row(rows):
    sizes = L.assign_folds(rows, "ck", 7).groupBy("label", "fold").count().collect()
    for label in (0, 1):
        counts = [r["count"] for r in sizes if r["label"] == label]
        assert len(counts) == 7 and max(counts) - min(counts) <= 1


def test_null_stratum(spark, rows):
    df = rows.withColumn("label", F.when(F.col("label") == 1, 1))
    kept = L.balance(df, "ck", "label").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in kept} == {None: 1000, 1: 1000}


def test_numbered_is_a_permutation(rows):
    found = {r["row"]: r["ck"] for r in L.numbered(rows, "ck").collect()}
    keys = [k for _, k in sorted(place(r["ck"]) for r in rows.collect())]
    assert [found[i] for i in range(3000)] == keys


def test_groups_stay_together(rows):
    df = rows.withColumn("g", F.substring("ck", 1, 3))
    for split in (L.group_split(df, "g", {"train": 0.5, "test": 0.5}), L.group_folds(df, "g").withColumnRenamed("fold", "split")):
        assert split.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_temporal_and_geographic(spark):
    df = spark.createDataFrame(
        [("a", "2018-05-01 00:00:00", ["Asia", "Europe"]), ("b", "junk", ["Africa"]), ("c", "2020-01-01 00:00:00", ["Moon"])],
        "ck string, t string, continents array<string>")
    years = {"train": [2018, 2019], "val": [2015], "test": [2017]}
    assert [(r["ck"], r["split"]) for r in L.temporal_split(df, "t", years).collect()] == [("a", "train")]
    groups = {"train": ["Europe"], "val": ["Africa"], "test": ["Asia", "Atlantis"]}
    assert sorted((r["ck"], r["split"]) for r in L.geographic_split(df, "continents", groups).collect()) == [
        ("a", "test"), ("a", "train"), ("b", "val")]
    assert L.geographic_split(df, "continents", groups, exclusive=True).count() == 2
    assert L.check_regions(df, "continents", groups)["test"] == ["Atlantis"]
    with pytest.raises(ValueError):
        L.check_regions(df, "continents", {"train": ["Atlantis"]})
