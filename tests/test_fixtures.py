"""What the fixtures shuffle: stored columns only, and no copies of texts."""

import datetime

import pytest
from pyspark.sql import functions as F

from checks import fixtures
from checks.fixtures import edits, full_changesets

DAY = datetime.datetime(1996, 5, 1)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = {
        "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                     "l_returnflag string, l_linestatus string, l_shipdate timestamp", [(k, 1, 1, n, 30.0, 9.5, "R", "F", DAY) for k in (10, 12, 12) for n in (1, 2)]),
        # order 12 comes twice
        "orders": ("o_orderkey bigint, o_custkey bigint, o_orderdate timestamp, o_orderpriority string", [(10, 1, DAY, "1-URGENT"), (12, 1, DAY, "2-HIGH"), (12, 1, DAY, "2-HIGH")]),
        "customer": ("c_custkey bigint, c_nationkey int", [(1, 0)]),
        "supplier": ("s_suppkey bigint, s_nationkey int", [(1, 0)]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "N", 0)]),
        "region": ("r_regionkey int, r_name string", [(0, "R")]),
        "documents": ("doc_id bigint, text string", [(0, "zero"), (1, "one"), (2, "two")]),
    }
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_edits_derive_after_the_joins_and_texts_come_last(spark, tables):
    lines = plan(edits(spark, tables, place=True, comment=True))
    joins = [i for i, line in enumerate(lines) if "Join " in line]
    assert "_doc" in lines[joins[0]]
    assert max(i for i, line in enumerate(lines) if "str_to_map" in line or "md5" in line) < joins[0]


def test_edits_of_a_repeated_order_come_once_for_each_pair_of_its_rows(spark, tables):
    found = edits(spark, tables, comment=True).groupBy("changeset_id", "comment").count().collect()
    assert sorted(map(tuple, found)) == [(10, "Revert vandalism in changeset 100010", 2), (12, "zero", 16)]


def test_texts_of_changesets_come_last(spark, tables):
    labels = spark.createDataFrame([(10, 1), (12, 0)], "changeset_id bigint, label int")
    df = full_changesets(spark, tables, labels)
    joins = [line for line in plan(df) if "Join " in line]
    assert "_doc" in joins[0]
    assert sorted((r["changeset_id"], r["label"], r["comment"], r["num_changes"]) for r in df.collect()) == [
        (10, 1, "Revert vandalism in changeset 100010", 2), (12, 0, "zero", 4), (12, 0, "zero", 4)]


def test_edits_are_dealt_once_where_the_side_tables_are_few(spark, tables, monkeypatch):
    """Orders of many rows are joined by their number; suppliers, customers and documents of few rows do not deal the edits anew."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(fixtures, "_few", lambda df, rows: F.broadcast(df) if rows < 3 else df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = edits(spark, tables, place=True, comment=True)
        exchanges = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
        # edits and orders, and the orders of that number again
        assert sum("(l_orderkey#" in e for e in exchanges) == 3
        assert not any(word in e for e in exchanges for word in ("l_suppkey", "user_id", "_doc", "%"))
        assert df.count() == 18
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_of_many_bytes_are_not_broadcast(spark, tables, monkeypatch):
    def sent():
        return [line for line in plan(edits(spark, tables, comment=True)) if "Join " in line and "_doc" in line and "strategy=broadcast" in line]

    assert len(sent()) == 1
    monkeypatch.setattr(fixtures, "BROADCAST_BYTES", 10)
    assert not sent()
