"""The chunked path for hot keys against plain Python and against the window path."""

import random

import pytest
from pyspark.sql import functions as F

from editwarden.operators import history
from editwarden.operators.aggregates import exact_quantiles, score_profile
from editwarden.operators.running import running, split_hot


def skewed_rows(n=600, seed=1):
    """A third of the rows belongs to user 1, another part to no user; times repeat."""
    chance = random.Random(seed)
    rows = []
    for i in range(n):
        user = 1 if i % 3 == 0 else (None if i % 5 == 0 else chance.randint(2, 30))
        rows.append((f"k{i:05d}", user, chance.randint(0, 200), chance.randint(0, 12), chance.randint(-50, 50)))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(skewed_rows(), "ck string, user_id long, t long, changeset_id long, v long")


def brute(rows):
    out = {}
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    for group in groups.values():
        group.sort(key=lambda r: (r[2], r[0]))
        total = sum(r[4] for r in group)
        for i, r in enumerate(group):
            seen = group[: i + 1]
            out[r[0]] = (
                sum(x[4] for x in seen), len({x[3] for x in seen}), len({x[2] for x in seen}), total,
                group[i - 1][2] if i else None, group[i + 1][2] if i + 1 < len(group) else None)
    return out


@pytest.mark.parametrize("limit", [None, 50, 1])
def test_running_matches_brute_force(table, limit):
    df = running(
        table, ["user_id"], ["t", "ck"], sums={"s": F.col("v")}, distinct={"d": "changeset_id"}, steps={"days": "t"},
        totals={"all": F.col("v")}, previous={"before": "t"}, following={"after": "t"}, limit=limit)
    found = {r["ck"]: (r["s"], r["d"], r["days"], r["all"], r["before"], r["after"]) for r in df.collect()}
    assert found == brute(skewed_rows())


def test_running_without_keys(table):
    plain = running(table, [], ["t", "ck"], sums={"s": F.col("v")}, limit=None).select("ck", "s")
    chunked = running(table, [], ["t", "ck"], sums={"s": F.col("v")}, limit=10).select("ck", "s")
    assert sorted(plain.collect()) == sorted(chunked.collect())


def test_split_hot_finds_null_and_large_keys(table):
    cold, hot = split_hot(table, ["user_id"], 50)
    assert {r["user_id"] for r in hot.select("user_id").distinct().collect()} == {1, None}
    assert cold.count() + hot.count() == table.count()
    assert split_hot(table, ["user_id"], 10_000)[1] is None


@pytest.mark.parametrize("limit", [10_000, 20])
def test_rows_within(spark, table, limit):
    df = table.withColumn("valid_from", F.timestamp_seconds("t").cast("timestamp_ntz"))
    found = {r["ck"]: r["n"] for r in history.rows_within(df, ["user_id"], "valid_from", 25, "n", limit).collect()}
    rows = skewed_rows()
    assert found == {r[0]: sum(1 for x in rows if x[1] == r[1] and r[2] - 25 <= x[2] <= r[2]) for r in rows}


def test_history_is_the_same_for_hot_keys(table):
    df = table.withColumn("valid_from", F.timestamp_seconds(F.col("t") * 7200).cast("timestamp_ntz"))
    df = df.withColumn("osm_id", F.col("changeset_id") % 3)
    for operator in (history.user_history, history.element_history, history.user_recency):
        plain, hot = operator(df), operator(df, limit=40)
        assert sorted(map(repr, plain.collect())) == sorted(map(repr, hot.select(plain.columns).collect()))


def test_quantiles_of_hot_groups(table):
    wanted = {"low": 0.0, "q": 0.3, "median": 0.5, "high": 1.0}
    plain = exact_quantiles(table, ["user_id"], "v", wanted, None)
    hot = exact_quantiles(table, ["user_id"], "v", wanted, 30)
    def rounded(df):
        return sorted((str(r["user_id"]), *[round(r[n], 9) for n in wanted]) for r in df.collect())
    assert rounded(plain) == rounded(hot)


def test_score_profile_of_hot_changesets(table):
    df = table.withColumn("predicted_prob", (F.col("v") + 50) / 100.0)
    def rounded(d):
        return sorted(tuple(round(float(v), 9) for v in r) for r in d.collect())
    plain = score_profile(df, limit=None)
    assert rounded(plain) == rounded(score_profile(df, limit=40).select(plain.columns))


def test_score_profile_edges(spark):
    df = spark.createDataFrame([(1, 0.7), (2, 0.5), (2, 0.5), (3, 0.5)], "changeset_id long, predicted_prob double")
    rows = {r["changeset_id"]: r for r in score_profile(df).collect()}
    assert rows[1]["std_prediction"] == 0 and rows[1]["skewness_prediction"] == 0 and rows[1]["all_vandalism_predictions"] == 1
    assert rows[2]["kurtosis_prediction"] == 0 and rows[2]["any_vandalism_prediction"] == 0
    assert rows[3]["proportion_vandalism"] == 0  # exactly 0.5 does not count
