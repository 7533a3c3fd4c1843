import struct

import pytest
from pyspark.sql import functions as F

from editwarden.functions import places, tags, texts, times


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_tag_diff_edges(spark):
    df = spark.sql("""
      SELECT 1 AS i, CAST(NULL AS MAP<STRING, STRING>) AS b, map('name', 'x') AS a UNION ALL
      SELECT 2, map('name', 'x', 'shop', NULL), map('name', 'y', 'shop', NULL) UNION ALL
      SELECT 3, map('name', NULL), map() UNION ALL
      SELECT 4, map('name', 'x', 'place', 'p'), map('place', 'q', 'shop', 's')""")
    diff = tags.tag_diff(F.col("b"), F.col("a"))
    flags = tags.key_tag_flags(F.col("b"), F.col("a"))
    rows = {r["i"]: r for r in df.select("i", *[c.alias(n) for n, c in (diff | flags).items()]).collect()}
    assert (rows[1]["tags_added"], rows[1]["tags_removed"], rows[1]["total_tags"], rows[1]["name_added"]) == (1, 0, 1, 1)
    assert (rows[2]["tags_modified"], rows[2]["name_modified"], rows[2]["shop_modified"], rows[2]["shop_changed"]) == (1, 1, 0, 0)
    assert (rows[3]["tags_removed"], rows[3]["name_removed"], rows[3]["name_changed"]) == (1, 1, 0)
    assert (rows[4]["tags_added"], rows[4]["tags_removed"], rows[4]["tags_modified"], rows[4]["tags_changed"]) == (1, 1, 1, 3)


def test_repeated_tag_keeps_the_last_value(spark):
    row = one(spark, F.map_from_entries(F.expr("array(struct('k', 'a'), struct('k', 'b'))")).alias("m"))
    assert row["m"] == {"k": "b"}


@pytest.mark.parametrize("hour,name", [(4, "night"), (5, "morning"), (11, "morning"), (12, "afternoon"), (17, "evening"), (20, "evening"), (21, "night")])
def test_time_of_day(spark, hour, name):
    assert one(spark, times.time_of_day(F.expr(f"timestamp_ntz'2024-01-01 {hour:02d}:30:00'")).alias("t"))["t"] == name


def test_times(spark):
    monday = F.expr("timestamp_ntz'2024-01-01 10:00:00'")
    row = one(
        spark, times.day_of_week(monday).alias("d"), times.text_to_epoch(F.lit("02/01/1970 00:01")).alias("e"),
        times.text_to_epoch(F.lit("junk")).alias("j"), times.text_to_epoch(F.lit(None).cast("string")).alias("n"),
        times.month_from_name(F.lit("contributions_2023-08.parquet")).alias("m"), times.month_from_name(F.lit("part-0003-03ab-2011-10ff")).alias("x"))
    assert tuple(row) == (0, 86460.0, -1.0, -1.0, "2023-08", None)


def test_interval(spark):
    df = spark.createDataFrame([(struct.pack("<III", 2, 40, 3_000_000_500),), (b"short",), (None,)], "b binary")
    assert [r[0] for r in df.select(times.interval_seconds(F.col("b"))).collect()] == [
        2 * 30 * 86400 + 40 * 86400 + 3_000_000.5, -1.0, -1.0]


def test_places(spark):
    def touched(*box):
        return one(spark, places.continents(*[F.lit(float(v)) for v in box]).alias("c"))["c"]
    assert touched(0, 1, 0, 1) == ["Africa"]
    assert touched(-179, -178, 0, 1) == ["Other"]
    assert touched(25.06667, 25.06667, 40, 40) == ["Asia", "Europe"]  # the edge of a box counts
    assert "Antarctica" in touched(-180, 180, -90, -60)
    row = one(spark, places.grid_cell(F.lit(-180.0), F.lit(-90.0)).alias("a"), places.grid_cell(F.lit(180.0), F.lit(90.0)).alias("b"))
    assert tuple(row) == ("0_0", "3600_1800")


def test_relative_change_and_density(spark):
    def change(delta, now):
        return one(spark, places.relative_change(F.lit(delta), F.lit(now)).alias("v"))["v"]
    assert change(5, 10) == 1.0 and change(100, 101) == 10.0
    assert change(3, 0) == 3.0 and change(-500, -600) == -10.0 and change(50, 20) == 10.0
    assert one(spark, tags.tag_density(F.lit(3), F.lit(0)).alias("v"))["v"] == 0.0


def test_nearest_center_prefers_the_lowest_id_on_a_tie(spark):
    centers = [(0, 1.0, 0.0), (1, -1.0, 0.0), (2, 5.0, 5.0)]
    assert one(spark, places.nearest_center(F.lit(0.0), F.lit(0.0), centers).alias("c"))["c"] == 0


def test_labels(spark):
    df = spark.createDataFrame([("TRUE",), ("no",), (None,), ("maybe",)], "v string")
    assert [r[0] for r in df.select(texts.yes_no(F.col("v"))).collect()] == ["yes", "no", None, None]
    ok = spark.createDataFrame([(True,), (False,)], "v boolean")
    assert [r[0] for r in ok.select(texts.checked_label(F.col("v"))).collect()] == [1, 0]
    with pytest.raises(Exception, match="not a 0/1 label"):
        spark.createDataFrame([(2,)], "v int").select(texts.checked_label(F.col("v"))).collect()


def test_reverts_and_source(spark):
    row = one(
        spark, texts.tells_of_revert(F.lit("VANDALISM in 12345")).alias("a"), texts.reverted_changeset(F.lit("Reverts 12345 and 1234567, 7654321")).alias("b"),
        texts.tells_of_revert(F.lit(None).cast("string")).alias("c"))
    assert tuple(row) == (True, "1234567", False)
    found = tags.source_features(F.expr("map('source', 'My BING aerial imagery')"))
    none = tags.source_features(F.expr("map('comment', 'x')"))
    row = one(spark, *[c.alias(f"a_{n}") for n, c in found.items()], *[c.alias(f"b_{n}") for n, c in none.items()])
    assert tuple(row) == (1, "My BING aerial imagery", 0, "unknown")


def test_change_documents(spark):
    xml = """<osmChange><create><node id="1"><tag k="a" v="b"/></node><node id="2"/></create><modify><way id="3"/></modify>
      <create><relation id="9"/></create><delete><node id="1"/></delete></osmChange>"""
    counts = texts.osmchange_counts(F.col("x"))
    df = spark.createDataFrame([(xml,), (None,)], "x string").select(*[c.alias(n) for n, c in counts.items()])
    rows = [r.asDict() for r in df.collect()]
    assert rows[0] == {"no_nodes": 3, "no_ways": 1, "no_relations": 1, "no_creates": 3, "no_modifications": 1, "no_deletions": 1}
    assert set(rows[1].values()) == {0}


def test_percentage(spark):
    row = one(spark, texts.percentage_text(F.lit(1), F.lit(3)).alias("a"), texts.percentage_text(F.lit(0), F.lit(0)).alias("b"))
    assert tuple(row) == ("33.3333", "0.0000")
