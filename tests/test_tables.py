import pytest
from pyspark.sql import functions as F

from editwarden.operators import encoders, joins, rows, tables
from editwarden.operators.insights import changeset_outliers, month_spikes, rare_tags
from editwarden.sources import readers, writers
from editwarden.sources.schemas import EDITS_WITH_HISTORY


def test_diff_tables(spark):
    a = spark.createDataFrame([(1, "x", 5), (2, "y", 6), (3, "z", None)], "id int, s string, only_a int").withColumn("v", F.lit(1))
    b = spark.createDataFrame([(1, "x", 1), (2, "q", 1), (4, "n", 1)], "id int, s string, v long")
    cells = {(r["id"], r["column"]): (r["value_a"], r["value_b"]) for r in joins.diff_tables(a, b, ["id"]).collect()}
    assert cells[(2, "s")] == ("y", "q") and cells[(3, "<row>")] == ("present", None) and cells[(4, "<row>")] == (None, "present")
    assert (1, "s") not in cells
    facts = {(r["fact"], r["column"]): (r["a"], r["b"]) for r in joins.diff_schema(a, b).collect()}
    assert facts[("only_a", "only_a")] == ("int", None) and facts[("type", "v")] == ("int", "bigint") and facts[("rows", None)] == ("3", "3")


def test_required_ids_and_labels(spark):
    ids = spark.createDataFrame([(i, "test") for i in range(30)], "changeset_id long, split string")
    features = ids.where("changeset_id < 12")
    row = joins.missing_ids(ids, features).first()
    assert row["missing"] == 18 and row["examples"].split(",") == [str(i) for i in range(12, 22)]
    with pytest.raises(ValueError, match="18"):
        joins.require_ids(ids, features)
    a = spark.createDataFrame([(1, 0)], "changeset_id long, y_true int")
    with pytest.raises(ValueError, match="changeset_id 1"):
        joins.require_same_labels(a, a.withColumn("y_true", F.lit(1)))


def test_label_edits_marks_empty_labels(spark):
    edits = spark.sql("SELECT named_struct('id', 1L) AS changeset UNION ALL SELECT named_struct('id', 2L) UNION ALL SELECT named_struct('id', 3L)")
    labels = spark.createDataFrame([(1, True), (2, None)], "changeset_id long, vandalism boolean")
    assert sorted(r["vandalism"] for r in rows.label_edits(edits, labels).collect()) == ["true", "unknown"]


def test_summary_upsert(spark):
    def summary(*lines):
        return spark.createDataFrame(list(lines), "month string, total_entries long, vandalism_count long, vandalism_percentage string")
    old, new = summary(("2024-01", 10, 1, "10.0000"), ("2024-02", 5, 0, "0.0000")), summary(("2024-02", 15, 4, "26.6667"), ("2024-03", 1, 1, "100.0000"))
    replaced = {r["month"]: r["total_entries"] for r in tables.upsert_summary(old, new).collect()}
    assert replaced == {"2024-01": 10, "2024-02": 15, "2024-03": 1}
    added = {r["month"]: tuple(r)[1:] for r in tables.upsert_summary(old, new, "add").collect()}
    assert added["2024-02"] == (20, 4, "20.0000")


def test_encoder_is_frozen(spark):
    train = spark.createDataFrame([(["A", "B"], "x"), (["B"], "y")], "countries array<string>, osm_type string")
    encoder = encoders.EditEncoder.fit(train)
    new = spark.createDataFrame([(["Z", "B"], "w"), (None, None)], "countries array<string>, osm_type string")
    got = [r.asDict() for r in encoder.transform(new).collect()]
    assert got[0] == {"country_A": 0, "country_B": 1, "osm_type_x": 0, "osm_type_y": 0}
    assert set(got[1].values()) == {0}


def test_a_large_vocabulary_is_kept_in_a_table(spark, tmp_path):
    """20,000 values with dots and spaces: numbered, saved, loaded, scored; values not seen share the last place."""
    from pyspark.ml.classification import LogisticRegression

    from checks.learning import place_of
    df = spark.range(20_000).select(F.concat(F.lit("v 1."), F.col("id").cast("string")).alias("created.by"), (F.col("id") % 2).cast("double").alias("label"))
    fitted = encoders.SparseVocabulary.fit(df, "created.by")
    assert fitted.size == 20_000
    fitted.save(str(tmp_path / "v"))
    loaded = encoders.SparseVocabulary.load(spark, "created.by", str(tmp_path / "v"))
    new = df.union(spark.createDataFrame([("unseen", 0.0), (None, 0.0)], "v string, label double"))
    places = loaded.transform(new, "vec").select("`created.by`", place_of("vec").alias("i")).collect()
    assert sorted(r["i"] for r in places) == [*range(20_001), 20_000]
    same = {r["created.by"]: r["i"] for r in fitted.transform(df, "vec").select("`created.by`", place_of("vec").alias("i")).collect()}
    assert all(same[r["created.by"]] == r["i"] for r in places if r["created.by"] in same)
    rows = loaded.transform(df, "vec").select("vec", "label")
    model = LogisticRegression(featuresCol="vec", maxIter=5).fit(rows)
    assert model.transform(rows).where("prediction = label").count() == 20_000


def test_align_columns(spark):
    df = spark.createDataFrame([(1, 2)], "b int, `country_NEW LAND` int")
    out = rows.align_columns(df, ["a", "country_NEW LAND"], keep=["b"])
    assert out.columns == ["b", "a", "country_NEW LAND"] and tuple(out.first()) == (1, 0, 2)


def test_labels_file_needs_its_columns(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "id int, label string").write.csv(str(tmp_path / "l"), sep="\t", header=True)
    with pytest.raises(ValueError, match="changeset"):
        readers.read_labels(spark, str(tmp_path / "l"))


def test_changeset_history_file(spark, tmp_path):
    (tmp_path / "h.osm").write_text("""<?xml version="1.0" encoding="UTF-8"?>
<osm version="0.6">
 <changeset id="5" created_at="2020-01-01T00:00:00Z" closed_at="2020-01-01T01:00:00Z" user="a" uid="9" num_changes="2"
   min_lat="1.0" min_lon="2.0" max_lat="3.0" max_lon="4.0">
  <tag k="comment" v="first &lt;b&gt;"/>
  <tag k="comment" v="last"/>
 </changeset>
 <changeset id="6" uid="8" min_lat="95.0" min_lon="0" max_lat="99" max_lon="1"/>
 <changeset id="70" uid="8"/>
</osm>""")
    found = {r["changeset_id"]: r for r in readers.read_changesets_xml(spark, str(tmp_path / "h.osm"), 1, 50).collect()}
    assert set(found) == {5, 6}
    assert found[5]["comment"] == "last" and found[5]["min_lat"] == 1.0 and str(found[5]["closed_at"]) == "2020-01-01 01:00:00"
    assert found[6]["min_lat"] is None and found[6]["created_by"] is None


def test_month_folders_are_pruned(spark, tmp_path):
    path = str(tmp_path / "m")
    spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-02-01")], "ck string, month string").write.partitionBy("month").parquet(path)
    df = readers.read_edits(spark, path, None, month="2024-02-01")
    assert [r["ck"] for r in df.collect()] == ["b"]
    assert len(df.inputFiles()) >= 1
    assert readers.with_file_month(df.select("ck", "_metadata")).select("file_month").first()[0] is None


def test_declared_schema_reads_own_files(spark, tmp_path):
    path = str(tmp_path / "e")
    rows.conform(spark.createDataFrame([(1, "w")], "user_id int, osm_type string"), EDITS_WITH_HISTORY).write.parquet(path)
    row = readers.read_edits(spark, path, EDITS_WITH_HISTORY).first()
    assert row["user_id"] == 1 and row["user_time_since_previous_edit"] is None


def test_compact_and_quarters(spark, tmp_path):
    df = spark.range(100).select(F.col("id").cast("string").alias("ck"), F.expr("timestamp_ntz'2023-11-15' + make_dt_interval(int(id))").alias("t"))
    writers.compact(df, str(tmp_path / "c"), 3, "ck")
    again = spark.read.parquet(str(tmp_path / "c"))
    assert again.count() == 100 and len(again.inputFiles()) == 3
    writers.write_by_quarter(df, "t", str(tmp_path / "q"))
    assert {(r[0], r[1]) for r in spark.read.parquet(str(tmp_path / "q")).select("year", "quarter").distinct().collect()} == {(2023, 4), (2024, 1)}


def test_insights(spark):
    df = spark.createDataFrame([(1, f"k{i}") for i in range(9)] + [(i, f"x{i}") for i in range(2, 30)], "changeset_id long, ck string")
    assert [r["changeset_id"] for r in changeset_outliers(df).collect()] == [1]
    months = spark.createDataFrame([(f"m{i}", 10) for i in range(20)] + [("peak", 500)], "month string, n long")
    assert [r["month"] for r in month_spikes(months, 3).where("spike = 1").collect()] == ["peak"]
    tagged = spark.sql("SELECT 'a' AS ck, map('common', '1', 'odd', '1') AS tags UNION ALL SELECT 'b', map('common', '2')")
    assert [tuple(r) for r in rare_tags(tagged, 2).collect()] == [("a", 1)]
