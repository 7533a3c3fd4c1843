"""Encoders E1-E5, clusters and models M1-M12, feature assembly F19, feature removal D14."""

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from checks.features import ADDED, HAD, HAS, MODIFIED, N_TAGS, REMOVED, SAME
from checks.fixtures import CHANGESETS, EDITS, EVALUATIONS, edits, evaluations, full_changesets, table, with_
from checks.joins import PLACED, placed
from checks.registry import check
from editwarden.functions import places
from editwarden.functions.tags import KEY_TAGS
from editwarden.operators import clusters, encoders, models
from editwarden.operators.aggregates import importance_report
from editwarden.operators.metrics import evaluate
from editwarden.operators.rows import flag
from editwarden.operators.sampling import meta_split
from editwarden.session import scratch_path
from editwarden.plans.features import FeatureSettings, build_features, changeset_features
from editwarden.plans.region_fits import fit_combinations
from editwarden.plans.runs import RunSettings, run_changesets
from editwarden.plans.training import TrainSettings, ablate, stack_run, train_run

E = with_(EDITS)
# The nations of the given tables.
NATIONS = [f"NATION_{i}" for i in range(25)]
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
TREES = {"n_estimators": 5, "max_depth": 3, "learning_rate": 0.3}
SETTINGS = FeatureSettings(key="ck")


def _in(name):
    _, s, n, w, e = next(b for b in places.CONTINENT_BOXES if b[0] == name)
    return f"(xmax >= {w}::DOUBLE AND xmin <= {e}::DOUBLE AND ymax >= {s}::DOUBLE AND ymin <= {n}::DOUBLE)"


CONTINENT = {name: _in(name) for name in places.CONTINENTS if name != places.OTHER}
CONTINENT[places.OTHER] = "NOT (" + " OR ".join(CONTINENT.values()) + ")"
COUNTRY_COLUMNS = ", ".join(f"list_contains(countries, '{n}')::INTEGER AS \"country_{n}\"" for n in NATIONS)
CONTINENT_COLUMNS = ", ".join(f"({c})::INTEGER AS \"continent_{n}\"" for n, c in CONTINENT.items())
CATEGORY_VALUES = {
    "osm_type": ("node", "relation", "way"), "contribution_type": ("CREATION", "DELETION", "GEOMETRY", "TAG"),
    "geometry_type": ("LineString", "Point", "Polygon"), "time_of_day": ("afternoon", "evening", "morning", "night"),
}
TIME_OF_DAY = """CASE WHEN hour(changeset_ts) BETWEEN 5 AND 11 THEN 'morning' WHEN hour(changeset_ts) BETWEEN 12 AND 16
  THEN 'afternoon' WHEN hour(changeset_ts) BETWEEN 17 AND 20 THEN 'evening' ELSE 'night' END"""
CATEGORY_SQL = {"osm_type": "osm_type", "contribution_type": "contrib_type", "geometry_type": "geometry_type", "time_of_day": TIME_OF_DAY}
CATEGORY_COLUMNS = ", ".join(
    f"({CATEGORY_SQL[c]} = '{v}')::INTEGER AS \"{c}_{v}\"" for c, values in CATEGORY_VALUES.items() for v in values)


@check("E1_multilabel", E + f"SELECT ck, {COUNTRY_COLUMNS} FROM edits")
def _(spark, sf):
    df = edits(spark, sf, place=True).select("ck", F.col("country_iso_a3").alias("countries"))
    return encoders.multilabel(df, "countries", encoders.fit_vocabulary(df, "countries"), "country")


@check("E1_continents", E + f"SELECT ck, {CONTINENT_COLUMNS} FROM edits")
def _(spark, sf):
    df = placed(spark, sf).select("ck", "continents")
    return encoders.multilabel(df, "continents", encoders.fit_vocabulary(df, "continents"), "continent")


@check("E2_onehot", E + """
SELECT ck, coalesce(t = 'node', false)::INTEGER AS osm_type_node, coalesce(t = 'relation', false)::INTEGER AS osm_type_relation,
  coalesce(t = 'way', false)::INTEGER AS osm_type_way FROM (SELECT ck, CASE WHEN h % 3 > 0 THEN osm_type END AS t FROM edits)""")
def _(spark, sf):
    df = edits(spark, sf).select("ck", F.when(F.col("h") % 3 > 0, F.col("osm_type")).alias("osm_type"))
    return encoders.onehot(df, "osm_type", encoders.fit_vocabulary(df, "osm_type"))


@check("E3_onehot_editor", "SELECT o_orderkey AS changeset_id, " + ", ".join(
    f"(o_orderpriority = '{p}')::INTEGER AS \"created_by_{p}\"" for p in PRIORITIES) + " FROM orders")
def _(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias("changeset_id"), F.col("o_orderpriority").alias("created_by"))
    return encoders.onehot(df, "created_by", encoders.fit_vocabulary(df, "created_by"))


def place_of(vector):
    """The place of the one in a one-hot vector, without making it dense."""
    return F.get_json_object(F.to_json(F.struct(F.col(vector).alias("v"))), "$.v.indices[0]").cast("bigint")


def width_of(vector):
    return F.get_json_object(F.to_json(F.struct(F.col(vector).alias("v"))), "$.v.size").cast("bigint")


@check("E3_onehot_sparse", """
SELECT changeset_id, i AS position, (SELECT count(DISTINCT o_custkey) FROM orders) AS width FROM (
  SELECT o_orderkey AS changeset_id, o_custkey FROM orders) JOIN (
  SELECT o_custkey, row_number() OVER (ORDER BY md5('42|' || o_custkey), o_custkey) - 1 AS i FROM (SELECT DISTINCT o_custkey FROM orders)) USING (o_custkey)""")
def _(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias("changeset_id"), F.col("o_custkey").alias("user"))
    # the vector keeps one more place for values it has not seen
    return encoders.onehot_sparse(df, "user").select("changeset_id", place_of("user_vec").alias("position"), (width_of("user_vec") - 1).alias("width"))


def full_edits(spark, sf):
    """Edits with all columns a feature table needs; history figures are taken from the hash."""
    h = F.col("h")
    return edits(spark, sf, place=True, comment=True).withColumns({
        "element_n_users_cum": h % 11, "element_n_versions": h % 13, "n_edits": h % 50, "user_n_changesets_cum": h % 17,
        "user_n_edits_cum": h % 23, "user_n_edit_days_cum": h % 19,
        "element_previous_edit_valid": F.col("previous_text"), "user_previous_edit_timestamp": F.col("previous_text"),
        "element_time_since_previous_edit": F.col("interval"), "user_time_since_previous_edit": F.col("interval"),
    })


HISTORY_SQL = """h % 11 AS element_n_users_cum, h % 13 AS element_n_versions, h % 50 AS n_edits, h % 17 AS user_n_changesets_cum,
  h % 23 AS user_n_edits_cum, h % 19 AS user_n_edit_days_cum"""
NUMBERS_SQL = f"""area_delta, length_delta, area, length, geometry_valid::INTEGER AS geometry_valid,
  round((xmax - xmin) * (ymax - ymin), 6) AS bounding_box_size, round(xmax, 6) AS xmax, round(xmin, 6) AS xmin, round(ymax, 6) AS ymax, round(ymin, 6) AS ymin,
  (isodow(changeset_ts) - 1)::INTEGER AS day_of_week, (isodow(changeset_ts) >= 6)::INTEGER AS is_weekend,
  {ADDED}::INTEGER AS tags_added, {REMOVED}::INTEGER AS tags_removed, {MODIFIED}::INTEGER AS tags_modified,
  ({ADDED} + {REMOVED} + {MODIFIED})::INTEGER AS tags_changed, {N_TAGS}::INTEGER AS total_tags, osm_version,
  round(xmax - xmin, 6) AS bbox_x_range, round(ymax - ymin, 6) AS bbox_y_range, round(centroid_x, 6) AS centroid_x, round(centroid_y, 6) AS centroid_y,
  len(countries)::INTEGER AS country_count,
  round(CASE WHEN area > 0 THEN least(ln(1 + {N_TAGS} / area::DOUBLE), 10) ELSE 0 END, 6) AS tag_density,
  round(least(greatest(CASE WHEN area - area_delta > 0 THEN area_delta::DOUBLE / (area - area_delta) ELSE area_delta::DOUBLE END, -10), 10), 6) AS relative_area_change,
  length(coalesce(comment, ''))::INTEGER AS changeset_comment_length, (coalesce(source, 'survey') <> 'survey')::INTEGER AS source_reliability,
  changeset_id, (h % 2 = 0)::INTEGER AS building, (h % 5 <> 0 AND h % 3 = 0)::INTEGER AS highway, (h % 7 = 0)::INTEGER AS landuse, vandalism, """ + ", ".join(
    f"({HAS[t]} AND NOT {HAD[t]})::INTEGER AS {t}_added, ({HAD[t]} AND NOT {HAS[t]})::INTEGER AS {t}_removed, "
    f"({HAD[t]} AND {HAS[t]} AND NOT {SAME[t]})::INTEGER AS {t}_modified, "
    f"(({HAS[t]} <> {HAD[t]}) OR ({HAS[t]} AND {HAD[t]} AND NOT {SAME[t]}))::INTEGER AS {t}_changed" for t in KEY_TAGS)
ROUNDED = ("bounding_box_size", "xmax", "xmin", "ymax", "ymin", "bbox_x_range", "bbox_y_range", "centroid_x", "centroid_y", "tag_density", "relative_area_change")
PREVIOUS_SQL = "(CASE WHEN h % 17 = 0 OR h % 19 = 0 THEN -1 ELSE epoch(date_trunc('minute', valid_from)) END)::DOUBLE"
INTERVAL_SQL = "((h % 3) * 2592000 + (h % 28) * 86400 + (h % 1000))::DOUBLE"
CONTINENT_TEXT = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in CONTINENT.items()) + ")"


@check("F19_build_features", with_(EDITS, CHANGESETS) + f"""
SELECT ck AS contribution_key, {HISTORY_SQL}, {NUMBERS_SQL}, geometry_type, {TIME_OF_DAY} AS time_of_day, valid_from AS date_created, osm_type, osm_id,
  contrib_type AS contribution_type, '' AS members, l_linestatus AS status, grid_cell_id, array_to_string(countries, ',') AS countries,
  {CONTINENT_TEXT} AS continents, coalesce(source, 'unknown') AS source_used, (h % 16)::INTEGER AS level, h % 100000 AS code
FROM edits JOIN changesets0 c USING (changeset_id)""")
def _(spark, sf):
    df = build_features(full_edits(spark, sf), SETTINGS)
    df = df.drop(*[f"{w}_{c}" for w in ("user", "element") for c in ("previous_edit_timestamp", "time_since_previous_edit")])
    texts = {c: F.concat_ws(",", c) for c in ("members", "countries", "continents")}
    return encoders.unnest_xzcode(df).withColumns(texts | {c: F.round(c, 6) for c in ROUNDED})


@check("E4_encode_edits", with_(EDITS, CHANGESETS) + f"""
SELECT ck, {HISTORY_SQL}, {NUMBERS_SQL}, (h % 16)::INTEGER AS level, {COUNTRY_COLUMNS}, {CONTINENT_COLUMNS}, {CATEGORY_COLUMNS},
  {PREVIOUS_SQL} AS user_previous_edit_timestamp, {PREVIOUS_SQL} AS element_previous_edit_timestamp,
  {INTERVAL_SQL} AS user_time_since_previous_edit, {INTERVAL_SQL} AS element_time_since_previous_edit
FROM edits JOIN changesets0 c USING (changeset_id)""")
def _(spark, sf):
    df, _ = encoders.encode_edits(build_features(full_edits(spark, sf), SETTINGS), keep=["contribution_key"])
    return df.withColumnRenamed("_keep_contribution_key", "ck").withColumns({c: F.round(c, 6) for c in ROUNDED})


@check("E5_encode_changesets", with_(EDITS, CHANGESETS) + """
SELECT changeset_id, user_id, num_changes, label, epoch(closed_at)::DOUBLE AS closed_at, epoch(account_created)::DOUBLE AS account_created,
  round(coalesce(min_lon, 0), 6) AS min_lon, round(coalesce(max_lon, 0), 6) AS max_lon, round(coalesce(min_lat, 0), 6) AS min_lat, round(coalesce(max_lat, 0), 6) AS max_lat,
  round((coalesce(min_lon, 0) + coalesce(max_lon, 0)) / 2, 6) AS centroid_x, round((coalesce(min_lat, 0) + coalesce(max_lat, 0)) / 2, 6) AS centroid_y,
  length(coalesce(comment, ''))::INTEGER AS changeset_comment_length, editor FROM changesets JOIN (
  SELECT created_by, row_number() OVER (ORDER BY md5('42|' || created_by), created_by) - 1 AS editor FROM (SELECT DISTINCT created_by FROM changesets)) USING (created_by)""")
def _(spark, sf):
    df = changeset_features(full_changesets(spark, sf).drop("source"))
    numbers = ("min_lon", "max_lon", "min_lat", "max_lat", "centroid_x", "centroid_y")
    return encoders.encode_changesets(df)[0].withColumns({c: F.round(c, 6) for c in numbers} | {"editor": place_of("created_by_vec")}).drop("created_by_vec")


# Eight points on the centroid plane.
CENTERS = [
    (0, -120.0, 40.0), (1, -60.0, -20.0), (2, 0.0, 50.0), (3, 20.0, 0.0), (4, 80.0, 20.0), (5, 110.0, 35.0), (6, 140.0, -30.0), (7, -10.0, -70.0),
]


@check("M1_fit_clusters", E + "SELECT count(*) AS points, 0::BIGINT AS nearer_to_another, 20::BIGINT AS centers FROM edits WHERE centroid_x IS NOT NULL AND centroid_y IS NOT NULL")
def _(spark, sf):
    """Each point against all centres: none is nearer than the one it is assigned to, and no centre is without points."""
    rows = edits(spark, sf).select("ck", "centroid_x", "centroid_y").where("centroid_x IS NOT NULL AND centroid_y IS NOT NULL")
    centers = clusters.fit_clusters(rows, 20)
    away = lambda c: (F.col("centroid_x") - c[1]) ** 2 + (F.col("centroid_y") - c[2]) ** 2
    mine = F.element_at(F.map_from_arrays(F.array(*[F.lit(c[0]) for c in centers]), F.array(*[away(c) for c in centers])), F.col("cluster_label"))
    rows = clusters.assign_clusters(rows, centers).withColumn("nearer", mine > F.least(*[away(c) for c in centers]) + 1e-9)
    return rows.agg(F.count(F.lit(1)).alias("points"), F.count_if("nearer").alias("nearer_to_another"), F.countDistinct("cluster_label").alias("centers"))


@check("M2_assign_clusters", E + "SELECT ck, list_min([" + ", ".join(
    f"{{'d': (centroid_x - {x}::DOUBLE) * (centroid_x - {x}::DOUBLE) + (centroid_y - {y}::DOUBLE) * (centroid_y - {y}::DOUBLE), 'id': {i}}}"
    for i, x, y in CENTERS) + "]).id AS cluster_label FROM edits")
def _(spark, sf):
    return clusters.assign_clusters(edits(spark, sf), CENTERS).select("ck", "cluster_label")


LARGE_SQL = "CASE WHEN h % 20 = 0 THEN (l_quantity <= 25)::INTEGER ELSE (l_quantity > 25)::INTEGER END"
FEATURES = ["area", "length", "area_delta", "length_delta", "osm_version", "centroid_x", "centroid_y"]


def labelled(spark, sf):
    """Edits with a label that the size of the element tells, but for one edit in twenty."""
    large = (F.col("l_quantity") > 25).cast("int")
    return edits(spark, sf).select(
        "ck", "changeset_id", *FEATURES, F.when(F.col("h") % 20 == 0, 1 - large).otherwise(large).alias("label"))


def split_rows(spark, sf):
    return meta_split(labelled(spark, sf), "ck", 0.4, 0.25, 0.0)


META_COUNTS = """
n AS (SELECT label, count(*) AS n, round(count(*) * 0.4::DOUBLE) AS held FROM {rows} GROUP BY 1),
v AS (SELECT *, round(held * 0.25::DOUBLE) AS val FROM n), m AS (SELECT *, round((held - val) * {meta}::DOUBLE) AS meta FROM v),
s AS (SELECT unnest([{{'split': 'train', 'k': n - held}}, {{'split': 'val', 'k': val}}, {{'split': 'test', 'k': held - val - meta}}, {{'split': 'test_meta', 'k': meta}}]) AS s, label FROM m)"""
SPLIT_ROWS = f", labelled AS (SELECT ck, {LARGE_SQL} AS label FROM edits), " + META_COUNTS.format(rows="labelled", meta=0)


def rebuilt(rows, model):
    """The probability from the single trees, their weights added up."""
    trees = model.stages[-1]
    rows = PipelineModel(model.stages[:-1]).transform(rows)
    margin = F.lit(0.0)
    for i, (tree, weight) in enumerate(zip(trees.trees, trees.treeWeights)):
        rows = tree.setFeaturesCol("_features").setPredictionCol(f"_t{i}").transform(rows)
        margin = margin + F.col(f"_t{i}") * F.lit(weight)
    return rows.withColumn("again", 1 / (1 + F.exp(-2 * margin)))


@check("M3_fit_and_M4_score", with_(EDITS) + SPLIT_ROWS + """
SELECT s.split AS split, sum(s.k)::BIGINT AS scored, 0::BIGINT AS differing, true AS better_than_chance FROM s WHERE s.k > 0 GROUP BY s.split""")
def _(spark, sf):
    """Scores of a weighted fit against the same trees added up one by one."""
    rows = split_rows(spark, sf)
    model = models.fit_model(rows, FEATURES, TREES | {"scale_pos_weight": 1.5}, split="split")
    both = rebuilt(models.score(rows, model), model)
    right = F.avg(((F.col("y_prob") >= 0.5).cast("int") == F.col("label")).cast("int"))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.abs(F.col("y_prob") - F.col("again")) > 1e-9).alias("differing"),
                                     (right > 0.6).alias("better_than_chance"))


@check("M3_patience", "SELECT true AS kept_is_least, true AS curve_agrees, 6::BIGINT AS rounds")
def _(spark, sf):
    """The rounds that stay are those up to the least loss on the validation rows, by the curve of the full model."""
    rows = split_rows(spark, sf)
    params = TREES | {"n_estimators": 6, "learning_rate": 0.9}
    model, losses = models.fit_patient(rows, FEATURES, params, patience=20)
    full = PipelineModel([*models._inputs(FEATURES), models.fit_trees(
        models.assembled(rows.where("split = 'train'"), FEATURES).select("_features", "label"), params)])
    curve = models.training_curve(full, rows.where("split = 'val'")).select("round", F.col("logloss").alias("other"))
    best = losses.agg(F.min_by("round", F.struct("logloss", "round")).alias("best"))
    both = losses.join(curve, "round").agg(F.count(F.lit(1)).alias("rounds"), F.max(F.abs(F.col("logloss") - F.col("other"))).alias("gap"))
    return best.crossJoin(both).select((F.col("best") + 1 == model.stages[-1].getNumTrees).alias("kept_is_least"), (F.col("gap") < 1e-9).alias("curve_agrees"), "rounds")


@check("M5_training_curve", "SELECT 5::BIGINT AS rounds, true AS last_auc_agrees, true AS last_error_agrees, true AS loss_falls")
def _(spark, sf):
    rows = split_rows(spark, sf)
    model = models.fit_model(rows, FEATURES, TREES)
    val = rows.where("split = 'val'")
    curve = models.training_curve(model, val)
    whole = evaluate(flag(models.score(val, model)).select("split", F.col("label").alias("y_true"), "y_pred", "y_prob"))
    ends = curve.agg(F.count(F.lit(1)).alias("rounds"), F.max_by("auc", "round").alias("auc"), F.max_by("error", "round").alias("error"),
                     (F.max_by("logloss", "round") < F.min_by("logloss", "round")).alias("loss_falls"))
    return ends.crossJoin(whole).select(
        "rounds", (F.abs(F.col("auc") - F.col("auc_roc")) < 1e-9).alias("last_auc_agrees"),
        (F.abs(1 - F.col("error") - F.col("accuracy")) < 1e-9).alias("last_error_agrees"), "loss_falls")


def searched(table):
    return table.agg(
        F.count(F.lit(1)).alias("settings"), F.countDistinct("settings").alias("different"), (F.min_by("auc_roc", "rank") == F.max("auc_roc")).alias("best_first"),
        (F.min("auc_roc") > 0.5).alias("better_than_chance"))


@check("M6_random_search", "SELECT 3::BIGINT AS settings, 3::BIGINT AS different, true AS best_first, true AS better_than_chance")
def _(spark, sf):
    grid = {"learning_rate": [0.1, 0.3], "max_depth": [2, 3], "n_estimators": [3, 4], "scale_pos_weight": [1, 2]}
    return searched(models.random_search(labelled(spark, sf), FEATURES, "ck", grid=grid, n=3, folds=2)[1])


@check("M7_grid_search", "SELECT 2::BIGINT AS settings, 2::BIGINT AS different, true AS best_first, true AS better_than_chance")
def _(spark, sf):
    grid = {"n_estimators": [3], "max_depth": [2, 3]}
    df = evaluations(spark, sf).withColumn("label", F.col("y_true").cast("int"))
    return searched(models.grid_search(df, ["y_prob_main", "y_prob_hyper"], "changeset_id", grid=grid, folds=2)[1])


@check("M8_cross_validate", "SELECT unnest(range(3))::INTEGER AS fold, true AS better_than_chance")
def _(spark, sf):
    found = models.cross_validate(labelled(spark, sf), FEATURES, TREES | {"n_estimators": 3}, "ck", k=3)
    return found.select(F.col("fold").cast("int").alias("fold"), F.col("score").between(0.5, 1).alias("better_than_chance"))


def stacked(spark, sf):
    e = evaluations(spark, sf)
    labels = e.select("changeset_id", F.col("y_true").cast("int").alias("label"))
    main = meta_split(labels, "changeset_id", 0.5, 0.2, 0.45).select(
        "changeset_id", "split", F.col("label").alias("y_true")).join(e.select("changeset_id", "y_prob_main"), "changeset_id")
    return stack_run(edits(spark, sf).select("changeset_id", "predicted_prob"), labels, main, TREES)


@check("M9_fit_hyper_M10_fit_meta", with_(EDITS, EVALUATIONS) + """
, n AS (SELECT y_true AS label, count(*) AS n, round(count(*) * 0.5::DOUBLE) AS held FROM evaluations GROUP BY 1),
v AS (SELECT *, round(held * 0.2::DOUBLE) AS val FROM n), m AS (SELECT *, round((held - val) * 0.45::DOUBLE) AS meta FROM v)
SELECT model, sum(meta)::BIGINT AS compared, coalesce(sum(meta) FILTER (label = 1), 0)::BIGINT AS positives FROM m, (SELECT unnest(['main', 'hyper', 'meta']) AS model) GROUP BY 1""")
def _(spark, sf):
    """The ids on which the three models are compared: those of test_meta, each once."""
    result = stacked(spark, sf)
    ids = result.scores.agg(F.countDistinct("changeset_id").alias("ids"))
    found = result.comparison.select("model", (F.col("TN") + F.col("FP") + F.col("FN") + F.col("TP")).alias("compared"), (F.col("FN") + F.col("TP")).alias("positives"))
    return found.join(ids, F.col("ids") == F.col("compared")).drop("ids")


@check("M10_fit_meta_trees", with_(EDITS, EVALUATIONS) + "SELECT count(*) AS scored, count(*) FILTER (y_true = 1) AS positives, 0::BIGINT AS differing FROM evaluations")
def _(spark, sf):
    e = evaluations(spark, sf).withColumn("y_true", F.col("y_true").cast("int"))
    model = models.fit_meta(e, "trees", TREES)
    both = rebuilt(models.score(e, model), model)
    return both.agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.col("y_true") == 1).alias("positives"), F.count_if(F.abs(F.col("y_prob") - F.col("again")) > 1e-9).alias("differing"))


@check("M11_importances", "SELECT 7::BIGINT AS features, true AS splits_add_up, true AS gains_add_up, true AS ranked_by_gain")
def _(spark, sf):
    """Splits and gains of all features against the trees themselves."""
    model = models.fit_model(split_rows(spark, sf), FEATURES, TREES, split="split")
    trees = model.stages[-1]
    splits = sum((t.numNodes - 1) // 2 for t in trees.trees)

    def gain(node):
        if node.numDescendants() == 0:
            return 0.0
        return node.gain() * node.impurityStats().rawCount() + gain(node.leftChild()) + gain(node.rightChild())

    total = sum(w * gain(t._java_obj.rootNode()) for t, w in zip(trees.trees, trees.treeWeights))
    table = importance_report(models.importances(model, FEATURES, spark))
    found = table.agg(F.count(F.lit(1)).alias("features"), F.sum("weight").alias("w"), F.sum("total_gain").alias("g"),
                      (F.min_by("total_gain", "rank") == F.max("total_gain")).alias("ranked_by_gain"))
    return found.select("features", (F.col("w") == splits).alias("splits_add_up"), (F.abs(F.col("g") / total - 1) < 1e-9).alias("gains_add_up"), "ranked_by_gain")


def small_training(spark, sf):
    df = full_edits(spark, sf)
    large = (F.col("l_quantity") > 25).cast("int")
    df = df.withColumn("vandalism", F.when(F.col("h") % 20 == 0, 1 - large).otherwise(large))
    n = df.count()
    settings = TrainSettings(test=n // 4, val=n // 10, ratio=0.2, clusters=10, params=TREES, features=SETTINGS)
    return df, train_run(df, settings)


@check("M12_train_run", with_(EDITS) + f""", labelled AS (SELECT {LARGE_SQL} AS label FROM edits), c AS (SELECT count(*) AS n, sum(label)::BIGINT AS bad FROM labelled),
k AS (SELECT n, bad, n // 4 AS test, n // 10 AS val, floor((n // 4) * 0.2::DOUBLE)::BIGINT AS bad_test, floor((n // 10) * 0.2::DOUBLE)::BIGINT AS bad_val FROM c)
SELECT unnest(['test', 'val', 'train']) AS split, unnest([test, val, n - test - val]) AS predicted, unnest([bad_test, bad_val, bad - bad_test - bad_val]) AS positives,
  true AS better_than_chance FROM k""")
def _(spark, sf):
    metrics = small_training(spark, sf)[1].metrics
    return metrics.select("split", (F.col("TN") + F.col("FP") + F.col("FN") + F.col("TP")).alias("predicted"), (F.col("FN") + F.col("TP")).alias("positives"),
                          (F.col("auc_roc") > 0.6).alias("better_than_chance"))


@check("D14_ablate", with_(EDITS) + SPLIT_ROWS + """
SELECT unnest([0, 1, 2]) AS step, unnest([7, 6, 5]) AS features, k AS tested FROM (SELECT sum(s.k)::BIGINT AS k FROM s WHERE s.split = 'test')""")
def _(spark, sf):
    lines = ablate(split_rows(spark, sf), FEATURES, TREES | {"n_estimators": 3}, 2)
    return lines.select("step", "features", (F.col("TN") + F.col("FP") + F.col("FN") + F.col("TP")).alias("tested"))


FOUR = ["Africa", "Asia", "Europe", "North America"]
GROUPS = "(SELECT [c] AS g FROM names UNION ALL SELECT list_sort([a.c, b.c]) FROM names a JOIN names b ON a.c < b.c)"


@check("V16_region_fits", with_(EDITS, PLACED) + f"""
, names AS (SELECT unnest({FOUR}) AS c), pick AS {GROUPS},
triples AS (SELECT t.g AS t, v.g AS v, (SELECT list_sort(list(c)) FROM names WHERE NOT list_contains(t.g, c) AND NOT list_contains(v.g, c)) AS s
  FROM pick t JOIN pick v ON NOT list_has_any(t.g, v.g)),
sets AS (SELECT ck, list(continent) AS r, any_value({LARGE_SQL}) AS label FROM placed GROUP BY 1),
kinds AS (SELECT list_sort(list_distinct(r)) AS r, count(*) AS n, sum(label) AS bad FROM sets GROUP BY 1)
SELECT array_to_string(t, ',') AS train_regions, array_to_string(v, ',') AS val_regions, array_to_string(s, ',') AS test_regions,
  coalesce(sum(n) FILTER (list_has_any(t, r)), 0)::BIGINT AS n_train, coalesce(sum(n) FILTER (list_has_any(v, r)), 0)::BIGINT AS n_val,
  coalesce(sum(n) FILTER (list_has_any(s, r)), 0)::BIGINT AS n_test, coalesce(sum(n) FILTER (list_has_any(s, r)), 0)::BIGINT AS predicted,
  coalesce(sum(bad) FILTER (list_has_any(s, r)), 0)::BIGINT AS positives, true AS better_than_chance
FROM triples, kinds WHERE len(s) BETWEEN 1 AND 2 GROUP BY t, v, s""")
def _(spark, sf):
    """A model for each of the 36 ways to give four continents to three groups of one or two."""
    large = (F.col("l_quantity") > 25).cast("int")
    rows = placed(spark, sf).withColumn("label", F.when(F.col("h") % 20 == 0, 1 - large).otherwise(large))
    out = fit_combinations(rows, FEATURES, {"n_estimators": 2, "max_depth": 2}, scratch_path(spark, "region-fits"), "label", "continents", FOUR, 1, 2)
    names = ("train_regions", "val_regions", "test_regions")
    return out.select(*[F.array_join(F.sort_array(c), ",").alias(c) for c in names], "n_train", "n_val", "n_test",
                      (F.col("TN") + F.col("FP") + F.col("FN") + F.col("TP")).alias("predicted"), (F.col("FN") + F.col("TP")).alias("positives"),
                      (F.col("accuracy") > 0.5).alias("better_than_chance"))


def changeset_run(spark, sf, folder, **more):
    """The run on the changesets that have edits, with a label that half of the edits of a changeset tell."""
    large = F.avg((F.col("l_quantity") > 25).cast("int")) > 0.5
    labels = edits(spark, sf).groupBy("changeset_id").agg(large.cast("int").alias("label"))
    sessions = full_changesets(spark, sf, labels).drop("source")
    scores = edits(spark, sf).select("changeset_id", (0.8 * F.col("l_quantity") / 50 + 0.2 * F.col("predicted_prob")).alias("predicted_prob"))
    settings = RunSettings(train=TrainSettings(params=TREES, clusters=5), iterations=10, hyper_params=TREES, **more)
    return run_changesets(sessions, scores, folder, settings)


@check("M12_changeset_run", with_(EDITS) + """
, c AS (SELECT changeset_id, (avg((l_quantity > 25)::INTEGER) > 0.5)::INTEGER AS label FROM edits GROUP BY 1),
n AS (SELECT label, count(*) AS n, round(count(*) * 0.4::DOUBLE) AS held FROM c GROUP BY 1),
v AS (SELECT *, round(held * 0.25::DOUBLE) AS val FROM n), m AS (SELECT *, round((held - val) * 0.5::DOUBLE) AS meta FROM v),
s AS (SELECT unnest([{'split': 'train', 'k': n - held}, {'split': 'val', 'k': val}, {'split': 'test', 'k': held - val - meta}, {'split': 'test_meta', 'k': meta}]) AS s, label FROM m)
SELECT s.split AS split, sum(s.k)::BIGINT AS changesets, coalesce(sum(s.k) FILTER (label = 1), 0)::BIGINT AS positives,
  sum(s.k)::BIGINT AS main, sum(s.k)::BIGINT AS hyper, CASE WHEN s.split = 'test_meta' THEN sum(s.k) ELSE 0 END::BIGINT AS all_three, 0::BIGINT AS ran_again
FROM s GROUP BY s.split""")
def _(spark, sf):
    """Counts of each split over the three models, and the steps that a second run of the same settings has to run."""
    folder = scratch_path(spark, "changeset-run")
    changeset_run(spark, sf, folder)
    again = changeset_run(spark, sf, folder)
    t = again.tables
    per = lambda df, name: df.groupBy("split").agg(F.count(F.lit(1)).alias(name))
    three = t["meta_scores"].where("y_prob_main IS NOT NULL AND y_prob_hyper IS NOT NULL AND y_prob_meta IS NOT NULL")
    out = t["splits"].groupBy("split").agg(F.count(F.lit(1)).alias("changesets"), F.sum("label").cast("bigint").alias("positives"))
    out = out.join(per(t["predictions"], "main"), "split", "left").join(per(t["hyper_scores"], "hyper"), "split", "left").join(per(three, "all_three"), "split", "left")
    return out.fillna(0, ["main", "hyper", "all_three"]).withColumn("ran_again", F.lit(len(again.ran)).cast("bigint"))
