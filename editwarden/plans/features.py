"""Feature tables of edits and of changesets."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editwarden.functions import places, tags, times

GEOMETRIC = ("area_delta", "length_delta", "area", "length", "geometry_type", "xmax", "xmin", "ymax", "ymin")
USER_COLUMNS = (
    "n_edits", "user_n_changesets_cum", "user_n_edits_cum", "user_n_edit_days_cum",
    "user_previous_edit_timestamp", "user_time_since_previous_edit",
)
ELEMENT_COLUMNS = (
    "element_n_users_cum", "element_n_versions", "element_previous_edit_timestamp", "element_time_since_previous_edit",
)


@dataclass(frozen=True)
class FeatureSettings:
    user: bool = True
    element: bool = True
    label: str = "vandalism"
    key: str | None = None  # name of a column that is already a unique edit key
    changeset_time: str = "changeset.timestamp"
    changeset_tags: str = "changeset.tags"
    changeset_id: str = "changeset.id"
    grid_size: float = 0.1
    countries: str = "country_iso_a3"


def geometric() -> dict[str, Column]:
    columns = {name: F.col(name) for name in GEOMETRIC}
    columns["bounding_box_size"] = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    columns["geometry_valid"] = F.col("geometry_valid").cast("int")
    return columns


def geometric_features(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *_named(geometric()))


def temporal(ts: Column, created: Column) -> dict[str, Column]:
    day = times.day_of_week(ts)
    return {
        "time_of_day": times.time_of_day(ts),
        "day_of_week": day,
        "is_weekend": (day >= 5).cast("int"),
        "date_created": created,
    }


def temporal_features(df: DataFrame, ts: str, created: str = "valid_from", keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *_named(temporal(F.col(ts), F.col(created))))


def content() -> dict[str, Column]:
    return {
        "osm_type": F.col("osm_type"),
        "osm_id": F.col("osm_id"),
        "osm_version": F.col("osm_version"),
        "contribution_type": F.col("contrib_type"),
        "members": F.col("members"),
        "status": F.col("status"),
    }


def content_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *_named(content()))


def spatial(grid_size: float = 0.1, countries: str = "country_iso_a3") -> dict[str, Column]:
    x, y = F.col("centroid.x"), F.col("centroid.y")
    box = [F.col(c) for c in ("xmin", "xmax", "ymin", "ymax")]
    return {
        "bbox_x_range": F.col("xmax") - F.col("xmin"),
        "bbox_y_range": F.col("ymax") - F.col("ymin"),
        "grid_cell_id": places.grid_cell(x, y, grid_size),
        "centroid_x": x,
        "centroid_y": y,
        "country_count": F.size(F.coalesce(F.col(countries), F.array().cast("array<string>"))),
        "countries": F.col(countries),
        "xzcode": F.col("xzcode"),
        "continents": places.continents(*box),
    }


def derived() -> dict[str, Column]:
    return {
        "tag_density": tags.tag_density(F.size("tags"), F.col("area")),
        "relative_area_change": places.relative_change(F.col("area_delta"), F.col("area")),
    }


def edit_key(ts: str = "valid_from", element: str = "osm_id", version: str = "osm_version") -> Column:
    return F.concat_ws("__", F.col(ts).cast("string"), F.col(element), F.col(version))


def changeset_columns(settings: FeatureSettings) -> dict[str, Column]:
    tag_map = F.col(settings.changeset_tags)
    return {
        "changeset_comment_length": tags.comment_length(tag_map),
        **tags.source_features(tag_map),
        "changeset_id": F.col(settings.changeset_id),
        "contribution_key": F.col(settings.key) if settings.key else edit_key(),
    }


def map_feature_flags(df: DataFrame, column: str = "map_features") -> dict[str, Column]:
    fields = df.schema[column].dataType.fieldNames()
    return {f: F.coalesce(F.col(column)[f], F.lit(False)).cast("int") for f in fields}


def element_columns(df: DataFrame) -> dict[str, Column]:
    """History of the element; older files name the previous edit ``element_previous_edit_valid``."""
    names = [n for n in ("element_previous_edit_timestamp", "element_previous_edit_valid") if n in df.columns]
    columns = {name: F.col(name) for name in ELEMENT_COLUMNS if name != "element_previous_edit_timestamp"}
    columns["element_previous_edit_timestamp"] = F.coalesce(*[F.col(n) for n in names])
    return columns


def user_columns(df: DataFrame) -> dict[str, Column]:
    return {name: F.col(name) for name in USER_COLUMNS}


def build_features(df: DataFrame, settings: FeatureSettings = FeatureSettings(), training: bool = True) -> DataFrame:
    """All features of an edit in one projection: no shuffle, no Python."""
    columns: dict[str, Column] = {}
    if settings.element:
        columns |= element_columns(df)
    if settings.user:
        columns |= user_columns(df)
    columns |= geometric()
    columns |= temporal(F.col(settings.changeset_time), F.col("valid_from"))
    columns |= tags.tag_diff(F.col("tags_before"), F.col("tags"))
    columns |= tags.key_tag_flags(F.col("tags_before"), F.col("tags"))
    columns |= content()
    columns |= spatial(settings.grid_size, settings.countries)
    columns |= derived()
    columns |= changeset_columns(settings)
    # a map feature and a key tag flag never share a name
    columns |= map_feature_flags(df)
    if training:
        columns[settings.label] = F.col(settings.label)
    return df.select(*_named(columns))


def changeset_features(df: DataFrame, temporal: bool = False) -> DataFrame:
    box = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("min_lon", "max_lon", "min_lat", "max_lat")}
    out = df.withColumns(box).withColumns({
        "centroid_x": (F.col("min_lon") + F.col("max_lon")) / 2,
        "centroid_y": (F.col("min_lat") + F.col("max_lat")) / 2,
        "changeset_comment_length": F.length(F.coalesce("comment", F.lit(""))),
    })
    return out.withColumn("date_created", F.col("created_at")) if temporal else out


def features_or_load(df: DataFrame, path: str, settings: FeatureSettings = FeatureSettings(), force: bool = False) -> DataFrame:
    """Read the stored feature table, or build and store it when it is absent or ``force`` is set."""
    spark = df.sparkSession
    if force or not path_exists(spark, os.path.join(path, "_SUCCESS")):
        # zstd takes a fifth less than the default: keys, times and cells differ on every row
        build_features(df, settings).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def path_exists(spark, path: str) -> bool:
    """Whether a path exists in the file system it names (local, HDFS, object store)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Columns a model can use: numbers and booleans."""
    kinds = (T.NumericType, T.BooleanType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in exclude]


def _named(columns: dict[str, Column]) -> list[Column]:
    return [column.alias(name) for name, column in columns.items()]
