"""Declared schemas. Reading with them keeps interval columns readable as 12 raw bytes."""

from pyspark.sql import types as T

# Flags of the map feature struct.
MAP_FEATURES = (
    "aerialway", "aeroway", "amenity", "barrier", "boundary", "building", "craft", "emergency", "geological",
    "healthcare", "highway", "historic", "landuse", "leisure", "man_made", "military",
)
_STRING, _LONG, _INT, _DOUBLE, _BOOL = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_TIME = T.TimestampNTZType()
_TAGS = T.MapType(_STRING, _STRING)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


EDITS = struct(
    user_id=_INT, valid_from=_TIME, valid_to=_TIME, osm_type=_STRING, osm_id=_STRING, osm_version=_INT,
    contrib_type=_STRING,
    members=T.ArrayType(struct(type=_STRING, id=_STRING, role=_STRING, geometry=T.BinaryType())),
    status=_STRING,
    changeset=struct(id=_LONG, timestamp=_TIME, tags=_TAGS, hashtags=T.ArrayType(_STRING), editor=_STRING),
    tags=_TAGS, tags_before=_TAGS,
    map_features=struct(**{name: _BOOL for name in MAP_FEATURES}),
    area=_LONG, area_delta=_LONG, length=_LONG, length_delta=_LONG,
    xzcode=struct(level=_INT, code=_LONG),
    country_iso_a3=T.ArrayType(_STRING),
    bbox=struct(xmin=_DOUBLE, ymin=_DOUBLE, xmax=_DOUBLE, ymax=_DOUBLE),
    xmin=_DOUBLE, xmax=_DOUBLE, ymin=_DOUBLE, ymax=_DOUBLE,
    centroid=struct(x=_DOUBLE, y=_DOUBLE),
    quadkey_z10=_STRING, h3_r5=T.DecimalType(20, 0), geometry_type=_STRING, geometry_valid=_BOOL,
    geometry=_STRING, vandalism=_BOOL,
)

HISTORY = struct(
    element_n_users_cum=_LONG, element_n_versions=_LONG, element_previous_edit_timestamp=_STRING,
    element_time_since_previous_edit=T.BinaryType(), n_edits=_LONG, user_n_changesets_cum=_LONG,
    user_n_edits_cum=_LONG, user_n_edit_days_cum=_LONG, user_previous_edit_timestamp=_STRING,
    user_time_since_previous_edit=T.BinaryType(),
)

EDITS_WITH_HISTORY = T.StructType(EDITS.fields + HISTORY.fields)

LABELS = struct(changeset=_LONG, label=_BOOL)

CHANGESET_XML = struct(
    _id=_LONG, _created_at=_STRING, _closed_at=_STRING, _user=_STRING, _uid=_LONG, _num_changes=_LONG,
    _min_lat=_DOUBLE, _min_lon=_DOUBLE, _max_lat=_DOUBLE, _max_lon=_DOUBLE,
    tag=T.ArrayType(struct(_k=_STRING, _v=_STRING)),
)
