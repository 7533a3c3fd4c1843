"""Expressions on tag maps."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tags that get flags of their own.
KEY_TAGS = (
    "name", "boundary", "population", "highway", "building", "landuse",
    "amenity", "natural", "waterway", "place", "railway", "shop", "leisure",
)

# Imagery names that mark a reliable source.
RELIABLE_SOURCES = (
    "bing aerial imagery",
    "esri world imagery",
    "mapbox",
    "digitalglobe",
    "here maps",
    "maxar technologies",
    "google satellite",
)


def _keys(tags: Column) -> Column:
    return F.coalesce(F.map_keys(tags), F.array().cast("array<string>"))


def value_of(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def tag_diff(before: Column, after: Column) -> dict[str, Column]:
    """Numbers of added, removed, modified and changed tags, and of tags after the edit."""
    old, new = _keys(before), _keys(after)
    added = F.size(F.array_except(new, old))
    removed = F.size(F.array_except(old, new))
    modified = F.size(
        F.filter(
            F.array_intersect(old, new),
            lambda k: ~F.try_element_at(before, k).eqNullSafe(F.try_element_at(after, k)),
        )
    )
    return {
        "tags_added": added,
        "tags_removed": removed,
        "tags_modified": modified,
        "tags_changed": added + removed + modified,
        "total_tags": F.size(new),
    }


def key_tag_flags(before: Column, after: Column, tags=KEY_TAGS) -> dict[str, Column]:
    """Added / removed / modified / changed, 0 or 1, for each key tag."""
    flags = {}
    for tag in tags:
        had = F.coalesce(F.map_contains_key(before, F.lit(tag)), F.lit(False))
        has = F.coalesce(F.map_contains_key(after, F.lit(tag)), F.lit(False))
        differs = ~value_of(before, tag).eqNullSafe(value_of(after, tag))
        flags[f"{tag}_added"] = (has & ~had).cast("int")
        flags[f"{tag}_removed"] = (had & ~has).cast("int")
        flags[f"{tag}_modified"] = (had & has & differs).cast("int")
        flags[f"{tag}_changed"] = differs.cast("int")
    return flags


def comment_length(tags: Column) -> Column:
    return F.length(F.coalesce(value_of(tags, "comment"), F.lit("")))


def source_features(tags: Column) -> dict[str, Column]:
    source = value_of(tags, "source")
    pattern = "|".join(RELIABLE_SOURCES)
    known = F.coalesce(F.length(source) > 0, F.lit(False))
    return {
        "source_reliability": F.coalesce(F.lower(source).rlike(pattern), F.lit(False)).cast("int"),
        "source_used": F.when(known, source).otherwise("unknown"),
    }


def tag_density(n_tags: Column, area: Column) -> Column:
    ratio = F.try_divide(n_tags.cast("double"), area.cast("double"))
    return F.when(area > 0, F.least(F.log1p(ratio), F.lit(10.0))).otherwise(F.lit(0.0))
