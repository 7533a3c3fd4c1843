"""Expressions on boxes, points and regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name, south, north, west, east.
CONTINENT_BOXES = (
    ("Africa", -34.83333, 37.09222, -17.62500, 51.20833),
    ("Antarctica", -90.0, -60.0, -180.0, 180.0),
    ("Asia", 11.16056, 77.71917, 25.06667, 168.95833),
    ("Europe", 34.50500, 71.18528, -24.95583, 68.93500),
    ("North America", 5.49955, 83.16210, -168.17625, -52.23304),
    ("South America", -56.10273, 12.45777, -81.76056, -34.72999),
    ("Oceania", -47.28639, -8.23306, 110.95167, 179.85917),
)
OTHER = "Other"
CONTINENTS = tuple(box[0] for box in CONTINENT_BOXES) + (OTHER,)


def continents(xmin: Column, xmax: Column, ymin: Column, ymax: Column) -> Column:
    """Names of all continent boxes that the given box touches, else ``['Other']``."""
    touched = [
        F.when((xmax >= west) & (xmin <= east) & (ymax >= south) & (ymin <= north), F.lit(name))
        for name, south, north, west, east in CONTINENT_BOXES
    ]
    found = F.array_compact(F.array(*touched))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(OTHER)))


def grid_cell(lon: Column, lat: Column, size: float = 0.1) -> Column:
    """Cell of a regular grid as ``column_row``, counted from the south-west corner."""
    x = ((lon + F.lit(180.0)) / F.lit(float(size))).cast("bigint")
    y = ((lat + F.lit(90.0)) / F.lit(float(size))).cast("bigint")
    return F.concat_ws("_", x, y)


def relative_change(delta: Column, value_now: Column, bound: float = 10.0) -> Column:
    """Change against the value before, kept within the bounds; the plain change if that was not positive."""
    delta, before = delta.cast("double"), (value_now - delta).cast("double")
    ratio = F.when(before > 0, F.try_divide(delta, before)).otherwise(delta)
    return F.least(F.greatest(ratio, F.lit(-bound)), F.lit(bound))


def nearest_center(x: Column, y: Column, centers: Sequence[tuple[int, float, float]]) -> Column:
    """Id of the closest centre; the lowest id wins a tie. Meant for up to a few hundred centres."""
    away = [
        F.struct(
            ((x - F.lit(float(cx))) * (x - F.lit(float(cx))) + (y - F.lit(float(cy))) * (y - F.lit(float(cy)))).alias("d"),
            F.lit(int(cid)).alias("id"),
        )
        for cid, cx, cy in centers
    ]
    return F.array_min(F.array(*away)).getField("id")
