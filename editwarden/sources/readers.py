"""Readers of edits, changesets, labels and id lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editwarden.functions.times import month_from_name
from editwarden.sources.schemas import CHANGESET_XML, EDITS, LABELS


def read_edits(
    spark: SparkSession, path: str, schema: T.StructType | None = EDITS, month: str | None = None,
    start: str | None = None, end: str | None = None,
) -> DataFrame:
    """Edits from parquet. With a ``month=`` folder layout ``month`` or ``start`` and ``end``
    (``YYYY-MM-01``, both included) select folders, so other months are not opened."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    if month is not None:
        df = df.where(F.col("month").cast("string") == month)
    if start is not None or end is not None:
        df = df.where(F.col("month").cast("string").between(start or "0000", end or "9999"))
    return df


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan out to all cores if it has fewer splits than half of them.

    A parquet file with one row group is one split, whatever comes after it. Scans with many
    splits, as large tables have, are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 > cores else df.repartition(cores)


def with_file_month(df: DataFrame, name: str = "file_month") -> DataFrame:
    """Month found in the name of the file a row came from."""
    return df.withColumn(name, month_from_name(F.col("_metadata.file_name")))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated changeset labels as (changeset_id, vandalism)."""
    header = spark.read.csv(path, sep="\t", header=True)
    absent = {f.name for f in LABELS.fields} - set(header.columns)
    if absent:
        raise ValueError(f"label file lacks columns {sorted(absent)}")
    return header.select(
        F.col("changeset").cast("bigint").alias("changeset_id"), F.lower("label").cast("boolean").alias("vandalism"))


def read_ids(spark: SparkSession, path: str, column: str = "changeset_id") -> DataFrame:
    return spark.read.csv(path, header=True).select(F.col(column).cast("bigint").alias(column))


def read_changesets_xml(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """Changesets of an id range from a history file; the box is null unless it is a valid one.

    The start of a record is the line separator of a text scan, so a file of any size is split
    over many tasks; each record is then parsed by itself."""
    start, end = "<changeset ", "</changeset>"
    text = F.col("value")
    record = F.when(text.contains(end), F.concat(F.substring_index(text, end, 1), F.lit(end))).otherwise(
        F.concat(F.substring_index(text, "/>", 1), F.lit("/>")))
    rows = spark.read.option("lineSep", start).text(path).where(text.rlike(r"^\s*[A-Za-z_]+="))
    rows = rows.select(F.from_xml(F.concat(F.lit(start), record), CHANGESET_XML).alias("_r")).select("_r.*")
    rows = rows.where(F.col("_id").between(low, high))
    box = [F.col(c) for c in ("_min_lat", "_max_lat", "_min_lon", "_max_lon")]
    valid = (box[0] >= -90) & (box[1] <= 90) & (box[2] >= -180) & (box[3] <= 180) & (box[0] <= box[1]) & (box[2] <= box[3])

    def time(column: str) -> Column:
        return F.regexp_replace(column, "Z$", "").try_cast("timestamp_ntz")

    def tag(key: str) -> Column:
        # the last one of a repeated key counts
        found = F.filter(F.coalesce("tag", F.array()), lambda t: t["_k"] == key)
        return F.try_element_at(found, F.lit(-1))["_v"]

    return rows.select(
        F.col("_id").alias("changeset_id"), time("_created_at").alias("created_at"), time("_closed_at").alias("closed_at"),
        F.col("_user").alias("user"), F.col("_uid").alias("user_id"), F.col("_num_changes").alias("num_changes"),
        *[F.when(valid, F.col(f"_{c}")).alias(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon")],
        tag("comment").alias("comment"), tag("created_by").alias("created_by"))
