"""Timelines, grouping and counts of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger.functions.prefix import last_so_far, running_sum


def legacy_timeline(entries: DataFrame) -> DataFrame:
    """By time stamp (nulls last), application and read order."""
    return entries.orderBy(F.col("timestamp").asc_nulls_last(), "app", "read_order")


def timeline_parts(entries: DataFrame, utc: str = "timestamp_utc") -> tuple[DataFrame, DataFrame]:
    """(with UTC, without): two disjoint collections that make up the selection, each in its own order."""
    dated = entries.where(F.col(utc).isNotNull()).orderBy(utc, "app", "read_order", "entry_id")
    undated = entries.where(F.col(utc).isNull()).orderBy("app", F.col("file_token").asc_nulls_last(), F.col("line_start").asc_nulls_last(), "read_order", "entry_id")
    return dated, undated


def grouped_positions(entries: DataFrame, scope: list[str], app: str, order: list[str], bucket_rows: int = 100_000) -> DataFrame:
    """entries with `position` (from 1) within `scope`: applications by first appearance (column `first`), then in
    read order. Rows are numbered in buckets, so an application of any size is no single row or task."""
    place = F.col(order[0])
    bucketed = entries.withColumns({"__one": F.lit(1).cast("long"), "__bucket": F.floor(place / bucket_rows)})
    return running_sum(bucketed, scope, ["first", app, "__bucket"], [F.col(c) for c in order], "__one", "position").drop("__one", "__bucket")


def grouped_by_app(entries: DataFrame) -> DataFrame:
    """Entries with their application's place by first appearance, and their position in read order within it."""
    first = entries.groupBy("app").agg(F.min(F.struct("file_token", "read_order")).alias("first"))
    return grouped_positions(entries.join(F.broadcast(first), "app"), ["app"], "file_token", ["read_order"]).orderBy("first", "position")


def counts(entries: DataFrame, category: str, app: str) -> DataFrame:
    """Counts by category and by application in one pass: dimension, key, n."""
    g = entries.groupingSets([[F.col(category)], [F.col(app)]], F.col(category), F.col(app)).agg(F.grouping(category).alias("__g"), F.count(F.lit(1)).alias("n"))
    return g.select(F.when(F.col("__g") == 0, "category").otherwise("app").alias("dimension"), F.when(F.col("__g") == 0, F.col(category).cast("string")).otherwise(F.col(app).cast("string")).alias("key"), "n")


def last_association(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The row of each key that came last."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), position).alias("__last")).select(*[key if c == key else F.col("__last")[c].alias(c) for c in rows.columns])


def carried_forward(rows: DataFrame, value: str, by: str, order: list[str], name: str, bucket_rows: int = 100_000) -> DataFrame:
    """The last non-null value so far within each group; the first column of the order is a number."""
    bucketed = rows.withColumn("__bucket", F.floor(F.col(order[0]) / bucket_rows))
    return last_so_far(bucketed, [by], ["__bucket"], order, F.col(value), name).drop("__bucket")


def ordered_distinct(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys with the place they first had."""
    return rows.groupBy(key).agg(F.min(order).alias("first_at")).orderBy("first_at")
