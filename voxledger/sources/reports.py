"""A store of curated reports: append-only Parquet, of which the newest row of each call counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "call_id string, report_text string, saved_at timestamp"


def current(log: DataFrame, key: str = "call_id", at: str = "saved_at", value: str = "report_text") -> DataFrame:
    """The newest value of each key, when it was first saved and when last."""
    return log.groupBy(key).agg(F.max_by(value, F.struct(at, value)).alias(value), F.min(at).alias("created_at"), F.max(at).alias("modified_at"))


def enriched(reports: DataFrame, dossiers: DataFrame, key: str = "call_id") -> DataFrame:
    """Reports with what the dossiers know about their calls, where they know something."""
    return reports.join(dossiers, key, "left")


class ReportStore:
    """Reports in a folder; saving appends, so writers never rewrite what others have saved."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, call_id: str, text: str) -> None:
        row = self.spark.createDataFrame([(call_id, text)], "call_id string, report_text string")
        row.withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(self.path)

    def reports(self) -> DataFrame:
        """All reports, newest first."""
        return current(self.spark.read.schema(SCHEMA).parquet(self.path)).orderBy(F.desc("modified_at"), "call_id")

    def get(self, call_id: str) -> DataFrame:
        return current(self.spark.read.schema(SCHEMA).parquet(self.path).where(F.col("call_id") == call_id))

    def export(self, dossiers: DataFrame) -> DataFrame:
        """Reports with what the dossiers know about their calls, where they know something."""
        return enriched(self.reports(), dossiers)

    def compact(self, target: str) -> None:
        """Write the current state to another folder, a store like this one: each report as first and last saved."""
        now = self.reports()
        row = lambda at: now.select("call_id", "report_text", F.col(at).alias("saved_at"))
        row("created_at").unionByName(row("modified_at")).distinct().write.mode("overwrite").parquet(target)
