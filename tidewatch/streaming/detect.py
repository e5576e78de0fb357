"""Rules, and hits a window, over a stream of unified events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EVENT_SCHEMA
from ..operators.rules import RULES, Rule, rule_hits


def read_event_stream(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """Unified events as Parquet files arrive in a folder."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(path)


def stream_hits(events: DataFrame, rules: tuple[Rule, ...] = RULES, late: str = "1 hour") -> DataFrame:
    """Rule hits of a stream, each event and rule once: repeats are dropped while their time is within the watermark."""
    return rule_hits(events, rules).withColumn("ts", F.col("ts_utc").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["case_id", "audit_id", "rule_id"])


def hit_counts(hits: DataFrame, every: str = "10 minutes") -> DataFrame:
    """Hits for each case, rule and tumbling window of time; a window is final once the watermark passes it."""
    return hits.groupBy("case_id", "rule_id", F.window("ts", every)).agg(F.count("*").alias("n")).select(
        "case_id",
        "rule_id",
        F.col("window.start").alias("start"),
        "n",
    )
