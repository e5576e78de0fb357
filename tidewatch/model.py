"""The unified event table: schema, envelope helpers, and an adapter from the driver's events table."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_COLUMNS = ("case_id", "evidence_id", "artifact_id", "audit_id", "ts_utc", "event_type", "computer", "payload_json")
EVENT_SCHEMA = T.StructType([T.StructField(c, T.TimestampNTZType() if c == "ts_utc" else T.StringType()) for c in EVENT_COLUMNS])
SEPARATOR = chr(31)

#: Findings as the operators of this package exchange them: one row a finding, its evidence as an array.
EVIDENCE = "array<struct<audit_id string, ts_utc timestamp_ntz, artifact_id string, event_type string, extra map<string,string>>>"
FINDING_SCHEMA = f"case_id string, finding_id string, source string, rule_id string, title string, severity string, techniques array<string>, tactics array<string>, approved boolean, rejected boolean, evidence {EVIDENCE}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session whose executors are threads of the driver (local master) gets a folder of this machine; any
    other session is refused, since its executors would each write to their own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(shared_folder, "own"):
        shared_folder.own = f"file://{tempfile.mkdtemp(prefix='tidewatch-')}"
        atexit.register(shutil.rmtree, shared_folder.own[7:], True)
    return shared_folder.own


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, so a lost executor costs no recomputation.

    The shuffle files of the write go as soon as it is done. release() deletes the table once nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out._kept = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that kept() wrote; frames derived from them can not be computed afterwards."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._kept)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row, however often later filters and columns name them.

    A filter is moved below the column it reads by writing the column's expression out in it, once for each mention, and so on down
    to the table; a generated column stays where it is.
    """
    names = [c for c in df.columns if c not in columns]
    return df.select(*names, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def audit_id(case: Column, artifact: Column, index: Column, raw: Column) -> Column:
    """First 32 hexadecimal digits of SHA-256 over the four parts, joined by the unit separator; the same row gives the same id."""
    joined = F.concat_ws(SEPARATOR, case, artifact, index.cast("string"), raw)
    return F.substring(F.sha2(joined, 256), 1, 32)


def row_index(df: DataFrame, source: list[str], order: list[str]) -> DataFrame:
    """Adds row_index: 0, 1, 2, ... within a source over its files and positions in order."""
    return df.withColumn("row_index", F.row_number().over(Window.partitionBy(*source).orderBy(*order)) - 1)


def make_event(df: DataFrame, *, case: Column, evidence: Column, artifact: Column, index: Column, ts: Column, event_type: Column, computer: Column, payload: Column) -> DataFrame:
    """The envelope: payload (a struct or map) as JSON text, a null computer as ''."""
    rows = df.select(
        case.alias("case_id"),
        evidence.alias("evidence_id"),
        artifact.alias("artifact_id"),
        index.alias("i_"),
        ts.alias("ts_utc"),
        event_type.alias("event_type"),
        F.coalesce(computer, F.lit("")).alias("computer"),
        F.to_json(payload).alias("payload_json"),
    )
    return rows.withColumn("audit_id", audit_id(F.col("case_id"), F.col("artifact_id"), F.col("i_"), F.col("payload_json"))).select(*EVENT_COLUMNS)


# The driver's event types and the artifacts they stand for.
ARTIFACT_OF = {"error": "evtx", "signup": "prefetch", "click": "browser_history", "view": "mft", "purchase": "registry"}


def unified_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events as unified events (see EVENTS_SQL for the same in SQL)."""
    artifact = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in ARTIFACT_OF.items()], F.lit("other"))
    case = F.concat(F.lit("C"), (F.col("user_id") % 3).cast("string"))
    return table(spark, sf_dir, "events").select(
        case.alias("case_id"),
        F.concat(F.lit("EV"), (F.col("user_id") % 5).cast("string")).alias("evidence_id"),
        artifact.alias("artifact_id"),
        audit_id(case, artifact, F.col("event_id"), F.col("props")).alias("audit_id"),
        F.col("ts").cast("timestamp_ntz").alias("ts_utc"),
        "event_type",
        F.concat(F.lit("HOST"), (F.col("user_id") % 7).cast("string")).alias("computer"),
        F.col("props").alias("payload_json"),
    )


EVENTS_SQL = """ue AS (SELECT 'C' || CAST(user_id % 3 AS VARCHAR) AS case_id, 'EV' || CAST(user_id % 5 AS VARCHAR) AS evidence_id,
 CASE event_type WHEN 'error' THEN 'evtx' WHEN 'signup' THEN 'prefetch' WHEN 'click' THEN 'browser_history' WHEN 'view' THEN 'mft' WHEN 'purchase' THEN 'registry' ELSE 'other' END AS artifact_id,
 event_id, ts AS ts_utc, event_type, 'HOST' || CAST(user_id % 7 AS VARCHAR) AS computer, props AS payload_json, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
ev AS (SELECT *, substr(sha256(case_id || chr(31) || artifact_id || chr(31) || CAST(event_id AS VARCHAR) || chr(31) || payload_json), 1, 32) AS audit_id FROM ue)"""


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, taken as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds(ts: Column) -> Column:
    return F.floor(micros(ts) / 1_000_000)
