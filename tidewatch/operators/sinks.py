"""Sinks and table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import one_line


def write_events(df: DataFrame, path: str) -> None:
    """The fact table by case and artifact, sorted by time within files, so that both prune."""
    df.repartition("case_id", "artifact_id", F.floor(F.rand(7) * 8)).sortWithinPartitions("case_id", "artifact_id", "ts_utc").write.mode("overwrite").partitionBy("case_id", "artifact_id").parquet(path)


def safe_id(name: str):
    return F.regexp_replace(F.col(name), r"[^A-Za-z0-9._-]", "_")


def write_findings(f: DataFrame, path: str) -> None:
    """JSON documents in a folder for each source and rule."""
    f.withColumn("source", safe_id("source")).withColumn("rule_id", safe_id("rule_id")).write.mode("overwrite").partitionBy("source", "rule_id").json(path)


def flat(df: DataFrame) -> DataFrame:
    """Text cells for CSV: lists joined by ';', line breaks out, structs and maps as JSON."""
    cols = []
    for c, t in df.dtypes:
        col = F.array_join(F.transform(c, lambda x: x.cast("string")), ";") if t.startswith("array<") and "struct" not in t else F.to_json(c) if t.startswith(("array<", "struct<", "map<")) else one_line(F.col(c).cast("string"))
        cols.append(col.alias(c))
    return df.select(*cols)


def write_report_csv(tables: dict[str, DataFrame], path: str) -> None:
    """A CSV folder for each fact table (findings, mitre, clusters, ioc, timeline)."""
    for name, df in tables.items():
        flat(df).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def write_legacy_csv(failed: DataFrame, findings: DataFrame, timeline: DataFrame, iocs: DataFrame, path: str) -> None:
    write_report_csv({"failed_artifacts": failed, "findings": findings, "timeline": timeline, "iocs": iocs}, path)


def export_case(tables: dict[str, DataFrame], case: str, path: str) -> DataFrame:
    """The case's rows of each table as JSON lines, and a manifest of row counts."""
    manifest = None
    for name, df in tables.items():
        own = df.where(F.col("case_id") == case)
        own.write.mode("overwrite").json(f"{path}/{name}")
        part = own.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        manifest = part if manifest is None else manifest.union(part)
    return manifest


def verify_manifest(spark, path: str, manifest: DataFrame) -> DataFrame:
    """file, state of each file: verified, mismatched, missing or unlisted. manifest: file (name), sha256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("file"),
        F.sha2("content", 256).alias("found"),
    )
    state = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("found") == F.lower("sha256"), "verified").otherwise("mismatched")
    return files.join(manifest.select("file", "sha256"), "file", "full").select("file", state.alias("state"))


def delete_case(tables: dict[str, DataFrame], case: str) -> dict[str, DataFrame]:
    return {k: v.where(~F.col("case_id").eqNullSafe(case)) for k, v in tables.items()}


def import_case(old: dict[str, DataFrame], new: dict[str, DataFrame], case: str, overwrite: bool = False) -> dict[str, DataFrame]:
    """Tables with the case's rows replaced; refused where the case is there and overwrite is not set."""
    if not overwrite and not old["cases"].where(F.col("case_id") == case).isEmpty():
        raise ValueError(f"case {case} is present")
    kept = delete_case(old, case)
    return {k: kept[k].unionByName(new[k], allowMissingColumns=True) if k in new else kept[k] for k in kept}


def vacuum_cases(tables: dict[str, DataFrame], keep: DataFrame, drop: DataFrame) -> dict[str, DataFrame]:
    """Rows of the kept cases less the dropped ones; an empty result is refused."""
    cases = keep.select("case_id").distinct().join(drop.select("case_id").distinct(), "case_id", "left_anti")
    if cases.isEmpty():
        raise ValueError("no case would be kept")
    return {k: v.join(cases, "case_id", "left_semi") for k, v in tables.items()}


def upsert_last(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Both tables, of each key one row: a new one if there is any, and of several the one with the largest order."""
    both = old.withColumn("g_", F.lit(0)).unionByName(new.withColumn("g_", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("g_"), F.desc(order))
    return both.withColumn("r_", F.row_number().over(w)).where("r_ = 1").drop("r_", "g_")


def upsert_parse_results(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows replaced by (case, evidence, artifact); a row with evidence '' goes once the artifact has a named evidence."""
    out = upsert_last(old, new, ["case_id", "evidence_id", "artifact_id"], "finished_at")
    named = out.where("evidence_id != ''").select("case_id", "artifact_id").distinct().withColumn("evidence_id", F.lit(""))
    return out.join(named, ["case_id", "evidence_id", "artifact_id"], "left_anti")


def insert_evidence_ignore(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(
        new.dropDuplicates(["case_id", "evidence_id"]).join(old.select("case_id", "evidence_id"), ["case_id", "evidence_id"], "left_anti"),
    )


def upsert_case(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cases with the new values; created_at stays that of the first registration."""
    o = old.select("case_id", *[F.col(c).alias(f"o_{c}") for c in old.columns if c != "case_id"])
    j = o.join(new, "case_id", "full")
    return j.select(
        "case_id",
        *[F.coalesce(f"o_{c}", c).alias(c) if c == "created_at" else F.coalesce(c, f"o_{c}").alias(c) for c in old.columns if c != "case_id"],
    )


def backfill_evidence_id(parse_results: DataFrame, evidence: DataFrame) -> DataFrame:
    """An evidence id of '' takes the case's only one; with none or several it stays."""
    only = evidence.groupBy("case_id").agg(F.count("*").alias("n_"), F.min("evidence_id").alias("e_"))
    return parse_results.join(only, "case_id", "left").withColumn(
        "evidence_id",
        F.when((F.col("evidence_id") == "") & (F.col("n_") == 1), F.col("e_")).otherwise(F.col("evidence_id")),
    ).select(*parse_results.columns)
