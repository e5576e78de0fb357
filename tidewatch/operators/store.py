"""Case tables kept as files, and their maintenance in place.

A table is a folder of Parquet files partitioned by case_id (the fact table by case_id and artifact_id, as write_events lays it
out). Every change is staged in the shared folder first, then replaces only the partitions it touches, by dynamic partition
overwrite; folders that end up without rows are removed last. So a change that fails half way leaves every partition either old or
new, and running it again completes it. Nothing outside the touched cases is read or written.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..model import kept, release

NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def _folders(spark: SparkSession, path: str, key: str) -> dict[str | None, str]:
    """Values of a partition key below a path, and their folders."""
    at, fs = _path(spark, path)
    if not fs.exists(at):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    own = [n for n in names if n.startswith(f"{key}=")]
    return {None if n.split("=", 1)[1] == NULL_PARTITION else unquote(n.split("=", 1)[1]): f"{path}/{n}" for n in own}


def _remove(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


def partition_keys(df: DataFrame) -> list[str]:
    return ["case_id", "artifact_id"] if {"artifact_id", "ts_utc"} <= set(df.columns) else ["case_id"]


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table's rows; none where it has not been written yet. The schema keeps partition values text."""
    return spark.read.schema(schema).parquet(path) if _folders(spark, path, "case_id") else spark.createDataFrame([], schema)


def put_rows(df: DataFrame, path: str) -> None:
    """Replaces the partitions that df has rows of by these rows; df may be derived from the table itself."""
    keys, staged = partition_keys(df), kept(df)
    order = ["ts_utc"] if "ts_utc" in df.columns else []
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys]), F.lit(8))  # a large partition is several files
    rows = staged.repartition(*keys, salt).sortWithinPartitions(*keys, *order)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    release(staged)


def delete_cases(spark: SparkSession, tables: dict[str, str], cases: list[str]) -> None:
    """Drops the folders of these cases from all tables (name -> path); what is not there is no error, so it can run again."""
    for path in tables.values():
        held = _folders(spark, path, "case_id")
        for case in cases:
            if case in held:
                _remove(spark, held[case])


def import_rows(spark: SparkSession, tables: dict[str, str], new: dict[str, DataFrame], case: str, overwrite: bool = False) -> None:
    """Puts one case's rows into the tables; refused where any table has the case and overwrite is not set.

    With overwrite, the case's partitions that the new rows do not have are removed after theirs are written, and the case goes
    from tables without new rows. Rows of other cases in new are left out.
    """
    if not overwrite and any(case in _folders(spark, path, "case_id") for path in tables.values()):
        raise ValueError(f"case {case} is present")
    for name, path in tables.items():
        own = new[name].where(F.col("case_id") == case) if name in new else None
        staged = kept(own) if own is not None else None
        if staged is None or staged.isEmpty():
            delete_cases(spark, {name: path}, [case])
            continue
        put_rows(staged, path)
        if "artifact_id" in partition_keys(staged):
            stay = {r[0] for r in staged.select("artifact_id").distinct().collect()}  # the artifacts of one case
            for artifact, folder in _folders(spark, _folders(spark, path, "case_id")[case], "artifact_id").items():
                if artifact not in stay:
                    _remove(spark, folder)
        release(staged)


def vacuum_tables(spark: SparkSession, tables: dict[str, str], keep: list[str] | None, drop: list[str]) -> list[str]:
    """Removes all cases but those of keep (all there are, if None) without those of drop; returns the kept ones. An empty result is refused."""
    held = {c for path in tables.values() for c in _folders(spark, path, "case_id") if c is not None}
    stay = (held if keep is None else held & set(keep)) - set(drop)
    if not stay:
        raise ValueError("no case would be kept")
    delete_cases(spark, tables, sorted(held - stay))
    return sorted(stay)


def merge_rows(spark: SparkSession, path: str, new: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Replaces the touched cases' rows by how(old, new), such as sinks.upsert_parse_results; only these cases are read.

    how must give every touched case at least one row.
    """
    staged = kept(new)
    old = read_table(spark, path, new.schema).join(staged.select("case_id").distinct(), "case_id", "left_semi").select(new.columns)
    put_rows(how(old, staged), path)
    release(staged)
