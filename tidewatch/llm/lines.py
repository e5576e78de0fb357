"""Line dedup by overlapping three-line windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_facts

WINDOW = 3


def line_windows(docs: DataFrame) -> DataFrame:
    """h (128-bit hash), doc_id, pos of every run of three consecutive lines; texts of fewer lines have none."""
    lines = F.split(F.col("text"), "\n", -1)
    runs = F.when(
        F.size("l") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("l") - (WINDOW - 1)), lambda i: F.unhex(F.md5(F.concat_ws("\n", F.slice("l", i, WINDOW))))),
    )
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", lines.alias("l")).select("doc_id", F.posexplode(runs).alias("pos", "h"))


def dedup_lines(df: DataFrame) -> DataFrame:
    """df with the lines removed that later occurrences of a repeated three-line window cover; adds n_lines and n_removed.

    The first occurrence of a window is the one of the smallest (doc_id, position); every other one loses its three
    lines, and overlapping windows merge into one stretch. Windows are judged on the input. A null text stays null with 0
    lines; an empty text is one empty line. Rows without a doc_id pass unchanged. Rows that share a doc_id count as the
    same place, so exact repeats of a row keep what the first keeps. Columns of any name pass through; columns of the
    input named n_lines or n_removed give way. An empty table stays empty.

    A window that a large share of all documents have is dealt over many tasks (join_facts); documents are joined by their
    doc_id, rows without one going around that join.
    """
    windows = line_windows(df.select("doc_id", "text"))
    place = F.struct("doc_id", "pos")
    repeated = windows.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("final"), F.count("*").alias("n")).where("first != final")
    later = join_facts(windows, cut(repeated.select("h", "first", "n")), ["h"], F.col("doc_id")).where(place != F.col("first"))
    covered = later.groupBy("doc_id").agg(F.collect_set("pos").alias("starts"))
    names = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    others = {c: f"c{i}" for i, c in enumerate(names) if c not in ("doc_id", "text")}  # under plain names until the end
    rows = df.select("doc_id", "text", *[F.col(f"`{c}`").alias(own) for c, own in others.items()])
    found = rows.where("doc_id IS NOT NULL").join(covered, "doc_id", "left")
    split = found.unionByName(
        rows.where("doc_id IS NULL").withColumn("starts", F.lit(None).cast("array<int>")),
    ).withColumn("l", F.split("text", "\n", -1))
    gone = split.withColumn("gone", F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p + 1, p + WINDOW)))))
    kept = F.transform(F.array_except(F.sequence(F.lit(1), F.size("l")), "gone"), lambda i: F.element_at("l", i))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(F.col("text").isNotNull(), F.size("l")).otherwise(0).cast("long")
    n_removed = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    out = [text.alias(c) if c == "text" else F.col(others.get(c, c)).alias(c) for c in names]
    return gone.select(*out, n_lines.alias("n_lines"), n_removed.alias("n_removed"))


LINES_SQL = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
i AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS pos FROM d),
w AS (SELECT doc_id, pos, list_slice(l, pos, pos + 2) AS run FROM i WHERE pos <= len(l) - 2),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS nth FROM w),
gone AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM r WHERE nth > 1),
kept AS (SELECT i.doc_id, string_agg(i.l[i.pos], chr(10) ORDER BY i.pos) AS text, count(*) AS n FROM i ANTI JOIN gone USING (doc_id, pos) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.l) AS BIGINT) AS n_lines, CAST(len(d.l) - coalesce(k.n, 0) AS BIGINT) AS n_removed, coalesce(k.text, '') AS text
FROM d LEFT JOIN kept k USING (doc_id)
"""
