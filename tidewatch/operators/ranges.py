"""Building blocks that hold no whole group in one task: two-level top-k, segmented runs, interval and nearest joins, salted joins.

Rows of a key are dealt by salt or by range of their order; what crosses a border between ranges is carried by a table of one
row a range and key. Ranges come from a sample, so ranged rows are written before anything is derived from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import kept, micros

#: Tasks over which a group, or a hot key of a join, is dealt.
SALTS = 64
#: A key is hot if more than one row in HOT_ONE_IN has it: no more than HOT_ONE_IN keys can be.
HOT_ONE_IN = 1000
#: Cells of the interval join: the narrowest is this many microseconds, each level is WIDER times as wide. From level DEALT on (an hour)
#: a cell may hold most of a key's rows, so its rows are dealt over SALTS tasks.
CELL, WIDER, DEALT = 60_000_000, 8, 2


def top_rows(df: DataFrame, keys: list[str], order: list[Column], most: int, name: str, spread: Column, salts: int = SALTS) -> DataFrame:
    """The first `most` rows of each key in order, numbered from 1 in column name.

    Each key is dealt by the hash of spread over salts, and each part is cut at the literal bound; what is left, at most most x salts
    rows a key, is ranked. So no task reads a whole key, and the second exchange carries no more than that.
    """
    part = df.withColumn("salt_", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    first = part.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "salt_").orderBy(*order))).where(F.col(name) <= most)
    return first.drop("salt_", name).withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= most)


def ranged(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """df dealt by ranges of keys and order, written, with the number of its range in range_."""
    return kept(df.repartitionByRange(*keys, *order).withColumn("range_", F.spark_partition_id()))


def islands(df: DataFrame, keys: list[str], ts: str, gap_s: int, tie: str, name: str) -> DataFrame:
    """Numbers runs 1, 2, ... within keys: a new one begins where the gap to the row before is more than gap_s seconds.

    A segmented scan: runs are counted within each range of (keys, ts, tie); a table of each range's first and last time and
    number of runs tells where a run goes on over a border, and how many runs came before. Needs ts not null.
    """
    order = [F.col(ts).asc(), F.col(tie).asc()]
    held = ranged(df, keys, order)
    gap = lambda later, earlier: (micros(later) - micros(earlier) > gap_s * 1_000_000).cast("int")
    inside = Window.partitionBy(*keys, "range_").orderBy(*order)
    new = F.coalesce(gap(F.col(ts), F.lag(ts).over(inside)), F.lit(0))  # the first of a range is judged at its border
    borders = held.withColumn("new_", new).groupBy(*keys, "range_").agg(F.min(ts).alias("first_"), F.max(ts).alias("last_"), F.sum("new_").alias("runs_"))
    along = Window.partitionBy(*keys).orderBy("range_")
    borders = borders.withColumn("begins_", F.coalesce(gap(F.col("first_"), F.lag("last_").over(along)), F.lit(1)))
    before = F.sum(F.col("runs_") + F.col("begins_")).over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("runs_")
    borders = borders.select(*keys, "range_", before.alias("before_"))
    numbered = held.withColumn("new_", new).withColumn(name, F.sum("new_").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.join(borders, [*keys, "range_"]).withColumn(name, (F.col(name) + F.col("before_")).cast("int")).drop("new_", "before_", "range_")


def nearest_point(rows: DataFrame, points: DataFrame, keys: list[str], at: str, name: str) -> DataFrame:
    """rows with the distance of their number `at` to the nearest of points (keys, at) of their keys; null where they have none.

    Rows and points lie in one stream, dealt by ranges of (keys, at). Within a range the nearest points left and right are the last
    one before and the first one after; over borders they come from a table of each range's least and greatest point.
    """
    marked = rows.withColumn("point_", F.lit(None).cast("long")).unionByName(
        points.select(*keys, at, F.col(at).cast("long").alias("point_")), allowMissingColumns=True,
    )
    order = [F.col(at).asc_nulls_last(), F.col("point_").asc_nulls_last()]  # a point before the rows of its place
    held = ranged(marked, keys, order)
    inside, along = Window.partitionBy(*keys, "range_").orderBy(*order), Window.partitionBy(*keys).orderBy("range_")
    borders = held.groupBy(*keys, "range_").agg(F.min("point_").alias("least_"), F.max("point_").alias("most_"))
    borders = borders.select(
        *keys, "range_", F.max("most_").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("left_"), F.min("least_").over(along.rowsBetween(1, Window.unboundedFollowing)).alias("right_"),
    )
    left = F.coalesce(F.last("point_", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("left_"))
    right = F.coalesce(F.first("point_", True).over(inside.rowsBetween(0, Window.unboundedFollowing)), F.col("right_"))
    found = held.join(borders, [*keys, "range_"]).withColumn("l_", left).withColumn("r_", right)
    away = F.least(F.abs(F.col(at) - F.col("l_")), F.abs(F.col(at) - F.col("r_")))
    return found.where("point_ IS NULL").withColumn(name, away).select(*rows.columns, name)


def in_windows(events: DataFrame, windows: DataFrame, keys: list[str], ts: str, lo: str, hi: str) -> DataFrame:
    """Pairs of an event and a window of its keys with lo <= ts <= hi (timestamps), both ends inclusive.

    The width of a window chooses its level, on which it meets at most WIDER + 1 cells; an event probes its one cell of each level
    that any window has (at most 13 levels, from a minute to beyond a million years). So a window of ten years is a few rows, and a
    minute's window does not meet a whole day's events. The events of a wide cell are dealt by their hash, its windows go to all parts.
    """
    a, b = micros(F.col(lo)), micros(F.col(hi))
    levels = range(13)
    level = F.coalesce(*[F.when(b - a <= CELL * WIDER ** (k + 1), F.lit(k)) for k in levels[:-1]], F.lit(levels[-1]))
    width = lambda k: F.lit(CELL) * F.pow(F.lit(WIDER), k).cast("long")
    cell = lambda t, k: F.floor(t / width(k)).cast("long")
    spread = windows.where(F.col(lo).isNotNull() & F.col(hi).isNotNull() & (F.col(lo) <= F.col(hi))).withColumn("level_", level)
    used = sorted(r[0] for r in spread.select("level_").distinct().collect())  # at most 13 numbers
    spread = spread.withColumn("cell_", F.explode(F.sequence(cell(a, F.col("level_")), cell(b, F.col("level_")))))
    spread = spread.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.when(F.col("level_") >= DEALT, F.lit(SALTS - 1)).otherwise(0))))
    own = F.pmod(F.xxhash64(*[c for c, kind in events.dtypes if "map<" not in kind]), F.lit(SALTS)).cast("int")
    place = lambda k: F.struct(F.lit(k).alias("level_"), cell(micros(F.col(ts)), F.lit(k)).alias("cell_"), (own if k >= DEALT else F.lit(0)).alias("salt_"))
    probes = F.array(*map(place, used)) if used else F.array().cast("array<struct<level_: int, cell_: bigint, salt_: int>>")
    met = ["level_", "cell_", "salt_"]
    probe = events.withColumn("at_", F.explode(probes)).select(*events.columns, *[f"at_.{c}" for c in met])
    return probe.join(spread, [*keys, *met]).where((F.col(ts) >= F.col(lo)) & (F.col(ts) <= F.col(hi))).drop(*met)


def join_counted(rows: DataFrame, facts: DataFrame, keys: list[str], spread: Column) -> DataFrame:
    """rows with what is known of their keys; facts has one row a key, and a column n: how many of rows have it.

    A hot key's rows are dealt over SALTS tasks and its fact goes to each of them; the hot keys, HOT_ONE_IN at most, are broadcast.
    Rows whose keys have no facts drop out.
    """
    total = facts.agg(F.sum("n")).head()[0] or 0
    hot = F.col("n") > F.lit(max(1, total // HOT_ONE_IN))
    known = F.broadcast(facts.where(hot).select(*keys, F.lit(SALTS).alias("salts_")))
    dealt = rows.join(known, keys, "left").withColumn("salt_", F.coalesce(F.pmod(F.xxhash64(spread), "salts_"), F.lit(0)).cast("int")).drop("salts_")
    held = facts.withColumn("salt_", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("n")
    return dealt.join(held, [*keys, "salt_"]).drop("salt_")
