"""Top-k, runs, windows, nearest points, chase and components against plain loops, with one hot key over many tasks."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import graph, joins, ranges, sessions

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


@pytest.fixture(scope="module")
def events(spark):
    """One case with nearly all rows, ties in time, a few rows of two other cases, and rows without a time."""
    rng = random.Random(1)
    rows = [("hot", f"id{i:04}", at(rng.choice([rng.randrange(90_000), 600 * rng.randrange(150)])), rng.choice(["evtx", "mft"]), "{}") for i in range(1500)]
    rows += [("small", f"s{i}", at(i * 1800), "mft", "{}") for i in range(5)] + [("none", "n", None, "mft", "{}"), ("hot", "nt", None, "mft", "{}")]
    return rows, spark.createDataFrame(rows, "case_id string, audit_id string, ts_utc timestamp_ntz, artifact_id string, payload_json string").repartition(7)


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_rows_holds_no_whole_group(events):
    rows, df = events
    got = ranges.top_rows(df, ["case_id", "artifact_id"], [F.col("ts_utc").asc_nulls_last(), F.col("audit_id").asc()], 40, "r", F.col("audit_id"), salts=8)
    want = set()
    for key in {(r[0], r[3]) for r in rows}:
        own = sorted([r for r in rows if (r[0], r[3]) == key], key=lambda r: (r[2] is None, r[2] or T0, r[1]))
        want |= {(r[1], i + 1) for i, r in enumerate(own[:40])}
    assert {(r.audit_id, r.r) for r in got.collect()} == want
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(got))
    assert dealt and all("salt_" in d for d in dealt[1::2])  # from the top: what is left by key, all rows by key and salt
    sample = plan(sessions.stratified_sample(df, 10))
    assert "salt_" in sample and "cross" not in sample.lower()


@pytest.mark.parametrize("gap", [0, 59, 600, 1800])
def test_islands_go_on_over_borders(events, gap):
    rows, df = events
    out = ranges.islands(df.where("ts_utc IS NOT NULL"), ["case_id"], "ts_utc", gap, "audit_id", "run")
    want, before = {}, {}
    for case, audit, ts, *_ in sorted([r for r in rows if r[2]], key=lambda r: (r[0], r[2], r[1])):
        ts0, n = before.get(case, (None, 0))
        n += ts0 is None or (ts - ts0).total_seconds() > gap
        before[case], want[audit] = (ts, n), n
    assert {r.audit_id: r.run for r in out.collect()} == want
    assert "range_" not in out.columns


def test_islands_of_nothing(events):
    assert ranges.islands(events[1].where("false"), ["case_id"], "ts_utc", 5, "audit_id", "run").count() == 0


def test_nearest_point(spark, events):
    rows, df = events
    rng = random.Random(3)
    points = [("hot", rng.randrange(100_000)) for _ in range(60)] + [("small", 1800), ("other", 5)]
    held = df.withColumn("sec", F.floor(ranges.micros(F.col("ts_utc")) / 1_000_000) - int((T0 - dt.datetime(1970, 1, 1)).total_seconds()))
    got = {r.audit_id: r.away for r in ranges.nearest_point(held, spark.createDataFrame(points, "case_id string, sec long"), ["case_id"], "sec", "away").collect()}
    for case, audit, ts, *_ in rows:
        own = [s for c, s in points if c == case]
        assert got[audit] == (min(abs((ts - T0).total_seconds() - s) for s in own) if own and ts else None)
    assert len(got) == len(rows)


def test_windows_of_all_widths(spark, events):
    rows, df = events
    rng = random.Random(4)
    spans = [("hot", i, at(a), at(a + rng.choice([0, 1, 59, 60, 61, 3600, 30_000]))) for i, a in enumerate(rng.randrange(90_000) for _ in range(40))]
    spans += [("hot", 90, at(-5 * 365 * 86400), at(5 * 365 * 86400)), ("small", 91, at(1800), at(3600)), ("hot", 92, at(10), at(5)), ("hot", 93, None, at(5)), ("no case", 94, at(0), at(99))]
    w = spark.createDataFrame(spans, "case_id string, cluster_id int, win_start timestamp_ntz, win_end timestamp_ntz")
    got = sorted((r.audit_id, r.cluster_id) for r in joins.window_events(df, w).collect())
    want = sorted((r[1], s[1]) for r in rows for s in spans if r[0] == s[0] and r[2] and s[2] and s[2] <= r[2] <= s[3])
    assert got == want
    assert joins.window_events(df, w.where("false")).count() == 0


@pytest.mark.parametrize("width", [0, 7, 1800])
def test_near_findings(spark, events, width):
    rows, df = events
    rng = random.Random(5)
    times = [("hot", at(rng.choice([rng.randrange(90_000), 600 * rng.randrange(20)]))) for _ in range(70)] + [("small", at(1801)), ("hot", None)]
    got = sorted(r.audit_id for r in joins.near_findings(df, spark.createDataFrame(times, "case_id string, ts timestamp_ntz"), width).collect())
    assert got == sorted(r[1] for r in rows if r[2] and any(c == r[0] and t and abs((t - r[2]).total_seconds()) <= width for c, t in times))


def test_chase_is_a_short_plan(spark):
    clusters = spark.createDataFrame([("c", i, at(20_000 * i), at(20_000 * i + 60)) for i in range(5)] + [("c", 9, None, None)], "case_id string, cluster_id int, start_ts timestamp_ntz, end_ts timestamp_ntz")
    flagged = spark.createDataFrame([("c", 1, at(21_500)), ("c", 1, at(23_000)), ("c", 1, at(24_500)), ("c", 2, at(100)), ("c", 3, at(60_000))], "case_id string, cluster_id int, ts_utc timestamp_ntz")
    out = sessions.chase(clusters, flagged)
    assert plan(out).split("Initial Plan")[0].count("Exchange") <= 3  # that of the last round; the others are written
    got = {r.cluster_id: (r.chase_rounds, r.capped, r.end_ts) for r in out.collect()}
    assert got == {0: (0, False, at(60)), 1: (2, True, at(23_000)), 2: (0, False, at(40_060)), 3: (0, False, at(60_060)), 4: (0, False, at(80_060))}


def test_components_of_chains_hubs_and_nulls(spark):
    links = [(f"a{i:04}", f"r{i // 2}") for i in range(300)] + [(f"a{i:04}", f"q{(i + 1) // 2}") for i in range(300)]  # one long chain
    links += [(f"h{i:03}", "hub") for i in range(400)] + [(f"h{i:03}", "hub") for i in range(9)] + [("z", None), (None, "r1"), ("alone", "x")]
    got = {r.l: r.component for r in graph.link_components(spark.createDataFrame(links, "l string, r string"), "l", "r").collect()}
    assert got == {f"a{i:04}": "a0000" for i in range(300)} | {f"h{i:03}": "h000" for i in range(400)} | {"alone": "alone"}
    assert graph.link_components(spark.createDataFrame([], "l string, r string"), "l", "r").count() == 0
