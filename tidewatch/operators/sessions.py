"""Gaps and islands, samples, windows and orderings in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import event_data, image_of, legacy_image_of, norm_user, phase_rank, severity_rank, suspicious_path
from ..model import kept, micros, seconds
from .filters import drop_evtx_noise
from .joins import burst_success, near_findings
from .ranges import HOT_ONE_IN, islands, nearest_point, top_rows


def first_evidence(findings: DataFrame) -> DataFrame:
    """findings with first_ts: the earliest time of the evidence."""
    times = F.filter(F.transform("evidence", lambda e: e["ts_utc"]), lambda t: t.isNotNull())
    return findings.withColumn("first_ts", F.array_min(times))


def first_of_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """As first_evidence, where the evidence lies in rows (keys, ts_utc): one row a finding, and no array of its evidence is made."""
    return rows.groupBy(*keys).agg(F.min("ts_utc").alias("first_ts"))


def cluster_findings(findings: DataFrame, gap_s: int = 1800) -> DataFrame:
    """cluster_id of each finding: by its first time, split where the gap is more than gap_s; undated ones form the last cluster of their case.

    Needs case_id, finding_id, first_ts. A case is dealt over ranges of time (see ranges.islands).
    """
    dated = findings.where("first_ts IS NOT NULL")
    numbered = islands(dated, ["case_id"], "first_ts", gap_s, "finding_id", "cluster_id")
    last = numbered.groupBy("case_id").agg(F.max("cluster_id").alias("m_"))
    undated = findings.where("first_ts IS NULL").join(last, "case_id", "left").withColumn("cluster_id", (F.coalesce("m_", F.lit(0)) + 1).cast("int")).drop("m_")
    return numbered.unionByName(undated)


def cluster_table(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("case_id", "cluster_id").agg(
        F.min("first_ts").alias("start_ts"),
        F.max("first_ts").alias("end_ts"),
        F.count("*").alias("n_findings"),
    )


def logon_events(df: DataFrame) -> DataFrame:
    """Logons (4624) and failures (4625) of evtx with user, sub status, logon type, workstation and address."""
    pay = F.col("payload_json")
    eid = F.get_json_object(pay, "$.EventId")
    named = {
        "target_user": "TargetUserName",
        "sub_status": "SubStatus",
        "logon_type": "LogonType",
        "workstation": "WorkstationName",
        "ip": "IpAddress",
    }
    return df.where((F.col("artifact_id") == "evtx") & eid.isin("4624", "4625")).select(
        "case_id",
        "audit_id",
        "ts_utc",
        eid.try_cast("int").alias("event_id"),
        *[event_data(pay, v).alias(k) for k, v in named.items()],
    )


def split_bursts(logons: DataFrame, gap_s: int = 600) -> DataFrame:
    """Failures numbered by burst within each account."""
    fails = logons.where("event_id = 4625 AND ts_utc IS NOT NULL").withColumn("account", norm_user(F.col("target_user"))).where("account NOT IN ('', '-')")
    return islands(fails, ["case_id", "account"], "ts_utc", gap_s, "audit_id", "burst_id")


def modal_value(rows: DataFrame, keys: list[str], col: str, name: str = "mode") -> DataFrame:
    """The most frequent value that is not blank, ties to the smallest, and its count."""
    counts = rows.withColumn("v_", F.trim(col)).where("v_ != ''").groupBy(*keys, "v_").agg(F.count("*").alias("n_"))
    return counts.groupBy(*keys).agg(F.min_by("v_", F.struct(-F.col("n_"), F.col("v_"))).alias(name), F.max("n_").alias(f"n_{name}"))


def detect_bruteforce(logons: DataFrame, least: int = 5, fail_gap_s: int = 600, success_gap_s: int = 600) -> DataFrame:
    """Bursts of at least `least` failures whose dominant sub status reaches it too (or that have none); high where a success follows."""
    keys = ["case_id", "account", "burst_id"]
    rows = split_bursts(logons, fail_gap_s)
    runs = rows.groupBy(*keys).agg(
        F.count("*").alias("failures"),
        F.min("ts_utc").alias("run_start"),
        F.max("ts_utc").alias("run_end"),
        F.array_sort(
            F.array_except(
                F.array_distinct(F.concat(F.collect_set(F.trim("workstation")), F.collect_set(F.trim("ip")))),
                F.array(F.lit(""), F.lit("-")),
            ),
        ).alias("sources"),
    )
    runs = runs.join(modal_value(rows, keys, "sub_status"), keys, "left").where(
        (F.col("failures") >= least) & (F.col("mode").isNull() | (F.col("n_mode") >= least)),
    )
    won = logons.where("event_id = 4624").withColumn("account", norm_user(F.col("target_user")))
    out = burst_success(runs, won, success_gap_s)
    return out.withColumn("severity", F.when(F.col("success_ts").isNotNull(), "high").otherwise("medium")).withColumn("technique", F.lit("T1110.001")).withColumn(
        "finding_id",
        F.concat(F.lit("bruteforce-"), F.col("account"), F.lit("-"), seconds(F.col("run_start")).cast("string")),
    )


def bruteforced_accounts(bursts: DataFrame) -> DataFrame:
    return bursts.select("case_id", "account").distinct()


def stratified_sample(df: DataFrame, max_rows: int) -> DataFrame:
    """The earliest rows of each artifact, at most max(100, max(2000, 5 max_rows) / artifacts) each; evtx noise is left out.

    The largest quota is a literal bound, by which each artifact is cut in salted parts before its parts are ranked together.
    """
    most = max(2000, 5 * max_rows)
    shares = df.groupBy("case_id").agg(F.countDistinct("artifact_id").alias("n_"))
    order = [F.col("ts_utc").asc_nulls_last(), F.col("audit_id").asc()]
    first = top_rows(drop_evtx_noise(df), ["case_id", "artifact_id"], order, most, "r_", F.col("audit_id"))
    quota = F.greatest(F.lit(100), F.floor(F.lit(most) / F.col("n_")))
    return first.join(shares, "case_id").where(F.col("r_") <= quota).drop("r_", "n_")


# Points that scarce artifacts add (lens A0).
DIVERSITY_BOOST = {
    "usn_journal": 1,
    "shellbags": 1,
    "browser_history": 1,
    "amcache": 1,
    "prefetch": 1,
    "registry": 1,
    "mft": 1,
    "lnk": 1,
    "jumplists": 1,
    "shimcache": 1,
}


def anomaly_candidates(df: DataFrame, cited: DataFrame, times: DataFrame, max_rows: int) -> DataFrame:
    """Scored events of the sample that are not cited yet: lenses, score, total; the top max_rows of each case by score and time.

    A1 before 6 or from 22 o'clock 2, A2 watched path 3, A4 image seen fewer than 3 times in the sample 2, A5 within 30
    minutes of a prior finding 1, A0 the artifact's boost; rows without points are dropped.
    """
    sample = kept(stratified_sample(df, max_rows).withColumn("image_", F.lower(image_of(F.col("payload_json")))))  # each lens reads it
    images = sample.where("image_ != ''").groupBy("case_id", "image_").agg(F.count("*").alias("n_img"))
    near = near_findings(sample.select("case_id", "audit_id", "ts_utc"), times).select("case_id", "audit_id", F.lit(True).alias("near_")).distinct()
    rows = sample.join(
        cited.select("case_id", "audit_id").distinct(),
        ["case_id", "audit_id"],
        "left_anti",
    ).join(images, ["case_id", "image_"], "left").join(near, ["case_id", "audit_id"], "left")
    hour = F.hour("ts_utc")
    points = F.lit(0)
    for artifact, value in DIVERSITY_BOOST.items():
        points = F.when(F.col("artifact_id") == artifact, F.lit(value)).otherwise(points)
    lenses = [
        ("A1", (hour < 6) | (hour >= 22), F.lit(2)),
        ("A2", suspicious_path(F.col("payload_json")), F.lit(3)),
        ("A4", F.col("n_img") < 3, F.lit(2)),
        ("A5", F.coalesce("near_", F.lit(False)), F.lit(1)),
        ("A0", points > 0, points),
    ]
    on = lambda c: F.coalesce(c, F.lit(False))
    score = sum((F.when(on(c), w).otherwise(0) for _, c, w in lenses), F.lit(0))
    rows = rows.withColumn(
        "lenses",
        F.array_compact(F.array(*[F.when(on(c), F.lit(n)) for n, c, _ in lenses])),
    ).withColumn("score", score.cast("int")).where("score > 0")
    totals = rows.groupBy("case_id").agg(F.count("*").alias("total"))
    order = Window.partitionBy("case_id").orderBy(F.desc("score"), F.col("ts_utc").asc_nulls_first(), "audit_id")
    top = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max_rows)
    return top.join(totals, "case_id").select("case_id", "audit_id", "artifact_id", "ts_utc", "lenses", "score", "place", "total")


def earliest_rows(df: DataFrame, most: int) -> DataFrame:
    """The `most` earliest rows of each case (ties by audit_id, those without a time last), over all its artifacts.

    A table of rows a case and day gives the day on which the bound is reached; later rows are cut before any exchange of whole
    rows, and the rest goes through ranges.top_rows. Only cases with more than one row in HOT_ONE_IN are cut so: their days are
    broadcast, HOT_ONE_IN rows at most. A join on the case instead would bring all rows of a case into one task.
    """
    day = F.coalesce(F.datediff("ts_utc", F.lit("1970-01-01")), F.lit(1 << 30))
    known = df.where("case_id IS NOT NULL")
    days = kept(known.groupBy("case_id", day.alias("day_")).agg(F.count("*").alias("n_")))
    total = days.agg(F.sum("n_")).head()[0] or 0
    before = F.sum("n_").over(Window.partitionBy("case_id").orderBy("day_").rowsBetween(Window.unboundedPreceding, -1))
    reached = days.withColumn("before_", F.coalesce(before, F.lit(0))).groupBy("case_id").agg(
        F.max(F.when(F.col("before_") < most, F.col("day_"))).alias("until_"), F.sum("n_").alias("n_"),
    )
    until = F.broadcast(reached.where(F.col("n_") > max(1, total // HOT_ONE_IN)).select("case_id", "until_"))
    early = known.withColumn("day_", day).join(until, "case_id", "left").where("until_ IS NULL OR day_ <= until_").drop("day_", "until_")
    return top_rows(early, ["case_id"], [F.col("ts_utc").asc_nulls_last(), F.col("audit_id").asc()], most, "r_", F.col("audit_id")).drop("r_")


def anomaly_candidates_legacy(df: DataFrame, cited: DataFrame, times: DataFrame, max_rows: int) -> DataFrame:
    """The older candidates: of each case's earliest max(1000, 5 max_rows) events those with points that are not cited yet.

    A1 before 6 or from 22 o'clock 2, A2 watched path 3, A4 image seen fewer than 3 times in the sample 2, A5 within 30 minutes of
    a prior finding 1; the top max_rows of each case by score and time. total counts all events of the case.
    """
    most = max(1000, 5 * max_rows)
    sample = kept(earliest_rows(df, most).withColumn("image_", F.lower(legacy_image_of(F.col("payload_json")))))  # each lens reads it
    images = sample.where("image_ != ''").groupBy("case_id", "image_").agg(F.count("*").alias("n_img"))
    near = near_findings(sample.select("case_id", "audit_id", "ts_utc"), times).select("case_id", "audit_id", F.lit(True).alias("near_")).distinct()
    rows = sample.join(cited.select("case_id", "audit_id").distinct(), ["case_id", "audit_id"], "left_anti")
    rows = rows.join(images, ["case_id", "image_"], "left").join(near, ["case_id", "audit_id"], "left")
    hour = F.hour("ts_utc")
    lenses = [
        ("A1", (hour < 6) | (hour >= 22), 2),
        ("A2", suspicious_path(F.col("payload_json"), single=True), 3),
        ("A4", F.col("n_img") < 3, 2),
        ("A5", F.col("near_"), 1),
    ]
    hit = {name: F.coalesce(on, F.lit(False)) for name, on, _ in lenses}
    score = sum((F.when(hit[name], F.lit(points)).otherwise(0) for name, _, points in lenses), F.lit(0))
    named = F.array_compact(F.array(*[F.when(on, F.lit(name)) for name, on in hit.items()]))
    scored = rows.withColumn("lenses", named).withColumn("score", score.cast("int")).where("score > 0")
    order = Window.partitionBy("case_id").orderBy(F.desc("score"), F.col("ts_utc").asc_nulls_first(), "audit_id")
    top = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max_rows)
    totals = df.groupBy("case_id").agg(F.count("*").alias("total"))
    return top.join(totals, "case_id").select("case_id", "audit_id", "artifact_id", "ts_utc", "lenses", "score", "place", "total")


def merge_candidates(cached: DataFrame, scored: DataFrame, cap: int) -> DataFrame:
    """Learned candidates first, then scored ones; an event once, with the lenses of both; at most cap a case."""
    both = cached.select("case_id", "audit_id", "ts_utc", "lenses", "score", F.lit(0).alias("p_")).union(
        scored.select("case_id", "audit_id", "ts_utc", "lenses", "score", F.lit(1).alias("p_")),
    )
    one = both.groupBy("case_id", "audit_id").agg(
        F.min("p_").alias("p_"),
        F.max("score").alias("score"),
        F.min("ts_utc").alias("ts_utc"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("lenses")))).alias("lenses"),
    )
    order = Window.partitionBy("case_id").orderBy("p_", F.desc("score"), "ts_utc", "audit_id")
    return one.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap).drop("p_")


def cluster_anchors(points: DataFrame, most: int = 96) -> DataFrame:
    """anchors of each cluster: distinct seconds of points (case_id, cluster_id, ts_utc), sorted, thinned evenly to `most`."""
    secs = points.where("ts_utc IS NOT NULL").groupBy("case_id", "cluster_id").agg(F.array_sort(F.collect_set(seconds(F.col("ts_utc")))).alias("a_"))
    n = F.size("a_")
    picked = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.element_at("a_", F.floor(i * (n - 1) / (most - 1) + 0.5).cast("int") + 1))
    return secs.select("case_id", "cluster_id", F.when(n > most, picked).otherwise(F.col("a_")).alias("anchors"))


def proximity_sample(rows: DataFrame, anchors: DataFrame, max_rows: int = 300) -> DataFrame:
    """Of each cluster's window rows, for each artifact the max(30, max_rows / artifacts) nearest to an anchor, in whole seconds; without anchors the earliest.

    Anchors and rows meet in one sorted stream (ranges.nearest_point), however many anchors a cluster has.
    """
    keys = ["case_id", "cluster_id"]
    shares = rows.groupBy(*keys).agg(F.countDistinct("artifact_id").alias("n_"))
    points = anchors.select(*keys, F.explode("anchors").alias("sec_"))
    held = nearest_point(drop_evtx_noise(rows).withColumn("sec_", seconds(F.col("ts_utc"))), points, keys, "sec_", "away").drop("sec_")
    held = held.withColumn("away", F.coalesce("away", F.lit(0)))
    order = [F.col("away").asc(), F.col("ts_utc").asc(), F.col("audit_id").asc()]
    first = top_rows(held, [*keys, "artifact_id"], order, max(30, max_rows), "r_", F.col("audit_id"))
    quota = F.greatest(F.lit(30), F.floor(F.lit(max_rows) / F.col("n_")))
    return first.join(shares, keys).where(F.col("r_") <= quota).drop("r_", "n_")


def cluster_boundaries(clusters: DataFrame) -> DataFrame:
    """prev_bound and next_bound (microseconds): the middles of the gaps to the nearest dated clusters of the case, the next one less 1 us."""
    order = Window.partitionBy("case_id").orderBy("start_ts", "cluster_id")
    s, e = micros(F.col("start_ts")), micros(F.col("end_ts"))
    dated = clusters.where("start_ts IS NOT NULL").withColumn(
        "p_",
        F.max(e).over(order.rowsBetween(Window.unboundedPreceding, -1)),
    ).withColumn("n_", F.lead(s).over(order))
    dated = dated.withColumn("prev_bound", F.col("p_") + F.floor((s - F.col("p_")) / 2)).withColumn("next_bound", e + F.floor((F.col("n_") - e) / 2) - 1)
    return dated.drop("p_", "n_")


def cluster_window(bounded: DataFrame, window_s: int = 1800, lo: str = "start_ts", hi: str = "end_ts") -> DataFrame:
    """win_start and win_end: the hull widened by window_s, held within the bounds, never inside the hull."""
    w = window_s * 1_000_000
    a, b = micros(F.col(lo)), micros(F.col(hi))
    left = F.least(F.greatest(a - w, F.coalesce("prev_bound", a - w)), a)
    right = F.greatest(F.least(b + w, F.coalesce("next_bound", b + w)), b)
    stamp = lambda c: F.timestamp_micros(c.cast("long")).cast("timestamp_ntz")
    return bounded.withColumn("win_start", stamp(left)).withColumn("win_end", stamp(right))


def grow_hull(clusters: DataFrame, flagged: DataFrame) -> DataFrame:
    """The hull widened to the flagged times of the cluster; grew tells whether it changed."""
    t = flagged.groupBy("case_id", "cluster_id").agg(F.min("ts_utc").alias("lo_"), F.max("ts_utc").alias("hi_"))
    out = clusters.join(t, ["case_id", "cluster_id"], "left").withColumn(
        "grew",
        F.coalesce((F.col("lo_") < F.col("start_ts")) | (F.col("hi_") > F.col("end_ts")), F.lit(False)),
    )
    return out.withColumn(
        "start_ts",
        F.least("start_ts", F.coalesce("lo_", "start_ts")),
    ).withColumn("end_ts", F.greatest("end_ts", F.coalesce("hi_", "end_ts"))).drop("lo_", "hi_")


def chase(clusters: DataFrame, flagged: DataFrame, window_s: int = 1800, rounds: int = 2) -> DataFrame:
    """Follows flagged events out of each cluster's window for a few rounds: grow the hull by what the window shows, hold it within the bounds, widen again.

    Adds continues_from_prev, continues_into_next, chase_rounds and capped (a further round would still have grown).

    A loop with a kept frontier: clusters and the flagged times are written once, a round joins the flagged times of open clusters
    only (those that grew in the round before) and writes what it finds; clusters that stay as they are leave the loop. It ends early
    where none is open.
    """
    keys = ["case_id", "cluster_id"]
    stamp = lambda c: F.timestamp_micros(c.cast("long")).cast("timestamp_ntz")
    off = F.lit(False)
    start = cluster_window(cluster_boundaries(clusters), window_s)
    frontier = kept(start.withColumns({"continues_from_prev": off, "continues_into_next": off, "chase_rounds": F.lit(0), "capped": off}))
    times = kept(flagged.select(*keys, "ts_utc"))
    done = []
    for k in range(1, rounds + 2):
        shown = times.join(frontier.select(*keys, "win_start", "win_end"), keys).where("ts_utc >= win_start AND ts_utc <= win_end")
        t = shown.groupBy(*keys).agg(F.min("ts_utc").alias("lo_"), F.max("ts_utc").alias("hi_"))
        lo, hi = F.least("start_ts", F.coalesce("lo_", "start_ts")), F.greatest("end_ts", F.coalesce("hi_", "end_ts"))
        cut_lo, cut_hi = F.coalesce(micros(lo) < F.col("prev_bound"), off), F.coalesce(micros(hi) > F.col("next_bound"), off)
        ends = {"nl_": F.when(cut_lo, stamp(F.col("prev_bound"))).otherwise(lo), "nh_": F.when(cut_hi, stamp(F.col("next_bound"))).otherwise(hi), "cl_": cut_lo, "ch_": cut_hi}
        seen = frontier.join(t, keys, "left").withColumns(ends).withColumn("grows_", F.coalesce((F.col("nl_") < F.col("start_ts")) | (F.col("nh_") > F.col("end_ts")), off))
        if k > rounds:
            done.append(seen.withColumn("capped", F.col("grows_")).select(frontier.columns))
            break
        grown = {
            "continues_from_prev": F.col("continues_from_prev") | F.col("cl_"),
            "continues_into_next": F.col("continues_into_next") | F.col("ch_"),
            "start_ts": F.when(F.col("grows_"), F.col("nl_")).otherwise(F.col("start_ts")),
            "end_ts": F.when(F.col("grows_"), F.col("nh_")).otherwise(F.col("end_ts")),
            "chase_rounds": F.when(F.col("grows_"), F.lit(k)).otherwise(F.col("chase_rounds")),
        }
        now = kept(cluster_window(seen.withColumns(grown), window_s).select(*frontier.columns, "grows_"))
        done.append(now.where("NOT grows_").drop("grows_"))
        frontier = now.where("grows_").drop("grows_")
        if frontier.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def merge_follow_ups(current: DataFrame, more: DataFrame) -> DataFrame:
    return current.unionByName(more).groupBy("case_id", "cluster_id", "audit_id").agg(F.min("ts_utc").alias("ts_utc")).orderBy("case_id", "cluster_id", "ts_utc", "audit_id")


def temporal_outliers(clusters: DataFrame, far_s: int = 365 * 86400) -> DataFrame:
    """Adds outlier: the middle of a dated cluster is more than far_s from the upper median of its case, which needs three."""
    mid = F.floor((seconds(F.col("start_ts")) + seconds(F.col("end_ts"))) / 2)
    dated = clusters.where("start_ts IS NOT NULL").withColumn("mid_", mid)
    order = Window.partitionBy("case_id").orderBy("mid_", "cluster_id")
    ranked = dated.select(
        "case_id",
        "cluster_id",
        "mid_",
        F.row_number().over(order).alias("r_"),
    ).join(dated.groupBy("case_id").agg(F.count("*").alias("n_")), "case_id")
    median = ranked.where("n_ >= 3 AND r_ = floor(n_ / 2) + 1").select("case_id", F.col("mid_").alias("med_"))
    return clusters.withColumn("mid_", mid).join(median, "case_id", "left").withColumn(
        "outlier",
        F.coalesce(F.abs(F.col("mid_") - F.col("med_")) > far_s, F.lit(False)),
    ).drop("mid_", "med_")


def numbered_rows(df: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """df with each row's number (from 0) within its key in order, and n_, the key's rows: ranges are numbered apart, then offset.

    No task holds a whole key: rows are dealt by ranges of key and order, and a table of one row a range and key has the counts.
    """
    ranged = kept(df.repartitionByRange(key, *order).withColumn("range_", F.spark_partition_id()))
    sizes = ranged.groupBy(key, "range_").agg(F.count("*").alias("c_"))
    before = F.sum("c_").over(Window.partitionBy(key).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(key, "range_", F.coalesce(before, F.lit(0)).alias("before_"), F.sum("c_").over(Window.partitionBy(key)).alias("n_"))
    own = F.row_number().over(Window.partitionBy(key, "range_").orderBy(*order))
    return ranged.withColumn("own_", own).join(sizes, [key, "range_"]).withColumn(name, F.col("own_") - 1 + F.col("before_")).drop("own_", "before_", "range_")


def sliding_windows(df: DataFrame, size: int, overlap: float = 0.2) -> DataFrame:
    """Rows of each case in time order, once for each of the overlapping row windows that hold them; odd overlaps count as 0.2."""
    if not 0 < overlap <= 0.5:
        overlap = 0.2
    stride = max(1, int(size * (1 - overlap)))
    rows = numbered_rows(df, "case_id", [F.col("ts_utc").asc_nulls_last(), F.col("audit_id").asc()], "i_")
    last = F.greatest(F.lit(0), F.ceil((F.col("n_") - size) / stride))
    lo = F.greatest(F.lit(0), F.floor((F.col("i_") - size) / stride) + 1)
    hi = F.least(last, F.floor(F.col("i_") / stride))
    return rows.withColumn(
        "window_id",
        F.explode(F.sequence(lo.cast("long"), hi.cast("long"))),
    ).withColumn("pos", F.col("i_") - F.col("window_id") * stride).drop("i_", "n_")


def attack_steps(tl: DataFrame) -> DataFrame:
    """The earliest event of each tactic with all of the tactic's ids, in kill-chain order, numbered."""
    steps = tl.where("tactic != ''").groupBy("case_id", "tactic").agg(
        F.min(F.struct("ts_utc", "audit_id")).alias("s_"),
        F.countDistinct("audit_id").alias("n_events"),
    ).withColumn("rank_", phase_rank(F.col("tactic")))
    return steps.withColumn("step", F.row_number().over(Window.partitionBy("case_id").orderBy("rank_", "s_.ts_utc", "tactic"))).select(
        "case_id",
        "step",
        "tactic",
        F.col("s_.ts_utc").alias("ts_utc"),
        F.col("s_.audit_id").alias("audit_id"),
        "n_events",
    )


def intrusion_path(clusters: DataFrame) -> DataFrame:
    """Clusters that are not noise, by phase and start, numbered."""
    live = clusters.where(~F.coalesce("noise", F.lit(False))).withColumn("rank_", phase_rank(F.col("attack_phase")))
    return live.withColumn(
        "step",
        F.row_number().over(Window.partitionBy("case_id").orderBy("rank_", F.col("start_ts").asc_nulls_last(), "cluster_id")),
    ).drop("rank_")


def order_attack_clusters(clusters: DataFrame, entry_ids: DataFrame, reliable: bool) -> DataFrame:
    """By start; on an unreliable timeline entry clusters come first, then phase, then start."""
    out = clusters.join(entry_ids.select("case_id", "cluster_id", F.lit(True).alias("in_")).distinct(), ["case_id", "cluster_id"], "left")
    key = [F.col("start_ts").asc_nulls_last()] if reliable else [
        F.coalesce("in_", F.lit(False)).desc(),
        phase_rank(F.col("attack_phase")),
        F.col("start_ts").asc_nulls_last(),
    ]
    return out.withColumn("place", F.row_number().over(Window.partitionBy("case_id").orderBy(*key, "cluster_id"))).drop("in_")


def story_gaps(clusters: DataFrame, gap_s: int = 1800) -> DataFrame:
    """quiet_s before each cluster, where it is longer than gap_s."""
    order = Window.partitionBy("case_id").orderBy("start_ts", "cluster_id")
    gap = seconds(F.col("start_ts")) - seconds(F.lag("end_ts").over(order))
    return clusters.where("start_ts IS NOT NULL").withColumn("quiet_s", F.when(gap > gap_s, gap))


def best_attribution(tl: DataFrame, refs: DataFrame) -> DataFrame:
    """Each event with the tactic of its best finding: confidence x 100 + evidence, ties to the smallest id."""
    best = refs.groupBy("case_id", "audit_id").agg(
        F.min_by(F.struct("finding_id", "tactic"), F.struct(-(F.col("confidence") * 100 + F.col("n_evidence")), F.col("finding_id"))).alias("b_"),
    )
    return tl.dropDuplicates(["case_id", "audit_id"]).join(best, ["case_id", "audit_id"], "left").withColumn("finding_id", F.col("b_.finding_id")).withColumn("tactic", F.col("b_.tactic")).drop("b_")


def rank_reviews(f: DataFrame) -> DataFrame:
    """Findings by severity, pending ones first, then id."""
    pending = ~F.coalesce("approved", F.lit(False)) & ~F.coalesce("rejected", F.lit(False))
    return f.orderBy(severity_rank(F.col("severity")).desc(), pending.desc(), "finding_id")


def evidence_preview(f: DataFrame, n: int = 3) -> DataFrame:
    return f.withColumn("preview", F.slice("evidence", 1, n))


def findings_by_tactic(f: DataFrame) -> DataFrame:
    """Findings by kill chain (unknown tactics last, by name), then confidence, falling."""
    rows = f.withColumn("tactic", F.explode("tactics"))
    return rows.withColumn("rank_", phase_rank(F.col("tactic"))).orderBy("rank_", "tactic", F.desc("confidence"), "finding_id").drop("rank_")


def evidence_appendix(f: DataFrame) -> DataFrame:
    return f.select(
        "case_id",
        "finding_id",
        "title",
        F.explode("evidence").alias("e"),
    ).select("case_id", "finding_id", "title", "e.*").orderBy("finding_id", "audit_id")


def skill_queries(skills: DataFrame, skill: str, schema: str, model: str) -> DataFrame:
    return skills.where(
        (F.col("skill") == skill) & (F.col("schema_version") == schema) & (F.col("model_id") == model) & (F.col("state") != "invalid"),
    ).orderBy((F.col("state") == "canonical").desc(), F.desc("hit_count"), "sql_sha256")
