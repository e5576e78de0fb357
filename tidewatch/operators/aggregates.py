"""Aggregations over events, findings, evidence and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SEVERITY_ORDER, clean_ioc, evidence_host, first_line, image_of, ioc_class, ioc_class_of_key, ioc_confidence, is_noise, json_field, norm_severity, pretty_tactic, severity_confidence, severity_rank
from ..model import kept, micros, once


def event_counts_by_case(parse_results: DataFrame) -> DataFrame:
    return parse_results.groupBy("case_id").agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("events"))


def evidence_count_by_case(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("case_id").agg(F.count("*").alias("n_evidence"))


def case_status(cases: DataFrame, evidence: DataFrame, parse_results: DataFrame) -> DataFrame:
    """Cases with their evidence count, event total and parse rows (one list a case; parse rows are few)."""
    rows = parse_results.groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.struct("evidence_id", "artifact_id", "exit_code", "row_count"))).alias("parsed"),
    )
    out = cases.join(evidence_count_by_case(evidence), "case_id", "left").join(event_counts_by_case(parse_results), "case_id", "left").join(rows, "case_id", "left")
    return out.fillna({"n_evidence": 0, "events": 0})


def artifact_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("case_id", "artifact_id").agg(F.count("*").alias("n")).orderBy("case_id", F.desc("n"), "artifact_id")


def parse_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("case_id").agg(F.countDistinct("evidence_id").alias("n_evidence"), F.max("ts_utc").alias("last_ts"), F.count("*").alias("n"))


def evidence_artifact_breakdown(df: DataFrame) -> DataFrame:
    per = df.groupBy("case_id", "evidence_id", "artifact_id").agg(F.count("*").alias("n"), F.max("ts_utc").alias("last_ts"))
    return per.groupBy("case_id", "evidence_id").agg(
        F.sum("n").alias("n"),
        F.max("last_ts").alias("last_ts"),
        F.array_sort(F.collect_list(F.struct("artifact_id", "n", "last_ts"))).alias("artifacts"),
    )


def channel_list(df: DataFrame) -> DataFrame:
    channel = F.trim(json_field(F.col("payload_json"), "Channel"))
    return df.where("artifact_id = 'evtx'").select("case_id", channel.alias("channel")).where("channel != ''").distinct()


def distinct_hosts(df: DataFrame, column: str = "computer") -> DataFrame:
    return df.select("case_id", F.trim(column).alias(column)).where(F.col(column) != "").distinct()


def affected_hosts(timeline: DataFrame) -> DataFrame:
    return distinct_hosts(timeline)


def rare_images(df: DataFrame, below: int = 3) -> DataFrame:
    """Events whose image, in lower case, occurs fewer than `below` times in its case.

    The image is taken from the payload once; what has one is written, to be counted and joined.
    """
    rows = kept(once(df, image=F.lower(image_of(F.col("payload_json")))).where("image != ''"))
    rare = rows.groupBy("case_id", "image").agg(F.count("*").alias("n_image")).where(F.col("n_image") < below)
    return rows.join(rare, ["case_id", "image"])


def severity_counts(f: DataFrame) -> DataFrame:
    """Counts of normalised severities: the known ones in their order, others after them by name."""
    counts = f.groupBy(norm_severity(F.col("severity")).alias("severity")).agg(F.count("*").alias("n"))
    place = F.lit(len(SEVERITY_ORDER))
    for i, s in enumerate(SEVERITY_ORDER):
        place = F.when(F.col("severity") == s, F.lit(i)).otherwise(place)
    return counts.withColumn("place", place).orderBy("place", "severity")


def finding_detail(f: DataFrame) -> DataFrame:
    """First time, artifacts, number of evidence, earliest audit id and first host of each finding."""
    rows = f.select("case_id", "finding_id", F.explode_outer("evidence").alias("e"))
    when = F.struct(F.coalesce(F.col("e.ts_utc"), F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")), F.col("e.audit_id"))
    return rows.groupBy("case_id", "finding_id").agg(
        F.min("e.ts_utc").alias("first_ts"),
        F.array_sort(F.collect_set("e.artifact_id")).alias("artifacts"),
        F.count("e").alias("n_evidence"),
        F.min_by("e.audit_id", when).alias("first_audit_id"),
        F.min_by(evidence_host(F.col("e.extra")), F.when(evidence_host(F.col("e.extra")) != "", when)).alias("computer"),
    )


def key_events(f: DataFrame) -> DataFrame:
    d = finding_detail(f).where("first_ts IS NOT NULL")
    return d.join(f.select("case_id", "finding_id", "title", "severity"), ["case_id", "finding_id"]).orderBy("first_ts", "finding_id")


def unique_event_technique_counts(f: DataFrame) -> DataFrame:
    ids = f.select("case_id", F.explode("evidence").alias("e")).groupBy("case_id").agg(F.countDistinct("e.audit_id").alias("n_events"))
    tech = f.select("case_id", F.explode("techniques").alias("t")).groupBy("case_id").agg(F.countDistinct("t").alias("n_techniques"))
    return ids.join(tech, "case_id", "full").fillna(0, ["n_events", "n_techniques"])


def mitre_matrix(f: DataFrame) -> DataFrame:
    """(tactic, technique) cells: findings, evidence, worst severity and its confidence; a finding without tactic counts under ''."""
    rows = f.select(
        "case_id",
        "finding_id",
        "severity",
        F.size("evidence").alias("n_e"),
        F.explode_outer("tactics").alias("tactic"),
        "techniques",
    ).select("*", F.explode("techniques").alias("technique"))
    cells = rows.groupBy("case_id", pretty_tactic(F.coalesce("tactic", F.lit(""))).alias("tactic"), "technique").agg(
        F.count("*").alias("findings"),
        F.sum("n_e").alias("evidence"),
        F.max_by(norm_severity(F.col("severity")), severity_rank(F.col("severity"))).alias("worst"),
    )
    return cells.withColumn("confidence", severity_confidence(F.col("worst")))


def iocs_of(f: DataFrame) -> DataFrame:
    """(type, value) rows of the evidence's extras: count, confidence (noise sticks), class, tactics and findings."""
    rows = f.select(
        "case_id",
        "finding_id",
        "title",
        "source",
        "tactics",
        F.explode("evidence").alias("e"),
    ).select("*", F.explode("e.extra").alias("k", "v"))
    rows = rows.withColumn("type", ioc_class_of_key(F.col("k"))).withColumn("v", F.trim("v")).where(
        "type IS NOT NULL AND v NOT IN ('', '-', '<nil>') AND length(v) <= 300",
    )
    rows = rows.withColumn("value", clean_ioc(F.col("type"), F.col("v")))
    rank = F.when(is_noise(F.col("value")), 4).when(ioc_confidence(F.col("source")) == "confirmed", 3).otherwise(2)
    out = rows.groupBy("case_id", "type", "value").agg(
        F.count("*").alias("n"),
        F.max(rank).alias("r_"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tactics")))).alias("tactics"),
        F.array_sort(F.collect_set("title")).alias("findings"),
    )
    out = out.withColumn("confidence", F.when(F.col("r_") == 4, "noise").when(F.col("r_") == 3, "confirmed").otherwise("inferred")).drop("r_")
    return out.withColumn("class", ioc_class(F.col("type"), F.col("value"), F.col("confidence")))


def ioc_table(f: DataFrame, cap: int = 200) -> DataFrame:
    """The first `cap` rows of iocs_of for each case by type, count (falling) and value."""
    order = Window.partitionBy("case_id").orderBy("type", F.desc("n"), "value")
    return iocs_of(f).withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap)


def web_iocs(f: DataFrame, labels: int = 8) -> DataFrame:
    return ioc_table(f).where("class = 'ioc'").withColumn("findings", F.slice("findings", 1, labels)).withColumn("tactics", F.slice("tactics", 1, labels))


def mitre_mapping(clusters: DataFrame) -> DataFrame:
    """For each technique: clusters, their ids and the tactic learned from findings, else the phase. clusters: cluster_id, attack_phase, techniques, benign, findings."""
    live = clusters.where(~F.coalesce("benign", F.lit(False)))
    own = live.select("case_id", "cluster_id", "attack_phase", F.explode("techniques").alias("technique"))
    learned = live.select("case_id", F.explode("findings").alias("f")).select(
        "case_id",
        F.explode("f.techniques").alias("technique"),
        F.get("f.tactics", F.lit(0)).alias("t_"),
    ).where("t_ != ''").groupBy("case_id", "technique").agg(F.min("t_").alias("t_"))
    out = own.groupBy("case_id", "technique").agg(
        F.countDistinct("cluster_id").alias("n_clusters"),
        F.array_sort(F.collect_set("cluster_id")).alias("cluster_ids"),
        F.min_by("attack_phase", "cluster_id").alias("p_"),
    ).join(learned, ["case_id", "technique"], "left")
    return out.withColumn("tactic", F.coalesce("t_", "p_")).drop("t_", "p_").orderBy("case_id", F.desc("n_clusters"), "technique")


def mitre_unconfirmed(clusters: DataFrame) -> DataFrame:
    """Techniques a cluster proposes that no finding of it backs. clusters: cluster_id, proposed, techniques."""
    rows = clusters.select("case_id", "cluster_id", F.explode(F.array_except("proposed", "techniques")).alias("technique"))
    return rows.groupBy("case_id", "technique").agg(F.count("*").alias("n_clusters"), F.array_sort(F.collect_set("cluster_id")).alias("cluster_ids"))


def legacy_mitre_mapping(f: DataFrame) -> DataFrame:
    rows = f.select(
        F.explode("tactics").alias("tactic"),
        "techniques",
        F.size("evidence").alias("n_e"),
        "confidence",
    ).select("tactic", F.explode("techniques").alias("technique"), "n_e", "confidence")
    return rows.groupBy("tactic", "technique").agg(
        F.count("*").alias("findings"),
        F.sum("n_e").alias("evidence"),
        F.max("confidence").alias("confidence"),
    )


def finding_stats(f: DataFrame) -> DataFrame:
    """Counts by tactic and by confidence, unique evidence: rows (kind, key, n)."""
    by_tactic = f.select(F.explode("tactics").alias("key")).groupBy("key").agg(F.count("*").alias("n")).select(F.lit("tactic").alias("kind"), "key", "n")
    by_conf = f.groupBy(
        F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.5, "medium").otherwise("low").alias("key"),
    ).agg(F.count("*").alias("n")).select(F.lit("confidence").alias("kind"), "key", "n")
    unique = f.select(F.explode("evidence").alias("e")).agg(F.countDistinct("e.audit_id").alias("n")).select(
        F.lit("unique_evidence").alias("kind"),
        F.lit("").alias("key"),
        "n",
    )
    return by_tactic.union(by_conf).union(unique)


# Tactics whose spread over evidences is a warning.
HIGH_IMPACT = ("TA0006", "TA0008", "TA0010", "TA0040", "credential-access", "lateral-movement", "exfiltration", "impact")


def cross_evidence(f: DataFrame, events: DataFrame) -> DataFrame:
    """Techniques seen on at least two evidences of a case, warnings first."""
    cited = f.select(
        "case_id",
        "finding_id",
        F.get("tactics", F.lit(0)).alias("tactic"),
        F.explode("techniques").alias("technique"),
        "evidence",
    ).select("case_id", "finding_id", "tactic", "technique", F.explode("evidence").alias("e")).select("case_id", "finding_id", "tactic", "technique", F.col("e.audit_id").alias("audit_id"))
    met = cited.join(events.select("case_id", "audit_id", "evidence_id"), ["case_id", "audit_id"])
    sets = met.groupBy("case_id", "technique").agg(
        F.min("tactic").alias("tactic"),
        F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"),
        F.array_sort(F.collect_set("finding_id")).alias("finding_ids"),
        F.countDistinct("audit_id").alias("n_audit_ids"),
    ).where(F.size("evidence_ids") >= 2)
    return sets.withColumn(
        "severity",
        F.when(F.col("tactic").isin(*HIGH_IMPACT), "warning").otherwise("info"),
    ).orderBy("case_id", F.desc("severity"), "technique")


def findings_summary(f: DataFrame) -> DataFrame:
    """For each tier: findings, by review state, and maps by severity and source."""
    rejected, approved = F.coalesce("rejected", F.lit(False)), F.coalesce("approved", F.lit(False))
    base = f.groupBy("tier").agg(
        F.count("*").alias("n"),
        F.count_if(rejected).alias("rejected"),
        F.count_if(approved & ~rejected).alias("approved"),
        F.count_if(~approved & ~rejected).alias("pending"),
    )
    as_map = lambda c, name: f.groupBy("tier", c.alias("k")).agg(F.count("*").alias("v")).groupBy("tier").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(name))
    return base.join(
        as_map(norm_severity(F.col("severity")), "by_severity"),
        "tier",
    ).join(as_map(F.coalesce("source", F.lit("")), "by_source"), "tier")


def finding_totals(f: DataFrame) -> DataFrame:
    kinds = (("tier", F.col("tier")), ("source", F.col("source")), ("severity", F.col("severity")))
    out = None
    for kind, col in kinds:
        part = f.groupBy(col.alias("key")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "key", "n")
        out = part if out is None else out.union(part)
    return out


def gate_summary(artifacts: DataFrame, reviews: DataFrame) -> DataFrame:
    """For each case: artifacts in each review state (pending by default), whether none blocks, and those that do."""
    rows = artifacts.select("case_id", "artifact_id").distinct().join(
        reviews.select("case_id", "artifact_id", "state"),
        ["case_id", "artifact_id"],
        "left",
    ).withColumn("state", F.coalesce("state", F.lit("pending")))
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    return rows.groupBy("case_id").agg(
        n("approved"),
        n("rejected"),
        n("pending"),
        F.every(F.col("state") == "approved").alias("satisfied"),
        F.array_sort(F.collect_set(F.when(F.col("state") != "approved", F.col("artifact_id")))).alias("blocking"),
    )


def failed_artifacts(parse_results: DataFrame) -> DataFrame:
    return parse_results.where("exit_code IS NULL OR exit_code != 0").select(
        "case_id",
        "evidence_id",
        "artifact_id",
        "exit_code",
        first_line(F.coalesce("stderr_tail", F.lit(""))).alias("reason"),
    )


def merge_parse_results(rows: DataFrame) -> DataFrame:
    """One row for the attempts of a key: exit code 0 if any succeeded, else the one of largest magnitude; sums, span and commands."""
    keys = ["case_id", "evidence_id", "artifact_id"]
    code = F.when(F.bool_or(F.col("exit_code") == 0), 0).otherwise(F.max_by("exit_code", F.struct(F.abs("exit_code"), "exit_code")))
    return rows.groupBy(*keys).agg(
        code.alias("exit_code"),
        F.sum("row_count").alias("row_count"),
        F.sum("duration_s").alias("duration_s"),
        F.min("started_at").alias("started_at"),
        F.max("finished_at").alias("finished_at"),
        F.array_join(F.array_sort(F.collect_list("command")), " && ").alias("command"),
    )


def rule_coverage(rules: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    return rules.groupBy("source").agg(n("built"), n("pending"), n("failed"), F.count("*").alias("total"))


def skill_counts(skills: DataFrame) -> DataFrame:
    return skills.groupBy("state").agg(F.count("*").alias("n"))


def calibrate(samples: DataFrame, least: int = 3) -> DataFrame:
    """For each tactic with enough samples (events x, seconds y): least squares of y on x; a flat y has R2 0, a flat x slope 0 and the mean."""
    x, y = F.col("events").cast("double"), F.col("duration_s").cast("double")
    out = samples.groupBy("tactic").agg(
        F.count("*").alias("n"),
        F.min(x).alias("min_events"),
        F.max(x).alias("max_events"),
        F.regr_slope(y, x).alias("s_"),
        F.regr_intercept(y, x).alias("i_"),
        F.avg(y).alias("m_"),
        F.stddev_pop(y).alias("d_"),
        F.regr_r2(y, x).alias("r_"),
    ).where(F.col("n") >= least)
    flat = F.col("min_events") == F.col("max_events")
    return out.select(
        "tactic",
        "n",
        "min_events",
        "max_events",
        F.when(flat, 0.0).otherwise(F.col("s_")).alias("slope"),
        F.when(flat, F.col("m_")).otherwise(F.col("i_")).alias("intercept"),
        F.when(flat | (F.col("d_") == 0), 0.0).otherwise(F.col("r_")).alias("r2"),
    )


def usage_cost(rows: DataFrame, pricing: DataFrame, fallback: float) -> DataFrame:
    """Tokens and cost by tier with a total row (tier null); models without a price take the fallback."""
    priced = rows.join(F.broadcast(pricing), "model", "left").withColumn("cost", F.col("tokens") * F.coalesce("price", F.lit(fallback)) / 1_000_000)
    return priced.rollup("tier").agg(F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.count("*").alias("calls"))


def merge_reports(reports: DataFrame) -> DataFrame:
    """For each id the last row (by pos), summed counters and the worst status."""
    worst = F.max_by("status", F.when(F.col("status") == "failed", 3).when(F.col("status") == "partial", 2).otherwise(1))
    return reports.groupBy("id").agg(F.max_by("text", "pos").alias("text"), F.sum("n").alias("n"), worst.alias("status"))


def merged_questions(rows: DataFrame) -> DataFrame:
    """Questions once each, whatever their case, in the order of their first appearance."""
    return rows.withColumn("k_", F.lower(F.trim("question"))).where("k_ != ''").groupBy("k_").agg(
        F.min_by(F.trim("question"), "pos").alias("question"),
        F.min("pos").alias("pos"),
    ).drop("k_").orderBy("pos")


def timeline_stats(tl: DataFrame) -> DataFrame:
    """Hosts, tactics and hours from the first TA0001 (else TA0002) to the latest of TA0040, TA0009 and TA0008."""
    first = lambda t: F.min(F.when(F.col("tactic") == t, micros(F.col("ts_utc"))))
    rows = tl.groupBy("case_id").agg(
        F.countDistinct(F.nullif("computer", F.lit(""))).alias("n_hosts"),
        F.countDistinct(F.nullif("tactic", F.lit(""))).alias("n_tactics"),
        F.coalesce(first("TA0001"), first("TA0002")).alias("a_"),
        F.max(F.when(F.col("tactic").isin("TA0040", "TA0009", "TA0008"), micros(F.col("ts_utc")))).alias("b_"),
    )
    return rows.withColumn("dwell_hours", F.when(F.col("b_") > F.col("a_"), (F.col("b_") - F.col("a_")) / 3.6e9).otherwise(0.0)).drop("a_", "b_")


def verdict(clusters: DataFrame, findings: DataFrame) -> DataFrame:
    """For each case: findings, confirmed ones, worst severity, first and last time, seconds between, state. findings: case_id, severity, confidence."""
    f = findings.groupBy("case_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("confidence") == "confirmed").alias("confirmed"),
        F.max_by(norm_severity(F.col("severity")), severity_rank(F.col("severity"))).alias("worst"),
    )
    c = clusters.groupBy("case_id").agg(F.min("start_ts").alias("earliest"), F.max("end_ts").alias("latest"))
    return f.join(c, "case_id", "left").withColumn(
        "dwell_s",
        F.when(F.col("latest") > F.col("earliest"), F.floor((micros(F.col("latest")) - micros(F.col("earliest"))) / 1_000_000)),
    ).withColumn("state", F.when(F.col("confirmed") > 0, "alert").otherwise("warn"))
