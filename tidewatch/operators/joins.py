"""Joins between findings, events and catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import merge_title
from ..model import micros
from .ranges import in_windows, islands


def hydrate_evidence(findings: DataFrame, events: DataFrame) -> DataFrame:
    """Fills a missing time, artifact or event type of evidence from the event it cites; values that are there stay."""
    rows = findings.select("case_id", "finding_id", F.posexplode("evidence").alias("i", "e"))
    known = events.select(
        "case_id",
        F.col("audit_id").alias("a_"),
        F.struct("ts_utc", "artifact_id", "event_type").alias("v_"),
    ).groupBy("case_id", "a_").agg(F.min("v_").alias("v_"))
    full = rows.join(known, (rows["case_id"] == known["case_id"]) & (rows["e"]["audit_id"] == known["a_"]), "left").select(
        rows["case_id"],
        "finding_id",
        "i",
        F.struct(
            F.col("e.audit_id").alias("audit_id"),
            F.coalesce("e.ts_utc", "v_.ts_utc").alias("ts_utc"),
            F.coalesce(F.nullif("e.artifact_id", F.lit("")), F.col("v_.artifact_id")).alias("artifact_id"),
            F.coalesce(F.nullif("e.event_type", F.lit("")), F.col("v_.event_type")).alias("event_type"),
            F.col("e.extra").alias("extra"),
        ).alias("e"),
    )
    new = full.groupBy("case_id", "finding_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "e")), lambda a, b: a["i"] - b["i"]), lambda x: x["e"]).alias("new_"),
    )
    return findings.join(new, ["case_id", "finding_id"], "left").withColumn("evidence", F.coalesce("new_", "evidence")).drop("new_")


def lookup_events(ids: DataFrame, events: DataFrame) -> DataFrame:
    return events.join(ids.select("case_id", "audit_id").distinct(), ["case_id", "audit_id"])


def unresolved_ids(ids: DataFrame, events: DataFrame) -> DataFrame:
    return ids.select("case_id", "audit_id").distinct().join(events, ["case_id", "audit_id"], "left_anti")


def validate_citations(findings: DataFrame, shown: DataFrame) -> DataFrame:
    """finding_id and error of findings without evidence, with a blank id, or with an id that was not shown."""
    none = findings.where(F.coalesce(F.size("evidence"), F.lit(0)) <= 0).select(
        "finding_id",
        F.lit(None).cast("string").alias("audit_id"),
        F.lit("no evidence").alias("error"),
    )
    cited = findings.select("finding_id", F.explode("evidence").alias("e")).select("finding_id", F.col("e.audit_id").alias("audit_id"))
    blank = F.trim(F.coalesce("audit_id", F.lit(""))) == ""
    empty = cited.where(blank).select("finding_id", "audit_id", F.lit("blank audit id").alias("error"))
    odd = cited.where(~blank).join(shown.select("audit_id").distinct(), "audit_id", "left_anti").select(
        "finding_id",
        "audit_id",
        F.lit("audit id was not shown").alias("error"),
    )
    return none.union(empty).union(odd)


def filter_phantom(observations: DataFrame, real: DataFrame) -> DataFrame:
    """Observations (obs_id, audit_ids) that cite a real id, without the ids that are not, and how many those were."""
    rows = observations.select("obs_id", F.size("audit_ids").alias("all_"), F.explode("audit_ids").alias("audit_id"))
    kept = rows.join(real.select("audit_id").distinct(), "audit_id", "left_semi")
    return kept.groupBy("obs_id").agg(F.array_sort(F.collect_set("audit_id")).alias("audit_ids"), (F.first("all_") - F.count("*")).alias("dropped"))


def exclude_prior(candidates: DataFrame, prior: DataFrame) -> DataFrame:
    return candidates.join(prior.select("case_id", "audit_id").distinct(), ["case_id", "audit_id"], "left_anti")


def near_findings(events: DataFrame, times: DataFrame, window_s: int = 1800) -> DataFrame:
    """Events within window_s seconds (inclusive) of any time of their case.

    Times whose surroundings touch are merged into disjoint stretches first, so dense times are one row; an event meets at most one.
    """
    w = window_s * 1_000_000
    stamp = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    points = times.select("case_id", F.col("ts").alias("t_")).where("t_ IS NOT NULL").distinct()
    runs = islands(points, ["case_id"], "t_", 2 * window_s, "t_", "run_").groupBy("case_id", "run_")
    stretches = runs.agg(stamp(micros(F.min("t_")) - w).alias("lo_"), stamp(micros(F.max("t_")) + w).alias("hi_")).drop("run_")
    return in_windows(events, stretches, ["case_id"], "ts_utc", "lo_", "hi_").drop("lo_", "hi_")


def window_events(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Events of each window (case_id, cluster_id, win_start, win_end), both ends inclusive; see ranges.in_windows."""
    return in_windows(events, windows.select("case_id", "cluster_id", "win_start", "win_end"), ["case_id"], "ts_utc", "win_start", "win_end")


def mark_detected(rows: DataFrame, findings: DataFrame) -> DataFrame:
    cited = findings.select("case_id", F.explode("evidence").alias("e")).select(
        "case_id",
        F.col("e.audit_id").alias("audit_id"),
        F.lit(True).alias("d_"),
    ).distinct()
    return rows.join(cited, ["case_id", "audit_id"], "left").withColumn("detected", F.coalesce("d_", F.lit(False))).drop("d_")


def burst_success(bursts: DataFrame, successes: DataFrame, gap_s: int) -> DataFrame:
    """The first success of the account from the end of each burst to gap_s seconds after it, inclusive."""
    w = gap_s * 1_000_000
    spread = bursts.select("case_id", "account", "burst_id", micros(F.col("run_end")).alias("e_")).withColumn(
        "b_",
        F.explode(F.array(F.floor(F.col("e_") / w), F.floor(F.col("e_") / w) + 1)),
    )
    probe = successes.select(
        "case_id",
        "account",
        "audit_id",
        F.col("ts_utc").alias("success_ts"),
        micros(F.col("ts_utc")).alias("t_"),
    ).withColumn("b_", F.floor(F.col("t_") / w))
    met = spread.join(probe, ["case_id", "account", "b_"]).where((F.col("t_") >= F.col("e_")) & (F.col("t_") - F.col("e_") <= w))
    first = met.groupBy("case_id", "account", "burst_id").agg(F.min(F.struct("success_ts", "audit_id")).alias("s_"))
    return bursts.join(first, ["case_id", "account", "burst_id"], "left").select(
        *bursts.columns,
        F.col("s_.success_ts").alias("success_ts"),
        F.col("s_.audit_id").alias("success_id"),
    )


def fold_twin_findings(f: DataFrame) -> DataFrame:
    """Without the passthrough findings whose trimmed lower title a signature finding of the case has too."""
    twins = f.where("source = 'sigma'").select("case_id", merge_title(F.col("title")).alias("t_")).where("t_ != ''").distinct()
    keyed = f.withColumn("t_", F.when(F.col("source") == "hayabusa", merge_title(F.col("title"))))
    return keyed.join(twins, ["case_id", "t_"], "left_anti").drop("t_")


def fold_twin_refs(refs: DataFrame) -> DataFrame:
    """As fold_twin_findings within each cluster (case_id, cluster_id, source, title, ...); adds how many each cluster lost."""
    key = merge_title(F.col("title"))
    twins = refs.where("source = 'sigma'").select("case_id", "cluster_id", key.alias("t_")).where("t_ != ''").distinct().withColumn("twin_", F.lit(True))
    marked = refs.withColumn("t_", key).join(twins, ["case_id", "cluster_id", "t_"], "left").withColumn(
        "out_",
        (F.col("source") == "hayabusa") & F.col("twin_").isNotNull(),
    )
    lost = marked.groupBy("case_id", "cluster_id").agg(F.count_if("out_").alias("dropped"))
    return marked.where(~F.col("out_")).join(lost, ["case_id", "cluster_id"]).select(*refs.columns, "dropped")


def append_new_findings(old: DataFrame, new: DataFrame, tag: str) -> DataFrame:
    """All old findings and the new ones with unseen ids, whose titles carry the tag."""
    fresh = new.join(old.select("finding_id"), "finding_id", "left_anti").withColumn("title", F.concat("title", F.lit(f" [{tag}]")))
    return old.unionByName(fresh, allowMissingColumns=True)


def resolved_rules(before: DataFrame, after: DataFrame) -> DataFrame:
    """rule_id and state (resolved, still_firing) of the rules that fired before."""
    b, a = before.select("rule_id").distinct(), after.select("rule_id").distinct().withColumn("on_", F.lit(True))
    return b.join(a, "rule_id", "left").select("rule_id", F.when(F.col("on_"), "still_firing").otherwise("resolved").alias("state"))


def apply_review(f: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings with approve, reject or reset applied; ids of decisions that name no finding)."""
    d = decisions.select("finding_id", F.lower("decision").alias("d_")).dropDuplicates(["finding_id"])
    out = f.join(d, "finding_id", "left")
    out = out.withColumn(
        "approved",
        F.when(F.col("d_") == "approve", True).when(F.col("d_").isin("reject", "reset"), False).otherwise(F.col("approved")),
    )
    out = out.withColumn(
        "rejected",
        F.when(F.col("d_") == "reject", True).when(F.col("d_").isin("approve", "reset"), False).otherwise(F.col("rejected")),
    ).select(*f.columns)
    return out, d.select("finding_id").join(f, "finding_id", "left_anti")


def assign_cluster(timeline: DataFrame, refs: DataFrame) -> DataFrame:
    """cluster_id of each timeline row: by (source, rule_id), the last reference winning; else by title, the first; else 0."""
    rule = refs.groupBy("case_id", "source", "rule_id").agg(F.max_by("cluster_id", "pos").alias("by_rule"))
    title = refs.groupBy("case_id", "title").agg(F.min_by("cluster_id", "pos").alias("by_title"))
    return timeline.join(rule, ["case_id", "source", "rule_id"], "left").join(title, ["case_id", "title"], "left").withColumn("cluster_id", F.coalesce("by_rule", "by_title", F.lit(0))).drop("by_rule", "by_title")


def resolve_follow_ups(ids: DataFrame, excerpt: DataFrame) -> DataFrame:
    """For each cluster: its distinct flagged ids as dated excerpt rows, and how many could not be resolved."""
    dated = excerpt.where("ts_utc IS NOT NULL").select("case_id", "audit_id", "ts_utc").dropDuplicates(["case_id", "audit_id"])
    met = ids.select("case_id", "cluster_id", "audit_id").distinct().join(dated, ["case_id", "audit_id"], "left")
    ref = F.when(F.col("ts_utc").isNotNull(), F.struct("ts_utc", "audit_id"))
    return met.groupBy("case_id", "cluster_id").agg(
        F.array_sort(F.collect_list(ref)).alias("events"),
        F.count_if(F.col("ts_utc").isNull()).alias("unresolved"),
    )


def input_presence(catalog: DataFrame, artifacts: DataFrame, channels: DataFrame) -> DataFrame:
    """catalog (input_id, artifact_id, tokens) with present: the artifact is at hand, or a channel holds one of the tokens, in any case."""
    tokens = catalog.select("input_id", F.explode_outer("tokens").alias("token")).where("token IS NOT NULL AND token != ''")
    names = channels.select(F.lower("channel").alias("c_")).distinct()
    met = names.join(F.broadcast(tokens), F.col("c_").contains(F.lower("token")))  # the catalog's tokens: a list that does not grow with the data
    by_channel = met.select("input_id").distinct().withColumn("ch_", F.lit(True))
    by_artifact = artifacts.select("artifact_id").distinct().withColumn("ar_", F.lit(True))
    return catalog.join(by_artifact, "artifact_id", "left").join(by_channel, "input_id", "left").withColumn("present", F.coalesce("ar_", "ch_", F.lit(False))).drop("ar_", "ch_")


def missing_inputs(results: DataFrame) -> DataFrame:
    """Absent inputs in catalog order with the totals of all and of critical ones."""
    gone = results.where(~F.col("present"))
    totals = gone.agg(F.count("*").alias("n_missing"), F.count_if("critical").alias("n_critical"))
    return gone.join(F.broadcast(totals), how="cross").orderBy("pos")  # one row on the right


# Artifacts that can show a technique.
ARTIFACTS_OF_TECHNIQUE = {
    "T1078": ("evtx", "registry"),
    "T1547.001": ("registry", "lnk"),
    "T1547.004": ("registry",),
    "T1546.008": ("registry",),
    "T1546.012": ("registry",),
    "T1543.003": ("registry", "evtx"),
    "T1053.005": ("scheduled_tasks", "evtx"),
    "T1059.001": ("evtx", "prefetch"),
    "T1059.003": ("evtx", "prefetch"),
    "T1110": ("evtx",),
    "T1003": ("evtx", "prefetch", "amcache"),
    "T1021": ("evtx",),
    "T1021.001": ("evtx",),
    "T1021.002": ("evtx",),
    "T1070.001": ("evtx",),
    "T1070.004": ("usn_journal", "mft"),
    "T1112": ("registry",),
    "T1083": ("prefetch", "shellbags", "jumplists"),
    "T1105": ("browser_history", "evtx", "mft"),
    "T1486": ("mft", "usn_journal", "evtx"),
}


def required_artifacts(techniques: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Artifacts that can show each technique (by its whole id), and whether one of them is at hand; null for others, which are not covered."""
    spark = techniques.sparkSession
    table = spark.createDataFrame([(k, list(v)) for k, v in ARTIFACTS_OF_TECHNIQUE.items()], "technique string, artifacts array<string>")
    met = techniques.select("technique").distinct().join(F.broadcast(table), "technique", "left")
    held = met.select("technique", F.explode("artifacts").alias("artifact_id")).join(
        artifacts.select("artifact_id").distinct(),
        "artifact_id",
        "left_semi",
    ).select("technique").distinct().withColumn("covered", F.lit(True))
    return met.join(held, "technique", "left").select("technique", "artifacts", F.coalesce("covered", F.lit(False)).alias("covered"))


def evidence_with_tz(summary: DataFrame, evidence: DataFrame, cases: DataFrame) -> DataFrame:
    """Adds the zone of each evidence (its own, else the case's, else UTC) and whether it is its own."""
    own, case = F.nullif(F.trim("e_tz"), F.lit("")), F.nullif(F.trim("c_tz"), F.lit(""))
    out = summary.join(
        evidence.select("case_id", "evidence_id", F.col("timezone").alias("e_tz")),
        ["case_id", "evidence_id"],
        "left",
    ).join(cases.select("case_id", F.col("timezone").alias("c_tz")), "case_id", "left")
    return out.withColumn("timezone", F.coalesce(own, case, F.lit("UTC"))).withColumn("overridden", own.isNotNull()).drop("e_tz", "c_tz")


def explain_actions(actions: DataFrame, findings: DataFrame, clusters: DataFrame) -> DataFrame:
    """Log rows with the finding of their (rule_source, rule_id) and the phase of their cluster."""
    f = findings.select(
        F.col("source").alias("rule_source"),
        "rule_id",
        F.col("title").alias("finding_title"),
    ).dropDuplicates(["rule_source", "rule_id"])
    c = clusters.select("cluster_id", F.col("attack_phase").alias("cluster_phase")).dropDuplicates(["cluster_id"])
    return actions.join(f, ["rule_source", "rule_id"], "left").join(c, "cluster_id", "left")




#: What explain_records adds; columns that the applying kind does not have are null.
EXPLANATION = ("branch", "title", "description", "source_path", "sql", "mitre", "events_scanned", "prior_findings", "anomalies", "question", "answer", "open_questions", "attack_phase", "narrative")
FOLLOW_UPS = ("active_search_generate", "active_search_interpret", "active_search_reframe")


def one_spaced(text: Column) -> Column:
    """Text with every run of white space as one space, and none at its ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def explain_records(actions: DataFrame, findings: DataFrame, skills: DataFrame, clusters: DataFrame, searches: DataFrame, overall: DataFrame) -> DataFrame:
    """Log records with what explains them: branch, and the columns of EXPLANATION that it fills; branch is null where nothing does.

    Each record takes the first that applies: a rule's finding by (rule_source, rule_id); a skill's report by the record's detail,
    unless it is empty; the first search of the record's cluster that ran the same SQL, its own or an attempt, white space aside; where
    no SQL fits, the cluster's open questions; for model calls the whole narrative, or the cluster's, by the detail.

    actions: actor, kind, detail, rule_source, rule_id, cluster_id, command. findings: source, rule_id, title, description,
    source_path, sql, tactics, techniques. skills: skill, events_scanned, prior_findings, anomalies (array). clusters: cluster_id, attack_phase,
    narrative, open_questions (array). searches: cluster_id, place, question, answer, sql, attempts (array). overall: narrative, one row.

    Every attempt is one key (cluster, SQL) that keeps the smallest place, so a record meets one row of each table at most; all are
    equi-joins, and a record only carries the key of its own kind, the others being null.
    """
    tier, kind = F.col("actor"), F.col("kind")
    is_rule = F.coalesce((tier == "tier1a") & (kind == "rule_sql") & (F.col("rule_id") != "") & (F.col("rule_source") != ""), F.lit(False))
    is_skill = F.coalesce((tier == "tier1b") & (kind == "llm_call") & (F.col("detail") != ""), F.lit(False))
    is_sql = F.coalesce((tier == "tier2") & (kind == "active_sql"), F.lit(False))
    is_call = F.coalesce((tier == "tier2") & (kind == "llm_call"), F.lit(False))
    cluster = F.coalesce("cluster_id", F.lit(0))
    keyed = actions.withColumns({
        "k_source": F.when(is_rule, F.col("rule_source")),
        "k_rule": F.when(is_rule, F.col("rule_id")),
        "k_skill": F.when(is_skill, F.col("detail")),
        "k_cluster": F.when(is_sql | is_call, cluster),
        "k_sql": F.when(is_sql, one_spaced(F.col("command"))),
        "k_all": is_call & F.coalesce(F.col("detail") == "overall_synthesis", F.lit(False)),
        "is_sql": is_sql,
    })
    mitre = F.concat(F.coalesce("tactics", F.array()), F.coalesce("techniques", F.array()))
    by_rule = findings.groupBy(F.col("source").alias("k_source"), F.col("rule_id").alias("k_rule")).agg(
        F.min(F.struct("title", "description", "source_path", "sql", F.when(F.size(mitre) > 0, mitre).alias("mitre"))).alias("f"),
    )
    some = (F.coalesce("events_scanned", F.lit(0)) != 0) | (F.coalesce("prior_findings", F.lit(0)) != 0) | (F.coalesce(F.size("anomalies"), F.lit(0)) > 0)
    by_skill = skills.where(some).groupBy(F.col("skill").alias("k_skill")).agg(F.min(F.struct("events_scanned", "prior_findings", "anomalies")).alias("s"))
    tried = searches.select("cluster_id", "place", "question", "answer", F.explode(F.concat(F.array("sql"), F.coalesce("attempts", F.array()))).alias("t"))
    by_sql = tried.groupBy(F.col("cluster_id").alias("k_cluster"), one_spaced(F.col("t")).alias("k_sql")).agg(F.min(F.struct("place", "question", "answer")).alias("q"))
    by_cluster = clusters.groupBy(F.col("cluster_id").alias("k_cluster")).agg(F.min(F.struct("attack_phase", "narrative", "open_questions")).alias("c"))
    whole = overall.where("narrative != ''").groupBy(F.lit(True).alias("k_all")).agg(F.min("narrative").alias("w"))
    held = keyed.join(by_rule, ["k_source", "k_rule"], "left").join(by_skill, "k_skill", "left").join(by_sql, ["k_cluster", "k_sql"], "left")
    held = held.join(by_cluster, "k_cluster", "left").join(F.broadcast(whole), "k_all", "left")  # one row
    asked = F.col("is_sql") & F.col("q").isNull() & (F.coalesce(F.size("c.open_questions"), F.lit(0)) > 0)
    of_cluster = ~F.col("is_sql") & F.col("c").isNotNull()
    branch = F.coalesce(
        F.when(F.col("f").isNotNull(), "rule"),
        F.when(F.col("s").isNotNull(), "skill"),
        F.when(F.col("q").isNotNull(), "search"),
        F.when(asked, "open_questions"),
        F.when(F.col("k_all") & F.col("w").isNotNull(), "overall"),
        F.when(of_cluster & (F.col("detail") == "cluster_analysis"), "cluster"),
        F.when(of_cluster & F.col("detail").isin(*FOLLOW_UPS), "follow_up"),
    )
    held = held.withColumn("branch", branch)
    within = lambda *names: F.col("branch").isin(*names)
    return held.select(
        *actions.columns,
        "branch",
        *[F.col(f"f.{c}").alias(c) for c in ("title", "description", "source_path", "sql", "mitre")],
        *[F.col(f"s.{c}").alias(c) for c in ("events_scanned", "prior_findings", "anomalies")],
        *[F.col(f"q.{c}").alias(c) for c in ("question", "answer")],
        F.when(within("open_questions", "cluster", "follow_up"), F.col("c.open_questions")).alias("open_questions"),
        F.when(within("cluster", "follow_up"), F.col("c.attack_phase")).alias("attack_phase"),
        F.when(within("overall"), F.col("w")).when(within("cluster"), F.col("c.narrative")).alias("narrative"),
    )
