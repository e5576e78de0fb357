"""Further registered queries: review states, catalogs, clusters, logs and maintenance over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import EVENTS_SQL, table, unified_events
from ..operators import aggregates as A
from ..operators import checks as C
from ..operators import filters as L
from ..operators import graph as G
from ..operators import joins as J
from ..operators import rules as R
from ..operators import sessions as W
from ..operators import sinks as K
from ..sources import logs as P
from ..sources import tables as T
from .queries import CL, FE, clusters, dated_findings, finding_rows, findings, query, signals, with_k


@query(f"WITH {EVENTS_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts_utc, audit_id) AS r, count(*) OVER (PARTITION BY case_id) AS total FROM ev WHERE k % 12 IN (5, 6) OR (artifact_id = 'prefetch' AND k % 12 > 7)) SELECT case_id, audit_id, total, total > 60 AS truncated FROM t WHERE r > 10 AND r <= 60")
def tactic_events(spark, sf_dir):
    return L.tactic_events(signals(spark, sf_dir), "execution", None, 50, 10).select("case_id", "audit_id", "total", "truncated")


@query(f"WITH {EVENTS_SQL} SELECT audit_id FROM ev WHERE case_id = 'C1' AND k % 12 = 7 ORDER BY ts_utc, audit_id LIMIT 50")
def events_by_ttp(spark, sf_dir):
    return L.events_by_ttp(signals(spark, sf_dir), "C1", "T1547").select("audit_id")


@query(f"WITH {EVENTS_SQL} SELECT audit_id FROM ev WHERE NOT (artifact_id = 'evtx' AND k % 2 = 0)")
def drop_evtx_noise(spark, sf_dir):
    e = with_k(unified_events(spark, sf_dir))
    noisy = e.withColumn("payload_json", F.when(F.col("k") % 2 == 0, F.lit('{"EventId":"4663"}')).otherwise(F.col("payload_json")))
    return L.drop_evtx_noise(noisy).select("audit_id")


@query(f"WITH {EVENTS_SQL} SELECT case_id, artifact_id AS kind, count(*) AS n, 'k' AS keys FROM ev WHERE artifact_id <> 'evtx' GROUP BY ALL UNION ALL SELECT case_id, 'evtx:', count(*), 'k' FROM ev WHERE artifact_id = 'evtx' GROUP BY ALL")
def sample_schema(spark, sf_dir):
    return L.sample_schema(unified_events(spark, sf_dir)).select("case_id", "kind", "n", F.array_join("keys", ",").alias("keys"))


@query(f"WITH {FE} SELECT DISTINCT case_id, audit_id FROM fe")
def prior_context_ids(spark, sf_dir):
    return R.prior_context(findings(spark, sf_dir))[0]


@query(f"WITH {FE} SELECT source, severity AS level, count(*) AS n FROM f GROUP BY ALL")
def prior_context_counts(spark, sf_dir):
    return R.prior_context(findings(spark, sf_dir))[2]


@query(f"WITH {EVENTS_SQL} SELECT case_id, audit_id FROM ev WHERE k <> 7")
def exclude_prior(spark, sf_dir):
    e = with_k(unified_events(spark, sf_dir))
    return J.exclude_prior(e, e.where("k = 7")).select("case_id", "audit_id")


@query(f"WITH {EVENTS_SQL} SELECT event_type || '-' || CAST(k AS VARCHAR) AS obs_id, count(*) FILTER (user_id % 2 = 0) AS kept, count(*) FILTER (user_id % 2 = 1) AS dropped FROM ev GROUP BY 1 HAVING count(*) FILTER (user_id % 2 = 0) > 0")
def filter_phantom(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        F.concat_ws("-", "event_type", F.get_json_object("props", "$.k")).alias("obs_id"),
        F.col("event_id").cast("string").alias("audit_id"),
        "user_id",
    )
    obs = e.groupBy("obs_id").agg(F.collect_list("audit_id").alias("audit_ids"))
    return J.filter_phantom(obs, e.where("user_id % 2 = 0")).select("obs_id", F.size("audit_ids").cast("long").alias("kept"), "dropped")


@query(f"WITH {FE} SELECT finding_id, audit_id, 'audit id was not shown' AS error FROM fe WHERE k >= 90")
def validate_citations(spark, sf_dir):
    return J.validate_citations(findings(spark, sf_dir), with_k(unified_events(spark, sf_dir)).where("k < 90"))


@query(f"WITH {CL} SELECT case_id, cluster_id, finding_id, source, title FROM cl a WHERE NOT (source = 'hayabusa' AND EXISTS (SELECT 1 FROM cl b WHERE b.case_id = a.case_id AND b.cluster_id = a.cluster_id AND b.source = 'sigma' AND b.title = a.title))")
def fold_twin_refs(spark, sf_dir):
    refs = W.cluster_findings(dated_findings(spark, sf_dir)).select("case_id", "cluster_id", "finding_id", "source", "title")
    return J.fold_twin_refs(refs).select("case_id", "cluster_id", "finding_id", "source", "title")


@query(f"WITH {FE} SELECT finding_id, CASE WHEN k = 3 THEN title || ' [rerun]' ELSE title END AS title FROM (SELECT DISTINCT finding_id, title, k FROM fe)")
def append_new_findings(spark, sf_dir):
    f = findings(spark, sf_dir)
    return J.append_new_findings(f.where("finding_id NOT LIKE '%-3'"), f, "rerun").select("finding_id", "title")


@query(f"WITH {FE} SELECT finding_id, severity IN ('critical', 'high') AS approved, severity = 'low' AS rejected FROM f")
def apply_review(spark, sf_dir):
    f = findings(spark, sf_dir)
    d = f.select(
        "finding_id",
        F.when(F.col("severity").isin("critical", "high"), "approve").when(F.col("severity") == "low", "reject").otherwise("reset").alias("decision"),
    )
    return J.apply_review(f, d)[0].select("finding_id", "approved", "rejected")


@query(f"WITH {CL}, r AS (SELECT case_id, source, CASE WHEN rule_id IN ('R3', 'R13') THEN 'gone' ELSE rule_id END AS rule_id, title, cluster_id FROM cl WHERE title <> ' Event 13'), a AS (SELECT case_id, source, rule_id, max(cluster_id) AS c FROM r GROUP BY ALL), t AS (SELECT case_id, title, min(cluster_id) AS c FROM r GROUP BY ALL) SELECT f.case_id, finding_id, coalesce(a.c, t.c, 0) AS cluster_id FROM f LEFT JOIN a USING (case_id, source, rule_id) LEFT JOIN t ON t.case_id = f.case_id AND t.title = f.title")
def assign_cluster(spark, sf_dir):
    """Two rules lost their reference, so that the title decides, and one title has none either."""
    c = W.cluster_findings(W.first_evidence(findings(spark, sf_dir)))
    refs = c.select("case_id", "source", "rule_id", "title", "cluster_id", F.col("cluster_id").alias("pos"))
    refs = refs.where("title != ' Event 13'").withColumn("rule_id", F.when(F.col("rule_id").isin("R3", "R13"), "gone").otherwise(F.col("rule_id")))
    return J.assign_cluster(c.drop("cluster_id"), refs).select("case_id", "finding_id", "cluster_id")


@query(f"WITH {EVENTS_SQL} SELECT DISTINCT artifact_id AS input_id, artifact_id IN ('mft', 'registry', 'evtx') AS present FROM ev")
def input_presence(spark, sf_dir):
    e = unified_events(spark, sf_dir)
    catalog = e.select(F.col("artifact_id").alias("input_id"), "artifact_id").distinct()
    tokens = F.when(F.col("artifact_id") == "evtx", F.array(F.lit(""), F.lit("nowhere"), F.lit("eRRo"))).when(F.col("artifact_id") == "prefetch", F.array(F.lit("nowhere")))
    catalog = catalog.withColumn("tokens", F.coalesce(tokens, F.array().cast("array<string>")))
    held = e.where("artifact_id IN ('mft', 'registry')")
    return J.input_presence(catalog, held, e.select(F.col("event_type").alias("channel"))).select("input_id", "present")


@query("SELECT n_nationkey AS case_id, c_custkey AS evidence_id, CASE WHEN c_custkey % 3 = 0 THEN 'Asia/Tokyo' WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'UTC' END AS timezone, c_custkey % 3 = 0 AS overridden FROM customer JOIN nation ON c_nationkey = n_nationkey")
def evidence_with_tz(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("case_id"), F.col("c_custkey").alias("evidence_id"))
    ev = c.withColumn("timezone", F.when(F.col("evidence_id") % 3 == 0, "Asia/Tokyo").otherwise(" "))
    n = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("case_id"),
        F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("timezone"),
    )
    return J.evidence_with_tz(c, ev, n).select("case_id", "evidence_id", "timezone", "overridden")


def full_clusters(spark, sf_dir) -> DataFrame:
    """Clusters with phase, techniques and findings, as the mapping operators take them."""
    return clusters_of(W.cluster_findings(dated_findings(spark, sf_dir)))


def clusters_of(clustered: DataFrame) -> DataFrame:
    """The clusters of clustered findings."""
    return clustered.groupBy("case_id", "cluster_id").agg(
        F.min("first_ts").alias("start_ts"),
        F.max("first_ts").alias("end_ts"),
        F.min(F.col("tactics")[0]).alias("attack_phase"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("techniques")))).alias("techniques"),
        F.array_sort(F.collect_list(F.struct("finding_id", "severity", "techniques", "tactics", "title", "source", "rule_id"))).alias("findings"),
        F.concat_ws(" ", F.array_sort(F.collect_set("title"))).alias("narrative"),
    )


@query(f"WITH {CL} SELECT case_id, technique, count(DISTINCT cluster_id) AS n_clusters, min(tactic) AS tactic FROM cl WHERE cluster_id % 4 <> 1 GROUP BY 1, 2")
def mitre_mapping(spark, sf_dir):
    return A.mitre_mapping(full_clusters(spark, sf_dir).withColumn("benign", F.col("cluster_id") % 4 == 1)).select("case_id", "technique", "n_clusters", "tactic")


@query(f"WITH {CL} SELECT case_id, 'T9999' AS technique, count(DISTINCT cluster_id) AS n_clusters FROM cl GROUP BY 1")
def mitre_unconfirmed(spark, sf_dir):
    c = full_clusters(spark, sf_dir)
    return A.mitre_unconfirmed(c.withColumn("proposed", F.concat("techniques", F.array(F.lit("T9999"))))).select("case_id", "technique", "n_clusters")


@query(f"WITH {CL} SELECT case_id, cluster_id, string_agg(DISTINCT technique, ',' ORDER BY technique) AS techniques FROM cl GROUP BY 1, 2")
def technique_union(spark, sf_dir):
    return C.technique_union(full_clusters(spark, sf_dir).drop("techniques")).select(
        "case_id",
        "cluster_id",
        F.array_join("techniques", ",").alias("techniques"),
    )


@query(f"WITH {FE} SELECT DISTINCT case_id, technique FROM fe INTERSECT SELECT DISTINCT case_id, 'T1' || CAST(110 + k % 45 AS VARCHAR) FROM fe")
def technique_conflicts(spark, sf_dir):
    rows = finding_rows(spark, sf_dir)
    return C.technique_conflicts(rows, rows.withColumn("technique", F.concat(F.lit("T1"), (F.lit(110) + F.col("k") % 45).cast("string"))))


@query(f"WITH {CL}, p AS (SELECT case_id, cluster_id, min(tactic) AS phase, min(first_ts) AS s FROM cl GROUP BY 1, 2) SELECT case_id, cluster_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY list_position(['initial-access','execution','persistence','privilege-escalation','defense-evasion','credential-access','discovery','lateral-movement','collection','command-and-control','exfiltration','impact'], phase), s, cluster_id) AS INTEGER) AS step FROM p")
def intrusion_path(spark, sf_dir):
    return W.intrusion_path(full_clusters(spark, sf_dir).withColumn("noise", F.lit(False))).select("case_id", "cluster_id", "step")


@query(f"WITH {CL} SELECT case_id, cluster_id, tactic, count(*) AS n_findings FROM cl WHERE severity IN ('critical', 'high') GROUP BY ALL")
def coverage_gaps(spark, sf_dir):
    return C.coverage_gaps(full_clusters(spark, sf_dir))


@query(f"WITH {FE} SELECT 'tactic' AS kind, tactic AS key, count(*) AS n FROM f GROUP BY ALL UNION ALL SELECT 'confidence', CASE WHEN severity IN ('critical', 'high') THEN 'high' ELSE 'low' END, count(*) FROM f GROUP BY ALL UNION ALL SELECT 'unique_evidence', '', count(DISTINCT audit_id) FROM fe")
def finding_stats(spark, sf_dir):
    return A.finding_stats(findings(spark, sf_dir).withColumn("confidence", F.when(F.col("severity").isin("critical", "high"), 0.9).otherwise(0.1)))


@query(f"WITH {FE} SELECT 'tier' AS kind, 'rule' AS key, count(*) AS n FROM f UNION ALL SELECT 'source', source, count(*) FROM f GROUP BY ALL UNION ALL SELECT 'severity', severity, count(*) FROM f GROUP BY ALL")
def finding_totals(spark, sf_dir):
    return A.finding_totals(findings(spark, sf_dir).withColumn("tier", F.lit("rule")))


@query(f"WITH {FE} SELECT tactic, technique, count(*) AS findings, CAST(sum(n_e) AS BIGINT) AS evidence FROM f GROUP BY 1, 2")
def legacy_mitre_mapping(spark, sf_dir):
    return A.legacy_mitre_mapping(findings(spark, sf_dir).withColumn("confidence", F.lit(0.5))).select("tactic", "technique", "findings", "evidence")


@query(f"WITH {FE} SELECT case_id, finding_id, audit_id, artifact_id FROM fe")
def evidence_appendix(spark, sf_dir):
    return W.evidence_appendix(findings(spark, sf_dir)).select("case_id", "finding_id", "audit_id", "artifact_id")


@query(f"WITH {FE} SELECT case_id, finding_id, array_to_string(list_slice(list(audit_id ORDER BY ts_utc, audit_id), 1, 3), ',') AS preview FROM fe GROUP BY 1, 2")
def evidence_preview(spark, sf_dir):
    f = findings(spark, sf_dir)
    in_time = F.array_sort("evidence", lambda a, b: F.when(a["ts_utc"] < b["ts_utc"], -1).when(a["ts_utc"] > b["ts_utc"], 1).when(a["audit_id"] < b["audit_id"], -1).otherwise(1))
    preview = F.transform("preview", lambda e: e["audit_id"])
    return W.evidence_preview(f.withColumn("evidence", in_time)).select("case_id", "finding_id", F.array_join(preview, ",").alias("preview"))


@query(f"WITH {EVENTS_SQL}, t AS (SELECT case_id, ts_utc, computer, ['TA0001','TA0002','TA0008','TA0009','TA0040'][k % 5 + 1] AS tactic FROM ev) SELECT case_id, count(DISTINCT computer) AS n_hosts, count(DISTINCT tactic) AS n_tactics, round(greatest(0, epoch_us(max(ts_utc) FILTER (tactic IN ('TA0040', 'TA0009', 'TA0008'))) - epoch_us(min(ts_utc) FILTER (tactic = 'TA0001'))) / 3600000000.0, 4) AS dwell_hours FROM t GROUP BY 1")
def timeline_stats(spark, sf_dir):
    tl = with_k(unified_events(spark, sf_dir)).withColumn(
        "tactic",
        F.element_at(F.array(*map(F.lit, ("TA0001", "TA0002", "TA0008", "TA0009", "TA0040"))), F.col("k") % 5 + 1),
    )
    return A.timeline_stats(tl).withColumn("dwell_hours", F.round("dwell_hours", 4))


@query("SELECT o_custkey AS case_id, count(*) FILTER (s = 'F') AS approved, count(*) FILTER (s = 'O') AS rejected, bool_and(s = 'F') AS satisfied FROM (SELECT o_custkey, o_orderkey, any_value(o_orderstatus) AS s FROM orders GROUP BY 1, 2) GROUP BY 1")
def gate_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("case_id"),
        F.col("o_orderkey").alias("artifact_id"),
        F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "rejected").otherwise("pending").alias("state"),
    )
    return A.gate_summary(o, o).select("case_id", "approved", "rejected", "satisfied")


@query("SELECT o_orderkey AS artifact_id, o_orderpriority AS reason FROM orders WHERE o_orderkey % 3 <> 0")
def failed_artifacts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("case_id"),
        F.lit("").alias("evidence_id"),
        F.col("o_orderkey").alias("artifact_id"),
        (F.col("o_orderkey") % 3).alias("exit_code"),
        F.concat(F.lit("\n \n"), "o_orderpriority", F.lit("\nmore")).alias("stderr_tail"),
    )
    return A.failed_artifacts(o).select("artifact_id", "reason")


@query("SELECT p_brand AS source, count(*) FILTER (p_size % 3 = 0) AS built, count(*) FILTER (p_size % 3 = 1) AS pending, count(*) FILTER (p_size % 3 = 2) AS failed, count(*) AS total FROM part GROUP BY 1")
def rule_coverage(spark, sf_dir):
    state = F.when(F.col("p_size") % 3 == 0, "built").when(F.col("p_size") % 3 == 1, "pending").otherwise("failed")
    return A.rule_coverage(table(spark, sf_dir, "part").select(F.col("p_brand").alias("source"), state.alias("state")))


@query("SELECT o_custkey AS case_id, CAST(sum(o_orderkey) AS BIGINT) AS events FROM orders GROUP BY 1")
def event_counts_by_case(spark, sf_dir):
    return A.event_counts_by_case(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("row_count")))


@query("SELECT c_custkey AS case_id, coalesce(n, 0) AS n_evidence, coalesce(e, 0) AS events FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS e FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def case_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("case_id"),
        F.col("o_orderkey").alias("evidence_id"),
        F.lit("a").alias("artifact_id"),
        F.lit(0).alias("exit_code"),
        F.col("o_orderkey").alias("row_count"),
    )
    cases = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"))
    return A.case_status(cases, o, o).select("case_id", "n_evidence", "events")


@query("SELECT o_custkey AS case_id, CASE WHEN n = 1 THEN m ELSE '' END AS evidence_id FROM (SELECT o_custkey, count(*) AS n, min(CAST(o_orderkey AS VARCHAR)) AS m FROM orders GROUP BY 1)")
def backfill_evidence_id(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").cast("string").alias("evidence_id"))
    return K.backfill_evidence_id(o.select("case_id").distinct().withColumn("evidence_id", F.lit("")), o)


@query("SELECT c_custkey AS case_id, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS name, 1 AS created_at FROM customer")
def upsert_case(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.lit("old").alias("name"), F.lit(1).alias("created_at"))
    return K.upsert_case(c, c.where("case_id % 2 = 0").withColumn("name", F.lit("new")).withColumn("created_at", F.lit(2)))


@query("SELECT c_custkey AS case_id, c_nationkey AS evidence_id FROM customer")
def insert_evidence_ignore(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_nationkey").alias("evidence_id"))
    return K.insert_evidence_ignore(c.where("case_id % 3 > 0"), c)


@query(f"WITH {EVENTS_SQL} SELECT case_id, audit_id FROM ev WHERE case_id = 'C2'")
def vacuum_cases(spark, sf_dir):
    e = unified_events(spark, sf_dir)
    return K.vacuum_cases({"e": e}, e.where("case_id != 'C0'"), e.where("case_id = 'C1'"))["e"].select("case_id", "audit_id")


@query(f"WITH {EVENTS_SQL} SELECT case_id, audit_id FROM ev WHERE case_id <> 'C1'")
def delete_case(spark, sf_dir):
    return K.delete_case({"e": unified_events(spark, sf_dir)}, "C1")["e"].select("case_id", "audit_id")


@query(f"WITH {CL}, e AS (SELECT finding_id, audit_id FROM fe) SELECT finding_id AS component, 1::BIGINT AS members FROM f")
def finding_components(spark, sf_dir):
    return G.finding_components(findings(spark, sf_dir).withColumn("confidence", F.lit(0.5))).select("component", "members")


def log_lines(spark, sf_dir, line) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("log"), (F.col("user_id") % 9).cast("string")).alias("file"),
        F.col("event_id").alias("line_no"),
        line.alias("line"),
    )


def stamp():
    return F.col("ts").cast("timestamp")


@query("SELECT event_id AS line_no, date_trunc('second', ts) - INTERVAL 9 HOUR AS ts_utc, 'error' AS severity, '10.0.0.' || CAST(user_id % 250 AS VARCHAR) AS client_ip, 'failed ' || event_type AS message FROM events")
def parse_apache_error(spark, sf_dir):
    line = F.concat(
        F.lit("["),
        F.date_format(stamp(), "EEE MMM dd HH:mm:ss yyyy"),
        F.lit("] [core:error] [pid 7] [client 10.0.0."),
        (F.col("user_id") % 250).cast("string"),
        F.lit(":80] failed "),
        F.col("event_type"),
    )
    return P.parse_apache_error(log_lines(spark, sf_dir, line), "Asia/Tokyo").select("line_no", "ts_utc", "severity", "client_ip", "message")


@query("SELECT event_id AS line_no, date_trunc('second', ts) AS ts_utc, 'warn' AS severity, '10.0.0.' || CAST(user_id % 250 AS VARCHAR) AS client_ip FROM events")
def parse_nginx_error(spark, sf_dir):
    line = F.concat(
        F.date_format(stamp(), "yyyy/MM/dd HH:mm:ss"),
        F.lit(" [warn] 12#0: *1 slow, client: 10.0.0."),
        (F.col("user_id") % 250).cast("string"),
        F.lit(", server: a"),
    )
    return P.parse_nginx_error(log_lines(spark, sf_dir, line)).select("line_no", "ts_utc", "severity", "client_ip")


@query("SELECT event_id AS line_no, date_trunc('second', ts) AS ts_utc, 'severe' AS severity, 'boom ' || event_type AS message FROM events")
def parse_tomcat_log(spark, sf_dir):
    line = F.concat(F.date_format(stamp(), "dd-MMM-yyyy HH:mm:ss"), F.lit(".000 SEVERE [main] boom "), F.col("event_type"))
    return P.parse_tomcat_log(log_lines(spark, sf_dir, line)).select("line_no", "ts_utc", "severity", "message")


@query("SELECT event_id AS line_no, date_trunc('second', ts) AS ts_utc, '/' || event_type AS stem, CASE WHEN event_id % 3 = 0 THEN '-' ELSE CAST(user_id AS VARCHAR) || ' x' END AS agent FROM events")
def parse_w3c_log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    file = F.concat(F.lit("log"), (F.col("user_id") % 9).cast("string"))
    body = F.concat(
        F.date_format(stamp(), "yyyy-MM-dd HH:mm:ss"),
        F.lit(" /"),
        F.col("event_type"),
        F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" x"))),
    )
    heads = e.select(file.alias("file")).distinct().select(
        "file",
        F.lit(-1).cast("long").alias("line_no"),
        F.lit("#Fields: date time cs-uri-stem cs(User-Agent)").alias("line"),
    )
    r = F.col("row")
    return P.parse_w3c_log(heads.union(e.select(file, "event_id", body))).select(
        "line_no",
        "ts_utc",
        r["cs-uri-stem"].alias("stem"),
        r["cs(User-Agent)"].alias("agent"),
    )


@query("SELECT event_id AS line_no, date_trunc('second', ts) - INTERVAL 9 HOUR AS ts_utc, '/' || event_type AS stem, '-' AS query FROM events")
def parse_iis_native(spark, sf_dir):
    line = F.concat(
        F.lit("1.1.1.1, u, "),
        F.date_format(stamp(), "MM/dd/yy, HH:mm:ss"),
        F.lit(", W3, H, 2.2.2.2, 1, 2, 3, 200, 0, GET, /"),
        F.col("event_type"),
        F.lit(","),
    )
    r = F.col("row")
    return P.parse_iis_native(log_lines(spark, sf_dir, line), "Asia/Tokyo").select(
        "line_no",
        "ts_utc",
        r["cs-uri-stem"].alias("stem"),
        r["cs-uri-query"].alias("query"),
    )


COLLECTION_LINES = (
    "[OK] [RAW] C:\\a% -> out/a% (% bytes, SHA256: ABCDEF%...)",
    "[SKIP] [API] C:\\b% — locked %",
    "[Fail] [API] C:\\c% - no rights",
    "[TOOL] [EXEC] Starting: t.exe -x % -> out/%",
    "[MATCH] [YARA] C:\\d% — rule_%",
    "[INFO] [-] done %",
    "[SCAN] [-] % files",
    "[OK] [RAW] C:\\e%",
    "no line %",
)


@query(r"""WITH c AS (SELECT *, event_id % 9 AS i, CAST(event_id AS VARCHAR) AS n FROM events)
SELECT event_id AS line_no, date_trunc('second', ts) - INTERVAL 9 HOUR AS ts_utc, ['evidence_collected','evidence_skipped','evidence_failed','tool_invoked','yara_match','collection_summary','scan_summary','evidence_collected'][i + 1] AS event_type,
 ['RAW','API','API','EXEC','YARA','-','-','RAW'][i + 1] AS method,
 CASE i WHEN 0 THEN 'C:\a' || n WHEN 1 THEN 'C:\b' || n WHEN 2 THEN 'C:\c' || n WHEN 4 THEN 'C:\d' || n END AS source_path,
 CASE i WHEN 0 THEN 'out/a' || n WHEN 3 THEN 'out/' || n END AS dest_path, CASE i WHEN 0 THEN event_id END AS size_bytes, CASE i WHEN 0 THEN 'abcdef' || n END AS sha256,
 CASE i WHEN 1 THEN 'locked ' || n WHEN 2 THEN 'no rights' END AS reason, CASE i WHEN 3 THEN 't.exe -x ' || n END AS command, CASE i WHEN 4 THEN 'rule_' || n END AS yara_rule,
 CASE i WHEN 5 THEN 'done ' || n END AS summary, CASE i WHEN 6 THEN n || ' files' WHEN 7 THEN 'C:\e' || n END AS unparsed_body FROM c WHERE i < 8""")
def parse_collection_log(spark, sf_dir):
    body = F.element_at(F.array(*map(F.lit, COLLECTION_LINES)), (F.col("event_id") % len(COLLECTION_LINES)).cast("int") + 1)
    line = F.concat(
        F.lit("["),
        F.date_format(stamp(), "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit("+0900] "),
        F.replace(body, F.lit("%"), F.col("event_id").cast("string")),
    )
    return P.parse_collection_log(log_lines(spark, sf_dir, line)).drop("file", "status")


@query("SELECT event_id AS line_no, CAST(event_id AS VARCHAR) AS offset, event_type AS value, props AS context FROM events")
def parse_feature_files(spark, sf_dir):
    line = F.concat_ws("\t", F.col("event_id").cast("string"), "event_type", "props")
    return P.parse_feature_files(log_lines(spark, sf_dir, line)).select("line_no", "offset", "value", "context")


@query("SELECT e.event_id AS visit_id, e.ts AS ts_utc, ['link','typed','bookmark'][e.user_id % 3 + 1] AS transition, p.event_type AS referrer_url FROM events e LEFT JOIN events p ON p.event_id = e.event_id - 1 AND e.event_id % 2 = 0")
def browser_visits_firefox(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    h = e.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("place_id"),
        F.unix_micros(stamp()).alias("visit_date"),
        F.when(F.col("event_id") % 2 == 0, F.col("event_id") - 1).alias("from_visit"),
        (F.col("user_id") % 3 + 1).alias("visit_type"),
    )
    places = e.select(F.col("event_type").alias("id")).distinct().select(
        "id",
        F.col("id").alias("url"),
        F.lit("").alias("title"),
        F.lit(1).alias("visit_count"),
        F.lit(0).alias("typed"),
    )
    return T.browser_visits_firefox(h, places).select("visit_id", "ts_utc", "transition", "referrer_url")


@query("SELECT event_id, 'T' || CAST(1000 + user_id % 90 AS VARCHAR) AS techniques, 'impact' AS tactics FROM events")
def sigma_tags(spark, sf_dir):
    tags = F.array(
        F.concat(F.lit("attack.t"), (F.col("user_id") % 90 + 1000).cast("string")),
        F.lit("attack.impact"),
        F.lit("attack.g0007"),
        F.lit("car.1"),
    )
    technique, tactic = S.sigma_tags(tags)
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.array_join(technique, ",").alias("techniques"),
        F.array_join(tactic, ",").alias("tactics"),
    )


@query(f"WITH {CL} SELECT ct.case_id, ct.cluster_id, CAST(count(*) FILTER (ev.artifact_id <> 'mft') AS INTEGER) AS n, count(*) FILTER (ev.artifact_id = 'mft') AS unresolved FROM ct JOIN ev ON ev.case_id = ct.case_id AND ev.ts_utc BETWEEN ct.start_ts AND ct.end_ts GROUP BY ALL")
def resolve_follow_ups(spark, sf_dir):
    w = clusters(spark, sf_dir).selectExpr("case_id", "cluster_id", "start_ts AS win_start", "end_ts AS win_end")
    rows = J.window_events(unified_events(spark, sf_dir), w)
    return J.resolve_follow_ups(rows, unified_events(spark, sf_dir).where("artifact_id != 'mft'")).select(
        "case_id",
        "cluster_id",
        F.size("events").alias("n"),
        "unresolved",
    )
