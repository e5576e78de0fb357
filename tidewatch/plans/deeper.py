"""Queries over whole forms: kept case tables, log explanations, the older candidates and digests, full technique table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.iocs import UNUSED_ADDRESSES, finding_iocs as iocs_of_findings, iocs_found_sql
from ..model import EVENT_SCHEMA, EVENTS_SQL, shared_folder, table, unified_events
from ..operators import filters as L
from ..operators import joins as J
from ..operators import sessions as W
from ..operators import sinks as K
from ..operators import store as D
from .queries import query, with_k

EV = f"WITH {EVENTS_SQL}"


def kept_events(spark, sf_dir: str) -> str:
    """A fresh copy of the events as a case table in the shared folder."""
    at = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    D.put_rows(unified_events(spark, sf_dir), at)
    return at


@query(f"{EV} SELECT case_id, artifact_id, audit_id, ts_utc FROM ev WHERE case_id <> 'C1'")
def store_delete_case(spark, sf_dir):
    at = kept_events(spark, sf_dir)
    D.delete_cases(spark, {"events": at}, ["C1", "never there"])
    return D.read_table(spark, at, EVENT_SCHEMA).select("case_id", "artifact_id", "audit_id", "ts_utc")


@query(f"{EV} SELECT case_id, artifact_id, count(*) AS n, min(computer) AS computer FROM (SELECT case_id, artifact_id, computer FROM ev WHERE case_id <> 'C1' UNION ALL SELECT case_id, artifact_id, 'IMPORTED' FROM ev WHERE case_id = 'C1' AND artifact_id IN ('evtx', 'mft')) GROUP BY ALL")
def store_import_case(spark, sf_dir):
    """C1 again with two of its artifacts: their partitions are replaced, its others go, other cases stay."""
    at, events = kept_events(spark, sf_dir), unified_events(spark, sf_dir)
    new = events.where("artifact_id IN ('evtx', 'mft')").withColumn("computer", F.lit("IMPORTED"))
    D.import_rows(spark, {"events": at}, {"events": new}, "C1", overwrite=True)
    return D.read_table(spark, at, EVENT_SCHEMA).groupBy("case_id", "artifact_id").agg(F.count("*").alias("n"), F.min("computer").alias("computer"))


@query(f"{EV} SELECT case_id, count(*) AS n FROM ev WHERE case_id = 'C2' GROUP BY 1")
def store_vacuum(spark, sf_dir):
    at = kept_events(spark, sf_dir)
    D.vacuum_tables(spark, {"events": at}, ["C1", "C2", "C9"], ["C1"])
    return D.read_table(spark, at, EVENT_SCHEMA).groupBy("case_id").agg(F.count("*").alias("n"))


@query(f"{EV}, p AS (SELECT case_id, evidence_id, artifact_id, count(*) AS row_count FROM ev GROUP BY ALL) SELECT case_id, evidence_id, artifact_id, CASE WHEN case_id = 'C0' AND artifact_id IN ('evtx', 'mft') THEN -row_count ELSE row_count END AS row_count FROM p")
def store_upsert_parse_results(spark, sf_dir):
    """Rows of an earlier run with a blank evidence, then one row an evidence: a case at a time, the second time for C0 only."""
    at = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rows = unified_events(spark, sf_dir).groupBy("case_id", "evidence_id", "artifact_id").agg(F.count("*").alias("row_count")).withColumn("finished_at", F.lit(1))
    blank = rows.withColumn("evidence_id", F.lit("")).dropDuplicates(["case_id", "artifact_id"])
    D.put_rows(blank, at)
    D.merge_rows(spark, at, rows, K.upsert_parse_results)
    again = rows.where("case_id = 'C0' AND artifact_id IN ('evtx', 'mft')").withColumn("row_count", -F.col("row_count")).withColumn("finished_at", F.lit(2))
    D.merge_rows(spark, at, again, K.upsert_parse_results)
    return D.read_table(spark, at, rows.schema).select("case_id", "evidence_id", "artifact_id", "row_count")


@query(f"""{EV}, d AS (SELECT audit_id, artifact_id, k, event_type, k % 7 = 0 AS bad FROM ev) SELECT audit_id,
CASE WHEN bad THEN 1 WHEN artifact_id = 'evtx' THEN 3 WHEN artifact_id IN ('registry', 'prefetch') THEN 2 ELSE 0 END AS n_keys,
CASE WHEN NOT bad AND artifact_id = 'evtx' THEN CAST(k * 1000000 AS VARCHAR) END AS event_id, CASE WHEN NOT bad AND artifact_id = 'registry' THEN 'HKLM' || chr(92) || event_type END AS key_path,
CASE WHEN bad THEN CASE WHEN k % 2 = 0 THEN '[1, 2]' ELSE 'no json ' || repeat('x', 112) || '...[truncated]' END END AS raw FROM d""")
def digest_payload(spark, sf_dir):
    e = with_k(unified_events(spark, sf_dir))
    k, kind = F.col("k").cast("string"), F.col("event_type")
    text = (
        F.when(F.col("k") % 14 == 0, F.lit("[1, 2]"))
        .when(F.col("k") % 7 == 0, F.concat(F.lit("no json "), F.repeat(F.lit("x"), 500)))
        .when(F.col("artifact_id") == "evtx", F.concat(F.lit('{"EventId":'), k, F.lit('000000,"Channel":"values of '), kind, F.lit('","Provider":null,"Dropped":1}')))
        .when(F.col("artifact_id") == "registry", F.concat(F.lit('{"Category":"c","KeyPath":"HKLM\\\\'), kind, F.lit('","Other":2}')))
        .when(F.col("artifact_id") == "prefetch", F.concat(F.lit('{"ExecutableName":"A.EXE","RunCount":'), k, F.lit("}")))
        .otherwise(F.lit('{"EventId":1}'))
    )
    out = L.digest_payload(e.withColumn("payload_json", F.when(F.col("k") == 0, F.lit("[1, 2]")).otherwise(text)))
    at = lambda key: F.try_element_at("payload", F.lit(key))
    event_id = F.when(at("EventId") == "0000000", F.lit("0")).otherwise(at("EventId"))
    return out.select("audit_id", F.size("payload").alias("n_keys"), event_id.alias("event_id"), at("KeyPath").alias("key_path"), at("_raw").alias("raw"))


TECHNIQUES_SQL = ", ".join(f"('{k}', {list(v)})" for k, v in J.ARTIFACTS_OF_TECHNIQUE.items())


@query(f"{EV}, t(technique, artifacts) AS (VALUES {TECHNIQUES_SQL}), e AS (SELECT DISTINCT unnest(['T' || CAST(1000 + k * 6 AS VARCHAR), 'T' || CAST(1000 + k * 5 AS VARCHAR), 'T' || CAST(1000 + k * 5 AS VARCHAR) || '.00' || CAST(k % 5 AS VARCHAR)]) AS technique FROM ev) SELECT e.technique, len(artifacts) AS n_artifacts, coalesce(list_has_any(artifacts, ['mft', 'prefetch']), false) AS covered FROM e LEFT JOIN t USING (technique)")
def required_artifacts(spark, sf_dir):
    e = with_k(unified_events(spark, sf_dir))
    name = lambda n: F.concat(F.lit("T"), (F.lit(1000) + F.col("k") * n).cast("string"))
    asked = e.select(F.explode(F.array(name(6), name(5), F.concat(name(5), F.lit(".00"), (F.col("k") % 5).cast("string")))).alias("technique"))
    return J.required_artifacts(asked, e.where("artifact_id IN ('mft', 'prefetch')")).select("technique", F.size("artifacts").alias("n_artifacts"), "covered")


@query(f"""{EV}, p AS (SELECT case_id, audit_id, ts_utc, k, CASE k % 5 WHEN 1 THEN 'img' || CAST(k AS VARCHAR) || '.exe' WHEN 2 THEN event_type || '.exe' END AS img FROM ev),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts_utc NULLS LAST, audit_id) AS r FROM p) WHERE r <= 1500),
c AS (SELECT case_id, img, count(*) AS n FROM s WHERE img IS NOT NULL GROUP BY ALL), t AS (SELECT DISTINCT case_id, ts_utc AS ts FROM ev WHERE k = 3),
near AS (SELECT DISTINCT s.audit_id FROM s JOIN t ON t.case_id = s.case_id AND abs(epoch_us(s.ts_utc) - epoch_us(t.ts)) <= 1800000000),
x AS (SELECT s.*, hour(ts_utc) < 6 OR hour(ts_utc) >= 22 AS a1, k % 5 = 0 AS a2, coalesce(c.n < 3, false) AS a4, near.audit_id IS NOT NULL AS a5 FROM s LEFT JOIN c USING (case_id, img) LEFT JOIN near USING (audit_id) WHERE k % 11 > 0),
y AS (SELECT *, CAST(a1 AS INT) * 2 + CAST(a2 AS INT) * 3 + CAST(a4 AS INT) * 2 + CAST(a5 AS INT) AS score, concat_ws(',', CASE WHEN a1 THEN 'A1' END, CASE WHEN a2 THEN 'A2' END, CASE WHEN a4 THEN 'A4' END, CASE WHEN a5 THEN 'A5' END) AS lenses FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, ts_utc, audit_id) AS place FROM y WHERE score > 0), n AS (SELECT case_id, count(*) AS total FROM ev GROUP BY 1)
SELECT case_id, audit_id, lenses, score, place, total FROM z JOIN n USING (case_id) WHERE place <= 300""")
def anomaly_candidates_legacy(spark, sf_dir):
    e = with_k(unified_events(spark, sf_dir))
    kind, k = F.col("k") % 5, F.col("k").cast("string")
    text = (
        F.when(kind == 0, F.lit('{"p":"c:\\\\Temp\\\\b"}'))
        .when(kind == 1, F.concat(F.lit('{"PayloadData4":"none","PayloadData3":" Img'), k, F.lit('.exe "}')))
        .when(kind == 2, F.concat(F.lit('{"Image":"'), F.col("event_type"), F.lit('.exe"}')))
        .when(kind == 3, F.lit('{"Image":"other","p":"c:\\\\perflogs\\\\b"}'))
        .otherwise(F.lit("no json"))
    )
    e = e.withColumn("payload_json", text)
    out = W.anomaly_candidates_legacy(e, e.where("k % 11 = 0"), e.where("k = 3").select("case_id", F.col("ts_utc").alias("ts")), 300)
    return out.select("case_id", "audit_id", F.array_join("lenses", ",").alias("lenses"), "score", "place", "total")


@query(f"""{EV}, a AS (SELECT event_id, k, ['tier1a', 'tier1b', 'tier2', 'tier2', 'tier0'][k % 5 + 1] AS actor, k % 40 AS c, k % 3 AS d, event_type AS t FROM ev),
b AS (SELECT *, CASE WHEN actor = 'tier1a' AND k % 20 < 10 THEN 'rule' WHEN actor = 'tier1b' AND k % 6 IN (1, 2) THEN 'skill'
 WHEN actor = 'tier2' AND k % 5 = 2 AND c % 2 = 0 AND k % 4 < 3 THEN 'search' WHEN actor = 'tier2' AND k % 5 = 2 AND c % 3 = 0 THEN 'open_questions'
 WHEN actor = 'tier2' AND k % 5 = 3 AND d = 0 THEN 'overall' WHEN actor = 'tier2' AND k % 5 = 3 AND d = 1 AND c % 3 = 0 THEN 'cluster' WHEN actor = 'tier2' AND k % 5 = 3 AND d = 2 AND c % 3 = 0 THEN 'follow_up' END AS branch FROM a)
SELECT event_id, branch, CASE WHEN branch = 'rule' THEN 'title of R' || CAST(k % 20 AS VARCHAR) END AS title, CASE WHEN branch = 'skill' THEN k % 6 END AS events_scanned,
CASE WHEN branch = 'search' THEN CASE WHEN k % 4 = 2 THEN 2 ELSE 1 END END AS question, CASE WHEN branch IN ('open_questions', 'cluster', 'follow_up') THEN 1 END AS n_open,
CASE WHEN branch = 'overall' THEN 'all' WHEN branch = 'cluster' THEN 'of ' || CAST(c AS VARCHAR) END AS narrative FROM b""")
def explain_records(spark, sf_dir):
    """Records of all kinds: rules with and without a finding, skills with and without content, SQL that fits itself, an attempt, or nothing."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k, c = F.col("k"), F.col("k") % 40
    one = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (n % len(names)).cast("int") + 1)
    actions = e.select(
        "event_id",
        one(k, "tier1a", "tier1b", "tier2", "tier2", "tier0").alias("actor"),
        one(k, "rule_sql", "llm_call", "active_sql", "llm_call", "parse").alias("kind"),
        F.when(k % 5 == 1, F.concat(F.lit("skill"), (k % 6).cast("string"))).when(k % 5 == 3, one(k, "overall_synthesis", "cluster_analysis", "active_search_interpret")).alias("detail"),
        F.lit("sigma").alias("rule_source"),
        F.concat(F.lit("R"), (k % 20).cast("string")).alias("rule_id"),
        c.alias("cluster_id"),
        one(k, "SELECT  1\n", " SELECT x\tFROM t", "select two", "other").alias("command"),
    )
    s = lambda *cols: e.select(*cols).distinct()
    rules = s((k % 20).alias("r")).where("r < 10").select(
        F.lit("sigma").alias("source"), F.concat(F.lit("R"), F.col("r").cast("string")).alias("rule_id"), F.concat(F.lit("title of R"), F.col("r").cast("string")).alias("title"),
        F.lit("d").alias("description"), F.lit("p").alias("source_path"), F.lit("q").alias("sql"), F.array(F.lit("impact")).alias("tactics"), F.array(F.lit("T1486")).alias("techniques"),
    )
    skills = s((k % 6).alias("n")).where("n < 3").select(F.concat(F.lit("skill"), F.col("n").cast("string")).alias("skill"), F.col("n").alias("events_scanned"), F.lit(0).alias("prior_findings"), F.array().cast("array<string>").alias("anomalies"))
    clusters = s(c.alias("cluster_id")).where("cluster_id % 3 = 0").select("cluster_id", F.lit("phase").alias("attack_phase"), F.concat(F.lit("of "), F.col("cluster_id").cast("string")).alias("narrative"), F.array(F.lit("why?")).alias("open_questions"))
    of = s(c.alias("cluster_id")).where("cluster_id % 2 = 0")
    searches = of.select("cluster_id", F.lit(1).alias("place"), F.lit("1").alias("question"), F.lit("yes").alias("answer"), F.lit("SELECT 1").alias("sql"), F.array(F.lit("SELECT x FROM t")).alias("attempts"))
    more = of.select("cluster_id", F.lit(2).alias("place"), F.lit("2").alias("question"), F.lit("no").alias("answer"), F.lit("select\ntwo ").alias("sql"), F.array(F.lit("SELECT 1")).alias("attempts"))
    overall = e.agg(F.count("*").alias("n")).select(F.lit("all").alias("narrative"))
    out = J.explain_records(actions, rules, skills, clusters, searches.union(more), overall)
    return out.select("event_id", "branch", "title", "events_scanned", F.col("question").cast("int").alias("question"), F.size("open_questions").alias("n_open"), "narrative")


FOUND_SQL = " UNION ALL ".join(f"SELECT * FROM ({iocs_found_sql('d', 'doc_id', c)})" for c in ("summary", "reasoning", "excerpt"))


@query(f"""WITH d AS (SELECT doc_id, lang, text AS summary, 'from 10.' || CAST(doc_id % 50 AS VARCHAR) || '.0.7, C:{chr(92)}Temp{chr(92)}Run' || source || '.exe.' AS reasoning, 'TaskName: {chr(92)}Job' || CAST(doc_id % 9 AS VARCHAR) AS excerpt FROM documents),
x AS (SELECT id, type, trim(value) AS value FROM ({FOUND_SQL}) WHERE trim(value) <> '' AND NOT (type = 'ipv4' AND value IN {UNUSED_ADDRESSES}))
SELECT type, lower(value) AS key, min(value) AS value, count(DISTINCT id) AS n_findings, string_agg(DISTINCT lang, ',' ORDER BY lang) AS tactics FROM x JOIN d ON d.doc_id = x.id GROUP BY 1, 2""")
def finding_iocs(spark, sf_dir):
    """Documents as findings: the text is the summary, the language the tactic."""
    d = table(spark, sf_dir, "documents")
    ten = F.concat(F.lit("from 10."), (F.col("doc_id") % 50).cast("string"), F.lit(".0.7, C:\\Temp\\Run"), F.col("source"), F.lit(".exe."))
    excerpts = F.array(F.concat(F.lit("TaskName: \\Job"), (F.col("doc_id") % 9).cast("string")))
    f = d.select(F.col("doc_id").cast("string").alias("finding_id"), F.col("lang").alias("tactic"), F.col("text").alias("summary"), ten.alias("reasoning"), excerpts.alias("excerpts"))
    return iocs_of_findings(f)[0].withColumn("tactics", F.array_join("tactics", ","))
