"""Case tables in place, directives carried over blocks, log explanations and the older candidates on small cases."""

import datetime as dt
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import joins, sessions, sinks, store
from tidewatch.sources import logs

EVENTS = "case_id string, artifact_id string, audit_id string, ts_utc timestamp_ntz, payload_json string"
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/table"


@pytest.fixture
def rows(spark):
    made = [(c, a, f"{c}{a}{i}", T0 + dt.timedelta(minutes=i) if i else None, "{}") for c in ("001", "a:b/c", None, "x") for a in ("evtx", "mft", None) for i in range(4)]
    return spark.createDataFrame(made, EVENTS)


def held(spark, path, schema):
    return sorted(tuple(map(str, r)) for r in store.read_table(spark, path, schema).select(*schema.names).collect())


def as_rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_tables_keep_their_values(spark, rows, folder):
    assert store.read_table(spark, folder, rows.schema).count() == 0
    store.put_rows(rows, folder)
    assert held(spark, folder, rows.schema) == as_rows(rows)
    store.put_rows(store.read_table(spark, folder, rows.schema).where("case_id = '001'"), folder)  # from itself
    assert held(spark, folder, rows.schema) == as_rows(rows)
    store.delete_cases(spark, {"events": folder, "none": folder + "-not-there"}, ["a:b/c", "nobody"])
    store.delete_cases(spark, {"events": folder}, ["a:b/c"])
    assert held(spark, folder, rows.schema) == as_rows(rows.where("case_id IS NULL OR case_id != 'a:b/c'"))
    assert store.vacuum_tables(spark, {"events": folder}, None, ["x"]) == ["001"]
    assert held(spark, folder, rows.schema) == as_rows(rows.where("case_id IS NULL OR case_id = '001'"))
    with pytest.raises(ValueError, match="no case"):
        store.vacuum_tables(spark, {"events": folder}, ["z"], [])


def test_import_replaces_one_case_and_can_run_again(spark, rows, folder):
    store.put_rows(rows, folder)
    new = rows.where("artifact_id = 'mft'").limit(100).withColumn("payload_json", F.lit("new"))
    with pytest.raises(ValueError, match="present"):
        store.import_rows(spark, {"e": folder}, {"e": new}, "001")
    assert held(spark, folder, rows.schema) == as_rows(rows)
    broken = new.withColumn("payload_json", F.when(F.col("case_id") == "001", F.raise_error(F.lit("lost"))).otherwise(F.col("payload_json")))
    with pytest.raises(Exception, match="lost"):
        store.import_rows(spark, {"e": folder}, {"e": broken}, "001", overwrite=True)
    assert held(spark, folder, rows.schema) == as_rows(rows)  # nothing was touched
    want = as_rows(rows.where("case_id IS NULL OR case_id != '001'").union(new.where("case_id = '001'")))
    for _ in range(2):
        store.import_rows(spark, {"e": folder}, {"e": new}, "001", overwrite=True)
        assert held(spark, folder, rows.schema) == want
    store.import_rows(spark, {"e": folder}, {}, "001", overwrite=True)
    assert held(spark, folder, rows.schema) == as_rows(rows.where("case_id IS NULL OR case_id != '001'"))


def test_merge_reads_touched_cases_only(spark, folder):
    schema = "case_id string, evidence_id string, artifact_id string, row_count long, finished_at int"
    old = spark.createDataFrame([("a", "", "mft", 1, 1), ("a", "e1", "evtx", 2, 1), ("b", "", "mft", 3, 1)], schema)
    store.put_rows(old, folder)
    new = spark.createDataFrame([("a", "e1", "mft", 9, 2), ("a", "e1", "mft", 8, 1), ("c", "e", "mft", 5, 2)], schema)
    for _ in range(2):
        store.merge_rows(spark, folder, new, sinks.upsert_parse_results)
        assert held(spark, folder, old.schema) == sorted([("a", "e1", "mft", "9", "2"), ("a", "e1", "evtx", "2", "1"), ("b", "", "mft", "3", "1"), ("c", "e", "mft", "5", "2")])


@pytest.mark.parametrize("block", [1, 3, 7, 100_000])
def test_directives_are_carried_over_blocks(spark, block):
    lines, want, names = [], [], {}
    for i in range(60):
        for f in ("f", "g"):
            text = f"#Fields: a{i} b{i}" if (i * 7) % 11 == (3 if f == "f" else 9) else "#Software: x" if i % 13 == 5 else f"{i} line"
            lines.append((f, i, text))
            if text.startswith("#Fields:"):
                names[f] = text.split()[1:]
            else:
                want.append((f, i, names.get(f)))
    lines.append(("no directive", 4, "some line"))
    want.append(("no directive", 4, None))
    got = logs.with_directive(spark.createDataFrame(lines, "file string, line_no long, line string").repartition(5), block)
    assert sorted((r.file, r.line_no, r.f_) for r in got.collect()) == sorted(want, key=lambda w: w[:2])


def test_records_take_the_first_explanation_that_applies(spark):
    actions = spark.createDataFrame(
        [
            (1, "tier1a", "rule_sql", None, "sigma", "R1", None, None), (2, "tier1a", "rule_sql", None, "sigma", "none", 1, None), (3, "tier1a", "rule_sql", None, "", "R1", 1, None),
            (4, "tier1b", "llm_call", "full", None, None, None, None), (5, "tier1b", "llm_call", "empty", None, None, None, None), (6, "tier1b", "llm_call", "", None, None, None, None),
            (7, "tier2", "active_sql", None, None, None, 1, " select  1 "), (8, "tier2", "active_sql", None, None, None, 1, "attempt\n2"), (9, "tier2", "active_sql", None, None, None, 1, "other"),
            (10, "tier2", "active_sql", None, None, None, 2, "select 1"), (11, "tier2", "llm_call", "cluster_analysis", None, None, 2, None), (12, "tier2", "llm_call", "overall_synthesis", None, None, None, None),
            (13, "tier2", "llm_call", "active_search_reframe", None, None, 1, None), (14, "tier2", "llm_call", "unknown", None, None, 1, None), (15, None, None, None, None, None, 1, None),
        ],
        "id int, actor string, kind string, detail string, rule_source string, rule_id string, cluster_id int, command string",
    )
    findings = spark.createDataFrame([("sigma", "R1", "t", "d", "p", "q", ["impact"], None), ("sigma", "R1", "u", "d", "p", "q", [], [])], "source string, rule_id string, title string, description string, source_path string, sql string, tactics array<string>, techniques array<string>")
    skills = spark.createDataFrame([("full", 0, 0, ["a"]), ("empty", 0, None, []), ("", 9, 9, [])], "skill string, events_scanned long, prior_findings long, anomalies array<string>")
    clusters = spark.createDataFrame([(1, "phase", "story", ["why"]), (2, "p2", "s2", None)], "cluster_id int, attack_phase string, narrative string, open_questions array<string>")
    searches = spark.createDataFrame([(1, 2, "late", "x", "select 1", None), (1, 1, "early", "y", "z", ["attempt 2", "select 1"])], "cluster_id int, place int, question string, answer string, sql string, attempts array<string>")
    overall = spark.createDataFrame([("whole",)], "narrative string")
    got = {r.id: r for r in joins.explain_records(actions, findings, skills, clusters, searches, overall).collect()}
    branches = {1: "rule", 4: "skill", 7: "search", 8: "search", 9: "open_questions", 11: "cluster", 12: "overall", 13: "follow_up"}
    assert {i: r.branch for i, r in got.items()} == {i: branches.get(i) for i in range(1, 16)}
    assert (got[1].title, got[1].mitre, got[4].anomalies, got[7].question, got[8].answer) == ("t", ["impact"], ["a"], "early", "y")
    assert (got[9].open_questions, got[11].narrative, got[11].open_questions, got[12].narrative, got[13].attack_phase, got[13].narrative) == (["why"], "s2", None, "whole", "phase", None)
    none = joins.explain_records(actions, findings, skills, clusters, searches, overall.where("false"))
    assert {r.id: r.branch for r in none.collect()} == {i: branches.get(i) if i != 12 else None for i in range(1, 16)}


def test_earliest_rows_over_days_ties_and_nulls(spark):
    made = [("c", f"{i:03}", T0 + dt.timedelta(hours=7 * (i % 40))) for i in range(200)] + [("c", f"n{i}", None) for i in range(9)] + [("d", "one", None), ("d", "two", T0)]
    df = spark.createDataFrame(made, "case_id string, audit_id string, ts_utc timestamp_ntz").repartition(6)
    for most in (1, 37, 199, 203, 500):
        want = {r[1] for c in "cd" for r in sorted([m for m in made if m[0] == c], key=lambda m: (m[2] is None, m[2] or T0, m[1]))[:most]}
        assert {r.audit_id for r in sessions.earliest_rows(df, most).collect()} == want


def test_earliest_rows_bring_no_case_into_one_task(spark, monkeypatch):
    """Where the table is too large for a broadcast, rows are dealt by case and salt: not by case, as the join with a case's last day did."""
    made = [(c, f"{i:03}", T0 + dt.timedelta(hours=7 * (i % 40))) for c in "cd" for i in range(100)] + [("e", "one", T0), (None, "none", T0)]
    df = spark.createDataFrame(made, "case_id string, audit_id string, ts_utc timestamp_ntz").repartition(6)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for one_in in (1, 1000):  # no case is cut by its days; all but the smallest are
            monkeypatch.setattr(sessions, "HOT_ONE_IN", one_in, raising=False)
            out = sessions.earliest_rows(df, 37)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert re.search(r"Exchange hashpartitioning\(case_id#\d+, salt_#\d+", plan)
            want = {(c, r[1]) for c in "cde" for r in sorted([m for m in made if m[0] == c], key=lambda m: (m[2], m[1]))[:37]}
            assert {(r.case_id, r.audit_id) for r in out.collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
