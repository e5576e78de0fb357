from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import scalars as S
from tidewatch.operators import checks as C
from tidewatch.operators import joins as J
from tidewatch.operators import sessions as W
from tidewatch.operators import sinks as K
from tidewatch.sources import logs as P
from tidewatch.sources import tables as T

T0 = datetime(2026, 1, 1, 12)


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(expr.alias("x")).head()[0]


def test_like_keeps_backslashes_and_wildcards(spark):
    c = F.col("a")
    assert one(spark, S.like_ci(c, "%\\users\\public\\%"), a="C:\\Users\\Public\\x") is True
    assert one(spark, S.like_ci(c, "%_payload.exe"), a="xpayload.exe") is True
    assert one(spark, S.like_ci(c, "a%b_d"), a="AxxBcD") is True
    assert one(spark, S.literal_like(c, "%_x"), a="ax") is False


def test_fields(spark):
    c = F.col("a")
    assert one(spark, S.field_text(c, "Image"), a='{"z":{"Image" : "C:\\\\a \\"q\\"","n":3}}') == 'C:\\\\a \\"q\\"'
    assert one(spark, S.field_text(c, "n"), a='{"n": 12, "m":1}') == "12"
    assert one(spark, S.field_text(c, "gone"), a='{"n": 12}') is None
    assert one(spark, S.event_data(c, "TargetUserName"), a='{"raw":{"Payload":"{\\"Data\\":[{\\"@Name\\":\\"TargetUserName\\",\\"#text\\":\\"bob\\"}]}"}}') == "bob"
    assert one(spark, S.image_of(c), a='{"ExecutableInfo":"C:\\\\x.exe /a"}') == "C:\\\\x.exe"


def test_labels(spark):
    c = F.col("a")
    assert one(spark, S.tactic_slugs(c), a="Persis \u00a6 C2 \u00a6 - \u00a6 Persis") == ["persistence", "command-and-control"]
    assert one(spark, S.technique_ids(c), a="T1003.001 \u00a6 G0007 \u00a6 T1059") == ["T1003.001", "T1059"]
    assert one(spark, S.norm_severity(c), a=" Crit ") == "critical"
    assert one(spark, S.norm_user(c), a="DOM\\Bob ") == "bob"
    assert one(spark, S.pretty_tactic(c), a="lateral-movement") == "Lateral Movement"
    assert one(spark, S.humanize_duration(c.cast("double")), a="5400") == "2 hours"
    assert one(spark, S.expand_env(c), a="%WinDir%\\x") == "C:\\Windows\\x"
    assert one(spark, S.first_line(c), a="\n  \n boom \nx") == "boom"
    assert one(spark, S.webkit_ts(c.cast("long")), a="11644473600000000") == datetime(1970, 1, 1)
    assert one(spark, S.webkit_ts(c.cast("long")), a="0") is None
    assert one(spark, S.registry_tactic_hints(F.lit(""), c, F.lit("")), a="HKLM\\Software\\Microsoft\\Windows\\CurrentVersion\\Run") == ["TA0003"]
    assert one(spark, S.display_tz(c.cast("timestamp_ntz"), "Asia/Tokyo"), a="2026-01-01 00:00:00") == "2026-01-01 09:00:00 +09:00"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_clusters_split_on_more_than_the_gap(spark):
    rows = [("c", "a", at(0)), ("c", "b", at(30)), ("c", "d", at(60.1)), ("c", "e", None)]
    df = spark.createDataFrame(rows, "case_id string, finding_id string, first_ts timestamp_ntz")
    assert {r.finding_id: r.cluster_id for r in W.cluster_findings(df).collect()} == {"a": 1, "b": 1, "d": 2, "e": 3}


def logons(spark, rows):
    return spark.createDataFrame([("c", f"{i:03}", at(m), e, u, s, "3", "-", "1.2.3.4") for i, (m, e, u, s) in enumerate(rows)], "case_id string, audit_id string, ts_utc timestamp_ntz, event_id int, target_user string, sub_status string, logon_type string, workstation string, ip string")


def test_bruteforce(spark):
    fails = [(i, 4625, "D\\Bob", "0xc000006a") for i in range(6)]
    got = W.detect_bruteforce(logons(spark, [*fails, (10, 4624, "bob", "")])).collect()
    assert [(r.account, r.failures, r.severity, r.sources) for r in got] == [("bob", 6, "high", ["1.2.3.4"])]
    assert W.detect_bruteforce(logons(spark, fails[:4])).count() == 0
    mixed = [(i, 4625, "bob", f"0x{i}") for i in range(6)]
    assert W.detect_bruteforce(logons(spark, mixed)).count() == 0
    two = [*fails, *[(100 + i, 4625, "bob", "") for i in range(5)]]
    assert W.detect_bruteforce(logons(spark, two)).count() == 2


def test_boundaries_and_chase(spark):
    c = spark.createDataFrame([("c", 1, at(0), at(10)), ("c", 2, at(100), at(110))], "case_id string, cluster_id int, start_ts timestamp_ntz, end_ts timestamp_ntz")
    flagged = spark.createDataFrame([("c", 1, at(35)), ("c", 1, at(54)), ("c", 1, at(90))], "case_id string, cluster_id int, ts_utc timestamp_ntz")
    got = {r.cluster_id: r for r in W.chase(c, flagged).collect()}
    assert got[1].end_ts == at(54) and got[1].chase_rounds == 2 and not got[1].continues_into_next
    assert got[2].start_ts == at(100) and got[2].chase_rounds == 0
    assert got[1].win_end == at(55) - timedelta(microseconds=1)


def test_temporal_outlier_needs_three(spark):
    rows = [("c", i, at(m), at(m)) for i, m in ((1, 0), (2, 60), (3, -60 * 24 * 800))]
    df = spark.createDataFrame(rows, "case_id string, cluster_id int, start_ts timestamp_ntz, end_ts timestamp_ntz")
    assert {r.cluster_id for r in W.temporal_outliers(df).where("outlier").collect()} == {3}
    assert W.temporal_outliers(df.where("cluster_id != 2")).where("outlier").count() == 0


def test_anchors_are_thinned(spark):
    df = spark.createDataFrame([("c", 1, at(0) + timedelta(seconds=i)) for i in range(200)], "case_id string, cluster_id int, ts_utc timestamp_ntz")
    a = W.cluster_anchors(df).head().anchors
    assert len(a) == 96 and a[-1] - a[0] == 199


def test_input_presence(spark):
    catalog = spark.createDataFrame([(1, "evtx:ps", "", ["powershell/operational"], True), (2, "mft", "mft", [], False), (3, "lnk", "lnk", [], True)], "pos int, input_id string, artifact_id string, tokens array<string>, critical boolean")
    held = spark.createDataFrame([("mft",)], "artifact_id string")
    channels = spark.createDataFrame([("Microsoft-Windows-PowerShell/Operational",)], "channel string")
    got = J.input_presence(catalog, held, channels)
    assert {r.input_id: r.present for r in got.collect()} == {"evtx:ps": True, "mft": True, "lnk": False}
    assert [(r.input_id, r.n_missing, r.n_critical) for r in J.missing_inputs(got).collect()] == [("lnk", 1, 1)]


def test_w3c_rebinds_fields(spark):
    lines = ["#Fields: date time c-ip cs(User-Agent)", "2026-01-01 00:00:01 1.1.1.1 a b c", "#Fields: date time c-ip", "2026-01-01 00:00:02"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string")
    got = [r.row for r in P.parse_w3c_log(df).orderBy("line_no").collect()]
    assert got[0]["cs(User-Agent)"] == "a b c" and got[1]["c-ip"] == "-"


def test_error_logs(spark):
    mk = lambda x: spark.createDataFrame([("f", 0, x)], "file string, line_no int, line string")
    a = P.parse_apache_error(mk("[Mon Jun 08 13:18:17.123456 2026] [core:error] [pid 1] [client 1.2.3.4:55] File does not exist"), "Asia/Tokyo").head()
    assert (a.ts_utc, a.severity, a.client_ip, a.message) == (datetime(2026, 6, 8, 4, 18, 17, 123456), "error", "1.2.3.4", "File does not exist")
    n = P.parse_nginx_error(mk("2026/06/08 13:18:17 [error] 12#0: *1 open() failed, client: 9.9.9.9, server: x")).head()
    assert (n.client_ip, n.severity) == ("9.9.9.9", "error")
    t = P.parse_tomcat_log(mk("08-Jun-2026 13:18:17.123 SEVERE [main] org.x boom")).head()
    assert (t.severity, t.message) == ("severe", "org.x boom")
    assert P.detect_error_format(mk("2026/06/08 13:18:17 [error] 12#0: x")).head().format == "nginx"


def test_unified_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"artifact_id":"evtx","audit_id":"1","timestamp":"2026-01-01T00:00:00Z","event_type":"x","computer":"h","payload":{"a":{"b":1}}}\n{bad\n{"artifact_id":"shimcache","audit_id":"2","timestamp":"","payload":null}\n')
    got = {r.audit_id: r for r in T.read_unified_jsonl(spark, str(tmp_path), "c", "e").collect()}
    assert set(got) == {"1", "2"}
    assert got["1"].payload_json == '{"a":{"b":1}}' and got["1"].ts_utc == datetime(2026, 1, 1)
    assert got["2"].ts_utc is None and got["2"].payload_json == "{}" and got["2"].computer == ""


def test_prefetch_runs(spark, tmp_path):
    (tmp_path / "p.csv").write_text("\ufeffExecutableName,Hash,RunCount,LastRun,PreviousRun0,PreviousRun1\nA.EXE,1,3,2026-01-01 00:00:00,2025-12-31 00:00:00,\nB.EXE,2,1,,,\n")
    got = T.explode_prefetch_runs(T.read_csv(spark, str(tmp_path)), "c", "e").collect()
    assert sorted((r.ts_utc is not None) for r in got) == [False, True, True]
    assert len({r.audit_id for r in got}) == 3


def test_tool_csv_times(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Created0x10,FileName\n,late.txt\n2026-01-02 03:04:05,a.txt\n")
    got = T.read_tool_csv(spark, str(tmp_path), "mft", "c", "e").collect()
    assert {r.ts_utc for r in got} == {None, datetime(2026, 1, 2, 3, 4, 5)} and all("FileName" in r.payload_json for r in got)


def test_tasks_xml(spark, tmp_path):
    (tmp_path / "Job.xml").write_text("<Task><RegistrationInfo><Date>2026-01-01T00:00:00</Date></RegistrationInfo><Principals><Principal><UserId>S-1-5-18</UserId></Principal></Principals><Actions><Exec><Command>powershell.exe</Command><Arguments>-enc x</Arguments></Exec></Actions></Task>")
    r = T.normalize_tasks(spark, str(tmp_path)).head()
    assert r.actions[0].command == "powershell.exe" and r.tactic_hints == ["TA0002", "TA0003", "TA0005", "TA0004"]


def test_browser_referrer(spark):
    v = spark.createDataFrame([(1, 10, 11644473600000001, 0, 1), (2, 11, 11644473600000002, 1, 0x30000008)], "id long, url long, visit_time long, from_visit long, transition long")
    u = spark.createDataFrame([(10, "a", "A", 1, 1), (11, "b", "B", 1, 0)], "id long, url string, title string, visit_count int, typed_count int")
    got = {r.visit_id: r for r in T.browser_visits_chromium(v, u).collect()}
    assert (got[1].transition, got[2].transition, got[2].referrer_url) == ("typed", "reload", "a")


def test_manifest(spark, tmp_path):
    import hashlib

    (tmp_path / "a").write_text("x")
    (tmp_path / "b").write_text("y")
    m = spark.createDataFrame([("a", hashlib.sha256(b"x").hexdigest()), ("b", "0"), ("c", "0")], "file string, sha256 string")
    assert {r.file: r.state for r in K.verify_manifest(spark, str(tmp_path), m).collect()} == {"a": "verified", "b": "mismatched", "c": "missing"}


def test_import_refuses_a_present_case(spark):
    t = {"cases": spark.createDataFrame([("c",)], "case_id string")}
    with pytest.raises(ValueError, match="present"):
        K.import_case(t, t, "c")
    assert K.import_case(t, t, "c", overwrite=True)["cases"].count() == 1


def test_demotion(spark):
    m = spark.createDataFrame([("c", "T1190"), ("c", "T1550.002"), ("c", "T1059")], "case_id string, technique string")
    ctx = spark.createDataFrame([("c", False, 1, False)], "case_id string, web_server boolean, n_burst_accounts int, reversed boolean")
    assert {r.technique for r in C.demote_techniques(m, ctx).where("demoted").collect()} == {"T1190", "T1550.002"}
    assert {r.label for r in C.uncorroborated_claims(C.demote_techniques(m, ctx)).collect()} == {"Web shell", "Pass-the-Hash"}


def test_phantoms_and_citations(spark):
    obs = spark.createDataFrame([("o1", ["a", "x"]), ("o2", ["x"])], "obs_id string, audit_ids array<string>")
    real = spark.createDataFrame([("a",)], "audit_id string")
    assert [(r.obs_id, r.audit_ids, r.dropped) for r in J.filter_phantom(obs, real).collect()] == [("o1", ["a"], 1)]


def test_rows_and_lines_are_numbered_over_blocks(spark, tmp_path):
    """Files larger than a block: numbers run on from block to block."""
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        for name in "ab":
            (tmp_path / f"{name}.csv").write_text("\ufeffn,Created0x10\n" + "".join(f"{name}{i},2026-01-01 00:00:{i % 60:02d}\n" for i in range(100)))
            (tmp_path / f"{name}.log").write_text("".join(f"line {name}{i}\n" + "\n" * (i % 3 == 0) for i in range(80)))
        rows = T.indexed(T.read_csv(spark, f"{tmp_path}/*.csv", multi_line=False))
        assert rows.select("_file", "_block").distinct().count() > 6
        assert sorted((r.n, r._i) for r in rows.collect()) == sorted((f"{n}{i}", i) for n in "ab" for i in range(100))
        lines = P.read_lines(spark, f"{tmp_path}/*.log").collect()
        assert sorted((r.line, r.line_no) for r in lines) == sorted((f"line {n}{i}", i + (i + 2) // 3) for n in "ab" for i in range(80))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_w3c_fields_change_within_a_file(spark):
    lines = ["#Software: x", "2026-01-01 00:00:00 before", "#Fields: date time a b", "2026-01-01 00:00:01 1 2 3", "#Fields: date time c", "2026-01-01 00:00:02", "2026-01-01 00:00:03 4"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no long, line string")
    got = {r.line_no: {k: v for k, v in r.row.items() if k not in ("date", "time")} for r in P.parse_w3c_log(df).collect()}
    assert got == {3: {"a": "1", "b": "2 3"}, 5: {"c": "-"}, 6: {"c": "4"}}


def test_upsert_prefers_new_rows(spark):
    old = spark.createDataFrame([("a", 9), ("b", 1)], "case_id string, finished_at int")
    new = spark.createDataFrame([("a", 5), ("a", 4), ("c", 2)], "case_id string, finished_at int")
    assert sorted(map(tuple, K.upsert_last(old, new, ["case_id"], "finished_at").collect())) == [("a", 5), ("b", 1), ("c", 2)]


def test_components_that_do_not_settle_are_an_error(spark):
    from tidewatch.operators import graph as G

    chain = spark.createDataFrame([(i, i // 2 if i % 2 == 0 else (i + 1) // 2) for i in range(1, 200)] + [(i, 1000 + i) for i in range(200)] + [(i + 1, 1000 + i) for i in range(200)], "l int, r int")
    with pytest.raises(RuntimeError):
        G.link_components(chain, "l", "r", most_rounds=1)


def test_windows_are_numbered_over_ranges(spark):
    rows = [("c", f"{i:03d}", at(i % 7)) for i in range(90)] + [("d", "x", None)]
    df = spark.createDataFrame(rows, "case_id string, audit_id string, ts_utc timestamp_ntz")
    got = {(r.case_id, r.audit_id): (r.i_, r.n_) for r in W.numbered_rows(df, "case_id", [F.col("ts_utc").asc_nulls_last(), F.col("audit_id").asc()], "i_").collect()}
    order = sorted((r for r in rows if r[0] == "c"), key=lambda r: (r[2], r[1]))
    assert got == {("c", a): (i, 90) for i, (_, a, _) in enumerate(order)} | {("d", "x"): (0, 1)}


def test_values_of_tactics_and_tasks(spark):
    c = F.col("a")
    want = {"stealth": "defense-evasion", "defense-impairment": "defense-evasion", "defense_evasion": "defense-evasion", "Credential_Access": "credential-access", "command and control": "command-and-control", "c2": "command-and-control", "discovery": "discovery"}
    assert {k: one(spark, S.canonical_tactic(c), a=k) for k in want} == want
    actions = lambda line: F.array(F.struct(F.lit(line).alias("command"), F.lit(None).cast("string").alias("arguments")))
    odd = {"powershell -e AA": True, "powershell Get-Date": False, "x -w  hidden": True, "IEX (y)": True, "MSHTA http://h": True, "C:\\ProgramData\\x.exe": True, "regsvr32 a": True, "rundll32 a": False}
    assert {k: "TA0005" in one(spark, S.task_hints(actions(k), c), a="alice") for k in odd} == odd
    assert "TA0004" in one(spark, S.task_hints(actions("x"), c), a="local system") and "TA0004" not in one(spark, S.task_hints(actions("x"), c), a="system32")


def test_tasks_and_modules(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "Up.xml").write_text('<?xml version="1.0"?><Task xmlns="http://schemas.microsoft.com/windows/2004/02/mit/task"><RegistrationInfo><Date>2026-01-01T00:00:00</Date><Author>me</Author></RegistrationInfo><Triggers><LogonTrigger><Enabled>true</Enabled></LogonTrigger><TimeTrigger><StartBoundary>2026-01-02</StartBoundary></TimeTrigger></Triggers><Principals><Principal><UserId> </UserId></Principal><Principal><UserId>bob</UserId></Principal></Principals><Actions><Exec><Command>a.exe</Command><WorkingDirectory>C:\\w</WorkingDirectory></Exec><ComHandler><ClassId>{1}</ClassId></ComHandler></Actions></Task>')
    r = T.normalize_tasks(spark, f"{tmp_path}/t").head()
    assert (r.task_name, r.author, r.run_as, r.ts_utc) == ("Up", "me", "bob", datetime(2026, 1, 1))
    assert sorted((t.type, t.start_boundary, t.enabled) for t in r.triggers) == [("LogonTrigger", "", "true"), ("TimeTrigger", "2026-01-02", "")]
    assert [(a.type, a.command, a.working_directory, a.class_id) for a in r.actions] == [("Exec", "a.exe", "C:\\w", None), ("ComHandler", None, None, "{1}")]
    (tmp_path / "m.config").write_text('<configuration><system.webServer><globalModules><add name="n" image="%windir%\\x.dll" preCondition="b64"/></globalModules><modules><add name="n"/><add name="m" type="T.M"/></modules></system.webServer><location path="site"><system.webServer><modules><add name="l" type="T.L"/></modules></system.webServer></location></configuration>')
    got = sorted((m.module_name, m.module_kind, m.image_expanded, m.precondition, m.location_path) for m in T.normalize_iis_modules(spark, f"{tmp_path}/m.config").collect())
    assert got == [("l", "managed", "T.L", "", ""), ("l", "managed", "T.L", "", "site"), ("m", "managed", "T.M", "", ""), ("n", "native", "C:\\Windows\\x.dll", "b64", "")]
    df = spark.createDataFrame([(5, 1767225600, 0, "f", 0), (77, 0, 1767225601, "f", 1)], "ActivityType int, StartTime long, LastModifiedTime long, _file string, _row long")
    events = T.activity_events(df, "c", "e").orderBy("ts_utc").collect()
    assert [(e.artifact_id, e.ts_utc.second, '"activity_type":"' in e.payload_json, len(e.audit_id)) for e in events] == [("win10timeline", 0, True, 32), ("win10timeline", 1, True, 32)]
