"""Corroboration and consistency checks: composed queries over findings, clusters and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import base_technique, canonical_tactic, event_data, evtx_time, is_web_root, json_field, phase_rank, time_change_benign
from ..model import seconds
from .aggregates import iocs_of
from .sessions import intrusion_path, temporal_outliers

# Words of noise narratives, and named claims with their aliases and grounding techniques.
NOISE_WORDS = (
    "誤検知",
    "false positive",
    "false-positive",
    "正規のインストール",
    "正規のバックグラウンド",
    "正規のソフトウェア",
    "legitimate install",
    "legitimate software",
    "benign system",
    "sysprep",
    "first boot",
    "初回ブート",
    "vm 作成",
    "vm作成",
    "os セットアップ",
)
CLAIMS = (
    ("Mimikatz", ("mimikatz",), ()),
    ("Cobalt Strike", ("cobalt strike", "cobaltstrike", "beacon"), ()),
    ("Metasploit/Meterpreter", ("metasploit", "meterpreter"), ()),
    ("Rubeus", ("rubeus",), ()),
    ("BloodHound", ("bloodhound", "sharphound"), ()),
    ("Impacket secretsdump", ("secretsdump", "impacket"), ()),
    ("LaZagne", ("lazagne",), ()),
    ("CrackMapExec", ("crackmapexec",), ()),
    ("PowerSploit", ("powersploit", "mimikittenz"), ()),
    ("Web shell", ("web shell", "webshell", "ウェブシェル", "web シェル"), ("T1505.003", "T1190")),
    ("Pass-the-Hash", ("pass-the-hash", "pass the hash", "passthehash", "パスザハッシュ", "パス・ザ・ハッシュ"), ("T1550.002",)),
)
# Marks of hedged prose.
HEDGES = (
    "ではなく", "ではない", "ではありません", "では無く", "証拠が無い", "証拠がない", "証拠は無い",
    "誤検知", "断定でき", "可能性", "未確認", "とは限らない", "確証", "裏付けられ", "示していません", "不明",
    "未裏付け", "裏付けが無い", "裏付けがない", "証跡が無い", "証跡がない", "証跡は無い",
    "no evidence", "false positive", "cannot confirm", "could not confirm",
    "unconfirmed", "rather than", "not confirmed", "is not ", "was not ",
)
# Words by which prose covers a tactic; marks of a security control in findings and in prose; severities that count.
TACTIC_WORDS = {
    "initial-access": ("初期アクセス", "initial access", "侵入経路", "phishing", "フィッシング", "exploit", "公開アプリ"),
    "execution": ("実行", "execution", "powershell", "コマンド", "script", "スクリプト", "wsmprovhost", "cmd.exe"),
    "persistence": ("永続化", "persistence", "subscription", "サブスクリプション", "scheduled task", "スケジュール", "run key", "自動実行", "wmi"),
    "privilege-escalation": ("権限昇格", "昇格", "privilege", "escalat", "uac", "token", "sid history"),
    "defense-evasion": ("防御回避", "回避", "evasion", "難読", "obfuscat", "disable", "無効化", "exclusion", "除外", "ログ削除", "clear log"),
    "credential-access": ("資格情報", "認証情報", "credential", "ダンプ", "dump", "lsass", "窃取", "パスワード", "password", "ハッシュ", "hash"),
    "discovery": ("偵察", "探索", "列挙", "discovery", "recon", "enumerat", "whoami", "nltest", "systeminfo", "ipconfig"),
    "lateral-movement": ("横展開", "横移動", "lateral", "remote", "リモート", "winrm", "psexec", "rdp", "wmi exec"),
    "collection": ("収集", "collection", "ステージング", "staging", "archive", "圧縮", "screenshot"),
    "command-and-control": ("c2", "command-and-control", "command and control", "ビーコン", "beacon", "外部通信", "外部接続", "コールバック"),
    "exfiltration": ("持ち出し", "流出", "exfiltrat", "アップロード", "upload", "送信", "転送", "transfer"),
    "impact": ("impact", "破壊", "暗号化", "ransom", "ランサム", "wipe", "destruction", "改ざん", "サービス停止"),
}
CONTROL_MARKS = (
    "defender",
    "antivirus",
    "anti-virus",
    "amsi",
    "applocker",
    "quarantine",
    "hacktool",
    "threat detected",
    "blocked",
    "prevented",
    "edr",
)
CONTROL_PROSE = ("defender", "antivirus", "anti-virus", "amsi", "applocker", "quarantine", "blocked", "検知", "遮断", "ブロック", "検疫", "防御製品", "セキュリティ製品")
SALIENT = ("critical", "high")
# Actions by tactic ("*": always), in the order in which each kind lists them.
ACTIONS = (
    ("credential-access", "containment", "Force-reset passwords for potentially compromised accounts and revoke active sessions"),
    ("credential-access", "eradication", "Double-reset the KRBTGT account and monitor for abuse of stolen credentials"),
    ("credential-access", "recovery", "Enforce multi-factor authentication for privileged accounts"),
    ("defense-evasion", "containment", "Enable centralized event-log forwarding (WEF/SIEM) to resist further tampering"),
    ("defense-evasion", "recovery", "Harden the audit policy and alert on log-clear events (EID 1102/104)"),
    ("execution", "containment", "Terminate the identified suspicious processes and quarantine the associated binaries"),
    ("execution", "eradication", "Remove dropped binaries (e.g. under C:\\Users\\Public)"),
    ("execution", "recovery", "Consider application allow-listing (WDAC/AppLocker)"),
    ("persistence", "eradication", "Remove malicious scheduled tasks, services and autorun entries"),
    ("lateral-movement", "containment", "Restrict RDP, admin shares and WMI; isolate affected hosts on the network"),
    ("lateral-movement", "eradication", "Identify and investigate candidate lateral-movement destination hosts"),
    ("initial-access", "containment", "Disable potentially compromised accounts and block internet-exposed RDP"),
    ("command-and-control", "containment", "Block communication to the identified C2 and isolate related hosts"),
    ("impact", "containment", "Isolate affected hosts to prevent further destructive actions"),
    ("impact", "eradication", "Verify the status of deleted shadow copies / backups"),
    ("impact", "recovery", "Validate recovery from offline, tamper-resistant backups"),
    ("*", "eradication", "Manually review every finding in this report and resolve the open questions"),
    ("*", "recovery", "After scoping is complete, consider clean rebuilds of compromised hosts"),
)
# What a tactic puts at risk; this library's own words.
AT_RISK = (
    ("credential-access", "account credentials"),
    ("collection", "user data"),
    ("exfiltration", "data that may have left"),
    ("impact", "system availability"),
)
WEB_ARTIFACTS = ("w3c_iis", "web_error", "iis_module")


def clock_reversed(df: DataFrame, threshold_s: int = 3600) -> DataFrame:
    """For each case, whether a clock change (4616) went back by more than the threshold other than through a time service."""
    pay = F.col("payload_json")
    rows = df.where((F.col("artifact_id") == "evtx") & (json_field(pay, "EventId") == "4616"))
    back = seconds(evtx_time(event_data(pay, "PreviousTime"))) - seconds(evtx_time(event_data(pay, "NewTime"))) > threshold_s
    hit = back & ~time_change_benign(event_data(pay, "SubjectUserSid"), event_data(pay, "SubjectUserName"))
    found = rows.groupBy("case_id").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("reversed"))
    return df.select("case_id").distinct().join(found, "case_id", "left").fillna(False, ["reversed"])


def web_server_present(df: DataFrame) -> DataFrame:
    pay = F.col("payload_json")
    hit = F.col("artifact_id").isin(*WEB_ARTIFACTS) | (
        (F.col("artifact_id") == "mft") & is_web_root(json_field(pay, "ParentPath"), json_field(pay, "FileName"))
    )
    return df.groupBy("case_id").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("web_server"))


def demote_techniques(mapping: DataFrame, context: DataFrame) -> DataFrame:
    """mapping (case_id, technique) with demoted and reason; context: case_id, web_server, n_burst_accounts, reversed."""
    m = mapping.join(context, "case_id", "left")
    web = F.col("technique").isin("T1190", "T1505.003") & ~F.coalesce("web_server", F.lit(False))
    pth = (F.col("technique") == "T1550.002") & (F.coalesce("n_burst_accounts", F.lit(0)) > 0)
    stomp = (F.col("technique") == "T1070.006") & F.coalesce("reversed", F.lit(False))
    reason = F.when(web, "no web server artifact").when(pth, "password guessing explains the logon").when(stomp, "clock reversal explains the times")
    return m.withColumn("reason", reason).withColumn("demoted", F.col("reason").isNotNull()).select(*mapping.columns, "demoted", "reason")


def timeline_reliability(clusters: DataFrame, clock: DataFrame) -> DataFrame:
    o = temporal_outliers(clusters).groupBy("case_id").agg(F.bool_or("outlier").alias("o_"))
    out = o.join(clock, "case_id", "left").fillna(False, ["o_", "reversed"])
    notes = F.array_compact(
        F.array(
            F.when(F.col("reversed"), F.lit("clock reversal")),
            F.when(F.col("o_"), F.lit("cluster far from the others")),
            F.when(F.col("reversed") | F.col("o_"), F.lit("provisioning or clock correction first")),
        ),
    )
    return out.select(
        "case_id",
        F.when(F.col("reversed") | F.col("o_"), "unreliable").otherwise("reliable").alias("reliability"),
        notes.alias("notes"),
    )


def is_benign_cluster(phase: Column, findings: Column, outlier: Column) -> Column:
    grave = F.exists(findings, lambda f: F.lower(F.trim(f["severity"])).isin("high", "critical"))
    return outlier | ((F.lower(F.trim(phase)) == "noise") & ~F.coalesce(grave, F.lit(False)))


def is_noise_cluster(phase: Column, narrative: Column) -> Column:
    p, text = F.lower(F.trim(F.coalesce(phase, F.lit("")))), F.lower(F.coalesce(narrative, F.lit("")))
    word = F.lit(False)
    for w in NOISE_WORDS:
        word = word | text.contains(w)
    return p.isin("", "unknown", "noise") | word


def claims_table(df: DataFrame) -> DataFrame:
    rows = [(label, a, list(t)) for label, aliases, t in CLAIMS for a in aliases]
    return df.sparkSession.createDataFrame(rows, "label string, alias string, techniques array<string>")


def _mentions(df: DataFrame, text: str) -> DataFrame:
    """df's key columns with label and techniques for each claim that the text names: one pass, no join; a text is lowered once."""
    df = df.withColumn("low_", F.lower(F.coalesce(F.col(text), F.lit(""))))
    low = F.col("low_")
    hits = []
    for label, aliases, techniques in CLAIMS:
        said = F.lit(False)
        for a in aliases:
            said = said | low.contains(a)
        hits.append(F.when(said, F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, techniques)).cast("array<string>").alias("techniques"))))
    return df.withColumn("m_", F.explode(F.array_compact(F.array(*hits)))).select("*", "m_.label", "m_.techniques").drop("m_", "low_")


def uncorroborated_claims(mapping: DataFrame) -> DataFrame:
    """Labels of the technique-gated claims whose technique is demoted. mapping: case_id, technique, demoted."""
    gated = claims_table(mapping).where(F.size("techniques") > 0).select("label", F.explode("techniques").alias("technique")).distinct()
    return mapping.where("demoted").join(F.broadcast(gated), "technique").select("case_id", "label").distinct()


def ungrounded_mentions(prose: DataFrame, findings: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(doc_id, case_id, label) of claims a text makes without ground: tools need a finding of the case that names them, others a confirmed technique."""
    said = _mentions(prose.select("case_id", "doc_id", "text"), "text").drop("text")
    named = _mentions(
        findings.select(
            "case_id",
            F.concat_ws(
                " ",
                "title",
                "rule_id",
                "source",
                F.array_join(F.flatten(F.transform("evidence", lambda e: F.map_values(e["extra"]))), " "),
            ).alias("g_"),
        ),
        "g_",
    ).where(F.size("techniques") == 0).select("case_id", "label").distinct()
    gated = claims_table(confirmed).select("label", F.explode("techniques").alias("technique")).distinct()
    backed = confirmed.select("case_id", "technique").join(F.broadcast(gated), "technique").select("case_id", "label").distinct()
    grounded = named.union(backed)  # the labels of a case that have ground: at most one row a claim
    return said.select("case_id", "doc_id", "label").join(grounded, ["case_id", "label"], "left_anti").select("case_id", "doc_id", "label").distinct()


def asserted_mentions(mentions: DataFrame, prose: DataFrame) -> DataFrame:
    """Mentions (doc_id, label) without those whose every sentence is hedged; labels that no sentence names stay."""
    sentences = prose.select("doc_id", F.explode(F.split("text", r"[。．.！!？?\n\r；;]+")).alias("sentence"))
    hedged = F.lit(False)
    for h in HEDGES:
        hedged = hedged | F.lower("sentence").contains(h)
    named = _mentions(sentences, "sentence").groupBy("doc_id", "label").agg(F.every(hedged).alias("all_hedged"))
    return mentions.join(named, ["doc_id", "label"], "left").where(~F.coalesce("all_hedged", F.lit(False))).drop("all_hedged")


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def coverage_gaps(clusters: DataFrame) -> DataFrame:
    """Activity of a cluster's critical and high findings that its narrative has no word for: by tactic, or 'security-control'.

    clusters: case_id, cluster_id, narrative, findings (title, source, rule_id, severity, tactics). Findings that name a
    security control or a block count under 'security-control' alone, the others under their first tactic; unknown tactics
    are left out.
    """
    f = F.col("f")
    rows = clusters.select("case_id", "cluster_id", F.lower(F.coalesce("narrative", F.lit(""))).alias("prose"), F.explode("findings").alias("f"))
    rows = rows.where(F.lower(F.trim(f["severity"])).isin(*SALIENT))
    control = _holds(F.lower(F.concat_ws(" ", f["title"], f["source"], f["rule_id"])), CONTROL_MARKS)
    rows = rows.withColumn("tactic", F.when(control, "security-control").otherwise(canonical_tactic(F.get(f["tactics"], F.lit(0)))))
    missing = F.when(F.col("tactic") == "security-control", ~_holds(F.col("prose"), CONTROL_PROSE))
    for tactic, words in TACTIC_WORDS.items():
        missing = missing.when(F.col("tactic") == tactic, ~_holds(F.col("prose"), words))
    return rows.where(missing).groupBy("case_id", "cluster_id", "tactic").agg(F.count("*").alias("n_findings"))


def check_case_consistency(f: DataFrame, events: DataFrame) -> DataFrame:
    """R1 cleared logs with fewer than two lateral or credential findings; R2 persistence without execution artifacts; R3 lateral movement with one host; R4 execution before initial access.

    f: case_id, finding_id, tactics (ids), techniques, evidence.
    """
    has = lambda t: F.array_contains("tactics", t)
    cleared = F.exists("techniques", lambda t: t.startswith("T1070.001")) & has("TA0005")
    first = F.array_min(F.transform("evidence", lambda e: e["ts_utc"]))
    runs = F.exists("evidence", lambda e: e["artifact_id"].isin("prefetch", "amcache"))
    per = f.groupBy("case_id").agg(
        F.count_if(cleared).alias("cleared"),
        F.count_if(has("TA0008")).alias("lateral"),
        F.count_if(has("TA0006")).alias("credential"),
        F.count_if(has("TA0003")).alias("persistent"),
        F.count_if(has("TA0003") & runs).alias("backed"),
        F.min(F.when(has("TA0002"), first)).alias("t_exec"),
        F.min(F.when(has("TA0001"), first)).alias("t_entry"),
    )
    ev = events.groupBy("case_id").agg(
        F.count_if(F.col("artifact_id").isin("prefetch", "amcache")).alias("n_runs"),
        F.countDistinct(F.nullif(F.trim("computer"), F.lit(""))).alias("n_hosts"),
    )
    j = per.join(ev, "case_id", "left").fillna(0, ["n_runs", "n_hosts"])
    issue = lambda rule, cond, sev: F.when(cond, F.struct(F.lit(rule).alias("rule"), sev.alias("severity")))
    warn = F.lit("warning")
    issues = F.array_compact(
        F.array(
            issue("R1", (F.col("cleared") > 0) & ~((F.col("lateral") >= 2) & (F.col("credential") >= 2)), warn),
            issue(
                "R2",
                (F.col("persistent") > 0) & ((F.col("n_runs") == 0) | (F.col("backed") == 0)),
                F.when(F.col("n_runs") == 0, "info").otherwise("warning"),
            ),
            issue("R3", (F.col("lateral") > 0) & (F.col("n_hosts") < 2), warn),
            issue("R4", F.col("t_exec") < F.col("t_entry"), warn),
        )
    )
    return j.select("case_id", F.explode(issues).alias("i_")).select("case_id", "i_.*").orderBy("case_id", "rule")


def affected_scope(f: DataFrame, cap: int = 25) -> DataFrame:
    """For each case: hosts and accounts among the indicators that are not noise, at most cap each, and data at risk by tactic."""
    rows = iocs_of(f).where("confidence != 'noise'")
    pick = lambda t: F.slice(F.array_sort(F.collect_set(F.when(F.col("type") == t, F.col("value")))), 1, cap)
    names = rows.groupBy("case_id").agg(pick("host").alias("hosts"), pick("account").alias("accounts"))
    tactics = f.select("case_id", F.explode("tactics").alias("t")).groupBy("case_id").agg(F.collect_set("t").alias("t_"))
    risk = F.array_compact(F.array(*[F.when(F.array_contains("t_", t), F.lit(x)) for t, x in AT_RISK]))
    return names.join(tactics, "case_id", "full").select("case_id", "hosts", "accounts", risk.alias("data_at_risk"))


def check_report_consistency(cases: DataFrame, confirmed: DataFrame, unconfirmed: DataFrame, f: DataFrame) -> DataFrame:
    """Six checks of a report. cases: case_id, entry_unknown, asserts_earliest, reliability, tech_summary, exec_brief, ungrounded; confirmed, unconfirmed: case_id, technique."""
    hedged = lambda c: F.exists(F.array(*map(F.lit, HEDGES)), lambda h: F.lower(c).contains(h))
    entry = entry_vector(confirmed).select("case_id").distinct().withColumn("has_entry", F.lit(True))
    c = cases.join(entry, "case_id", "left")
    c1 = c.where(F.col("entry_unknown") & F.col("has_entry")).select(
        "case_id",
        F.lit("intrusion-path-contradicts-entry-vector").alias("code"),
        F.lit("blocker").alias("severity"),
        F.lit("").alias("detail"),
    )
    c2 = c.where((F.lower("reliability") == "unreliable") & F.col("asserts_earliest")).select(
        "case_id",
        F.lit("earliest-claim-on-unreliable-timeline").alias("code"),
        F.lit("warning").alias("severity"),
        F.lit("").alias("detail"),
    )
    c3 = technique_conflicts(confirmed, unconfirmed).select("case_id", F.lit("technique-confirmed-and-unconfirmed"), F.lit("warning"), "technique")
    said = _mentions(
        cases.where(~hedged(F.coalesce("tech_summary", F.lit("")))).select("case_id", "tech_summary"),
        "tech_summary",
    ).select("case_id", "label", F.explode("techniques").alias("technique"))
    c4 = said.join(unconfirmed.select("case_id", "technique"), ["case_id", "technique"], "left_semi").select(
        "case_id",
        F.lit("demoted-technique-asserted-in-prose"),
        F.lit("warning"),
        "label",
    ).distinct()
    brief = _mentions(cases.where(~hedged(F.coalesce("exec_brief", F.lit("")))).select("case_id", "exec_brief", "ungrounded"), "exec_brief")
    c5 = brief.where(F.array_contains("ungrounded", F.col("label"))).select(
        "case_id",
        F.lit("ungrounded-mention-in-exec-brief"),
        F.lit("warning"),
        "label",
    )
    noise = iocs_of(f).where("confidence = 'noise' AND type IN ('host', 'account')").select("case_id", F.lower("value").alias("v_"))
    scope = affected_scope(f).select("case_id", F.explode(F.concat("hosts", "accounts")).alias("v"))
    c6 = scope.join(
        noise,
        (scope["case_id"] == noise["case_id"]) & (F.lower(scope["v"]) == noise["v_"]),
        "left_semi",
    ).select("case_id", F.lit("noise-ioc-in-affected-scope"), F.lit("warning"), "v")
    return c1.union(c2).union(c3).union(c4).union(c5).union(c6)


def technique_conflicts(confirmed: DataFrame, unconfirmed: DataFrame) -> DataFrame:
    return confirmed.select("case_id", "technique").intersect(unconfirmed.select("case_id", "technique"))


def technique_union(clusters: DataFrame) -> DataFrame:
    """Adds techniques: the standard ids of the cluster's findings, once each, sorted."""
    ids = F.filter(F.flatten(F.transform("findings", lambda f: f["techniques"])), lambda t: t.rlike(r"^T\d{4}(\.\d{3})?$"))
    return clusters.withColumn("techniques", F.array_sort(F.array_distinct(ids)))


def merge_open_questions(clusters: DataFrame) -> DataFrame:
    """Trimmed questions once each, in the order of cluster and place."""
    rows = clusters.select("case_id", "cluster_id", F.posexplode("open_questions").alias("i", "q")).withColumn("q", F.trim("q")).where("q != ''")
    return rows.groupBy("case_id", "q").agg(F.min(F.struct("cluster_id", "i")).alias("first")).orderBy("case_id", "first").select("case_id", F.col("q").alias("question"))


def entry_vector(mapping: DataFrame) -> DataFrame:
    """Techniques of the entry: those of initial access, else T1110, T1078 and T1133 by their base ids. mapping: case_id, technique (tactic optional)."""
    tactic = F.col("tactic") if "tactic" in mapping.columns else F.lit(None)
    entry = base_technique(F.col("technique")).isin("T1190", "T1566", "T1189", "T1195", "T1200", "T1091") | F.coalesce(tactic == "initial-access", F.lit(False))
    other = base_technique(F.col("technique")).isin("T1110", "T1078", "T1133")
    rows = mapping.withColumn("p_", F.when(entry, 1).when(other, 2)).where("p_ IS NOT NULL")
    best = rows.groupBy("case_id").agg(F.min("p_").alias("b_"))
    return rows.join(best, "case_id").where("p_ = b_").drop("p_", "b_")


def recommendations(f: DataFrame) -> DataFrame:
    """case_id, kind, place, action, tactic: the actions for the tactics of each case and the general ones, numbered within their kind."""
    rows = [(t, kind, i, action) for i, (t, kind, action) in enumerate(ACTIONS)]
    table = f.sparkSession.createDataFrame(rows, "tactic string, kind string, i int, action string")
    tactics = f.select("case_id", F.explode("tactics").alias("tactic")).union(f.select("case_id", F.lit("*").alias("tactic"))).distinct()
    place = F.row_number().over(Window.partitionBy("case_id", "kind").orderBy("i"))
    return tactics.join(F.broadcast(table), "tactic").withColumn("place", place).select("case_id", "kind", "place", "action", "tactic")


def timeline_view(f: DataFrame, clustered: DataFrame, noise: DataFrame | None = None) -> DataFrame:
    """Flat timeline of evidence with the cluster of its finding (0: none), and whether that cluster is noise.

    noise: case_id, cluster_id, noise.
    """
    rows = f.select("case_id", "finding_id", "title", "severity", F.explode("evidence").alias("e")).select(
        "case_id",
        "finding_id",
        "title",
        "severity",
        "e.audit_id",
        "e.ts_utc",
        "e.artifact_id",
    )
    return timeline_rows(rows, clustered, noise).orderBy("case_id", F.col("ts_utc").asc_nulls_last(), "audit_id")


def timeline_rows(rows: DataFrame, clustered: DataFrame, noise: DataFrame | None = None) -> DataFrame:
    """The rows of timeline_view, unordered, where the evidence lies in rows: case_id, finding_id, title, severity, audit_id, ts_utc, artifact_id."""
    rows = rows.select("case_id", "finding_id", "title", "severity", "audit_id", "ts_utc", "artifact_id")
    out = rows.join(clustered.select("case_id", "finding_id", "cluster_id"), ["case_id", "finding_id"], "left").fillna(0, ["cluster_id"])
    marks = clustered.select("case_id", "cluster_id").distinct().withColumn("noise", F.lit(False)) if noise is None else noise.select("case_id", "cluster_id", "noise")
    return out.join(marks, ["case_id", "cluster_id"], "left").fillna(False, ["noise"])


def timeline_clusters(timeline: DataFrame, clusters: DataFrame) -> DataFrame:
    """Cluster rows of the view: phase and its rank, times, techniques, noise, how many timeline rows each has, and its step.

    clusters: case_id, cluster_id, attack_phase, start_ts, end_ts, narrative, techniques. Steps number the clusters that are not
    noise by phase and start (intrusion_path); noise has none.
    """
    counts = timeline.where("cluster_id != 0").groupBy("case_id", "cluster_id").agg(F.count("*").alias("event_count"))
    marked = clusters.withColumn(
        "noise",
        is_noise_cluster(F.col("attack_phase"), F.col("narrative")),
    ).withColumn("phase_rank", phase_rank(F.col("attack_phase")))
    steps = intrusion_path(marked).select("case_id", "cluster_id", "step")
    out = marked.join(counts, ["case_id", "cluster_id"], "left").join(steps, ["case_id", "cluster_id"], "left")
    return out.select(
        "case_id",
        "cluster_id",
        "attack_phase",
        "phase_rank",
        "start_ts",
        "end_ts",
        "narrative",
        "techniques",
        "noise",
        F.coalesce("event_count", F.lit(0)).cast("long").alias("event_count"),
        "step",
    )


def promotable_queries(f: DataFrame, source: DataFrame) -> DataFrame:
    """Distinct statement hashes whose rows findings cite. source: audit_id, sql_sha256."""
    cited = f.select(F.explode("evidence").alias("e")).select(F.col("e.audit_id").alias("audit_id")).distinct()
    return source.join(cited, "audit_id", "left_semi").select("sql_sha256").distinct()


def promote(skills: DataFrame, hashes: DataFrame, case: str) -> DataFrame:
    hit = hashes.select("sql_sha256", F.lit(True).alias("h_")).distinct()
    out = skills.join(hit, "sql_sha256", "left")
    return out.withColumn("state", F.when(F.col("h_"), "canonical").otherwise(F.col("state"))).withColumn("hit_count", F.col("hit_count") + F.when(F.col("h_"), 1).otherwise(0)).withColumn(
        "last_used_case",
        F.when(F.col("h_"), F.lit(case)).otherwise(F.col("last_used_case")),
    ).select(*skills.columns)


def prune(skills: DataFrame, older_than) -> DataFrame:
    return skills.where(~((F.col("hit_count") == 0) & (F.col("created_at") < F.lit(older_than))))


def insert_candidates(skills: DataFrame, new: DataFrame) -> DataFrame:
    fresh = new.dropDuplicates(["skill", "sql_sha256"]).join(skills.select("skill", "sql_sha256"), ["skill", "sql_sha256"], "left_anti")
    return skills.unionByName(fresh, allowMissingColumns=True)


def union_findings(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
