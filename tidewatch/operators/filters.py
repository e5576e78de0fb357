"""Filters and projections over unified events, findings and catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cut, field_text, json_field, like_ci

# Event ids of high-volume channels, keys kept for each artifact, and event ids of each tactic.
NOISE_EVENT_IDS = ("4656", "4658", "4663", "4670", "4674", "4690", "4703", "5152", "5154", "5156", "5157", "5158")
KEPT_KEYS = {
    "evtx": ("EventId", "Channel", "MapDescription", "PayloadData1", "ExecutableInfo"),
    "hayabusa": ("RuleTitle", "Level", "Channel", "EventID", "Details"),
    "registry": ("HiveType", "Category", "KeyPath", "ValueName", "ValueData"),
    "lnk": ("SourceFile", "RelativePath", "WorkingDirectory", "TargetCreated", "FileSize"),
    "prefetch": ("executable", "run_count", "hash", "size_bytes"),
    "mft": ("ParentPath", "FileName", "Extension", "FileSize", "InUse"),
    "amcache": ("ApplicationName", "FullPath", "SHA1", "ProductName", "FileExtension"),
    "shellbags": ("BagPath", "AbsolutePath", "ShellType", "CreatedOn", "ModifiedOn"),
    "browser_history": ("browser_kind", "url", "title", "visit_count", "typed_count"),
    "jumplists": ("SourceFile", "AppId", "Path", "TargetCreated"),
    "recyclebin": ("SourceName", "FileSize", "DeletedOn"),
    "win10timeline": ("AppId", "AppName", "Payload", "StartTime"),
    "srum": ("AppId", "UserName", "BytesSent", "BytesRecvd"),
    "usn_journal": ("FileName", "Reason", "FullPath"),
    "collection_audit": ("path", "status", "category"),
}
# kind, artifact, argument: id (evtx event id), sysmon (evtx event id of that provider), hint (registry tactic), like (payload pattern), all (every row).
_E, _S, _H, _A = (lambda i: ("id", "evtx", i)), (lambda i: ("sysmon", "evtx", i)), (lambda t: ("hint", "registry", t)), (lambda a: ("all", a, ""))


def _like(artifact: str, *patterns: str) -> list[tuple[str, str, str]]:
    return [("like", artifact, x) for x in patterns]


TACTIC_CLAUSES: dict[str, list[tuple[str, str, str]]] = {
    "initial_access": [
        _E("4624"),
        _E("4625"),
        _E("4648"),
        _S("1"),
        *_like("registry", "%Office%TrustRecords%", "%Office%Security%VBAWarnings%"),
        *_like("evtx", "%ParentImage%chrome%", "%ParentImage%msedge%", "%ParentImage%outlook%", "%ParentImage%winword%", "%ParentImage%excel%"),
    ],
    "execution": [
        _E("4688"),
        _S("1"),
        _E("4697"),
        _E("7045"),
        _A("scheduled_tasks"),
        _A("prefetch"),
        _A("amcache"),
        *_like("evtx", "%Microsoft-Windows-PowerShell/Operational%"),
    ],
    "persistence": [
        _H("TA0003"),
        _A("scheduled_tasks"),
        *[_E(i) for i in ("4697", "7045", "4698", "4699", "4700", "4701", "4702", "4720", "4732", "4738", "4724")],
        _S("12"),
        _S("13"),
    ],
    "privilege_escalation": [_E("4672"), _E("4673"), _E("4674"), _H("TA0004"), _S("10"), *_like("evtx", "%LogonType%9%")],
    "defense_evasion": [
        _E("1102"),
        _E("104"),
        *_like("evtx", "%Microsoft-Windows-Windows Defender%", "%5001%"),
        _H("TA0005"),
        *_like("evtx", "%-EncodedCommand%", "%-WindowStyle Hidden%", "%mshta%", "%rundll32%", "%regsvr32%"),
        _S("12"),
        _S("13"),
    ],
    "credential_access": [
        _E("4768"),
        _E("4769"),
        _E("4776"),
        _E("4648"),
        _E("4740"),
        _S("10"),
        _H("TA0006"),
        *_like("registry", "%\\\\SAM\\\\Domains\\\\Account%", "%\\\\SECURITY\\\\Policy\\\\Secrets%"),
    ],
    "discovery": [
        _E("4688"),
        _S("1"),
        *_like(
            "evtx",
            "%whoami%",
            "%net.exe%user%",
            "%net.exe%group%",
            "%net.exe%localgroup%",
            "%ipconfig%",
            "%nltest%",
            "%tasklist%",
            "%systeminfo%",
            "%netstat%",
            "%arp -a%",
            "%route print%",
        ),
        _H("TA0007"),
    ],
    "lateral_movement": [
        *_like("evtx", '%"LogonType"%"3"%', '%"LogonType"%"10"%'),
        _E("4624"),
        _E("4625"),
        *_like("evtx", "%TerminalServices-RemoteConnectionManager%", "%TerminalServices-LocalSessionManager%", "%RdpCoreTS%"),
        _E("5140"),
        _E("5145"),
        *_like("evtx", "%Windows Remote Management%", "%WMI-Activity%"),
        _A("scheduled_tasks"),
        _H("TA0008"),
    ],
    "collection": [
        _S("11"),
        _E("4663"),
        _E("4656"),
        *_like("evtx", "%TargetFilename%\\\\Temp\\\\%", "%TargetFilename%\\\\AppData\\\\%", "%7z.exe%", "%winrar%", "%makecab%", "%Compress-Archive%"),
        _S("24"),
    ],
    "impact": [
        *_like(
            "evtx",
            "%vssadmin%delete%",
            "%wbadmin%delete%",
            "%wmic%shadowcopy%delete%",
            "%bcdedit%recoveryenabled%no%",
            "%bcdedit%bootstatuspolicy%ignoreallfailures%",
        ),
        _S("11"),
        _E("4660"),
        _E("7036"),
        *_like("evtx", "%stop-service%"),
        *_like("registry", "%\\\\BCD0%", "%VolumeSnapshots%"),
    ],
}


def query_events(df: DataFrame, *, case: str, artifact: str | None = None, evidence: str | None = None, audit: str | None = None, start=None, end=None, computer: str | None = None, contains: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Events that meet every given condition (start inclusive, end exclusive), by time and audit_id; a page of them."""
    out = df.where(F.col("case_id") == case)
    for name, value in (("artifact_id", artifact), ("evidence_id", evidence), ("audit_id", audit), ("computer", computer)):
        if value:
            out = out.where(F.col(name) == value)
    if start is not None:
        out = out.where(F.col("ts_utc") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.where(F.col("ts_utc") < F.lit(end).cast("timestamp_ntz"))
    if contains:
        out = out.where(F.col("payload_json").contains(contains))
    return out.orderBy(F.col("ts_utc").asc_nulls_last(), "audit_id").offset(offset).limit(limit)


def _like_cs(col: Column, pattern: str) -> Column:
    inner = pattern.strip("%")
    return col.contains(inner) if "%" not in inner and "_" not in inner else F.like(col, F.lit(pattern.replace("!", "!!")), F.lit("!"))


def tactic_predicate(tactic: str, artifacts: tuple[str, ...] | None = None) -> Column:
    """The OR of a tactic's clauses, those of the given artifacts only if any are given."""
    out, pay = F.lit(False), F.col("payload_json")
    for kind, artifact, arg in TACTIC_CLAUSES[tactic]:
        if artifacts and artifact not in artifacts:
            continue
        body = {
            "id": lambda a: pay.contains(f'"EventId": "{a}"'),
            "sysmon": lambda a: pay.contains("Microsoft-Windows-Sysmon") & pay.contains(f'"EventId": "{a}"'),
            "hint": pay.contains,
            "like": lambda a: _like_cs(pay, a),
            "all": lambda a: F.lit(True),
        }[kind](arg)
        out = out | ((F.col("artifact_id") == artifact) & body)
    return out


def tactic_events(df: DataFrame, tactic: str, artifact_scope: tuple[str, ...] | None = None, max_rows: int = 1000, offset: int = 0) -> DataFrame:
    """A page of a case's events of a tactic by time, each with the case's total and whether it was cut."""
    found = df.where(tactic_predicate(tactic, artifact_scope))
    totals = found.groupBy("case_id").agg(F.count("*").alias("total"))
    order = Window.partitionBy("case_id").orderBy(F.col("ts_utc").asc_nulls_last(), "audit_id")
    page = found.withColumn("r_", F.row_number().over(order)).where(F.col("r_") <= offset + max_rows).where(F.col("r_") > offset).drop("r_")
    return page.join(totals, "case_id").withColumn("truncated", F.col("total") > offset + max_rows)


def tactic_count(df: DataFrame, tactic: str) -> DataFrame:
    return df.where(tactic_predicate(tactic)).groupBy("case_id").agg(F.count("*").alias("n"))


def tactics_for_artifact(artifact: str) -> list[str]:
    return sorted(t for t, clauses in TACTIC_CLAUSES.items() if any(a == artifact for _, a, _ in clauses))


def drop_evtx_noise(df: DataFrame) -> DataFrame:
    """Without the high-volume event ids of evtx; rows without an id stay."""
    return df.where(~((F.col("artifact_id") == "evtx") & F.coalesce(json_field(F.col("payload_json"), "EventId"), F.lit("")).isin(*NOISE_EVENT_IDS)))


def events_by_ttp(df: DataFrame, case: str, technique: str, limit: int = 50) -> DataFrame:
    return df.where(
        (F.col("case_id") == case) & F.col("payload_json").contains(technique),
    ).orderBy(F.col("ts_utc").asc_nulls_last(), "audit_id").limit(max(1, min(500, limit)))


def filter_findings(f: DataFrame, source: str | None = None, rule_source: str | None = None, severity: str | None = None, review_state: str | None = None) -> DataFrame:
    for name, value in (("source", source), ("rule_source", rule_source), ("severity", severity), ("review_state", review_state)):
        if value:
            f = f.where(F.lower(name) == value.lower())
    return f


def search_findings(f: DataFrame, q: str) -> DataFrame:
    """Findings whose title, rule, skill, lens or techniques hold q; a blank q finds all."""
    have = [c for c in ("title", "rule_id", "skill", "lens") if c in f.columns]
    text = F.lower(F.concat_ws(" ", *have, F.array_join("techniques", " ")))
    return f.where(text.contains(q.strip().lower()))


def search_rules(rules: DataFrame, source: str | None = None, state: str | None = None, q: str = "", limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the rule catalog by source and rule, with the total on each row."""
    for name, value in (("source", source), ("state", state)):
        if value:
            rules = rules.where(F.col(name) == value)
    if q.strip():
        rules = rules.where(F.lower(F.concat_ws(" ", "rule_id", "title")).contains(q.strip().lower()))
    total = rules.agg(F.count("*").alias("total"))
    return rules.join(F.broadcast(total), how="cross").orderBy("source", "rule_id").offset(offset).limit(min(limit, 500))  # one row on the right


def drop_rejected(f: DataFrame) -> DataFrame:
    return f.where(~F.coalesce(F.col("rejected"), F.lit(False)))


def only_approved(f: DataFrame) -> DataFrame:
    return f.where(F.coalesce(F.col("approved"), F.lit(False)))


def shrink_payload(df: DataFrame, most: int = 200) -> DataFrame:
    """Adds payload: the artifact's kept keys with values of at most `most` characters, or an excerpt for other artifacts."""
    pay, out = F.col("payload_json"), F.create_map(F.lit("_excerpt"), cut(F.col("payload_json"), most))
    for artifact, keys in KEPT_KEYS.items():
        pairs = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), cut(field_text(pay, k), most).alias("value")) for k in keys]))
        out = F.when(F.col("artifact_id") == artifact, F.map_filter(pairs, lambda k, v: v.isNotNull())).otherwise(out)
    return df.withColumn("payload", out)


# The few keys that the older timeline shows of each artifact.
DIGEST_KEYS = {
    "evtx": ("Provider", "EventId", "Channel", "MapDescription"),
    "registry": ("Category", "KeyPath", "ValueName"),
    "scheduled_tasks": ("task_name", "run_as"),
    "prefetch": ("ExecutableName", "RunCount"),
    "amcache": ("FullPath", "amcache_table"),
}


def digest_payload(df: DataFrame) -> DataFrame:
    """Adds payload: the artifact's few keys, whole, as text; none for other artifacts; an excerpt of 120 characters (_raw) where the JSON is no object.

    A key that is there with a JSON null keeps a null.
    """
    pay = F.col("payload_json")
    none = F.create_map().cast("map<string,string>")
    out = none
    present = F.coalesce(F.json_object_keys(pay), F.array().cast("array<string>"))
    for artifact, keys in DIGEST_KEYS.items():
        pairs = F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*[json_field(pay, k) for k in keys]))
        out = F.when(F.col("artifact_id") == artifact, F.map_filter(pairs, lambda k, v: F.array_contains(F.col("keys_"), k))).otherwise(out)
    raw = F.create_map(F.lit("_raw"), F.when(F.length(pay) > 120, F.concat(F.substring(pay, 1, 120), F.lit("...[truncated]"))).otherwise(pay))
    return df.withColumn("keys_", present).withColumn("payload", F.when(F.json_object_keys(pay).isNull(), raw).otherwise(out)).drop("keys_")


def sample_schema(df: DataFrame, event_ids: int = 6, artifacts: int = 8) -> DataFrame:
    """One real payload for each evtx event id (the most frequent ones) and for each other artifact, with its top-level keys."""
    kind = F.when(
        F.col("artifact_id") == "evtx",
        F.concat(F.lit("evtx:"), F.coalesce(json_field(F.col("payload_json"), "EventId"), F.lit(""))),
    ).otherwise(F.col("artifact_id"))
    rows = df.withColumn("kind", kind)
    sizes = rows.groupBy("case_id", "kind").agg(F.count("*").alias("n"), F.min(F.struct("audit_id", "payload_json")).alias("s"))
    group = F.col("kind").startswith("evtx:")
    ranked = sizes.withColumn("r_", F.row_number().over(Window.partitionBy("case_id", group).orderBy(F.desc("n"), "kind")))
    return ranked.where((group & (F.col("r_") <= event_ids)) | (~group & (F.col("r_") <= artifacts))).select(
        "case_id",
        "kind",
        "n",
        "s.audit_id",
        F.array_sort(F.json_object_keys("s.payload_json")).alias("keys"),
        F.col("s.payload_json").alias("payload_json"),
    )


def all_null_projection(df: DataFrame, envelope: tuple[str, ...] = ("audit_id", "ts_utc", "artifact_id", "event_type")) -> DataFrame:
    """One row: whether there are rows and every other column is null or blank in all of them."""
    blank = F.lit(True)
    for c in (c for c in df.columns if c not in envelope):
        blank = blank & (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "")
    return df.agg(((F.count("*") > 0) & F.coalesce(F.every(blank), F.lit(False))).alias("all_null"))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "like_ci")]
