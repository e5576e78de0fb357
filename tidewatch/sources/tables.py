"""Tool output, browser tables, XML, JSON: normalisers from raw tables to unified events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import any_time, expand_env, prtime_ts, registry_tactic_hints, task_hints, webkit_ts
from ..model import EVENT_COLUMNS, EVENT_SCHEMA, make_event


def read_unified_jsonl(spark: SparkSession, path: str, case: str, evidence: str) -> DataFrame:
    """NDJSON events: bad lines are skipped, a bad or blank time is null, missing text is '', the payload stays text, a null payload is '{}'."""
    schema = "artifact_id string, audit_id string, timestamp string, event_type string, computer string, payload string"
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select(
        F.lit(case).alias("case_id"),
        F.lit(evidence).alias("evidence_id"),
        text("artifact_id").alias("artifact_id"),
        text("audit_id").alias("audit_id"),
        any_time(F.col("timestamp")).alias("ts_utc"),
        text("event_type").alias("event_type"),
        text("computer").alias("computer"),
        F.coalesce("payload", F.lit("{}")).alias("payload_json"),
    )


@dataclass(frozen=True)
class CsvSpec:
    """A tool's CSV: artifact, event type, time columns in order of preference, computer column."""

    artifact: str
    event_type: str
    times: tuple[str, ...]
    computer: str | None = None


# Time columns of the tools' CSVs.
SPECS = {
    "mft": CsvSpec("mft", "mft_entry", ("Created0x10", "LastModified0x10", "LastRecordChange0x10", "LastAccess0x10")),
    "jumplists": CsvSpec("jumplists", "jumplist_entry", ("LastModified", "TargetCreated", "SourceCreated")),
    "lnk": CsvSpec("lnk", "lnk_file", ("SourceModified", "TargetModified", "SourceCreated")),
    "recyclebin": CsvSpec("recyclebin", "recyclebin_entry", ("DeletedOn",)),
    "shellbags": CsvSpec("shellbags", "shellbag", ("LastWriteTime", "FirstInteracted", "LastInteracted")),
    "shimcache": CsvSpec("shimcache", "shimcache_entry", ("LastModifiedTimeUTC",)),
    "usn_journal": CsvSpec("usn_journal", "usn_record", ("UpdateTimestamp", "Timestamp")),
    "evtx": CsvSpec("evtx", "evtx", ("TimeCreated",), "Computer"),
    "hayabusa": CsvSpec("hayabusa", "hayabusa_alert", ("Timestamp",), "Computer"),
    "registry": CsvSpec("registry", "registry_entry", ("LastWriteTimestamp",)),
}
EVTX_COLUMNS = ("EventId", "Channel", "Provider", "Level", "UserId", "MapDescription", "PayloadData1", "PayloadData2", "ExecutableInfo")
AMCACHE_TIMES = {
    "ProgramEntries": "KeyLastWriteTimestamp",
    "UnassociatedFileEntries": "FileKeyLastWriteTimestamp",
    "AssociatedFileEntries": "FileKeyLastWriteTimestamp",
    "DriverBinaries": "KeyLastWriteTimestamp",
    "DevicePnps": "KeyLastWriteTimestamp",
    "ShortCuts": "KeyLastWriteTimestamp",
}


#: Columns that place a row: its file, the offset of its block there, and an ascending number within the block.
PLACE = ("_file", "_block", "_row")
#: Tools whose cells hold line breaks. Their files cannot be split; all others are read in blocks.
BROKEN_LINES = ("evtx", "hayabusa", "registry", "prefetch", "amcache")


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Header CSVs (a byte-order mark goes) as text columns, with each row's place."""
    raw = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    placed = raw.select(
        *[F.col(f"`{c}`").alias(c.lstrip("﻿")) for c in raw.columns],
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )
    return placed.withColumn("_row", F.monotonically_increasing_id())


def _first_time(df: DataFrame, names: tuple[str, ...]) -> Column:
    have = [any_time(F.regexp_replace(F.col(f"`{c}`"), r" ([+-]\d{2}:?\d{2})$", "$1")) for c in names if c in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("timestamp_ntz")


def indexed(df: DataFrame) -> DataFrame:
    """_i: the row's number within its file: the rows of the blocks before it, and its number within its own block.

    No task holds more than a block of a file. Tables without blocks count as one block a file.
    """
    rows = df if "_block" in df.columns else df.withColumn("_block", F.lit(0).cast("long"))
    sizes = rows.groupBy("_file", "_block").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_row"))
    return rows.withColumn("own_", own).join(
        sizes.select("_file", "_block", before.alias("before_")),
        ["_file", "_block"],
    ).withColumn("_i", F.col("before_") + F.col("own_") - 1).drop("own_", "before_")


def _own(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in PLACE]


def normalize_csv(df: DataFrame, spec: CsvSpec, case: str, evidence: str, payload: Column | None = None, event_type: Column | None = None, ts: Column | None = None) -> DataFrame:
    """Rows of read_csv, or any table of text columns with _file and _row, as events of the spec: the whole row is the payload."""
    own = _own(df)
    computer = F.col(f"`{spec.computer}`") if spec.computer in own else F.lit("")
    rows = indexed(df)
    return make_event(
        rows,
        case=F.lit(case),
        evidence=F.lit(evidence),
        artifact=F.lit(spec.artifact),
        index=F.col("_i"),
        ts=_first_time(df, spec.times) if ts is None else ts,
        event_type=F.lit(spec.event_type) if event_type is None else event_type,
        computer=computer,
        payload=F.struct(*[F.col(f"`{c}`") for c in own]) if payload is None else payload,
    )


def read_tool_csv(spark: SparkSession, path: str, artifact: str, case: str, evidence: str) -> DataFrame:
    return normalize_csv(read_csv(spark, path, artifact in BROKEN_LINES), SPECS[artifact], case, evidence)


def normalize_evtx(df: DataFrame, case: str, evidence: str) -> DataFrame:
    own = _own(df)
    raw = F.struct(*[F.col(f"`{c}`") for c in own]).alias("raw")
    return normalize_csv(df, SPECS["evtx"], case, evidence, F.struct(*[F.col(c) for c in EVTX_COLUMNS if c in own], raw))


def normalize_hayabusa(df: DataFrame, case: str, evidence: str) -> DataFrame:
    return normalize_csv(df, SPECS["hayabusa"], case, evidence)


def normalize_registry(df: DataFrame, case: str, evidence: str) -> DataFrame:
    own = _own(df)
    get = lambda c: F.col(c) if c in own else F.lit("")
    hints = registry_tactic_hints(get("Category"), get("KeyPath"), get("ValueName")).alias("tactic_hints")
    return normalize_csv(df, SPECS["registry"], case, evidence, F.struct(*[F.col(f"`{c}`") for c in own], hints))


def normalize_usn(df: DataFrame, case: str, evidence: str) -> DataFrame:
    return normalize_csv(df, SPECS["usn_journal"], case, evidence)


def _table_of(file: Column) -> Column:
    return F.regexp_extract(file, r"_([A-Za-z0-9]+)\.csv$", 1)


def normalize_amcache(df: DataFrame, case: str, evidence: str) -> DataFrame:
    """The table in the file's name picks the time column; it is added to the payload."""
    own = _own(df)
    ts = F.lit(None).cast("timestamp_ntz")
    for table, col in AMCACHE_TIMES.items():
        if col in own:
            ts = F.when(_table_of(F.col("_file")) == table, any_time(F.col(col))).otherwise(ts)
    payload = F.struct(*[F.col(f"`{c}`") for c in own], _table_of(F.col("_file")).alias("amcache_table"))
    return normalize_csv(df, CsvSpec("amcache", "amcache_entry", ()), case, evidence, payload, ts=ts)


def normalize_srum(df: DataFrame, case: str, evidence: str) -> DataFrame:
    spec = CsvSpec("srum", "srum", ("Timestamp", "TimeStamp", "EndTime", "ConnectStartTime"))
    return normalize_csv(df, spec, case, evidence, event_type=F.concat(F.lit("srum_"), F.lower(_table_of(F.col("_file")))))


def explode_prefetch_runs(df: DataFrame, case: str, evidence: str) -> DataFrame:
    """One event for each execution: LastRun always, PreviousRun0 to 6 where they are times."""
    runs = [("LastRun", True)] + [(f"PreviousRun{i}", False) for i in range(7)]
    each = F.array(*[F.struct(F.lit(n).alias("kind"), any_time(F.col(n)).alias("ts"), F.lit(a).alias("always")) for n, a in runs if n in df.columns])
    rows = indexed(df).withColumn("r_", F.explode(F.filter(each, lambda x: x["always"] | x["ts"].isNotNull())))
    get = lambda c: (F.col(c) if c in df.columns else F.lit("")).alias
    payload = F.struct(
        get("ExecutableName")("executable"),
        get("Hash")("hash"),
        get("Size")("size_bytes"),
        get("RunCount")("run_count"),
        get("FilesLoaded")("files_loaded"),
        F.col("r_.kind").alias("run_kind"),
    )
    return make_event(
        rows,
        case=F.lit(case),
        evidence=F.lit(evidence),
        artifact=F.lit("prefetch"),
        index=F.concat_ws(":", F.col("_i").cast("string"), F.col("r_.kind")),
        ts=F.col("r_.ts"),
        event_type=F.lit("prefetch_run"),
        computer=F.lit(""),
        payload=payload,
    )


def normalize_plaso(df: DataFrame, artifact: str, case: str, evidence: str) -> DataFrame:
    """Rows with an offset-aware datetime column, as UTC at second precision; bad text gives null."""
    spec = CsvSpec(artifact, f"{artifact}_plaso", ())
    return normalize_csv(df, spec, case, evidence, ts=F.date_trunc("second", any_time(F.col("datetime")).cast("timestamp")).cast("timestamp_ntz"))


# Codes of browser visits and activities.
CHROMIUM = {
    0: "link",
    1: "typed",
    2: "auto_bookmark",
    3: "auto_subframe",
    4: "manual_subframe",
    5: "generated",
    6: "start_page",
    7: "form_submit",
    8: "reload",
    9: "keyword",
    10: "keyword_generated",
}
FIREFOX = {
    1: "link",
    2: "typed",
    3: "bookmark",
    4: "embed",
    5: "redirect_permanent",
    6: "redirect_temporary",
    7: "download",
    8: "framed_link",
    9: "reload",
}
ACTIVITY = {2: "notification", 3: "mobile_backup", 5: "open_app", 6: "in_use", 10: "clipboard", 16: "copy_paste"}


def _decoded(col: Column, table: dict[int, str]) -> Column:
    out = F.concat(F.lit("unknown("), col.cast("string"), F.lit(")"))
    for k, v in table.items():
        out = F.when(col == k, F.lit(v)).otherwise(out)
    return out


def browser_visits_chromium(visits: DataFrame, urls: DataFrame) -> DataFrame:
    """Visits with their page, decoded transition and the page they came from. visits: id, url, visit_time, from_visit, transition; urls: id, url, title, visit_count, typed_count."""
    v = visits.select(
        F.col("id").alias("visit_id"),
        F.col("url").alias("u_"),
        "visit_time",
        "from_visit",
        F.coalesce("transition", F.lit(0)).alias("transition_raw"),
    )
    u = urls.select(F.col("id").alias("u_"), "url", "title", "visit_count", "typed_count")
    came = visits.select(F.col("id").alias("from_visit"), F.col("url").alias("ru_")).join(
        urls.select(F.col("id").alias("ru_"), F.col("url").alias("referrer_url")),
        "ru_",
        "left",
    ).select("from_visit", "referrer_url")
    code = F.col("transition_raw").bitwiseAND(255)
    return v.join(u, "u_").join(came, "from_visit", "left").select(
        "visit_id",
        webkit_ts(F.col("visit_time")).alias("ts_utc"),
        "url",
        "title",
        "visit_count",
        "typed_count",
        _decoded(code, CHROMIUM).alias("transition"),
        "referrer_url",
    )


def browser_visits_firefox(history: DataFrame, places: DataFrame) -> DataFrame:
    """As browser_visits_chromium for history (id, place_id, visit_date, from_visit, visit_type) and places (id, url, title, visit_count, typed)."""
    v = history.select(F.col("id").alias("visit_id"), "place_id", "visit_date", "from_visit", "visit_type")
    u = places.select(F.col("id").alias("place_id"), "url", "title", "visit_count", F.col("typed").alias("typed_count"))
    came = history.select(F.col("id").alias("from_visit"), F.col("place_id").alias("rp_")).join(
        places.select(F.col("id").alias("rp_"), F.col("url").alias("referrer_url")),
        "rp_",
        "left",
    ).select("from_visit", "referrer_url")
    return v.join(u, "place_id").join(came, "from_visit", "left").select(
        "visit_id",
        prtime_ts(F.col("visit_date")).alias("ts_utc"),
        "url",
        "title",
        "visit_count",
        "typed_count",
        _decoded(F.col("visit_type"), FIREFOX).alias("transition"),
        "referrer_url",
    )


# The kinds of triggers and actions of a scheduled task, and the fields of each.
TRIGGERS = (
    "BootTrigger",
    "RegistrationTrigger",
    "IdleTrigger",
    "TimeTrigger",
    "EventTrigger",
    "LogonTrigger",
    "SessionStateChangeTrigger",
    "CalendarTrigger",
    "WnfStateChangeTrigger",
)
TRIGGER_FIELDS = {"start_boundary": "StartBoundary", "enabled": "Enabled", "execution_time_limit": "ExecutionTimeLimit"}
TASK_ACTIONS = {
    "Exec": {"command": "Command", "arguments": "Arguments", "working_directory": "WorkingDirectory"},
    "ComHandler": {"class_id": "ClassId", "data": "Data"},
    "SendEmail": {"to": "To", "subject": "Subject"},
}


def _kinds_schema(kinds: dict[str, tuple[str, ...]]) -> str:
    return ",".join(f"{kind}:array<struct<{','.join(f'{f}:string' for f in fields)}>>" for kind, fields in kinds.items())


TASK_XML = (
    "RegistrationInfo struct<Author:string,Date:string,Description:string>, Principals struct<Principal:array<struct<UserId:string>>>, "
    f"Triggers struct<{_kinds_schema({t: tuple(TRIGGER_FIELDS.values()) for t in TRIGGERS})}>, "
    f"Actions struct<{_kinds_schema({t: tuple(f.values()) for t, f in TASK_ACTIONS.items()})}>"
)


def _entries(parent: str, kinds: dict[str, dict[str, str]]) -> Column:
    """One array over all kinds of children: type and the fields of any kind, '' where the child lacks one, null where its kind does."""
    names = list(dict.fromkeys(n for fields in kinds.values() for n in fields))
    empty = F.array().cast(f"array<struct<type:string,{','.join(f'{n}:string' for n in names)}>>")

    def made(kind: str, fields: dict[str, str]) -> Column:
        field = lambda x, n: (F.coalesce(F.trim(x[fields[n]]), F.lit("")) if n in fields else F.lit(None).cast("string")).alias(n)
        return F.coalesce(F.transform(F.col(f"{parent}.{kind}"), lambda x: F.struct(F.lit(kind).alias("type"), *[field(x, n) for n in names])), empty)

    return F.concat(*[made(kind, fields) for kind, fields in kinds.items()])


def normalize_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Scheduled-task XML: task_name, author, description, run_as (the first principal with one), triggers, actions, hints, ts_utc (registration date).

    Triggers and actions come kind by kind, in their order within a kind.
    """
    raw = spark.read.format("xml").option("rowTag", "Task").schema(TASK_XML).load(path).withColumn("file", F.input_file_name())
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    users = F.filter(F.transform("Principals.Principal", lambda p: F.trim(p["UserId"])), lambda u: u != "")
    out = raw.select(
        F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.xml$", "").alias("task_name"),
        text("RegistrationInfo.Author").alias("author"),
        text("RegistrationInfo.Description").alias("description"),
        F.coalesce(F.get(users, F.lit(0)), F.lit("")).alias("run_as"),
        _entries("Triggers", {t: TRIGGER_FIELDS for t in TRIGGERS}).alias("triggers"),
        _entries("Actions", TASK_ACTIONS).alias("actions"),
        any_time(F.col("RegistrationInfo.Date")).alias("ts_utc"),
    )
    return out.withColumn("tactic_hints", task_hints(F.col("actions"), F.col("run_as")))


def normalize_iis_modules(spark: SparkSession, path: str) -> DataFrame:
    """Native and managed modules of web-server configuration: name, kind, image, expanded image, precondition, section and location.

    Managed modules come once for each section that holds them, and once more with its path for one inside a location.
    Entries without a type only switch a native module on and are left out.
    """
    add = "struct<add:array<struct<_name:string,_image:string,_type:string,_preCondition:string>>>"

    def read(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).withColumn("config_path", F.input_file_name())

    none = F.lit("")
    native = read("globalModules", add[len("struct<") : -1].replace("add:", "add ", 1)).select(
        "config_path",
        none.alias("location_path"),
        F.explode("add").alias("a"),
    )
    server = read("system.webServer", f"modules {add}").select("config_path", none.alias("location_path"), F.explode("modules.add").alias("a"))
    inside = read("location", f"_path string, `system.webServer` struct<modules:{add}>").select(
        "config_path",
        F.coalesce("_path", none).alias("location_path"),
        F.explode("`system.webServer`.modules.add").alias("a"),
    )
    managed = server.union(inside).where("coalesce(a._type, '') != ''")
    shown = lambda kind, section, image, expanded: [F.coalesce("a._name", none).alias("module_name"), F.lit(kind).alias("module_kind"), image.alias("image"), expanded.alias("image_expanded"), F.coalesce("a._preCondition", none).alias("precondition"), F.lit(section).alias("config_section"), "location_path", "config_path"]
    image = F.coalesce("a._image", none)
    return native.select(*shown("native", "globalModules", image, expand_env(image))).union(
        managed.select(*shown("managed", "modules", F.col("a._type"), F.col("a._type"))),
    )


def normalize_activities(df: DataFrame) -> DataFrame:
    """Activity rows (ActivityType, StartTime, LastModifiedTime, in seconds) with decoded type and time."""
    when = F.coalesce(F.when(F.col("StartTime") > 0, F.col("StartTime")), F.when(F.col("LastModifiedTime") > 0, F.col("LastModifiedTime")))
    return df.withColumn("activity", _decoded(F.col("ActivityType"), ACTIVITY)).withColumn("ts_utc", F.timestamp_seconds(when).cast("timestamp_ntz"))


def activity_events(df: DataFrame, case: str, evidence: str) -> DataFrame:
    """normalize_activities as events: the row with its decoded type is the payload, numbered by _file and _row."""
    own = [c for c in df.columns if c not in PLACE]
    rows = normalize_activities(indexed(df))
    payload = F.struct(*[F.col(f"`{c}`") for c in own], F.col("activity").alias("activity_type"))
    return make_event(
        rows,
        case=F.lit(case),
        evidence=F.lit(evidence),
        artifact=F.lit("win10timeline"),
        index=F.col("_i"),
        ts=F.col("ts_utc"),
        event_type=F.lit("activity"),
        computer=F.lit(""),
        payload=payload,
    )


def normalize_tool_json(df: DataFrame, artifact: str, event_type: str, case: str, evidence: str) -> DataFrame:
    """One event for each tool row (needs _file and _row)."""
    return normalize_csv(df, CsvSpec(artifact, event_type, ()), case, evidence)


def not_present(catalog: DataFrame, detected: DataFrame) -> DataFrame:
    """A result row for each catalogued artifact that was not detected."""
    return catalog.select("artifact_id").distinct().join(detected.select("artifact_id").distinct(), "artifact_id", "left_anti").select(
        "artifact_id",
        F.lit(0).cast("long").alias("row_count"),
        F.lit("(not present)").alias("command"),
        F.lit(0).alias("exit_code"),
    )


ACTIONS = "ts string, actor string, kind string, success boolean, duration_seconds double, row_count long, model string, tokens long, cost_usd double, rule_id string, rule_source string, cluster_id int, attempt int, outcome string"


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ACTIONS).json(path).withColumn("ts", any_time(F.col("ts")))


def read_findings(spark: SparkSession, *paths: str) -> DataFrame:
    """Findings of several folders, one object or an array a file; folders that are missing or empty count as no rows."""
    from pyspark.errors import AnalysisException

    from ..model import FINDING_SCHEMA

    out = spark.createDataFrame([], FINDING_SCHEMA)
    for p in paths:
        try:
            out = out.unionByName(spark.read.schema(FINDING_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).json(p))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return out


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "EVENT_COLUMNS", "EVENT_SCHEMA")]
