"""Detection rules as data, and the runner that evaluates all of them in one scan.

A rule is a predicate over unified events with a fixed leading projection and extras. The runner turns all rules into one
array of hits a row, so N rules cost one pass and one parse of the payload; a row evaluates only the rules of its own artifact.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import BAR, json_field, like_any, like_ci, norm_level, tactic_slugs, technique_ids
from ..model import kept
from .ranges import top_rows


@dataclass(frozen=True)
class Rule:
    rule_id: str
    title: str
    level: str
    tactics: tuple[str, ...]
    techniques: tuple[str, ...]
    artifacts: tuple[str, ...]
    predicate: Callable[[], Column]
    extras: dict[str, str] = field(default_factory=dict)
    source: str = "custom"


FIELDS = "payload_fields_"


def with_fields(df: DataFrame) -> DataFrame:
    """df with the payload's top-level fields as a map of texts, parsed once a row; rules look their keys up in it."""
    return df.withColumn(FIELDS, F.from_json("payload_json", "map<string,string>"))


def p(key: str) -> Column:
    """A payload field of a row that with_fields prepared; paths that begin with '$' are read from the payload itself."""
    return json_field(F.col("payload_json"), key) if key.startswith("$") else F.try_element_at(F.col(FIELDS), F.lit(key))


def low(key: str) -> Column:
    return F.lower(p(key))


# Strings of the rules' conditions.
SYSTEM_PROCESSES = (
    "svchost.exe",
    "services.exe",
    "lsass.exe",
    "winlogon.exe",
    "csrss.exe",
    "smss.exe",
    "taskhostw.exe",
    "taskhost.exe",
    "dllhost.exe",
    "conhost.exe",
    "rundll32.exe",
    "spoolsv.exe",
    "wininit.exe",
)
DOCUMENT_MARKS = ("%.pdf.%", "%.doc.%", "%.docx.%", "%.xls.%", "%.xlsx.%", "%.jpg.%", "%.jpeg.%", "%.png.%", "%.txt.%", "%.zip.%")
PROGRAM_ENDS = ("%.exe", "%.scr", "%.com", "%.bat", "%.cmd", "%.pif", "%.vbs", "%.js")
HACKTOOLS = (
    "procdump%.exe",
    "mimikatz%.exe",
    "mimi.exe",
    "stager.ps1",
    "%_payload.exe",
    "%_payload.go",
    "%_payload.ps1",
    "%_payload.dll",
    "lazagne.exe",
    "psexec.exe",
    "rubeus.exe",
    "seatbelt.exe",
    "sharphound.exe",
    "winpeas%.exe",
    "cobaltstrike%",
    "meterpreter%",
    "pwdump%.exe",
    "wce.exe",
    "nc.exe",
    "ncat.exe",
)
SCRIPT_END = r"\.(aspx|ashx|asmx|ascx|asp|php|php5|phtml|jsp|jspx|cshtml|vbhtml|cfm|cgi|pl|py)$"
UPLOAD_DIR = "/(uploads|upload|fileupload|files|userfiles|images|img|media|avatars|photos|documents|temp|tmp|data|assets|static|public|downloads)/"
WEB_TOOLS = "(printspoofer|godpotato|juicypotato|roguepotato|sweetpotato|efspotato|rottenpotato|rubeus|mimikatz)"
DEFENDER_VALUES = (
    "DisableAntiSpyware",
    "DisableAntiVirus",
    "DisableRealtimeMonitoring",
    "DisableBehaviorMonitoring",
    "DisableOnAccessProtection",
    "DisableScanOnRealtimeEnable",
    "DisableIOAVProtection",
    "TamperProtection",
)
STARTUP_ENDS = ("%.lnk", "%.exe", "%.bat", "%.cmd", "%.vbs", "%.vbe", "%.js", "%.jse", "%.ps1", "%.hta", "%.scr", "%.wsf", "%.pif")
WEBROOT_ENDS = (
    "%.aspx",
    "%.asp",
    "%.ashx",
    "%.asmx",
    "%.asax",
    "%.php",
    "%.php3",
    "%.php4",
    "%.php5",
    "%.phtml",
    "%.jsp",
    "%.jspx",
    "%.jspf",
    "%.cfm",
)


def _text(*marks: str) -> Column:
    return like_any(F.col("payload_json"), *[f"%{m}%" for m in marks])


def _names(col: Column) -> Column:
    return like_any(col, *[f"%{n}%" for n in SYSTEM_PROCESSES])


def _request() -> Column:
    return F.lower(F.concat(F.coalesce(p("cs-uri-stem"), F.lit("")), F.lit(" "), F.coalesce(p("cs-uri-query"), F.lit(""))))


def _is(artifact: str) -> Column:
    return F.col("artifact_id") == artifact


def _double(*cols: Column) -> Column:
    marked, ends = F.lit(False), F.lit(False)
    for c in cols:
        marked, ends = marked | F.coalesce(like_any(c, *DOCUMENT_MARKS), F.lit(False)), ends | F.coalesce(like_any(c, *PROGRAM_ENDS), F.lit(False))
    return marked & ends


# File names and paths of the rules' conditions.
DOUBLE_LINKS = (
    "%.pdf.lnk",
    "%.doc.lnk",
    "%.docx.lnk",
    "%.xls.lnk",
    "%.xlsx.lnk",
    "%.ppt.lnk",
    "%.pptx.lnk",
    "%.rtf.lnk",
    "%.txt.lnk",
    "%.jpg.lnk",
    "%.jpeg.lnk",
    "%.png.lnk",
    "%.csv.lnk",
    "%.zip.lnk",
)
PAYLOAD_URLS = ("%.exe", "%.scr", "%.dll", "%.zip", "%.7z", "%.rar", "%.iso", "%.img", "%.lnk", "%.hta", "%.ps1", "%.bat")
WRITABLE_LIBRARIES = (
    "%\\DOWNLOADS\\%.DLL",
    "%\\APPDATA\\LOCAL\\TEMP\\%.DLL",
    "%\\APPDATA\\ROAMING\\%.DLL",
    "%\\PROGRAMDATA\\%.DLL",
    "%\\USERS\\PUBLIC\\%.DLL",
    "%\\WINDOWS\\TEMP\\%.DLL",
)
DOWNLOADED_PROGRAMS = ("%\\Users\\%\\Downloads\\%.exe", "%\\Users\\%\\Desktop\\%.exe", "%\\Users\\%\\AppData\\Local\\Temp\\%.exe")
ODD_PROGRAMS = ("%\\ProgramData\\%.exe", "%\\PerfLogs\\%.exe", "%\\Users\\Public\\%.exe", "%\\$Recycle.Bin\\%.exe", "%\\Windows\\Temp\\%.exe")
ODD_LOADED = ("%\\PROGRAMDATA\\%.EXE%", "%\\PERFLOGS\\%.EXE%", "%\\USERS\\PUBLIC\\%.EXE%", "%\\$RECYCLE.BIN\\%.EXE%", "%\\WINDOWS\\TEMP\\%.EXE%")


def _downloads(c: Column) -> Column:
    return like_any(c, *DOWNLOADED_PROGRAMS)


def _odd_places(c: Column) -> Column:
    return like_any(c, *ODD_PROGRAMS)


def _odd_or_root(c: Column) -> Column:
    return _odd_places(c) | F.lower(c).rlike(r"^[a-z]:\\[^\\]+\.exe$")


def _set(c: Column) -> Column:
    return c.isNotNull() & (c != "")


COMMAND, ARGUMENTS = "$.actions[0].command", "$.actions[0].arguments"
REGISTRY = {"key_path": "KeyPath", "value_name": "ValueName", "value_data": "ValueData"}
USN = {"file_name": "Name", "update_reasons": "UpdateReasons"}

RULES = (
    Rule(
        "ntds-dit-writable-path",
        "Domain database copied to a user-writable path",
        "high",
        ("credential-access", "exfiltration"),
        ("T1003.003",),
        ("mft",),
        lambda: (low("FileName") == "ntds.dit") & like_any(
            p("ParentPath"),
            "%\\appdata\\%",
            "%\\users\\public\\%",
            "%\\temp\\%",
            "%\\programdata\\%",
            "%\\downloads\\%",
            "%\\desktop\\%",
            "c:\\temp\\%",
        ),
        {"file_name": "FileName", "parent_path": "ParentPath"},
    ),
    Rule(
        "task-hidden-powershell",
        "Scheduled task runs hidden or encoded PowerShell",
        "high",
        ("persistence", "execution", "defense-evasion"),
        ("T1053.005", "T1059.001"),
        ("scheduled_tasks",),
        lambda: like_ci(p(COMMAND), "%powershell%") & like_any(
            p(ARGUMENTS),
            "%-w hidden%",
            "%-windowstyle hidden%",
            "%-enc %",
            "%-encodedcommand%",
            "%frombase64string%",
            "%downloadstring%",
            "%iex(%",
            "%invoke-expression%",
        ),
        {"task_name": "task_name", "task_arguments": ARGUMENTS},
    ),
    Rule(
        "powershell-reserved-tld",
        "PowerShell network call to a reserved top-level domain",
        "high",
        ("command-and-control",),
        ("T1071.001", "T1071.004"),
        ("evtx",),
        lambda: like_ci(p("Channel"), "%powershell%") & _text(
            "invoke-webrequest",
            "invoke-restmethod",
            "resolve-dnsname",
            "gethostaddresses",
            "net.webclient",
            "downloadstring",
            "downloaddata",
            "start-bitstransfer",
        ) & _text(".test/", ".test'", '.test\\"', ".invalid", ".example/"), {"channel": "Channel", "event_id": "EventId"},
    ),
    Rule(
        "task-system-process-name",
        "Scheduled task runs a system-process name from a user-writable path",
        "high",
        ("persistence", "defense-evasion"),
        ("T1053.005", "T1036.005"),
        ("scheduled_tasks",),
        lambda: _names(p(COMMAND)) & like_any(
            p(COMMAND),
            "%\\appdata\\%",
            "%\\users\\public\\%",
            "%\\temp\\%",
            "%\\programdata\\%",
            "c:\\temp\\%",
            "%\\$recycle.bin\\%",
        ),
        {"task_name": "task_name", "task_command": COMMAND},
    ),
    Rule(
        "exec-world-writable-path",
        "Executable staged in a world-writable path",
        "medium",
        ("defense-evasion", "collection"),
        ("T1074.001",),
        ("amcache",),
        lambda: low("FileExtension").isin(".exe", ".dll", ".scr", ".com", ".ps1", ".bat") & like_any(
            p("FullPath"),
            "%\\users\\public\\%",
            "%\\windows\\temp\\%",
            "c:\\temp\\%",
            "%\\$recycle.bin\\%",
        ),
        {"full_path": "FullPath", "file_name": "Name"},
    ),
    Rule(
        "ransom-locked-rename",
        "Renames to .locked, or a ransom note",
        "high",
        ("impact",),
        ("T1486",),
        ("usn_journal",),
        lambda: ((p("Extension") == ".locked") & like_ci(p("UpdateReasons"), "%RenameNewName%")) | like_ci(p("Name"), "README_RESTORE%"),
        USN,
    ),
    Rule(
        "lnk-double-extension",
        "Link file with a double extension",
        "high",
        ("initial-access", "execution", "defense-evasion"),
        ("T1566.001", "T1204.002", "T1036.007"),
        ("usn_journal",),
        lambda: like_any(p("Name"), *DOUBLE_LINKS),
        USN,
    ),
    Rule(
        "run-key-system-process-name",
        "Run key names a system process outside Windows",
        "high",
        ("persistence", "defense-evasion"),
        ("T1547.001", "T1036.005"),
        ("registry",),
        lambda: like_ci(p("KeyPath"), "%currentversion%run%") & ~like_ci(p("ValueData"), "%\\windows\\%") & _names(p("ValueData")),
        REGISTRY,
    ),
    Rule(
        "admin-share-shellbags",
        "Administrative share in shellbags",
        "medium",
        ("lateral-movement",),
        ("T1021.002",),
        ("shellbags",),
        lambda: like_any(p("Value"), "\\\\%c$", "\\\\%admin$", "\\\\%ipc$") | like_any(p("AbsolutePath"), "%\\c$", "%\\admin$"),
        {"shell_value": "Value", "absolute_path": "AbsolutePath"},
    ),
    Rule(
        "hacktool-self-delete",
        "Offensive tool deleted",
        "high",
        ("defense-evasion",),
        ("T1070.004",),
        ("usn_journal",),
        lambda: like_ci(p("UpdateReasons"), "%filedelete%") & like_any(p("Name"), *HACKTOOLS),
        USN,
    ),
    Rule(
        "script-in-upload-dir",
        "Web script served from an upload folder",
        "high",
        ("persistence", "initial-access"),
        ("T1505.003", "T1190"),
        ("w3c_iis",),
        lambda: low("cs-uri-stem").rlike(SCRIPT_END) & low("cs-uri-stem").rlike(UPLOAD_DIR),
        {"client_ip": "c-ip", "http_method": "cs-method", "uri_stem": "cs-uri-stem", "http_status": "sc-status"},
    ),
    Rule(
        "web-tool-exec",
        "Web request runs a program from a web root or names a privilege tool",
        "high",
        ("execution", "privilege-escalation"),
        ("T1505.003", "T1059", "T1068"),
        ("w3c_iis",),
        lambda: (
            (_request().rlike("(inetpub|wwwroot)") & _request().rlike(r"\.(exe|ps1|bat|cmd|vbs|hta|dll|jar|sh|py)"))
            | _request().rlike(WEB_TOOLS)
        ),
        {"client_ip": "c-ip", "http_method": "cs-method", "uri_query": "cs-uri-query"},
    ),
    Rule(
        "iis-module-odd-image",
        "Native web-server module outside the standard folders",
        "critical",
        ("persistence",),
        ("T1505.004",),
        ("iis_module",),
        lambda: (p("module_kind") == "native") & (F.coalesce(p("image"), F.lit("")) != "") & ~like_any(
            F.replace(p("image_expanded"), F.lit("\\"), F.lit("/")),
            "%/windows/system32/inetsrv/%",
            "%/windows/microsoft.net/%",
            "%/program files/%",
            "%/program files (x86)/%",
        ),
        {"module_name": "module_name", "image": "image", "config_path": "config_path"},
    ),
    Rule(
        "amcache-nonos-pe-profile",
        "Program outside the OS under a user profile",
        "medium",
        ("execution", "persistence"),
        ("T1204.002",),
        ("amcache",),
        lambda: (p("IsPeFile") == "true") & (p("IsOsComponent") == "false") & like_ci(p("FullPath"), "%\\Users\\%"),
        {"full_path": "FullPath", "sha1": "SHA1", "name": "Name", "file_key_last_write": "FileKeyLastWriteTimestamp"},
        "forensic",
    ),
    Rule(
        "browser-payload-provenance",
        "Browser fetched a payload",
        "medium",
        ("initial-access", "command-and-control"),
        ("T1566.002", "T1105"),
        ("browser_history",),
        lambda: like_ci(p("title"), "Directory listing for%") | (
            like_any(p("url"), *PAYLOAD_URLS) & ((p("transition") == "typed") | (p("typed_count").try_cast("int") > 0))
        ),
        {"url": "url", "title": "title", "transition": "transition", "typed_count": "typed_count"},
        "forensic",
    ),
    Rule(
        "dll-from-writable-path",
        "Library loaded from a user-writable path",
        "high",
        ("defense-evasion", "persistence", "privilege-escalation"),
        ("T1574.002",),
        ("prefetch",),
        lambda: like_any(p("files_loaded"), *WRITABLE_LIBRARIES),
        {"executable": "executable", "files_loaded": "files_loaded"},
        "forensic",
    ),
    Rule(
        "double-extension-executable",
        "Executable with a document's extension before its own",
        "high",
        ("execution", "defense-evasion"),
        ("T1036.007",),
        ("mft", "amcache", "prefetch"),
        lambda: (
            _is("mft") & ~p("IsDirectory").eqNullSafe("true") & _double(p("FullPath"))
        ) | (_is("amcache") & _double(p("FullPath"), p("Name"))) | (_is("prefetch") & _double(p("executable"))),
        {"full_path": "FullPath", "file_name": "Name", "prefetch_executable": "executable"},
        "forensic",
    ),
    Rule(
        "exec-from-download-or-temp",
        "Program ran from Downloads, Desktop or a temp folder",
        "high",
        ("execution", "initial-access"),
        ("T1204.002",),
        ("prefetch", "amcache", "registry", "shimcache"),
        lambda: (
            _is("prefetch") & like_any(p("files_loaded"), "%\\DOWNLOADS\\%.EXE%", "%\\DESKTOP\\%.EXE%", "%\\APPDATA\\LOCAL\\TEMP\\%.EXE%")
        ) | (_is("amcache") & (p("IsOsComponent") == "false") & _downloads(p("FullPath"))) | (_is("registry") & (p("Category") == "Program Execution") & _downloads(p("ValueData"))) | (_is("shimcache") & _downloads(p("Path"))),
        {"files_loaded": "files_loaded", "full_path": "FullPath", "value_data": "ValueData", "path": "Path"},
        "forensic",
    ),
    Rule(
        "exec-from-odd-location",
        "Program ran from an unusual location",
        "high",
        ("execution", "defense-evasion"),
        ("T1036.005", "T1204.002"),
        ("prefetch", "amcache", "registry", "shimcache"),
        lambda: (_is("prefetch") & like_any(p("files_loaded"), *ODD_LOADED)) | (_is("amcache") & _odd_or_root(p("FullPath"))) | (
            _is("registry") & (p("Category") == "Program Execution") & _odd_or_root(p("ValueData"))
        ) | (_is("shimcache") & _odd_or_root(p("Path"))),
        {"executable": "executable", "full_path": "FullPath", "value_data": "ValueData", "path": "Path"},
        "forensic",
    ),
    Rule(
        "registry-appinit",
        "AppInit libraries",
        "high",
        ("persistence", "privilege-escalation", "defense-evasion"),
        ("T1546.010",),
        ("registry",),
        lambda: like_ci(p("KeyPath"), "%\\Windows NT\\CurrentVersion\\Windows%") & (
            ((low("ValueName") == "appinit_dlls") & _set(F.trim(p("ValueData")))) | (
                (low("ValueName") == "loadappinit_dlls") & p("ValueData").isin("1", "0x1")
            )
        ),
        REGISTRY,
        "forensic",
    ),
    Rule(
        "registry-com-hijack",
        "COM server points at a user-writable path",
        "medium",
        ("persistence", "privilege-escalation", "defense-evasion"),
        ("T1546.015",),
        ("registry",),
        lambda: like_any(p("KeyPath"), "%\\CLSID\\%\\InprocServer32%", "%\\CLSID\\%\\LocalServer32%") & like_ci(p("HiveType"), "%NTUSER%") & like_any(
            p("ValueData"),
            "%\\Users\\%",
            "%\\AppData\\%",
            "%\\ProgramData\\%",
            "%\\Temp\\%",
            "%\\Downloads\\%",
        ),
        REGISTRY,
        "forensic",
    ),
    Rule(
        "registry-defender-tamper",
        "Defender disabled",
        "high",
        ("defense-evasion",),
        ("T1562.001",),
        ("registry",),
        lambda: like_ci(p("KeyPath"), "%Windows Defender%") & p("ValueName").isin(*DEFENDER_VALUES) & F.when(
            p("ValueName") == "TamperProtection",
            p("ValueData").isin("0", "0x0"),
        ).otherwise(p("ValueData").isin("1", "0x1")),
        REGISTRY,
        "forensic",
    ),
    Rule(
        "registry-ifeo-debugger",
        "Image-file debugger",
        "high",
        ("persistence", "privilege-escalation", "defense-evasion"),
        ("T1546.012", "T1546.008"),
        ("registry",),
        lambda: like_ci(p("KeyPath"), "%\\Image File Execution Options\\%") & (low("ValueName") == "debugger") & _set(p("ValueData")),
        REGISTRY,
        "forensic",
    ),
    Rule(
        "registry-run-key",
        "Run key points at a suspicious payload",
        "high",
        ("persistence",),
        ("T1547.001",),
        ("registry",),
        lambda: (like_any(p("KeyPath"), "%\\CurrentVersion\\Run%", "%\\CurrentVersion\\Explorer\\Run%") | (p("Description") == "Run")) & (
            like_any(p("ValueData"), "%\\Users\\%\\Downloads\\%", "%\\Users\\%\\Desktop\\%", "%\\Users\\%\\AppData\\%", "%\\ProgramData\\%", "%\\Windows\\Temp\\%") | (
                like_any(p("ValueData"), "%powershell%", "%cmd.exe%", "%wscript%", "%cscript%", "%mshta%", "%rundll32%", "%regsvr32%") & like_any(
                    p("ValueData"),
                    "%-enc%",
                    "%-e jab%",
                    "%frombase64string%",
                    "%downloadstring%",
                    "%http://%",
                    "%https://%",
                    "%javascript:%",
                )
            )
        ),
        REGISTRY,
        "forensic",
    ),
    Rule(
        "registry-service-image",
        "Service with a suspicious image path",
        "high",
        ("persistence", "privilege-escalation"),
        ("T1543.003",),
        ("registry",),
        lambda: like_ci(p("KeyPath"), "%\\Services\\%") & like_ci(p("ValueName"), "%ImagePath%") & like_any(
            p("ValueData"),
            "%\\Users\\%",
            "%\\ProgramData\\%",
            "%\\AppData\\%",
            "%\\Windows\\Temp\\%",
            "%\\PerfLogs\\%",
            "%powershell%",
            "%cmd.exe%",
            "%rundll32%",
            "%regsvr32%",
            "%mshta%",
            "%COMSPEC%",
            "%-enc%",
            "%DownloadString%",
        ),
        REGISTRY,
        "forensic",
    ),
    Rule(
        "registry-winlogon",
        "Winlogon shell or userinit changed",
        "high",
        ("persistence", "privilege-escalation"),
        ("T1547.004",),
        ("registry",),
        lambda: like_ci(p("KeyPath"), "%\\Windows NT\\CurrentVersion\\Winlogon%") & low("ValueName").isin("shell", "userinit") & p("ValueData").isNotNull() & (
            ((low("ValueName") == "shell") & (low("ValueData") != "explorer.exe")) | ((low("ValueName") == "userinit") & (low("ValueData") != "c:\\windows\\system32\\userinit.exe,")) | like_any(
                p("ValueData"),
                "%\\Users\\%",
                "%\\AppData\\%",
                "%\\ProgramData\\%",
                "%\\Temp\\%",
                "%cmd.exe%",
                "%powershell%",
                "%wscript%",
                "%cscript%",
            )
        ),
        REGISTRY,
        "forensic",
    ),
    Rule(
        "startup-folder-payload",
        "Payload in a startup folder",
        "high",
        ("persistence",),
        ("T1547.001",),
        ("mft",),
        lambda: like_any(
            p("FullPath"),
            "%\\Start Menu\\Programs\\Startup\\%",
            "%\\ProgramData\\Microsoft\\Windows\\Start Menu\\Programs\\StartUp\\%",
        ) & like_any(p("FullPath"), *STARTUP_ENDS) & ~like_ci(p("FullPath"), "%desktop.ini"),
        {"full_path": "FullPath"},
        "forensic",
    ),
    Rule(
        "script-in-webroot",
        "Script written into a web root",
        "high",
        ("persistence",),
        ("T1505.003",),
        ("mft",),
        lambda: like_any(
            p("FullPath"),
            "%\\inetpub\\wwwroot\\%",
            "%\\wwwroot\\%",
            "%\\htdocs\\%",
            "%\\www\\%",
            "%\\tomcat%\\webapps\\%",
            "%\\xampp\\htdocs\\%",
        ) & like_any(p("FullPath"), *WEBROOT_ENDS),
        {"full_path": "FullPath", "file_size": "FileSize"},
        "forensic",
    ),
)

HIT = "rule_id string, extra map<string,string>"


def available_artifacts(df: DataFrame) -> DataFrame:
    return df.select("case_id", "artifact_id").distinct()


def prefilter_rules(rules: tuple[Rule, ...], artifacts: set[str]) -> tuple[Rule, ...]:
    """Rules whose artifact list meets the artifacts at hand; an empty list meets all."""
    return tuple(r for r in rules if not r.artifacts or artifacts & {a.strip() for a in r.artifacts})


def valid_rules(df: DataFrame, rules: tuple[Rule, ...]) -> tuple[tuple[Rule, ...], dict[str, str]]:
    """Rules whose predicates analyse against df, and the error of each other one."""
    good, bad = [], {}
    for r in rules:
        try:
            with_fields(df.limit(0)).select(r.predicate().alias("x")).schema  # noqa: B018
            good.append(r)
        except AnalysisException as e:
            bad[r.rule_id] = str(e).splitlines()[0]
    return tuple(good), bad


def rule_hits(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Events with rule_id and extra for every rule that they match: one scan for all rules."""

    def hit(r: Rule) -> Column:
        extra = F.create_map(*[x for k, v in r.extras.items() for x in (F.lit(k), p(v))]) if r.extras else F.create_map().cast("map<string,string>")
        return F.when(
            (F.col("artifact_id").isin(*r.artifacts) if r.artifacts else F.lit(True)) & r.predicate(),
            F.struct(F.lit(r.rule_id).alias("rule_id"), extra.alias("extra")),
        )

    hits = F.filter(F.array(*[hit(r) for r in rules]), lambda x: x.isNotNull())
    return with_fields(df).withColumn("hit_", F.explode(hits)).select(
        "case_id",
        "evidence_id",
        "artifact_id",
        "audit_id",
        "ts_utc",
        "event_type",
        "computer",
        "hit_.rule_id",
        "hit_.extra",
    )


def capped_evidence(hits: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """For each key: match_count, truncated, and the first cap rows by time and audit_id. Rows are ranked before they are collected."""
    ranked = hits.withColumn(
        "rank_",
        F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("ts_utc").asc_nulls_last(), "audit_id")),
    ).where(F.col("rank_") <= cap)
    ref = F.struct("rank_", "audit_id", "ts_utc", "artifact_id", "event_type", "extra")
    evidence = ranked.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(ref), lambda a, b: a["rank_"] - b["rank_"]),
            lambda x: F.struct(
                x["audit_id"].alias("audit_id"),
                x["ts_utc"].alias("ts_utc"),
                x["artifact_id"].alias("artifact_id"),
                x["event_type"].alias("event_type"),
                x["extra"].alias("extra"),
            ),
        ).alias("evidence"),
    )
    counts = hits.groupBy(*keys).agg(F.count("*").alias("match_count"))
    return counts.join(evidence, keys).withColumn("truncated", F.col("match_count") > cap)


def rule_table(spark, rules: tuple[Rule, ...]) -> DataFrame:
    rows = [(r.rule_id, r.source, r.title, r.level, list(r.tactics), list(r.techniques), list(r.artifacts)) for r in rules]
    return spark.createDataFrame(
        rows,
        "rule_id string, source string, title string, severity string, tactics array<string>, techniques array<string>, artifacts array<string>",
    )


def run_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, max_evidence: int = 100) -> DataFrame:
    """Findings: one row a case and rule that matches, with the exact count and capped evidence.

    The hits of the one scan are written to the shared folder, since counts and evidence both read them. Rules that do not
    analyse are left out with a warning (see valid_rules and rule_run_report).
    """
    rules, bad = valid_rules(df, rules)
    for rule_id, error in bad.items():
        warnings.warn(f"rule {rule_id} is left out: {error}", stacklevel=2)
    found = capped_evidence(kept(rule_hits(df, rules)), ["case_id", "rule_id"], max_evidence)
    meta = rule_table(df.sparkSession, rules).drop("artifacts")
    return found.join(F.broadcast(meta), "rule_id").withColumn("finding_id", F.concat_ws("-", "case_id", "rule_id")).withColumn(
        "approved",
        norm_level(F.col("severity")).isin("critical", "high"),
    ).withColumn("rejected", F.lit(False))


def rule_run_report(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each case: rules in all, matched, without match, skipped (no such artifact) and in error."""
    good, bad = valid_rules(df, rules)
    cases = df.groupBy("case_id").agg(F.collect_set("artifact_id").alias("held"))
    per_rule = cases.withColumn(
        "r_",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(r.rule_id).alias("rule_id"),
                        F.array(*map(F.lit, r.artifacts)).cast("array<string>").alias("artifacts"),
                    ) for r in good
                ],
            ),
        ),
    ).select("case_id", "held", "r_.*")
    hits = rule_hits(df, good).select("case_id", "rule_id").distinct().withColumn("hit", F.lit(True))
    state = F.when((F.size("artifacts") > 0) & ~F.arrays_overlap("artifacts", "held"), "skipped").when(F.col("hit"), "matched").otherwise("no_match")
    rows = per_rule.join(hits, ["case_id", "rule_id"], "left").withColumn("state", state)
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    return rows.groupBy("case_id").agg(
        (F.count("*") + len(bad)).alias("total"),
        n("matched"),
        n("no_match"),
        n("skipped"),
    ).withColumn("errors", F.lit(len(bad)).cast("long"))


def passthrough_findings(df: DataFrame, include_info: bool = False, cap: int = 100) -> DataFrame:
    """Findings of precomputed detections (artifact hayabusa): one for each RuleID, informational and low levels dropped unless asked for.

    Tactics and techniques are those of the first row, by time, that has any.
    """
    rows = with_fields(df.where(F.col("artifact_id") == "hayabusa")).select(
        "*",
        p("RuleID").alias("rule_id"),
        p("RuleTitle").alias("title"),
        norm_level(p("Level")).alias("severity"),
        tactic_slugs(F.coalesce(p("MitreTactics"), F.lit(""))).alias("t_"),
        technique_ids(F.coalesce(p("MitreTags"), F.lit(""))).alias("q_"),
    )
    rows = rows.where(F.coalesce(F.col("rule_id"), F.lit("")) != "")
    if not include_info:
        rows = rows.where(~F.coalesce(F.col("severity"), F.lit("")).isin("info", "informational", "low", ""))
    rows = rows.withColumn(
        "extra",
        F.create_map(*[x for k in ("Channel", "EventID", "Computer", "Details", "ExtraFieldInfo") for x in (F.lit(k), p(k))]),
    )
    rows = kept(rows.select("case_id", "audit_id", "ts_utc", "artifact_id", "event_type", "rule_id", "title", "severity", "t_", "q_", "extra"))
    order = F.struct(F.coalesce(F.col("ts_utc"), F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")), "audit_id")
    meta = rows.groupBy("case_id", "rule_id").agg(
        F.min_by("title", order).alias("title"),
        F.min_by("severity", order).alias("severity"),
        F.min_by("t_", F.when(F.size("t_") > 0, order)).alias("tactics"),
        F.min_by("q_", F.when(F.size("q_") > 0, order)).alias("techniques"),
    )
    none = F.array().cast("array<string>")
    return capped_evidence(rows, ["case_id", "rule_id"], cap).join(meta, ["case_id", "rule_id"]).withColumn("tactics", F.coalesce("tactics", none)).withColumn("techniques", F.coalesce("techniques", none)).withColumn("source", F.lit("hayabusa"))


def prior_context(findings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(distinct cited audit ids, distinct times cut to seconds, counts by source and level)."""
    cited = findings.select("case_id", "source", "severity", F.explode_outer("evidence").alias("e"))
    return cited.select("case_id", "e.audit_id").where("audit_id IS NOT NULL AND audit_id != ''").distinct(), cited.select("case_id", F.date_trunc("second", "e.ts_utc").alias("ts")).where("ts IS NOT NULL").distinct(), findings.groupBy("source", F.lower("severity").alias("level")).agg(F.count("*").alias("n"))


def run_learned_queries(df: DataFrame, queries: tuple[Rule, ...], cap: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(candidates with lens S0 and score 10, queries of each event; hit totals of each query) of learned queries, in one scan."""
    hits = rule_hits(df, queries)
    totals = hits.groupBy("rule_id").agg(F.count("*").alias("hits"))
    order = [F.col("ts_utc").asc_nulls_last(), F.col("audit_id").asc()]
    ranked = top_rows(hits, ["case_id", "rule_id"], order, cap, "r_", F.col("audit_id"))
    found = ranked.groupBy("case_id", "audit_id").agg(
        F.array_sort(F.collect_set("rule_id")).alias("queries"),
        F.min("ts_utc").alias("ts_utc"),
        F.min("artifact_id").alias("artifact_id"),
    )
    return found.withColumn("lenses", F.array(F.lit("S0"))).withColumn("score", F.lit(10)), totals


__all__ = [
    "BAR",
    "RULES",
    "Rule",
    "available_artifacts",
    "capped_evidence",
    "passthrough_findings",
    "prefilter_rules",
    "prior_context",
    "rule_hits",
    "rule_run_report",
    "run_learned_queries",
    "run_rules",
    "valid_rules",
]
