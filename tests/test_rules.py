"""Every rule on a row that it must hit and one that it must not, and a row of another case."""

import json

import pytest

from tidewatch.model import EVENT_SCHEMA
from tidewatch.operators import rules as R

B = "\\"
W = f"C:{B}Users{B}u{B}AppData{B}Roaming{B}x{B}"
CASES = {
    "ntds-dit-writable-path": ("mft", {"FileName": "NTDS.dit", "ParentPath": f".{B}Users{B}Public{B}x"}, {"FileName": "ntds.dit", "ParentPath": f".{B}Windows{B}NTDS"}),
    "task-hidden-powershell": ("scheduled_tasks", {"actions": [{"command": "PowerShell.exe", "arguments": "-nop -W Hidden -c x"}]}, {"actions": [{"command": "cmd.exe", "arguments": "-w hidden"}]}),
    "powershell-reserved-tld": ("evtx", {"Channel": "Windows PowerShell", "ScriptBlockText": "Invoke-WebRequest http://a.test/x"}, {"Channel": "Security", "ScriptBlockText": "Invoke-WebRequest http://a.test/x"}),
    "task-system-process-name": ("scheduled_tasks", {"actions": [{"command": W + "svchost.exe"}]}, {"actions": [{"command": W + "update.exe"}]}),
    "exec-world-writable-path": ("amcache", {"FullPath": f"c:{B}users{B}public{B}a.exe", "FileExtension": ".exe"}, {"FullPath": f"c:{B}users{B}public{B}a.txt", "FileExtension": ".txt"}),
    "ransom-locked-rename": ("usn_journal", {"Name": "a.locked", "Extension": ".locked", "UpdateReasons": "RenameNewName"}, {"Name": "a.locked", "Extension": ".locked", "UpdateReasons": "FileCreate"}),
    "lnk-double-extension": ("usn_journal", {"Name": "bill.PDF.lnk"}, {"Name": "short.lnk"}),
    "run-key-system-process-name": ("registry", {"KeyPath": f"x{B}CurrentVersion{B}Run", "ValueData": W + "svchost.exe"}, {"KeyPath": f"x{B}CurrentVersion{B}Run", "ValueData": f"C:{B}Windows{B}System32{B}svchost.exe"}),
    "admin-share-shellbags": ("shellbags", {"Value": f"{B}{B}10.0.0.1{B}C$"}, {"Value": f"{B}{B}files{B}public"}),
    "hacktool-self-delete": ("usn_journal", {"Name": "my_payload.exe", "UpdateReasons": "FileDelete|Close"}, {"Name": "SubmissionPayload.json", "UpdateReasons": "FileDelete|Close"}),
    "script-in-upload-dir": ("w3c_iis", {"cs-uri-stem": "/a/uploads/s.aspx"}, {"cs-uri-stem": "/a/home.aspx"}),
    "web-tool-exec": ("w3c_iis", {"cs-uri-stem": "/c.aspx", "cs-uri-query": f"c={B}inetpub{B}wwwroot{B}x.exe"}, {"cs-uri-stem": "/c.aspx", "cs-uri-query": "cmd=whoami"}),
    "iis-module-odd-image": ("iis_module", {"module_kind": "native", "image": "x", "image_expanded": f"C:{B}Windows{B}System32{B}x.dll"}, {"module_kind": "native", "image": "x", "image_expanded": f"C:{B}Windows{B}System32{B}inetsrv{B}x.dll"}),
    "amcache-nonos-pe-profile": ("amcache", {"IsPeFile": "true", "IsOsComponent": "false", "FullPath": f"C:{B}Users{B}u{B}a.exe"}, {"IsPeFile": "true", "IsOsComponent": "true", "FullPath": f"C:{B}Users{B}u{B}a.exe"}),
    "browser-payload-provenance": ("browser_history", {"url": "http://h/a.iso", "typed_count": "2", "transition": "link"}, {"url": "http://h/a.iso", "typed_count": "many", "transition": "link"}),
    "dll-from-writable-path": ("prefetch", {"files_loaded": f"{B}V{B}USERS{B}PUBLIC{B}A.DLL"}, {"files_loaded": f"{B}V{B}WINDOWS{B}A.DLL"}),
    "double-extension-executable": ("mft", {"FullPath": f".{B}a.pdf.exe"}, {"FullPath": f".{B}a.pdf.exe", "IsDirectory": "true"}),
    "exec-from-download-or-temp": ("shimcache", {"Path": f"C:{B}Users{B}u{B}Downloads{B}a.exe"}, {"Path": f"C:{B}Tools{B}a.exe"}),
    "exec-from-odd-location": ("shimcache", {"Path": f"D:{B}run.exe"}, {"Path": f"D:{B}dir{B}run.exe"}),
    "registry-appinit": ("registry", {"KeyPath": f"x{B}Windows NT{B}CurrentVersion{B}Windows", "ValueName": "AppInit_DLLs", "ValueData": "a.dll"}, {"KeyPath": f"x{B}Windows NT{B}CurrentVersion{B}Windows", "ValueName": "AppInitXDLLs", "ValueData": "a.dll"}),
    "registry-com-hijack": ("registry", {"KeyPath": f"x{B}CLSID{B}y{B}InprocServer32", "HiveType": "NTUSER", "ValueData": f"C:{B}Users{B}u{B}a.dll"}, {"KeyPath": f"x{B}CLSID{B}y{B}InprocServer32", "HiveType": "SOFTWARE", "ValueData": f"C:{B}Users{B}u{B}a.dll"}),
    "registry-defender-tamper": ("registry", {"KeyPath": "Windows Defender", "ValueName": "DisableAntiSpyware", "ValueData": "0x1"}, {"KeyPath": "Windows Defender", "ValueName": "TamperProtection", "ValueData": "1"}),
    "registry-ifeo-debugger": ("registry", {"KeyPath": f"x{B}Image File Execution Options{B}sethc.exe", "ValueName": "DEBUGGER", "ValueData": "cmd"}, {"KeyPath": f"x{B}Image File Execution Options{B}sethc.exe", "ValueName": "Debugger", "ValueData": ""}),
    "registry-run-key": ("registry", {"Description": "Run", "ValueData": "powershell -enc AAAA"}, {"Description": "Run", "ValueData": f"C:{B}Program Files{B}a.exe"}),
    "registry-service-image": ("registry", {"KeyPath": f"x{B}Services{B}y", "ValueName": "ImagePath", "ValueData": "%COMSPEC% /c x"}, {"KeyPath": f"x{B}Services{B}y", "ValueName": "ImagePath", "ValueData": f"C:{B}Windows{B}x.exe"}),
    "registry-winlogon": ("registry", {"KeyPath": f"x{B}Windows NT{B}CurrentVersion{B}Winlogon", "ValueName": "Shell", "ValueData": "evil.exe"}, {"KeyPath": f"x{B}Windows NT{B}CurrentVersion{B}Winlogon", "ValueName": "Shell", "ValueData": "Explorer.exe"}),
    "startup-folder-payload": ("mft", {"FullPath": f".{B}Start Menu{B}Programs{B}Startup{B}a.vbs"}, {"FullPath": f".{B}Start Menu{B}Programs{B}Startup{B}desktop.ini"}),
    "script-in-webroot": ("mft", {"FullPath": f"D:{B}tomcat9{B}webapps{B}a.jsp"}, {"FullPath": f"D:{B}tomcat9{B}webapps{B}a.png"}),
}


@pytest.fixture(scope="module")
def hits(spark):
    rows = []
    for rule, (artifact, yes, no) in CASES.items():
        for name, payload, case in ((f"{rule}/yes", yes, "c1"), (f"{rule}/no", no, "c1"), (f"{rule}/yes", yes, "c2")):
            rows.append((case, "e", artifact, name, None, artifact, "", json.dumps(payload)))
    df = spark.createDataFrame(rows, EVENT_SCHEMA)
    return {(r.case_id, r.rule_id, r.audit_id) for r in R.rule_hits(df).collect()}


def test_all_rules_have_a_case():
    assert {r.rule_id for r in R.RULES} == set(CASES) and len(CASES) == 28


@pytest.mark.parametrize("rule", CASES)
def test_rule(hits, rule):
    found = {a for c, r, a in hits if r == rule and c == "c1"}
    assert f"{rule}/yes" in found and f"{rule}/no" not in found
    assert (("c2", rule, f"{rule}/yes") in hits)


def test_invalid_rule_is_reported(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([], EVENT_SCHEMA)
    good, bad = R.valid_rules(df, (R.RULES[0], R.Rule("broken", "x", "low", (), (), (), lambda: F.col("nowhere") == 1)))
    assert [r.rule_id for r in good] == [R.RULES[0].rule_id] and list(bad) == ["broken"]


def test_prefilter():
    assert {r.rule_id for r in R.prefilter_rules(R.RULES, {"iis_module"})} == {"iis-module-odd-image"}
