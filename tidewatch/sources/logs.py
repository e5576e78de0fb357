"""Line-based logs as rows: web access logs, error logs, collection logs, feature files.

Each parser takes lines (file, line_no, line), as read_lines gives them, so a file may span many tasks: what a line needs
from an earlier one (the W3C directive) is found by line number, not by reading order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import local_to_utc, split_uri
from .tables import indexed


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0), line of every text file, blank lines left out. Files are read in blocks, and numbered by them."""
    lines = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )
    numbered = indexed(lines.withColumn("_row", F.monotonically_increasing_id()))
    return numbered.where("line != ''").select(F.col("_file").alias("file"), F.col("_i").cast("long").alias("line_no"), "line")


# Shapes of web and error log lines, and the columns of the web server's own format.
NCSA = r'^(\S+)\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]*)"\s+(\d{3}|-)\s+(\d+|-)(?:\s+"([^"]*)"\s+"([^"]*)")?'
IIS_FIELDS = (
    "c-ip",
    "cs-username",
    "date",
    "time",
    "s-sitename",
    "s-computername",
    "s-ip",
    "time-taken",
    "cs-bytes",
    "sc-bytes",
    "sc-status",
    "sc-win32-status",
    "cs-method",
    "cs-uri-stem",
    "cs-uri-query",
)
APACHE = r"^\[([A-Z][a-z]{2} [A-Z][a-z]{2} [ \d]\d [\d:.]+ \d{4})\]\s+\[([^\]]+)\]\s+(?:\[pid[^\]]*\]\s+)?(?:\[client ([^\]]+)\]\s+)?(.*)$"
NGINX = r"^(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2})\s+\[(\w+)\]\s+\d+#\d+:\s+(.*)$"
TOMCAT = r"^(\d{2}-[A-Z][a-z]{2}-\d{4} \d{2}:\d{2}:\d{2}\.\d+)\s+(SEVERE|WARNING|INFO|CONFIG|FINE|FINER|FINEST|ERROR|WARN|DEBUG|TRACE)\s+(?:\[([^\]]*)\]\s+)?(.*)$"


def _time(col: Column, *formats: str) -> Column:
    return F.coalesce(*[F.try_to_timestamp(col, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def detect_log_format(lines: DataFrame) -> DataFrame:
    """file, format (w3c, ncsa, iis or null) by the first telling line among the first 50 of each file."""
    line = F.col("line")
    kind = F.when(
        line.startswith("#Fields:") | line.startswith("#Software:"),
        "w3c",
    ).when(line.startswith("#"), None).when(line.rlike(NCSA), "ncsa").when(F.size(F.split(line, ", ")) >= 11, "iis")
    return lines.where("line_no < 50").withColumn("k_", kind).groupBy("file").agg(
        F.min_by("k_", F.when(F.col("k_").isNotNull(), F.col("line_no"))).alias("format"),
    )


def detect_error_format(lines: DataFrame) -> DataFrame:
    """file, format (apache, nginx, tomcat or null) by the first line that is not empty."""
    kind = F.when(F.col("line").rlike(APACHE), "apache").when(F.col("line").rlike(NGINX), "nginx").when(F.col("line").rlike(TOMCAT), "tomcat")
    return lines.where("line_no < 50").groupBy("file").agg(F.min_by(F.struct(kind.alias("k")), "line_no").alias("k_")).select("file", F.col("k_.k").alias("format"))


#: Lines of a file that one task looks through for directives.
BLOCK_LINES = 100_000


def with_directive(lines: DataFrame, block: int = BLOCK_LINES) -> DataFrame:
    """Lines with f_, the fields of the last directive before them in their file, and without the directives.

    Carried over blocks: each block of a file gives its last directive, a table of one row a block gives every block the last one
    of those before it, and within a block the last one seen so far counts.
    """
    names = F.split(F.trim(F.expr("substring(line, 9)")), r"\s+")
    told = lines.withColumn("d_", F.when(F.col("line").startswith("#Fields:"), names)).withColumn("b_", F.floor(F.col("line_no") / block))
    blocks = told.groupBy("file", "b_").agg(F.max_by("d_", F.when(F.col("d_").isNotNull(), F.col("line_no"))).alias("last_"))
    before = F.last("last_", True).over(Window.partitionBy("file").orderBy("b_").rowsBetween(Window.unboundedPreceding, -1))
    carried = blocks.select("file", "b_", before.alias("carry_"))
    inside = Window.partitionBy("file", "b_").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    held = told.join(carried, ["file", "b_"]).withColumn("f_", F.coalesce(F.last("d_", True).over(inside), F.col("carry_")))
    return held.where("d_ IS NULL").drop("d_", "b_", "carry_")


def parse_w3c_log(lines: DataFrame) -> DataFrame:
    """file, line_no, ts_utc, row (field -> value): fields by the last directive before the line; short rows are padded with '-', what is over joins the last field."""
    rows = with_directive(lines).where(~F.col("line").startswith("#") & F.col("f_").isNotNull())
    n, parts = F.size("f_"), F.split("line", " ")
    padded = F.concat(parts, F.array_repeat(F.lit("-"), F.greatest(F.lit(0), n - F.size(parts))))
    folded = F.when(
        F.size(parts) > n,
        F.concat(F.slice(parts, F.lit(1), n - 1), F.array(F.array_join(F.slice(parts, n, F.size(parts)), " "))),
    ).otherwise(padded)
    row = F.map_from_arrays("f_", folded)
    out = rows.select("file", "line_no", row.alias("row"))
    return out.select(
        "file",
        "line_no",
        _time(F.concat_ws(" ", F.col("row")["date"], F.col("row")["time"]), "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS").alias("ts_utc"),
        "row",
    )


def parse_iis_native(lines: DataFrame, zone: str = "UTC") -> DataFrame:
    """The fixed fifteen columns; the wall clock is taken in the zone."""
    text = F.regexp_replace("line", ",+$", "")
    parts = F.transform(F.split(text, ", "), lambda x: F.trim(x))
    n = len(IIS_FIELDS)
    padded = F.slice(F.concat(parts, F.array_repeat(F.lit("-"), n)), 1, n)
    rows = lines.where(~F.col("line").startswith("#")).select(
        "file",
        "line_no",
        F.map_from_arrays(F.array(*map(F.lit, IIS_FIELDS)), padded).alias("row"),
    )
    ts = _time(F.concat_ws(" ", F.col("row")["date"], F.col("row")["time"]), "MM/dd/yy HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "M/d/yy HH:mm:ss")
    return rows.select("file", "line_no", local_to_utc(ts, zone).alias("ts_utc"), "row")


def parse_ncsa(lines: DataFrame) -> DataFrame:
    """Common and combined lines; the request is cut into method, stem, query and version."""
    g = lambda i: F.regexp_extract("line", NCSA, i)
    req = F.filter(F.split(g(4), r"\s+"), lambda x: x != "")
    at = lambda i: F.coalesce(F.get(req, F.lit(i)), F.lit("-"))
    stem, query = split_uri(at(1))
    blank = lambda c: F.when(c == "", "-").otherwise(c)
    cols = {
        "c-ip": g(1),
        "cs-username": g(2),
        "cs-method": at(0),
        "cs-uri-stem": stem,
        "cs-uri-query": query,
        "cs-version": at(2),
        "sc-status": g(5),
        "sc-bytes": g(6),
        "cs(Referer)": blank(g(7)),
        "cs-User-Agent": blank(g(8)),
    }
    rows = lines.where(~F.col("line").startswith("#") & F.col("line").rlike(NCSA))
    ts = F.try_to_timestamp(g(3), F.lit("dd/MMM/yyyy:HH:mm:ss Z")).cast("timestamp_ntz")
    return rows.select("file", "line_no", ts.alias("ts_utc"), F.create_map(*[x for k, v in cols.items() for x in (F.lit(k), v)]).alias("row"))


def _error(lines: DataFrame, pattern: str, server: str, ts: Column, severity: Column, client: Column, message: Column, zone: str) -> DataFrame:
    return lines.where(F.col("line").rlike(pattern)).select(
        "file",
        "line_no",
        local_to_utc(ts, zone).alias("ts_utc"),
        F.lit(server).alias("server_type"),
        severity.alias("severity"),
        client.alias("client_ip"),
        message.alias("message"),
    )


def parse_apache_error(lines: DataFrame, zone: str = "UTC") -> DataFrame:
    g = lambda i: F.regexp_extract("line", APACHE, i)
    when = F.regexp_replace(F.regexp_replace(g(1), r"^\w{3} ", ""), " +", " ")
    client = F.when(g(3) == "", "-").otherwise(F.regexp_replace(g(3), r":[^:]*$", ""))
    return _error(
        lines,
        APACHE,
        "apache",
        _time(when, "MMM d HH:mm:ss.SSSSSS yyyy", "MMM d HH:mm:ss yyyy"),
        F.lower(F.trim(F.element_at(F.split(g(2), ":"), -1))),
        client,
        g(4),
        zone,
    )


def parse_nginx_error(lines: DataFrame, zone: str = "UTC") -> DataFrame:
    g = lambda i: F.regexp_extract("line", NGINX, i)
    ip = F.trim(F.regexp_extract(g(3), r"client:\s*([^,]+)", 1))
    return _error(lines, NGINX, "nginx", _time(g(1), "yyyy/MM/dd HH:mm:ss"), F.lower(g(2)), F.when(ip == "", "-").otherwise(ip), g(3), zone)


def parse_tomcat_log(lines: DataFrame, zone: str = "UTC") -> DataFrame:
    g = lambda i: F.regexp_extract("line", TOMCAT, i)
    return _error(lines, TOMCAT, "tomcat", _time(g(1), "dd-MMM-yyyy HH:mm:ss.SSS"), F.lower(g(2)), F.lit("-"), g(4), zone)


# The line of a collection log, the bodies of its statuses, and their event types.
COLLECTED = r"^\[([^\]]+)\]\s+\[([^\]]+)\]\s+\[([^\]]+)\]\s+(.*)$"
BODY_OK = r"^(.+?)\s+->\s+(.+?)\s+\((\d+)\s+bytes,\s+SHA256:\s+([0-9a-fA-F]+)\.*\s*\)\s*$"
BODY_SKIPPED = r"^(.+?)\s+(?:—|--|-)\s+(.+)$"
BODY_TOOL = r"^Starting:\s+(.+?)\s+->\s+(.+)$"
BODY_MATCH = r"^(.+?)\s+—\s+(.+)$"
COLLECTION_TYPES = {
    "OK": "evidence_collected",
    "SKIP": "evidence_skipped",
    "FAIL": "evidence_failed",
    "TOOL": "tool_invoked",
    "MATCH": "yara_match",
    "INFO": "collection_summary",
    "SCAN": "scan_summary",
}


def parse_collection_log(lines: DataFrame) -> DataFrame:
    """[time] [STATUS] [METHOD] body; lines of another shape are dropped.

    The body is read by status: OK source_path, dest_path, size_bytes and sha256; SKIP and FAIL source_path and reason; TOOL
    command and dest_path; MATCH source_path and yara_rule; INFO summary. A body of another shape or status is unparsed_body.
    Times with an offset become UTC; other statuses are collection_<status>.
    """
    rows = lines.where(F.col("line").rlike(COLLECTED))
    part = lambda i: F.trim(F.regexp_extract("line", COLLECTED, i))
    status, body = F.upper(part(2)), part(4)
    kind = F.concat(F.lit("collection_"), F.lower(status))
    for name, event_type in COLLECTION_TYPES.items():
        kind = F.when(status == name, event_type).otherwise(kind)
    shapes = [("OK", BODY_OK), ("SKIP", BODY_SKIPPED), ("FAIL", BODY_SKIPPED), ("TOOL", BODY_TOOL), ("MATCH", BODY_MATCH)]
    met = status == "INFO"
    for name, pattern in shapes:
        met = met | ((status == name) & body.rlike(pattern))

    def piece(*places: tuple[str, str, int]) -> Column:
        out = F.lit(None).cast("string")
        for name, pattern, i in places:
            out = F.when((status == name) & body.rlike(pattern), F.regexp_extract(body, pattern, i)).otherwise(out)
        return out

    offset = F.regexp_replace(part(1), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return rows.select(
        "file",
        "line_no",
        F.try_to_timestamp(offset).cast("timestamp_ntz").alias("ts_utc"),
        kind.alias("event_type"),
        part(2).alias("status"),
        part(3).alias("method"),
        piece(("OK", BODY_OK, 1), ("SKIP", BODY_SKIPPED, 1), ("FAIL", BODY_SKIPPED, 1), ("MATCH", BODY_MATCH, 1)).alias("source_path"),
        piece(("OK", BODY_OK, 2), ("TOOL", BODY_TOOL, 2)).alias("dest_path"),
        piece(("OK", BODY_OK, 3)).cast("long").alias("size_bytes"),
        F.lower(piece(("OK", BODY_OK, 4))).alias("sha256"),
        piece(("SKIP", BODY_SKIPPED, 2), ("FAIL", BODY_SKIPPED, 2)).alias("reason"),
        piece(("TOOL", BODY_TOOL, 1)).alias("command"),
        piece(("MATCH", BODY_MATCH, 2)).alias("yara_rule"),
        F.when(status == "INFO", body).alias("summary"),
        F.when(~met, body).alias("unparsed_body"),
    )


def parse_feature_files(lines: DataFrame) -> DataFrame:
    """offset, value and context of feature files; event_type is ioc_ and the file's name; comments are skipped and there is no time."""
    parts = F.split("line", "\t", 3)
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    return lines.where(~F.col("line").startswith("#") & (F.size(parts) >= 2)).select(
        "file",
        "line_no",
        F.concat(F.lit("ioc_"), name).alias("event_type"),
        F.get(parts, F.lit(0)).alias("offset"),
        F.get(parts, F.lit(1)).alias("value"),
        F.coalesce(F.get(parts, F.lit(2)), F.lit("")).alias("context"),
    )
