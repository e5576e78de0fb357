from datetime import datetime

from tidewatch.model import EVENT_SCHEMA
from tidewatch.operators.rules import RULES
from tidewatch.streaming.detect import hit_counts, read_event_stream, stream_hits


def test_hits_of_a_stream_count_once(spark, tmp_path):
    locked = '{"Name":"a.locked","Extension":".locked","UpdateReasons":"RenameNewName"}'
    row = lambda i, h: ("c", "e", "usn_journal", i, datetime(2026, 1, 1, h, 3), "x", "", locked)
    spark.createDataFrame([row("1", 1), row("2", 1), row("1", 1), row("3", 2)], EVENT_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.statefulOperator.allowMultiple", "true")
    own = tuple(r for r in RULES if r.rule_id == "ransom-locked-rename")
    q = hit_counts(stream_hits(read_event_stream(spark, str(tmp_path / "in")), own)).writeStream.format("memory").queryName("hits").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("hits").collect()
    assert {(r.rule_id, r.n) for r in got} <= {("ransom-locked-rename", 2), ("ransom-locked-rename", 1)}
    q2 = stream_hits(read_event_stream(spark, str(tmp_path / "in")), own).writeStream.format("memory").queryName("each").outputMode("append").option("checkpointLocation", str(tmp_path / "state2")).trigger(availableNow=True).start()
    q2.awaitTermination(120)
    assert sorted(r.audit_id for r in spark.table("each").collect()) == ["1", "2", "3"]
