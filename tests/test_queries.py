"""Every registered query runs on sf0.001, and gives what its SQL gives."""

import duckdb
import pytest

from tidewatch.plans import catalog, deeper, more  # noqa: F401  register their queries
from tidewatch.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def normal(rows):
    cell = lambda v: "" if v is None else repr(round(float(v), 4)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", plans.QUERIES)
def test_query(spark, data, db, name):
    df = plans.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    if name not in plans.ORACLE:
        assert got is not None
        return
    want = db.sql(plans.ORACLE[name])
    assert sorted(want.columns) == cols
    assert normal(got) == normal(want.select(*[f'"{c}"' for c in cols]).fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_all_kinds_of_indicators_in_documents(spark, tmp_path):
    sha256, sha1, md5 = "a" * 64, "B" * 40, "c" * 32
    one = f"{sha256} {sha1} {md5} 10.1.2.3 http://ex.test/p). www.evil.com api.evil.app bare.dev C:\\Temp\\x.exe; HKLM\\Software\\Run, Name: spoolsvc TaskName: \\\\Updater"
    rows = [(1, one), (2, f"WWW.EVIL.com {sha1.lower()}"), (3, None), (4, "0.0.0.0 nothing")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.type, r.key, r.value, r.n_texts, r.first_id) for r in plans.QUERIES["document_iocs"](spark, str(tmp_path)).collect()}
    once = [("sha256", sha256), ("md5", md5), ("ipv4", "10.1.2.3"), ("url", "http://ex.test/p"), ("file_path", "C:\\Temp\\x.exe"), ("registry_key", "HKLM\\Software\\Run"), ("service", "spoolsvc"), ("task", "\\\\Updater"), ("domain", "api.evil.app")]
    assert got == {(t, v.lower(), v, 1, 1) for t, v in once} | {("sha1", "b" * 40, sha1, 2, 1), ("domain", "www.evil.com", "www.evil.com", 2, 1)}
