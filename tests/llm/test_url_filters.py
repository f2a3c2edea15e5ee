"""URL filters: the query against SQL, and every defined case against a plain loop."""

import datetime as dt

import check
from seqstats.llm import url_filters as u
from seqstats.llm.queries import ORACLES

FOLDER = "/root/testdata/sf0.01"


def test_query_matches_sql(spark):
    assert check.compare(spark, check.connect(FOLDER), FOLDER, "op3_url_filters", ORACLES["op3_url_filters"]) is None


def test_query_blocks_some(spark):
    rows = u.report(spark.read.parquet(f"{FOLDER}/pages.parquet"))
    assert 0 < rows.where("blocked").count() < rows.count()


def test_no_python(spark):
    plan = u.report(spark.read.parquet(f"{FOLDER}/pages.parquet"))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def day(n):
    return dt.date(2024, 1, n)


def test_cases(spark):
    changes = [
        ("host", "a.b.com", "add", day(5)), ("host", "a.b.com", "remove", day(8)), ("host", "a.b.com", "ADD", day(12)),
        ("host", "a.b.com", "add", day(5)), ("host", "same.org", "add", day(3)), ("host", "same.org", "remove", day(3)),
        ("domain", "b.com", "add", day(20)), ("path", "a.b.com/x", "add", day(25)), ("token", "spam", "add", day(1)),
        ("host", None, "add", day(1)), ("host", "null.com", "add", None), (None, "q.com", "add", day(1)), ("host", "", "add", day(1)),
    ]
    listed = spark.createDataFrame(changes, "kind string, value string, action string, listed_on date")
    expected = [
        ("http://a.b.com/x?y", day(4), ""), ("http://a.b.com/x?y", day(5), "host:a.b.com"), ("http://a.b.com/x?y", day(7), "host:a.b.com"),
        ("http://a.b.com/x?y", day(8), ""), ("HTTPS://u:p@A.B.com:80/z", day(13), "host:a.b.com"), ("http://c.b.com", day(19), ""),
        ("http://c.b.com", day(20), "domain:b.com"), ("http://a.b.com/x", day(26), "domain:b.com,host:a.b.com,path:a.b.com/x"),
        ("ftp://my-spam.net/", day(2), "token:spam"), ("ftp://my-spam.net/", day(2), "token:spam"), ("http://notb.com/", day(28), ""),
        ("http://same.org", day(9), "host:same.org"), (None, day(9), ""), ("http://a.b.com/", None, ""), ("", day(9), ""), ("no url", day(9), ""),
        ("http://null.com", day(9), ""), ("http://q.com", day(9), ""),
    ]
    rows = [(i, url, when, want) for i, (url, when, want) in enumerate(expected)]
    captures = spark.createDataFrame(rows, "kind int, url string, fetched_on date, entries string")
    got = {r.kind: (r.entries, r.n_entries, r.blocked) for r in u.filtered(captures, listed).collect()}
    assert got == {i: (want, len(want.split(",")) if want else 0, bool(want)) for i, _, _, want in rows}
    assert u.filtered(captures.limit(0), listed).count() == 0
    assert u.filtered(captures, listed.limit(0)).where("blocked").count() == 0
