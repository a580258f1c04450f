from datetime import datetime

from limnos.llm import revisits, urls

DAY = lambda d, h=0: datetime(2024, 1, d, h)


def test_entries_hold_only_while_listed(spark):
    events = spark.createDataFrame(
        [("domain", "bad.com", "x", "add", DAY(2)), ("domain", "bad.com", "x", "add", DAY(3)), ("domain", "bad.com", "x", "remove", DAY(5)), ("domain", "bad.com", "x", "add", DAY(9)), ("prefix", "ok.com/a", "y", "add", DAY(1)), ("domain", None, "z", "add", DAY(1))],
        "kind string, key string, category string, action string, at timestamp",
    )
    rows = [(1, "http://Bad.com/p", DAY(1)), (2, "http://www.bad.com/p", DAY(2)), (3, "https://u@bad.com:80/p", DAY(4, 23)), (4, "http://bad.com", DAY(5)), (5, "http://bad.com", DAY(20)), (6, "http://ok.com/a/b?q", DAY(3)), (7, "http://ok.com/ab", DAY(3)), (8, None, DAY(3)), (9, "nonsense", DAY(3)), (10, "http://bad.com", None), (2, "http://www.bad.com/p", DAY(2))]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp")
    got = sorted((r.page_id, r.blocked, r.categories, r.n_entries) for r in urls.listed(captures, events).collect())
    assert [g[0] for g in got if g[1]] == [2, 2, 3, 5, 6] and len(got) == 11
    assert {g[0]: g[2] for g in got}[6] == "y"
    assert urls.listed(captures.limit(0), events).count() == 0
    assert not any(r.blocked for r in urls.listed(captures, events.limit(0)).collect())


def test_canonical(spark):
    rows = [("http://WWW.A.com:80/x/?b=2&a=1&utm_source=f#t",), ("https://a.com/x?a=1&b=2",)]
    got = [r.k for r in spark.createDataFrame(rows, "u string").select(urls.canonical(urls.F.col("u")).alias("k")).collect()]
    assert got == ["a.com/x?a=1&b=2"] * 2


def test_revisits(spark):
    shape = "record_id long, url string, ts timestamp, kind string, etag string, last_modified string, digest string, headers map<string,string>"
    rows = [
        (1, "http://a.com/", DAY(1), "response", '"1"', "m1", "d1", {"ETag": '"1"', "Content-Length": "9", "Date": "x"}),
        (2, "http://a.com", DAY(2), "revisit", 'W/"1"', None, None, {"DATE": "y", "Content-Length": "0"}),
        (3, "https://a.com/", DAY(3), "response", '"2"', "m2", "d2", None),
        (4, "http://a.com/", DAY(4), "revisit", '"1"', "m2", None, None),
        (5, "http://a.com/", DAY(5), "revisit", None, "m2", None, None),
        (6, "http://a.com/", DAY(3), "revisit", '"1"', None, None, None),
        (7, "http://b.com/", DAY(3), "revisit", '"1"', None, None, None),
        (8, None, DAY(3), "revisit", '"1"', None, None, None),
        (9, "http://a.com/", None, "response", None, None, None, None),
        (5, "http://a.com/", DAY(5), "revisit", None, "m2", None, None),
    ]
    got = [(r.record_id, r.state, r.resolved_from, r.headers) for r in revisits.resolve(spark.createDataFrame(rows, shape)).collect()]
    by = {g[0]: g for g in got}
    assert len(got) == 10
    assert by[2][1:] == ("resolved", 1, {"etag": '"1"', "content-length": "9", "date": "y"})
    assert by[4][1] == "changed" and by[5][1:3] == ("resolved", 3) and by[6][1:3] == ("resolved", 1)
    assert by[7][1] == by[8][1] == "no response" and by[9][1] == "response"
    assert revisits.resolve(spark.createDataFrame([], shape)).count() == 0


def test_one_url_over_many_partitions(spark):
    rows = [(k, "http://a.com/x", datetime(2024, 1, 1 + k // 1440, k // 60 % 24, k % 60), "response" if k % 97 == 0 else "revisit", f'"{k // 97}"', None, None, None) for k in range(2_000)]
    df = spark.createDataFrame(rows, "record_id long, url string, ts timestamp, kind string, etag string, last_modified string, digest string, headers map<string,string>")
    got = {r.record_id: r.resolved_from for r in revisits.resolve(df.repartition(8)).filter("kind = 'revisit'").collect()}
    assert all(v == k // 97 * 97 for k, v in got.items()) and len(got) == 2_000 - 21
