"""The queries of the URL and archive operators over pages, with their SQL.

Pages carry neither fetch times nor archive headers nor dated lists; the queries derive them by the stated
rules, alike in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import revisits, urls
from .common import table

# Entries of a blocklist with the days (from 2024-01-01) on which they come and go.
DATED = (
    ("domain", "cheap-pills.example.com", "spam", "add", 10), ("domain", "cheap-pills.example.com", "spam", "remove", 60), ("domain", "cheap-pills.example.com", "spam", "add", 120),
    ("domain", "adult-x.example.net", "adult", "add", 0), ("domain", "adult-x.example.net", "adult", "add", 40), ("domain", "adult-x.example.net", "adult", "remove", 150),
    ("domain", "tionsh.example.net", "malware", "add", 30), ("domain", "tionsh.example.net", "malware", "remove", 90),
    ("domain", "example.org", "parked", "add", 75), ("domain", "example.org", "parked", "remove", 75), ("domain", "example.org", "parked", "remove", 100),
    ("prefix", "tionsh.example.net/en", "copied", "add", 20), ("prefix", "tionsh.example.net/en", "copied", "remove", 180),
    ("prefix", "blog.tionble.example.com/de", "copied", "add", 5),
)
START, DAYS = "2024-01-01 00:00:00", 200


def op2_dated_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetched = F.lit(START).cast("timestamp") + F.make_dt_interval(F.pmod(F.col("page_id") * 7919, F.lit(DAYS)).cast("int"), F.lit(0), F.lit(0), F.pmod(F.col("page_id"), F.lit(86_400)))
    captures = table(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("fetched_at"))
    # Every host is on the list for a while, as a rule of its name.
    hosts = captures.select(urls.host_of(F.col("url")).alias("key")).filter("key <> ''").distinct()
    first = F.crc32(F.col("key").cast("binary")) % 90
    ruled = hosts.select(F.lit("domain").alias("kind"), "key", F.lit("ruled").alias("category"), F.explode(F.array(*[F.struct(F.lit(a).alias("action"), (first + d).cast("int").alias("day")) for a, d in (("add", 0), ("remove", 25), ("add", 70))])).alias("e"))
    ruled = ruled.select("kind", "key", "category", "e.action", "e.day")
    stated = spark.createDataFrame([*DATED], "kind string, key string, category string, action string, day int")
    at = (F.lit(START).cast("timestamp") + F.make_dt_interval("day")).alias("at")
    return urls.listed(captures, stated.unionByName(ruled).select("kind", "key", "category", "action", at))


def _sql_host(url: str) -> str:
    return f"lower(regexp_replace(regexp_replace(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^[^@]*@', ''), '\\.?(:\\d*)?$', ''))"


def op2_sql() -> str:
    stated = ", ".join(str(x) for x in DATED)
    return f"""
WITH cap AS (
  SELECT page_id, url, {_sql_host("url")} AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
         TIMESTAMP '{START}' + to_days(CAST((page_id * 7919) % {DAYS} AS INT)) + to_seconds(page_id % 86400) AS fetched_at
  FROM pages),
ev AS (
  SELECT * FROM (VALUES {stated}) AS v(kind, key, category, action, day)
  UNION ALL
  SELECT 'domain', host, 'ruled', e.action, CAST(crc % 90 + e.d AS INT)
  FROM (SELECT host, {CRC_SQL.format(x="host")} AS crc FROM (SELECT DISTINCT host FROM cap WHERE host <> '')),
       (VALUES ('add', 0), ('remove', 25), ('add', 70)) AS e(action, d)),
stamped AS (SELECT DISTINCT kind, key, category, action, TIMESTAMP '{START}' + to_days(day) AS at FROM ev),
keys AS (
  SELECT page_id, fetched_at, 'domain' AS kind, array_to_string(list_slice(string_split(host, '.'), i, 99), '.') AS key
  FROM cap, unnest(range(1, len(string_split(host, '.')) + 1)) AS u(i) WHERE host <> ''
  UNION
  SELECT page_id, fetched_at, 'prefix', lower(host || '/' || array_to_string(list_slice(s, 1, i), '/'))
  FROM (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM cap), unnest(range(1, len(s) + 1)) AS u(i) WHERE host <> ''),
latest AS (
  SELECT k.page_id, k.fetched_at, e.category, arg_max(e.action, (e.at, e.action = 'add')) AS state
  FROM keys k JOIN stamped e ON k.kind = e.kind AND k.key = e.key AND e.at <= k.fetched_at
  GROUP BY k.page_id, k.fetched_at, k.kind, k.key, e.category),
hit AS (
  SELECT page_id, count(*) AS n, string_agg(DISTINCT category, ',' ORDER BY category) AS c FROM latest WHERE state = 'add' GROUP BY page_id)
SELECT page_id, fetched_at, coalesce(n, 0) AS n_entries, coalesce(c, '') AS categories, n IS NOT NULL AS blocked
FROM cap LEFT JOIN hit USING (page_id)"""


#: DuckDB has no crc32: the bitwise rule over the bytes of {x}.
CRC_SQL = (
    "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, 1 + strlen({x})), lambda i: CAST(ascii({x}[i]) AS BIGINT))), "
    "lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(1 AS BIGINT), 1, 1, 1, 1, 1, 1, 1]), "
    "lambda p, q: CASE WHEN p % 2 = 1 THEN xor(p >> 1, 3988292384) ELSE p >> 1 END)), CAST(4294967295 AS BIGINT))"
)


def archive_records(pages: DataFrame) -> DataFrame:
    """Three records of each page: a response, a revisit with its tag, and a revisit whose tag fits two times in three."""
    p = F.col("page_id")
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    base = F.lit(START).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), p)

    def record(n, kind, at, etag, modified, headers):
        return F.struct((p * 3 + n).alias("record_id"), F.lit(kind).alias("kind"), at.alias("ts"), etag.alias("etag"), modified.alias("last_modified"), F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in headers])).alias("headers"))

    none = F.lit(None).cast("string")
    day = F.make_dt_interval(F.lit(1))
    rows = F.array(
        record(0, "response", base, tag, F.concat(F.lit("day "), (p % 5).cast("string")), [("Content-Type", F.lit("text/html")), ("Date", F.lit("d0")), ("ETag", tag), ("Content-Length", F.length(F.coalesce("html", F.lit(""))).cast("string"))]),
        record(1, "revisit", base + day, F.concat(F.lit("W/"), tag), none, [("Date", F.lit("d1")), ("Cache-Control", F.lit("max-age=60")), ("Content-Length", F.lit("0"))]),
        record(2, "revisit", base + day + day, none, F.concat(F.lit("day "), F.when(p % 3 == 0, (p + 1) % 5).otherwise(p % 5).cast("string")), [("Date", F.lit("d2")), ("Server", F.lit("x"))]),
    )
    return pages.select("url", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"), F.explode(rows).alias("r")).select("r.*", "url", F.when(F.col("r.kind") == "response", F.col("digest")).alias("digest"))


def op8_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = revisits.resolve(archive_records(table(spark, sf_dir, "pages")))
    return out.select("record_id", "kind", "state", "resolved_from", "digest", revisits.header_text(F.col("headers")).alias("headers"))


def op8_sql() -> str:
    host = f"regexp_replace({_sql_host('url')}, '^www\\.', '')"
    return f"""
WITH p AS (
  SELECT page_id AS p, url, coalesce(html, '') AS h, '"' || md5(coalesce(html, '')) || '"' AS tag, sha256(coalesce(html, '')) AS dg,
         TIMESTAMP '{START}' + to_seconds(page_id) AS base,
         list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{urls.TRACKING}'))) AS q,
         {host} || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS k0
  FROM pages),
r AS (
  SELECT p * 3 AS record_id, 'response' AS kind, base AS ts, tag AS etag, 'day ' || (p % 5) AS lm, dg AS digest, k0, q, h, tag FROM p
  UNION ALL SELECT p * 3 + 1, 'revisit', base + INTERVAL 1 DAY, 'W/' || tag, NULL, NULL, k0, q, h, tag FROM p
  UNION ALL SELECT p * 3 + 2, 'revisit', base + INTERVAL 2 DAY, NULL, 'day ' || (CASE WHEN p % 3 = 0 THEN (p + 1) % 5 ELSE p % 5 END), NULL, k0, q, h, tag FROM p),
k AS (SELECT *, k0 || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS key FROM r),
resp AS (SELECT * FROM k WHERE kind = 'response'),
j AS (
  SELECT a.*, b.record_id AS bid, b.etag AS be, b.lm AS bl, b.digest AS bd, length(b.h) AS bn, b.tag AS bt,
         row_number() OVER (PARTITION BY a.record_id ORDER BY b.ts DESC, b.record_id DESC) AS rn
  FROM k a LEFT JOIN resp b ON a.kind = 'revisit' AND b.key = a.key AND b.ts < a.ts),
s AS (
  SELECT *, CASE WHEN kind = 'response' THEN 'response' WHEN bid IS NULL THEN 'no response'
    WHEN coalesce(regexp_replace(etag, '^W/', '') = regexp_replace(be, '^W/', ''), lm = bl, digest = bd, false) THEN 'resolved' ELSE 'changed' END AS state
  FROM j WHERE rn = 1)
SELECT record_id, kind, state, CASE WHEN state = 'resolved' THEN bid END AS resolved_from,
       CASE WHEN state = 'resolved' THEN bd ELSE digest END AS digest,
       CASE WHEN state = 'response' THEN 'content-length: ' || length(h) || '; content-type: text/html; date: d0; etag: ' || tag
            WHEN state = 'resolved' AND record_id % 3 = 1 THEN 'cache-control: max-age=60; content-length: ' || bn || '; content-type: text/html; date: d1; etag: ' || bt
            WHEN state = 'resolved' THEN 'content-length: ' || bn || '; content-type: text/html; date: d2; etag: ' || bt
            WHEN record_id % 3 = 1 THEN 'cache-control: max-age=60; content-length: 0; date: d1' ELSE 'date: d2; server: x' END AS headers
FROM s"""
