"""URL filters by dated lists, and the URL expressions that they and the archive operator share.

List events (kind, key, category, action, at) become validity intervals: an entry is active from an ``add`` until the
next ``remove`` of the same key and category. A capture is tested against every entry that was active when it was
fetched: its host and each parent domain (kind ``domain``), its host with each leading part of the path (kind
``prefix``). Intervals are laid into buckets of ``BUCKET_DAYS`` days, so the as-of join is an equality join on key
and bucket with a range test: one key with a third of all captures is split by Spark like any skewed join, and a key that
comes and goes often meets only the intervals of the capture's bucket.

Keys of entries are the same whatever their case.

Defined cases: captures without a URL, a host or a fetch time match nothing and stay, not blocked; events with a null in key, category,
action or time are ignored; of events at one time ``remove`` counts as the earlier; repeated captures are each
judged; very long URLs are cut into all their keys; an empty list blocks nothing; other columns of the captures are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BUCKET_DAYS = 30
# Parameters that only track where a visitor came from.
TRACKING = r"^(utm_[^=]*|gclid|fbclid|ref)(=|$)"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty where there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^[^@]*@", ""), r"\.?(:\d*)?$", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """host/path?query: no scheme, leading www, fragment, tracking parameters or final slash; parameters sorted."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def intervals(events: DataFrame) -> DataFrame:
    """kind, key, category, since, until (null: open)."""
    good = events.withColumn("key", F.lower("key")).filter("key IS NOT NULL AND category IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')")
    w = Window.partitionBy("kind", "key", "category").orderBy("at", F.col("action").desc())
    changes = good.withColumn("before", F.lag("action").over(w)).filter("before IS NULL AND action = 'add' OR before <> action")
    return changes.withColumn("until", F.lead("at").over(w)).filter("action = 'add'").selectExpr("kind", "key", "category", "at AS since", "until")


def keys_of(url: Column) -> Column:
    """kind and key of every entry that could name this URL."""
    labels = F.split(host_of(url), r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, n), ".").alias("key")))
    steps = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    prefixes = F.transform(
        F.sequence(F.lit(0), F.size(steps)),
        lambda i: F.struct(F.lit("prefix").alias("kind"), F.lower(F.concat_ws("/", host_of(url), F.when(i > 0, F.array_join(F.slice(steps, F.lit(1), F.greatest(i, F.lit(1))), "/")))).alias("key")),
    )
    return F.concat(domains, F.filter(prefixes, lambda p: F.instr(p.key, "/") > 0))


def _bucket(at: Column) -> Column:
    return F.floor(F.unix_timestamp(at) / (86_400 * BUCKET_DAYS))


def listed(captures: DataFrame, events: DataFrame, capture_id: str = "page_id", url: str = "url", at: str = "fetched_at") -> DataFrame:
    """The id, fetched_at, n_entries active for it then, their categories (sorted, by comma) and blocked, for every capture."""
    kept = captures.select(F.col(f"`{capture_id}`").alias("id"), F.col(f"`{url}`").alias("url"), F.col(f"`{at}`").alias("fetched_at"))
    rows = written(kept.withColumn("row", F.monotonically_increasing_id()), "captures")
    last = F.coalesce(F.col("until"), F.col("last"))
    span = rows.agg(F.max("fetched_at").alias("last"))  # one row
    active = intervals(events).crossJoin(F.broadcast(span)).filter("last >= since")
    laid = active.withColumn("bucket", F.explode(F.sequence(_bucket(F.col("since")), _bucket(F.least(last, F.col("last")))))).drop("last")
    asked = rows.filter("url IS NOT NULL AND fetched_at IS NOT NULL").filter(host_of(F.col("url")) != "")
    asked = asked.select("row", "fetched_at", _bucket(F.col("fetched_at")).alias("bucket"), F.explode(F.array_distinct(keys_of(F.col("url")))).alias("k")).select("row", "fetched_at", "bucket", "k.*")
    hits = asked.join(laid, ["kind", "key", "bucket"]).filter("since <= fetched_at AND (until IS NULL OR fetched_at < until)")
    found = hits.groupBy("row").agg(F.count(F.lit(1)).alias("n_entries"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    return rows.join(found, "row", "left").select(
        F.col("id").alias(capture_id), "fetched_at", F.coalesce("n_entries", F.lit(0).cast("long")).alias("n_entries"), F.coalesce("categories", F.lit("")).alias("categories"), F.col("n_entries").isNotNull().alias("blocked")
    )
