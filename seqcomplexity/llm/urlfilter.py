"""URL filters: a temporal join of captures with dated lists, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Salts of the list side, so that a key with a large part of all captures is joined by so many tasks.
SALTS = 16


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Turn dated entries ``key, action, effective_at`` into intervals ``key, action, valid_from, valid_to``.

    ``action`` is ``block``, ``allow`` or ``remove``; times are seconds. An entry holds from its date until the
    next entry of its key (null: still open); ``remove`` only ends. Of entries of one key and date, block wins over
    allow, allow over remove. Entries with a null key, date or other action are void. Keys are hosts or
    domains (which cover their subdomains), or hosts with leading path segments (``host/a/b``), in lower-case host.
    """
    known = entries.where(F.col("action").isin("block", "allow", "remove") & F.col("key").isNotNull() & F.col("effective_at").isNotNull())
    order = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).otherwise(0)
    at = known.groupBy("key", F.col("effective_at").cast("long").alias("valid_from")).agg(F.max_by("action", order).alias("action"))
    then = F.lead("valid_from").over(W.partitionBy("key").orderBy("valid_from"))
    return at.withColumn("valid_to", then).where("action <> 'remove'").select("key", "action", "valid_from", "valid_to")


def url_parts(captures: DataFrame) -> DataFrame:
    """Add ``host`` (lower case, without user, port and final dot; empty if there is none), its ``labels``, and the path's ``steps``."""
    authority = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_replace(authority, r"^.*@|:[0-9]*$", "")), r"\.+$", "")
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    rows = captures.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("labels", F.split("host", r"\."))
    return rows.withColumn("steps", F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda x: x != ""))


def url_keys(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """A row with ``host`` and ``tried`` for each key that may match: the parent domains of the host, and the host with each run of
    leading path segments, as far as keys of the list have so many labels or segments, and one with a null key for every capture.

    So a URL's keys grow with the list's longest key, not with the square of the URL's length."""
    parts = F.split("key", "/")
    longest = entries.where("key is not null").agg(F.max(F.size(F.split(parts[0], r"\."))).alias("labels"), F.max(F.size(parts) - 1).alias("steps"))
    most = lambda c: F.coalesce(longest.select(c).scalar(), F.lit(0))
    rows = url_parts(captures).withColumn("most_labels", F.least(F.size("labels"), most("labels"))).withColumn("most_steps", F.least(F.size("steps"), most("steps")))
    rows = rows.withColumn("labels", F.slice("labels", F.size("labels") - F.col("most_labels") + 1, F.col("most_labels"))).withColumn("steps", F.slice("steps", F.lit(1), F.col("most_steps")))
    rows = rows.withColumn("which", F.explode(F.when(F.col("host") == "", F.array(F.lit(0))).otherwise(F.sequence(-F.col("most_labels"), F.col("most_steps")))))
    domain = F.array_join(F.slice("labels", F.size("labels") + F.col("which") + 1, -F.col("which")), ".")
    prefix = F.concat("host", F.lit("/"), F.array_join(F.slice("steps", F.lit(1), F.col("which")), "/"))
    tried = F.when(F.col("which") < 0, domain).when(F.col("which") > 0, prefix)
    return rows.withColumn("tried", tried).drop("labels", "steps", "most_labels", "most_steps", "which")


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """Evaluate every capture against the entries active when it was fetched (an as-of join on validity intervals).

    The most specific active entry decides: a longer path, then a longer domain; a capture without one is kept.
    Returns one row for each capture row: ``page_id, host, fetched_at, blocked, matched_key, valid_from, valid_to``.
    A null or relative URL has host ``''`` and matches nothing, nor does a null fetch time; repeated rows each get
    their row; very long URLs are tried as deep as the list's keys go; empty tables are fine; other columns are ignored.

    Repeated captures are counted before the shuffle and restored at the end. The join is on key and salt with
    the list side repeated ``SALTS`` times, so a hot host spreads; a small list is broadcast by Spark's own size check.
    """
    rows = captures.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(time_col).cast("long").alias("fetched_at")).groupBy("page_id", "url", "fetched_at").agg(F.count("*").alias("copies"))
    salt = F.pmod(F.xxhash64("page_id", "url", "fetched_at"), F.lit(SALTS))
    tried = url_keys(rows, entries).withColumn("salt", salt)
    spans = validity_intervals(entries).withColumn("list_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    active = (F.col("tried") == F.col("key")) & (F.col("salt") == F.col("list_salt")) & (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    rank = F.struct(F.contains(F.col("key"), F.lit("/")).alias("path"), F.length("key").alias("length"), "key", "action", "valid_from", "valid_to")
    hit = tried.join(spans, active, "left").groupBy("page_id", "url", "fetched_at", "copies", "host").agg(F.max(F.when(F.col("key").isNotNull(), rank)).alias("hit"))
    hit = hit.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return hit.select("page_id", "host", "fetched_at", F.coalesce(F.col("hit.action") == "block", F.lit(False)).alias("blocked"), F.col("hit.key").alias("matched_key"), F.col("hit.valid_from").alias("valid_from"), F.col("hit.valid_to").alias("valid_to"))


# The query's captures and lists: the tables hold no dates, so fetch times follow from page ids and list dates from host digests.
_EPOCH, _DAY = 1704067200, 86400


def dated_captures(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", (F.lit(_EPOCH) + F.pmod(F.col("page_id") * 7919, F.lit(366)) * _DAY).cast("long").alias("fetched_at"))


def dated_entries(captures: DataFrame) -> DataFrame:
    """For every host seen: a block entry, its removal, a later block again and an allowed path; for every parent domain a block entry."""
    hosts = url_parts(captures.select("url").distinct()).where("host <> ''").select("host").distinct()
    digit = lambda i: F.conv(F.substring(F.md5("host"), i, 3), 16, 10).cast("long")
    day = lambda x: (F.lit(_EPOCH) + x * _DAY).cast("long")
    first, held, again = digit(1) % 200, digit(4) % 90 + 1, digit(7) % 60 + 1
    entry = lambda key, action, at: F.struct(key.alias("key"), F.lit(action).alias("action"), at.alias("effective_at"))
    own = F.array(
        entry(F.col("host"), "block", day(first)), entry(F.col("host"), "remove", day(first + held)), entry(F.col("host"), "block", day(first + held + again)), entry(F.concat("host", F.lit("/en")), "allow", day(digit(10) % 366)),
    )
    listed = hosts.select(F.explode(own).alias("e")).select("e.*")
    parent = hosts.select(F.substring_index("host", ".", -2).alias("host")).distinct()
    return listed.unionByName(parent.select(F.col("host").alias("key"), F.lit("block").alias("action"), day(digit(1) % 366).alias("effective_at")))


ORACLE = r"""
WITH c AS (
  SELECT page_id, url, CAST(1704067200 + ((page_id * 7919) % 366) * 86400 AS BIGINT) AS fetched_at,
    regexp_replace(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@|:[0-9]*$', '', 'g')), '\.+$', '') AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS steps
  FROM pages
), h AS (SELECT DISTINCT host, md5(host) AS m FROM c WHERE host <> ''),
d AS (
  SELECT host, CAST('0x' || m[1:3] AS BIGINT) % 200 AS first, CAST('0x' || m[4:6] AS BIGINT) % 90 + 1 AS held, CAST('0x' || m[7:9] AS BIGINT) % 60 + 1 AS again, CAST('0x' || m[10:12] AS BIGINT) % 366 AS path FROM h
), p AS (SELECT DISTINCT array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS host FROM h),
e AS (
  SELECT host AS key, 'block' AS action, 1704067200 + first * 86400 AS since FROM d
  UNION ALL SELECT host, 'remove', 1704067200 + (first + held) * 86400 FROM d
  UNION ALL SELECT host, 'block', 1704067200 + (first + held + again) * 86400 FROM d
  UNION ALL SELECT host || '/en', 'allow', 1704067200 + path * 86400 FROM d
  UNION ALL SELECT host, 'block', 1704067200 + (CAST('0x' || md5(host)[1:3] AS BIGINT) % 366) * 86400 FROM p
), o AS (
  SELECT key, since AS valid_from, max(CASE action WHEN 'block' THEN 2 WHEN 'allow' THEN 1 ELSE 0 END) AS act FROM e GROUP BY ALL
), s AS (SELECT *, lead(valid_from) OVER (PARTITION BY key ORDER BY valid_from) AS valid_to FROM o),
k AS (
  SELECT c.*, unnest(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    list_transform(range(1, len(steps) + 1), lambda i: host || '/' || array_to_string(steps[1:i], '/')))) AS tried
  FROM c WHERE host <> ''
), m AS (
  SELECT k.page_id, s.*, row_number() OVER (PARTITION BY page_id ORDER BY contains(key, '/') DESC, length(key) DESC, key DESC) AS n
  FROM k JOIN s ON tried = key AND act > 0 AND fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to)
)
SELECT c.page_id, c.host, c.fetched_at, coalesce(act = 2, false) AS blocked, key AS matched_key, valid_from, valid_to
FROM c LEFT JOIN m ON c.page_id = m.page_id AND n = 1
"""
