"""Resolution of WARC revisit records: as-of join with the latest earlier full response of a canonical URL.

A revisit (a server's "not modified") is resolved by the latest response before its time whose canonical
URL is the same. Validators are checked: payload digests if both have one, else entity tags (weakly compared),
else last-modified dates; if neither side offers one in common the revisit is resolved unchecked. Of the headers,
those that a 304 may update replace the stored ones, all others stay.

The join is one window over (URL, piece of time): the last response so far. What comes before a piece is the
last response of the pieces before, found on one row for each URL and piece that has a response. Pieces are cut
at ``PIECES`` quantiles of time, so that a URL with a third of all rows is dealt over as many tasks.

Defined cases: a null or empty URL resolves nothing (``no_response``), nor does a null time. Of responses with equal time, the one with
the largest record id counts. A response at the very time of a revisit is not earlier, and not used. Repeated rows are each resolved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

PIECES = 64
#: Headers that a 304 response may carry (RFC 9110, 15.4.5) and that replace stored ones.
UPDATES = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that only say where a visitor came from.
TRACKING = "utm_[^&=]*|gclid|fbclid|ref|sid|sessionid"


def canonical_url(url: Column) -> Column:
    """One form for URLs of one page: no scheme, fragment, default port, ``www.`` or tracking parameters; host in lower case, parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^(?i)https?://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), ":(80|443)$", ""), r"^www\d*\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    asked = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)"))
    query = F.array_join(F.array_sort(asked), "&")
    return F.when(F.trim(url) != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve(responses: DataFrame, revisits: DataFrame) -> DataFrame:
    """Both: record_id long, url string, time long, digest string, headers map<string,string> (names in lower case).

    Rows (record_id, url_key, response_id, response_time, status, headers), one for each revisit. Status: ``resolved``,
    ``unchecked``, ``mismatch`` (validators differ) or ``no_response``.
    """
    columns = ("record_id", canonical_url(F.col("url")).alias("url_key"), F.col("time").cast("long").alias("time"), "digest", "headers")
    rows = responses.select(*columns, F.lit(True).alias("full")).where("url_key is not null and time is not null").unionByName(revisits.select(*columns, F.lit(False).alias("full")))
    cuts = rows.select(F.percentile_approx("time", [i / PIECES for i in range(1, PIECES)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    piece = F.lit(0)
    for at in cuts:
        piece = piece + F.when(F.col("time") >= at, 1).otherwise(0)
    rows = rows.withColumn("piece", piece)
    said = F.struct("time", "record_id", "digest", "headers")
    lone = F.when(F.col("url_key").isNull() | F.col("time").isNull(), F.xxhash64("record_id"))  # rows that find nothing are not one group
    here = Window.partitionBy("url_key", "piece", "lone").orderBy("time", "full", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    # at one time revisits come first; of the responses before, the last in order has the largest record id
    found = rows.withColumn("lone", lone).withColumn("in_piece", F.last(F.when(F.col("full"), said), ignorenulls=True).over(here)).where("not full").drop("lone")
    ends = rows.where("full").groupBy("url_key", "piece").agg(F.max(F.struct("time", "record_id")).alias("top"))
    pieces = ends.select("url_key", "piece", "top").unionByName(rows.where("not full and url_key is not null").groupBy("url_key", "piece").agg(F.lit(None).cast("struct<time:bigint,record_id:bigint>").alias("top")))
    earlier = pieces.groupBy("url_key", "piece").agg(F.max("top").alias("top")).withColumn("carried", F.last("top", ignorenulls=True).over(Window.partitionBy("url_key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)))
    carried = earlier.where("carried is not null").select("url_key", "piece", F.col("carried.time").alias("c_time"), F.col("carried.record_id").alias("c_id"))
    # the carried response's validators and headers
    full = rows.where("full").groupBy(F.col("url_key"), F.col("time").alias("c_time"), F.col("record_id").alias("c_id")).agg(F.max(F.struct("digest", F.map_entries("headers").alias("h"))).alias("d"))
    carried = carried.join(full, ["url_key", "c_time", "c_id"]).select("url_key", "piece", F.struct(F.col("c_time").alias("time"), F.col("c_id").alias("record_id"), F.col("d.digest").alias("digest"), F.map_from_entries("d.h").alias("headers")).alias("carried"))
    found = found.join(carried, ["url_key", "piece"], "left").withColumn("r", F.coalesce("in_piece", "carried"))
    tag, when = _weak(F.col("headers")["etag"]), F.col("headers")["last-modified"]
    old_tag, old_when = _weak(F.col("r.headers")["etag"]), F.col("r.headers")["last-modified"]
    agree = F.coalesce(F.col("digest") == F.col("r.digest"), tag == old_tag, when == old_when)
    status = F.when(F.col("r").isNull(), "no_response").when(agree.isNull(), "unchecked").when(agree, "resolved").otherwise("mismatch")
    fresh = F.map_filter("headers", lambda k, v: k.isin(*UPDATES))
    none = F.create_map().cast("map<string,string>")
    mine, stored = F.coalesce(fresh, none), F.coalesce(F.col("r.headers"), none)
    merged = F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(mine, k)), mine)
    return found.withColumn("status", status).select("record_id", "url_key", F.col("r.record_id").alias("response_id"), F.col("r.time").alias("response_time"), "status", F.when(F.col("status").isin("resolved", "unchecked"), F.map_from_entries(F.array_sort(F.map_entries(merged)))).alias("headers"))


#: A page in so many is stored once more, changed, so many steps later; another in so many asks without validators, or before it was stored.
AGAIN, STEPS, BARE, EARLY = 3, 40, 5, 11


def as_records(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A crawl of the pages. Page i is stored whole at time 2 i; where i is divisible by ``AGAIN`` it is stored again,
    changed, at 2 i + 2 ``STEPS``. It is asked for once more at an odd time up to 199 later, or, where i is divisible
    by ``EARLY``, just before it was stored. The server says "not modified" with the validators of the first storing
    and a new date, or without validators where i is divisible by ``BARE``.

    So revisits are resolved, unchecked, without a response, or mismatched: by the page stored again, or by another
    page of that canonical URL stored in between.
    """
    said = F.md5(F.coalesce("html", F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("id"), "url", said.alias("digest"))
    i, every = F.col("id"), lambda n: F.pmod(F.col("id"), F.lit(n)) == 0
    text = lambda x: x.cast("string")
    tag = lambda digest: F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    stored = lambda time, digest: F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("etag"), tag(digest), F.lit("date"), text(time))
    first = rows.select((4 * i).alias("record_id"), "url", (2 * i).alias("time"), "digest", stored(2 * i, F.col("digest")).alias("headers"))
    changed, at = F.reverse("digest"), 2 * i + 2 * STEPS
    second = rows.where(every(AGAIN)).select((4 * i + 1).alias("record_id"), "url", at.alias("time"), changed.alias("digest"), stored(at, changed).alias("headers"))
    asked = F.when(every(EARLY), 2 * i - 1).otherwise(2 * i + 1 + 2 * F.pmod(i * 7919, F.lit(100)))
    plain = F.create_map(F.lit("date"), text(asked), F.lit("server"), F.lit("cache"))
    weak = F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag(F.col("digest"))), F.lit("date"), text(asked), F.lit("server"), F.lit("cache"))
    revisits = rows.select((4 * i + 2).alias("record_id"), "url", asked.alias("time"), F.when(~every(BARE), F.col("digest")).alias("digest"), F.when(every(BARE), plain).otherwise(weak).alias("headers"))
    return first.unionByName(second), revisits


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response that each page's revisit resolves to, and the merged headers as JSON."""
    found = resolve(*as_records(common.table(spark, sf_dir, "pages")))
    return found.select("record_id", "url_key", "response_id", "response_time", "status", F.to_json("headers").alias("headers"))


SQL = rf"""
WITH p AS (
  SELECT page_id AS id, url, md5(coalesce(html, '')) AS digest, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^https?://', '', 'i') AS bare FROM pages
), q AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), ':(80|443)$', ''), '^www\d*\.', '') AS host,
    regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^({TRACKING})(=|$)'))) AS asked FROM p
), k AS (
  SELECT id, digest, CASE WHEN trim(url) <> '' THEN host || path || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END END AS url_key FROM q
), stored AS (
  SELECT 4 * id AS record_id, url_key, 2 * id AS time, digest FROM k
  UNION ALL SELECT 4 * id + 1, url_key, 2 * id + {2 * STEPS}, reverse(digest) FROM k WHERE id % {AGAIN} = 0
), one AS (
  SELECT * FROM stored WHERE url_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url_key, time ORDER BY record_id DESC) = 1
), asked AS (
  SELECT 4 * id + 2 AS record_id, url_key, CASE WHEN id % {EARLY} = 0 THEN 2 * id - 1 ELSE 2 * id + 1 + 2 * ((id * 7919) % 100) END AS time, CASE WHEN id % {BARE} <> 0 THEN digest END AS digest FROM k
), met AS (
  SELECT a.record_id, a.url_key, a.time, a.digest, o.record_id AS response_id, o.time AS response_time, o.digest AS old
  FROM asked a ASOF LEFT JOIN one o ON a.url_key = o.url_key AND a.time > o.time
), said AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'no_response' WHEN digest IS NULL THEN 'unchecked' WHEN digest = old THEN 'resolved' ELSE 'mismatch' END AS status FROM met
)
SELECT record_id, url_key, response_id, response_time, status,
  CASE WHEN status IN ('resolved', 'unchecked') THEN '{{"content-type":"text/html","date":"' || time || '","etag":"'
    || CASE WHEN digest IS NULL THEN '' ELSE 'W/' END || '\"' || substr(CASE WHEN digest IS NULL THEN old ELSE digest END, 1, 16) || '\""}}' END AS headers
FROM said
"""
