"""Operator 5: resolving WARC revisits of unchanged resources.

A revisit record (server answered 304, profile server-not-modified) has no body: it
stands for the latest earlier full response of the same resource. That is an as-of
join by canonical URL and time; the match counts if the validators agree, and the
resolved record has the original's body and the original's headers updated by those
that a 304 answer may carry.

* Canonical URL: lower-case host without ``www.`` and default port, no scheme, no
  fragment, path without its last slash, percent-escapes in upper case, query
  parameters sorted, tracking parameters dropped.
* Earlier: strictly before the revisit's date; of several at one date the largest
  record id.
* Validators: entity tags by weak comparison; without a tag in the revisit the
  Last-Modified date; without either the verdict is ``unvalidated`` and the match is
  used. A different or missing value in the original is ``validator_mismatch``; no
  earlier response is ``no_original``.
* Headers: all of the original's, replaced or joined by the revisit's, except those
  that describe a body or one connection (``NOT_MERGED``).

The as-of join never sorts a resource's captures in one task: full responses are first
reduced to one row per URL and date; the latest earlier one is sought in the rows of
the same URL and day (one row per date, to the microsecond) and else
taken from the latest earlier day that has one (one row per URL and day). Revisits
then join these rows by equality of URL and date, left to AQE if a URL is hot. Bodies are
not moved: a resolved record names the original, and ``with_bodies`` joins them.

Defined results: records with null URL or date resolve to ``no_original``; null headers
are empty; header names compare in lower case, of repeated names the last counts; fractions of a
second count (``op5_warc_revisits`` prints whole seconds); full responses are those of status 200 and type response; repeated
rows are rows of their own (of equal originals the row is one); empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table

TRACKING = r"^(utm_[^=]*|fbclid|gclid|ref|sessionid)(=|$)"
#: Headers of RFC 9110/9111 that a 304 answer must not change in a stored response.
NOT_MERGED = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
              "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]


def _upper_escapes(c: Column) -> Column:
    parts = F.transform(F.split(c, "%"), lambda p, i: F.when((i > 0) & p.rlike("^[0-9A-Fa-f]{2}"), F.concat(
        F.upper(F.substring(p, 1, 2)), F.substring(p, 3, 1 << 30))).otherwise(p))
    return F.array_join(parts, "%")


def canonical_url(url: Column) -> Column:
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(u, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^www\\.", ""), ":(80|443)$", "")
    path = _upper_escapes(F.regexp_extract(u, "^[^/?]*([^?]*)", 1))
    path = F.regexp_replace(path, "/+$", "")
    query = _upper_escapes(F.regexp_extract(u, "^[^?]*\\?(.*)$", 1))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def lower_names(headers: Column) -> Column:
    empty = F.expr("CAST(map() AS map<string,string>)")
    pairs = F.transform(F.map_entries(F.coalesce(headers, empty)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    # of repeated names the last stays
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), p["value"].alias("value"), i.alias("i"))),
                    lambda p: ~F.exists(F.slice(pairs, p["i"] + 2, F.greatest(F.size(pairs) - p["i"] - 1, F.lit(0))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"])))


def merged_headers(original: Column, update: Column) -> Column:
    new = F.map_filter(update, lambda k, v: ~k.isin(NOT_MERGED))
    old = F.map_filter(original, lambda k, v: ~F.coalesce(F.array_contains(F.map_keys(new), k), F.lit(False)))
    return F.map_concat(old, new)


def _opaque(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, url_key, warc_date, original_id, verdict, headers.

    ``records``: record_id, warc_type, target_uri, warc_date, status, headers (map).
    """
    r = records.select("record_id", "warc_type", canonical_url(F.col("target_uri")).alias("url_key"),
                       F.col("warc_date").alias("at"), "status", lower_names(F.col("headers")).alias("headers"))
    full = r.filter((F.col("warc_type") == "response") & (F.col("status") == 200) & F.col("url_key").isNotNull() & F.col("at").isNotNull())
    revisits = r.filter(F.col("warc_type") == "revisit")
    original = F.struct(F.col("record_id").alias("id"), F.col("headers").alias("headers"))
    # one row per URL and date that has a full response or is asked for
    best = full.groupBy("url_key", "at").agg(F.max_by(original, "record_id").alias("best"))
    asked = revisits.filter(F.col("url_key").isNotNull() & F.col("at").isNotNull()).select("url_key", "at").distinct()
    dates = (best.unionByName(asked.withColumn("best", F.lit(None).cast(best.schema["best"].dataType)))
             .groupBy("url_key", "at").agg(F.first("best", ignorenulls=True).alias("best"))
             .withColumn("day", F.to_date("at")))
    earlier = Window.unboundedPreceding, -1
    in_day = Window.partitionBy("url_key", "day").orderBy("at").rowsBetween(*earlier)
    dates = dates.withColumn("same_day", F.last("best", ignorenulls=True).over(in_day))
    days = dates.filter("best IS NOT NULL").groupBy("url_key", "day").agg(F.max_by("best", "at").alias("last"))
    days = days.unionByName(dates.select("url_key", "day").distinct().withColumn("last", F.lit(None).cast(days.schema["last"].dataType)))
    days = days.groupBy("url_key", "day").agg(F.first("last", ignorenulls=True).alias("last"))
    by_day = Window.partitionBy("url_key").orderBy("day").rowsBetween(*earlier)
    days = days.select(F.col("url_key").alias("_u"), F.col("day").alias("_d"), F.last("last", ignorenulls=True).over(by_day).alias("day_before"))
    found = (dates.join(days, (F.col("url_key") == F.col("_u")) & (F.col("day") == F.col("_d")))
             .select(F.col("url_key").alias("_u"), F.col("at").alias("_at"), F.coalesce("same_day", "day_before").alias("o")))
    out = revisits.join(found, (F.col("url_key") == F.col("_u")) & (F.col("at") == F.col("_at")), "left")
    old, new = F.col("o.headers"), F.col("headers")
    tag, date = new["etag"], new["last-modified"]
    same = F.when(tag.isNotNull(), _opaque(tag) == _opaque(old["etag"])).when(date.isNotNull(), date == old["last-modified"])
    verdict = (F.when(F.col("o").isNull(), "no_original").when(tag.isNull() & date.isNull(), "unvalidated")
               .when(F.coalesce(same, F.lit(False)), "resolved").otherwise("validator_mismatch"))
    out = out.withColumn("verdict", verdict)
    used = F.col("verdict").isin("resolved", "unvalidated")
    return out.select("record_id", "url_key", F.col("at").alias("warc_date"), F.when(used, F.col("o.id")).alias("original_id"),
                      "verdict", F.when(used, merged_headers(old, new)).alias("headers"))


def with_bodies(resolved: DataFrame, records: DataFrame, body: str = "body") -> DataFrame:
    """Resolved revisits with the original's body (null where there is none)."""
    bodies = records.select(F.col("record_id").alias("_id"), F.col(body).alias(body))
    return resolved.join(bodies, resolved["original_id"] == bodies["_id"], "left").drop("_id")


def page_records(pages: DataFrame) -> DataFrame:
    """WARC records derived from the pages table: per page a full response and two revisits.

    The first revisit follows a day later under another spelling of the URL, its tag weak,
    changed (every fifth page) or missing (every seventh); the second is dated before the
    page's own response, so only another page with the same URL can be its original.
    """
    day = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    at = F.timestamp_add("SECOND", (F.pmod(F.col("page_id"), F.lit(97)) * 86400 + F.pmod(F.col("page_id") * 7919, F.lit(86400))).cast("int"), day)
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    modified = F.date_format(at, "yyyy-MM-dd")
    size = F.octet_length("html").cast("string")
    p = pages.select("page_id", "url", at.alias("at"), tag.alias("tag"), modified.alias("modified"), size.alias("size"))

    def headers(*pairs):
        arr = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs]), lambda x: x["value"].isNotNull())
        return F.map_from_entries(arr)

    stale = F.pmod("page_id", F.lit(5)) == 0
    untagged = F.pmod("page_id", F.lit(7)) == 0
    new_tag = F.when(untagged, F.lit(None)).when(stale, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), "tag"))
    first = F.when(F.col("url").startswith("http:"), F.concat(F.lit("HTTPS://"), F.substring("url", 8, 100000)))\
        .otherwise(F.concat(F.col("url"), F.lit("#again")))
    full = p.select((F.col("page_id") * 3).alias("record_id"), F.lit("response").alias("warc_type"), F.col("url").alias("target_uri"),
                    F.col("at").alias("warc_date"), F.lit(200).alias("status"),
                    headers(("ETag", F.col("tag")), ("Last-Modified", F.col("modified")), ("Content-Type", F.lit("text/html")),
                            ("Content-Length", F.col("size")), ("Cache-Control", F.lit("max-age=60"))).alias("headers"))
    later = p.select((F.col("page_id") * 3 + 1).alias("record_id"), F.lit("revisit").alias("warc_type"), first.alias("target_uri"),
                     F.timestamp_add("DAY", F.lit(1), F.col("at")).alias("warc_date"), F.lit(304).alias("status"),
                     headers(("etag", new_tag), ("last-modified", F.when(untagged & ~stale, F.col("modified"))), ("Content-Length", F.lit("0")),
                             ("cache-control", F.lit("max-age=600")), ("Age", F.lit("7"))).alias("headers"))
    before = p.select((F.col("page_id") * 3 + 2).alias("record_id"), F.lit("revisit").alias("warc_type"), F.col("url").alias("target_uri"),
                      F.timestamp_add("SECOND", F.lit(-30), F.col("at")).alias("warc_date"), F.lit(304).alias("status"),
                      headers(("Age", F.lit("1"))).alias("headers"))
    return full.unionByName(later).unionByName(before)


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve(page_records(table(spark, sf_dir, "pages")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return out.select("record_id", "url_key", F.date_format("warc_date", "yyyy-MM-dd HH:mm:ss").alias("warc_date"), "original_id", "verdict",
                      text.alias("headers"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id % 97 * 86400 + page_id * 7919 % 86400) AS ts,
         '"' || substr(md5(html), 1, 16) || '"' AS tag, octet_length(encode(html))::VARCHAR AS size FROM pages),
rec AS (
  SELECT page_id * 3 AS record_id, 'response' AS kind, url AS uri, ts, tag, strftime(ts, '%Y-%m-%d') AS modified,
         size, 'max-age=60' AS cache, NULL AS age FROM p
  UNION ALL
  SELECT page_id * 3 + 1, 'revisit', CASE WHEN url LIKE 'http:%' THEN 'HTTPS://' || substr(url, 8) ELSE url || '#again' END,
         ts + INTERVAL 1 DAY, CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 5 = 0 THEN '"changed"' ELSE 'W/' || tag END,
         CASE WHEN page_id % 7 = 0 AND page_id % 5 <> 0 THEN strftime(ts, '%Y-%m-%d') END, '0', 'max-age=600', '7' FROM p
  UNION ALL
  SELECT page_id * 3 + 2, 'revisit', url, ts - INTERVAL 30 SECOND, NULL, NULL, NULL, NULL, '1' FROM p),
cut AS (SELECT *, regexp_replace(regexp_replace(trim(uri), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM rec),
parts AS (
  SELECT *, list_sort(list_filter(string_split(regexp_extract(u, '^[^?]*\?(.*)$', 1), '&'),
           lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[^=]*|fbclid|gclid|ref|sessionid)(=|$)'))) AS qs FROM cut),
keyed AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '')
    || CASE WHEN len(qs) > 0 THEN '?' || array_to_string(qs, '&') ELSE '' END AS url_key
  FROM parts),
matched AS (
  SELECT r.*, f.record_id AS f_id, f.tag AS f_tag, f.modified AS f_modified, f.size AS f_size, f.cache AS f_cache
  FROM (SELECT * FROM keyed WHERE kind = 'revisit') r
  LEFT JOIN (SELECT * FROM keyed WHERE kind = 'response') f ON r.url_key = f.url_key AND f.ts < r.ts
  QUALIFY row_number() OVER (PARTITION BY r.record_id ORDER BY f.ts DESC NULLS LAST, f.record_id DESC) = 1),
judged AS (
  SELECT *, CASE WHEN f_id IS NULL THEN 'no_original' WHEN tag IS NULL AND modified IS NULL THEN 'unvalidated'
    WHEN coalesce(CASE WHEN tag IS NOT NULL THEN regexp_replace(tag, '^W/', '') = f_tag ELSE modified = f_modified END, false)
    THEN 'resolved' ELSE 'validator_mismatch' END AS verdict FROM matched)
SELECT record_id, url_key, strftime(ts, '%Y-%m-%d %H:%M:%S') AS warc_date,
  CASE WHEN verdict IN ('resolved', 'unvalidated') THEN f_id END AS original_id, verdict,
  CASE WHEN verdict IN ('resolved', 'unvalidated') THEN
    'age: ' || age || chr(10) || 'cache-control: ' || coalesce(cache, f_cache) || chr(10) || 'content-length: ' || f_size || chr(10)
    || 'content-type: text/html' || chr(10) || 'etag: ' || coalesce(tag, f_tag) || chr(10)
    || 'last-modified: ' || coalesce(modified, f_modified) END AS headers
FROM judged
"""
