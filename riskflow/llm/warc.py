"""Not-modified revisits of an archive: which full response stands for them.

Each revisit takes the latest strictly earlier full response of the same canonical URL. Its
validators are checked (ETag if both have one, else Last-Modified), and the headers that a
304 answer may carry replace those of the response.

The as-of join runs on ranges of (URL, time): a hot URL is spread over ranges by time, each
range is walked by itself, and only the last response of every (range, URL) is carried on.
Defined results: a record without URL or time resolves to nothing (``no_response``) and is
never resolved to; of several responses at one time the largest record id counts; a revisit
at the very time of a response does not see it; repeated rows are resolved one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.common import stage

#: fixed values: headers a 304 answer may update (RFC 9110, 15.4.5)
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
RECORD = "record_id long, kind string, url string, time timestamp, headers map<string,string>, digest string"


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, sorted query, path ``/`` at least."""
    bare = F.regexp_replace(url, r"#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    host = F.lower(F.regexp_extract(bare, r"^[^:/?]*://([^/?]*)", 1))
    port = F.when(scheme == "http", ":80$").when(scheme == "https", ":443$").otherwise("$^")
    host = F.regexp_replace(host, port, F.lit(""))
    path = F.regexp_extract(bare, r"^[^:/?]*://[^/?]*([^?]*)", 1)
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    query = F.array_join(F.array_sort(F.split(query, "&")), "&")
    return F.concat(
        scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path),
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )


def resolve(records: DataFrame) -> DataFrame:
    """Revisits of ``records`` (columns of ``RECORD``, header names in lower case) with their response.

    Adds ``canonical_url``, ``response_id``, ``outcome`` (``resolved``, ``validator_mismatch``,
    ``no_response``), ``merged`` headers and the response's ``response_digest``. The last two are null
    unless resolved.
    """
    spark = records.sparkSession
    full = F.when(
        F.col("kind") == "response",
        F.struct("time", "record_id", "headers", "digest"),
    )
    narrow = records.select("record_id", "kind", "url", "time", "headers", "digest")
    keyed = narrow.withColumn("canonical_url", canonical(F.col("url")))
    able = F.col("canonical_url").isNotNull() & F.col("time").isNotNull()
    late = F.when(F.col("kind") == "response", 1).otherwise(0).alias("_late")
    order = ["canonical_url", "time", "_late", "record_id"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        keyed.where(able).select("*", late).repartitionByRange(parts, *order)
        .withColumn("_range", F.spark_partition_id())
    )
    rows = stage(ranged, "warc-ranges").withColumn("_full", full)
    ends = (
        rows.where(F.col("kind") == "response").groupBy("canonical_url", "_range")
        .agg(F.max_by(F.struct("record_id", "headers", "digest"), F.struct("time", "record_id")).alias("_end"))
    )
    # what earlier ranges of the URL leave behind: one row per URL and range
    touched = rows.groupBy("canonical_url", "_range").agg(F.count("*").alias("_n")).drop("_n")
    before = Window.partitionBy("canonical_url").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = touched.join(ends, ["canonical_url", "_range"], "left").select(
        "canonical_url", "_range", F.last("_end", ignorenulls=True).over(before).alias("_carry")
    )
    inside = Window.partitionBy("canonical_url", "_range").orderBy("time", "_late", "record_id")
    seen = rows.withColumn(
        "_here", F.last("_full", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ).where(F.col("kind") == "revisit")
    pick = lambda f: F.coalesce(F.col(f"_here.{f}"), F.col(f"_carry.{f}"))
    found = seen.join(carried, ["canonical_url", "_range"], "left").select(
        "record_id", "url", "time", "headers", "canonical_url",
        pick("record_id").alias("response_id"), pick("headers").alias("_theirs"),
        pick("digest").alias("response_digest"),
    )
    rest = keyed.where(~able & (F.col("kind") == "revisit")).select(
        "record_id", "url", "time", "headers", "canonical_url", F.lit(None).cast("long").alias("response_id"),
        F.lit(None).cast("map<string,string>").alias("_theirs"), F.lit(None).cast("string").alias("response_digest"),
    )
    return _judged(found.unionByName(rest))


def _judged(found: DataFrame) -> DataFrame:
    ours, theirs = F.col("headers"), F.col("_theirs")
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    tag = weak(ours["etag"]) != weak(theirs["etag"])
    mismatch = F.coalesce(tag, ours["last-modified"] != theirs["last-modified"], F.lit(False))
    outcome = F.when(F.col("response_id").isNull(), "no_response").when(mismatch, "validator_mismatch").otherwise("resolved")
    news = F.map_filter(F.coalesce(ours, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(PERMITTED) & v.isNotNull())
    base = F.map_filter(F.coalesce(theirs, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(news, k))
    good = outcome == "resolved"
    return found.select(
        "record_id", "url", "time", "canonical_url", "response_id", outcome.alias("outcome"),
        F.when(good, F.map_concat(base, news)).alias("merged"),
        F.when(good, F.col("response_digest")).alias("response_digest"),
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Every page as a full response, captured later a second time as not modified.

    The revisit spells the URL differently (capital host, default port, another fragment). One in
    seven brings another ETag, one in five no ETag but a Last-Modified.
    """
    p = F.col("page_id")
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s)
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 12), F.lit('"'))
    modified = F.concat(F.lit("day "), (p % 28).cast("string"))
    response = pages.select(
        (p * 2).alias("record_id"), F.lit("response").alias("kind"), "url",
        at(p * 10).alias("time"),
        F.create_map(
            F.lit("content-type"), F.lit("text/html"), F.lit("etag"), tag, F.lit("last-modified"), modified,
            F.lit("date"), F.concat(F.lit("t"), p.cast("string")),
        ).alias("headers"),
        F.md5(F.coalesce("html", F.lit(""))).alias("digest"),
    )
    host = F.regexp_extract("url", "^(https?://)([^/?#]*)(.*)$", 2)
    tail = F.regexp_replace(F.regexp_extract("url", "^(https?://)([^/?#]*)(.*)$", 3), "#.*$", "")
    scheme = F.regexp_extract("url", "^(https?://)", 1)
    port = F.when(p % 3 == 0, F.when(scheme == "http://", ":80").otherwise(":443")).otherwise("")
    revisit = pages.select(
        (p * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"),
        F.concat(scheme, F.upper(host), port, tail, F.lit("#again")).alias("url"),
        at(p * 10 + 5000).alias("time"),
        F.map_filter(
            F.create_map(
                F.lit("etag"),
                F.when(p % 5 == 0, None).when(p % 7 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag)),
                F.lit("last-modified"), modified, F.lit("content-type"), F.lit("not/merged"),
                F.lit("date"), F.concat(F.lit("again "), p.cast("string")), F.lit("expires"), F.lit("never"),
            ),
            lambda k, v: v.isNotNull(),
        ).alias("headers"),
        F.lit(None).cast("string").alias("digest"),
    )
    return response.unionByName(revisit)


#: DuckDB SQL of the query; the canonical URL of these pages is spelled out by the same rules
SQL = r"""
WITH p AS (SELECT *, '"' || left(md5(coalesce(html, '')), 12) || '"' AS tag, 'day ' || (page_id % 28) AS modified,
  regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host,
  regexp_replace(regexp_extract(url, '^https?://[^/?#]*(.*)$', 1), '#.*$', '') AS tail FROM pages),
c AS (SELECT *, scheme || '://' || lower(host) || CASE WHEN regexp_extract(tail, '^([^?]*)', 1) = '' THEN '/'
    ELSE regexp_extract(tail, '^([^?]*)', 1) END || CASE WHEN regexp_extract(tail, '\?(.*)$', 1) = '' THEN ''
    ELSE '?' || array_to_string(list_sort(string_split(regexp_extract(tail, '\?(.*)$', 1), '&')), '&') END AS canon FROM p),
j AS (SELECT v.page_id, v.canon, v.tag, v.modified, r.page_id AS rid, r.tag AS rtag, r.modified AS rmod,
    md5(coalesce(r.html, '')) AS rdigest,
    row_number() OVER (PARTITION BY v.page_id ORDER BY r.page_id DESC NULLS LAST) AS k
  FROM c v LEFT JOIN c r ON v.canon = r.canon AND r.page_id * 10 < v.page_id * 10 + 5000),
o AS (SELECT *, CASE WHEN rid IS NULL THEN 'no_response'
    WHEN page_id % 5 != 0 THEN CASE WHEN page_id % 7 = 0 OR tag != rtag THEN 'validator_mismatch' ELSE 'resolved' END
    WHEN modified != rmod THEN 'validator_mismatch' ELSE 'resolved' END AS outcome FROM j WHERE k = 1)
SELECT page_id * 2 + 1 AS record_id, canon AS canonical_url, rid * 2 AS response_id, outcome,
  CASE WHEN outcome = 'resolved' THEN 'content-type=text/html;date=again ' || page_id || ';etag=' ||
    CASE WHEN page_id % 5 = 0 THEN rtag ELSE 'W/' || tag END || ';expires=never;last-modified=' || rmod END AS merged,
  CASE WHEN outcome = 'resolved' THEN rdigest END AS response_digest
FROM o
"""
