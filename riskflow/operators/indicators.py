"""Look-ups against indicator and allow-list tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.functions.urls import url_host
from riskflow.operators.joins import dim_join, is_small

_HIT = ["url", "domain", "threat_type", "tags", "url_status", "first_seen", "source"]


def with_feed_hit(
    df: DataFrame, feed: DataFrame, url: str = "url", online_only: bool = False
) -> DataFrame:
    """Add ``feed_hit``: the indicator row of the exact link, else of its host, else null.

    Several indicators of one host are reduced to the smallest URL first, so the
    join cannot multiply rows.
    """
    feed = feed.select(*[c if c in feed.columns else F.lit(None).cast("string").alias(c)
                         for c in _HIT])
    if online_only:
        feed = feed.where("url_status = 'online'")
    small = is_small(feed)
    row = F.struct(*_HIT)
    exact = feed.groupBy(F.col("url").alias("_fu")).agg(F.min(row).alias("_exact"))
    by_host = (
        feed.where("domain <> ''")
        .groupBy(F.col("domain").alias("_fd"))
        .agg(F.min(row).alias("_byhost"))
    )
    df = df.withColumns({"_lu": F.trim(url), "_lh": url_host(F.trim(url))})
    df = dim_join(df, exact, F.col("_lu") == F.col("_fu"), small=small)
    df = dim_join(df, by_host, F.col("_lh") == F.col("_fd"), small=small)
    return df.withColumn("feed_hit", F.coalesce("_exact", "_byhost")).drop(
        "_lu", "_lh", "_fu", "_fd", "_exact", "_byhost"
    )


def with_allow_list(df: DataFrame, allow: DataFrame, url: str = "url") -> DataFrame:
    """Add ``allow_listed``: the host, or its last two labels, is on the list.

    Values without ``://`` are taken as a host name.
    """
    small = is_small(allow)
    names = allow.select(F.lower("domain").alias("_ad")).distinct().withColumn("_in", F.lit(True))
    host = F.when(F.col(url).contains("://"), url_host(F.col(url))).otherwise(
        F.lower(F.trim(url))
    )
    df = df.withColumn("_ah", host)
    df = df.withColumn(
        "_ap",
        F.when(
            F.size(F.split("_ah", r"\.")) > 2, F.substring_index(F.col("_ah"), ".", -2)
        ),
    )
    for key, out in (("_ah", "_full"), ("_ap", "_parent")):
        side = names.select(F.col("_ad").alias(out + "_d"), F.col("_in").alias(out))
        df = dim_join(df, side, F.col(key) == F.col(out + "_d"), small=small)
    return df.withColumn(
        "allow_listed", F.coalesce("_full", "_parent", F.lit(False))
    ).drop("_ah", "_ap", "_full", "_full_d", "_parent", "_parent_d")


def with_hash_hit(df: DataFrame, hashes: DataFrame, content: str = "file_bytes") -> DataFrame:
    """Add ``sha256`` of the content and ``hash_hit``, the indicator row or null."""
    one = hashes.groupBy(F.lower(F.trim("sha256")).alias("_hk")).agg(
        F.min(
            F.struct("signature", "file_type", "clamav", "vt_percent", "first_seen", "source")
        ).alias("hash_hit")
    )
    df = df.withColumn(
        "sha256", F.when(F.octet_length(content) > 0, F.sha2(F.col(content), 256))
    )
    return dim_join(df, one, F.col("sha256") == F.col("_hk"), small=is_small(hashes)).drop("_hk")
