"""Redirect chains over a crawled hop table ``redirects(url, status, location)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.functions.urls import is_ip_literal, is_public_address, with_url_parts
from riskflow.operators.chains import follow
from riskflow.operators.joins import BROADCAST_ROWS, dim_join
from riskflow.session import cut

REDIRECT_STATUS = [301, 302, 303, 307, 308]


def _resolved(base: str, location: Column) -> Column:
    """Location against the URL parts of its page; absolute ones stay as they are."""
    c = lambda n: F.col(base + n)
    root = F.concat(c("scheme"), F.lit("://"), c("netloc"))
    folder = F.regexp_replace(
        F.when(c("path") == "", F.lit("/")).otherwise(c("path")), r"[^/]*$", ""
    )
    query = F.when(location.startswith("?"), F.concat(root, c("path"), location))
    relative = F.concat(folder, location)
    # drop "." and resolve "x/.." steps of all folders; the last step is not a folder
    steps = F.split(relative, "/")
    kept = F.aggregate(
        F.slice(steps, 2, F.greatest(F.size(steps) - 2, F.lit(0))),
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done)
        .when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.array_append(done, s)),
    )
    last = F.element_at(steps, -1)
    tidy = F.concat(F.lit("/"), F.array_join(F.array_append(kept, last), "/"))
    return (
        F.when(location.rlike(r"(?i)^[a-z][a-z0-9+.\-]*:"), location)
        .when(location.startswith("//"), F.concat(c("scheme"), F.lit(":"), location))
        .when(location.startswith("/"), F.concat(root, location))
        .when(query.isNotNull(), query)
        .otherwise(F.concat(root, tidy))
    )


def hop_table(redirects: DataFrame) -> DataFrame:
    """url -> next_url for every hop that is followed; one row per URL."""
    p = "_rd_"
    rows = with_url_parts(
        redirects.where(F.col("status").isin(REDIRECT_STATUS) & (F.col("location") != "")),
        "url",
        p,
    )
    c = lambda n: F.col(p + n)
    unsafe = is_ip_literal(c("host")) & ~is_public_address(c("host"))
    return (
        rows.where(~unsafe)
        .select("url", _resolved(p, F.col("location")).alias("next_url"))
        .groupBy("url")
        .agg(F.min("next_url").alias("next_url"))
    )


def chain_ends(redirects: DataFrame, max_hops: int | None = None) -> tuple[DataFrame, int]:
    """``start, end, cyclic`` of every URL that redirects, and their number.

    ``end`` is null where a target has credentials, another scheme or no host, or where the chain
    never ends. With ``max_hops`` a chain is left there; the target of its last hop is not looked at.
    """
    p = "_pt_"
    c = lambda n: F.col(p + n)
    fine = c("scheme").isin("http", "https") & (c("userinfo") == "") & (c("host") != "")
    links = with_url_parts(hop_table(redirects), "next_url", p).select(
        F.col("url").alias("node"), F.col("next_url").alias("next"), F.coalesce(fine, F.lit(False)).alias("ok")
    )
    if max_hops is None:
        ends, total = follow(links)
        return ends.select(
            F.col("node").alias("start"), F.when(F.col("ok"), F.col("at")).alias("end"), "cyclic"
        ), total
    links = cut(links)
    near, total = follow(links, max_hops - 1)
    last = links.select(F.col("node").alias("at"), F.col("next").alias("_last"))
    return near.join(last, "at", "left").select(
        F.col("node").alias("start"),
        F.when(F.col("ok"), F.coalesce("_last", "at")).alias("end"),
        F.lit(False).alias("cyclic"),
    ), total


def resolve_redirects(
    df: DataFrame, redirects: DataFrame, url: str = "url", max_hops: int | None = None
) -> DataFrame:
    """Add ``final_url``: the end of the link's redirect chain.

    Chains are followed once per redirecting URL, however many rows share it. Where a chain is
    unsafe or never ends the URL stays as it was. ``max_hops`` leaves longer chains early.
    """
    ends, total = chain_ends(redirects, max_hops)
    ends = ends.where("end IS NOT NULL").select(F.col("start").alias("_start"), F.col("end").alias("_end"))
    return (
        dim_join(df, ends, F.col(url) == F.col("_start"), small=total <= BROADCAST_ROWS)
        .withColumn("final_url", F.coalesce("_end", url))
        .drop("_start", "_end")
    )
