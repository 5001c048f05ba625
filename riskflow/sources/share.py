"""Routing of shared payloads to text, link or file scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.functions.columns import blank
from riskflow.functions.urls import first_share_url

SEND = "android.intent.action.SEND"
APPLICATION_TYPES = ["application/json", "application/xml", "application/x-www-form-urlencoded"]


def route_shares(shares: DataFrame) -> DataFrame:
    """Add ``kind`` (Text, URL, File), ``scan_text``, ``scan_url`` and ``reject_reason``.

    Reads ``action, mime_type, text, stream_uri, data_uri, file_name, file_content,
    file_error``.
    """
    mime = F.lower(F.trim(F.substring_index("mime_type", ";", 1)))
    df = shares.withColumns(
        {
            "_mime_ok": F.coalesce(
                mime.startswith("text/") | mime.isin(APPLICATION_TYPES), F.lit(False)
            ),
            "_text": F.nullif(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), F.lit("")),
            "_file": ~blank(F.col("stream_uri")),
            "_data": F.when(F.col("data_uri").rlike("(?i)^https?://"), F.col("data_uri")),
        }
    )
    df = df.withColumn(
        "_shared", F.when(F.col("_file"), F.col("_text")).otherwise(F.coalesce("_text", "_data"))
    )
    found = first_share_url(F.col("_shared"))
    df = df.withColumn(
        "_url", F.when(F.col("_file"), found).otherwise(F.coalesce(found, F.col("_data")))
    )
    reject = (
        F.when(~F.col("action").eqNullSafe(SEND), F.lit("Unsupported share action."))
        .when(F.col("_file") & ~F.col("_mime_ok"), F.lit("Unsupported shared file type."))
        .when(F.col("_file") & F.col("file_error").isNotNull(), F.col("file_error"))
        .when(
            F.col("_file") & (F.coalesce(F.length("file_content"), F.lit(0)) == 0),
            F.lit("Shared file is empty."),
        )
        .when(
            ~F.col("_file") & F.col("mime_type").isNotNull() & ~F.col("_mime_ok"),
            F.lit("Unsupported shared content type."),
        )
        .when(
            ~F.col("_file") & F.col("_shared").isNull(),
            F.lit("No shared text or URL was provided."),
        )
    )
    df = df.withColumn("reject_reason", reject)
    ok = F.col("reject_reason").isNull()
    return df.withColumns(
        {
            "kind": F.when(
                ok,
                F.when(F.col("_file"), F.lit("File"))
                .when(F.col("_url").isNotNull(), F.lit("URL"))
                .otherwise("Text"),
            ),
            "scan_url": F.when(ok, F.col("_url")),
            "scan_text": F.when(
                ok & ~F.col("_shared").eqNullSafe(F.col("_url")), F.col("_shared")
            ),
            "source_channel": F.lit("android_share"),
        }
    ).drop("_mime_ok", "_text", "_file", "_data", "_shared", "_url")
