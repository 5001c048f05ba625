"""Mail messages: body extraction from flattened parts, conversion to scans, accounting."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.functions.columns import blank, filled, keep
from riskflow.functions.text import html_to_text, stripped
from riskflow.functions.urls import extract_mail_urls
from riskflow.operators.joins import keep_rows

# charset names that Spark decodes; all others fall back to UTF-8 (fixed values)
CHARSETS = {
    "iso-8859-1": "ISO-8859-1", "latin1": "ISO-8859-1", "us-ascii": "US-ASCII",
    "utf-16": "UTF-16", "utf-16be": "UTF-16BE", "utf-16le": "UTF-16LE",
}
# single characters are looked up in one table, ranges are tried one after the other
NOT_BASE64 = f"[^{string.ascii_letters}{string.digits}+/_\\-]+"


def _charset(part: Column) -> Column:
    types = F.filter(
        F.map_entries(part["headers"]), lambda e: F.lower(e["key"]) == "content-type"
    )
    return F.lower(
        F.regexp_extract(
            F.coalesce(F.try_element_at(types, F.lit(1))["value"], F.lit("")),
            r"(?i)charset\s*=\s*[\"']?([^;\"'\s]+)",
            1,
        )
    )


def _decoded(parts: Column) -> Column:
    """Text of each part. Every step is a transform of its own, so it runs once per part."""
    clean = lambda p: F.replace(
        F.replace(F.regexp_replace(p["data"], NOT_BASE64, ""), F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/")
    )
    padded = lambda d: F.concat(d, F.repeat(F.lit("="), F.pmod(-F.length(d), F.lit(4))))

    def text(part: Column) -> Column:
        out = F.decode(part["content"], "UTF-8")
        for name, spark_name in CHARSETS.items():
            out = F.when(part["charset"] == name, F.decode(part["content"], spark_name)).otherwise(out)
        return out

    raw = F.transform(
        parts,
        lambda p: F.struct(
            _charset(p).alias("charset"), F.when(filled(p["data"]), clean(p)).alias("data")
        ),
    )
    content = F.transform(
        raw,
        lambda p: F.struct(
            p["charset"].alias("charset"),
            F.try_to_binary(padded(p["data"]), F.lit("base64")).alias("content"),
        ),
    )
    return F.transform(content, text)


def extract_mail(messages: DataFrame) -> DataFrame:
    """Readable body of each message.

    Adds ``status`` (extracted, missing_body, malformed), ``sender``, ``recipient``,
    ``subject``, ``body_text`` and ``urls``. Plain parts win over HTML parts; parts
    with a file name or an attachment id are skipped.
    """
    mime = lambda p: F.lower(F.trim(F.substring_index(p["mime"], ";", 1)))
    inline = F.filter(
        "parts", lambda p: blank(p["filename"]) & blank(p["attachment_id"])
    )
    decode = lambda kind: F.filter(
        _decoded(F.filter(inline, lambda p: mime(p) == kind)),
        lambda t: F.coalesce(F.trim(t) != "", F.lit(False)),
    )
    header = lambda name: F.nullif(
        F.try_element_at(
            F.filter(F.map_entries("headers"), lambda e: F.lower(e["key"]) == name), F.lit(-1)
        )["value"],
        F.lit(""),
    )
    df = messages.withColumns({"_plain": decode("text/plain"), "_html": decode("text/html")})
    df = df.withColumn("_html", F.transform("_html", html_to_text))
    body = F.when(F.size("_plain") > 0, F.array_join("_plain", "\n")).when(
        F.size("_html") > 0, F.array_join("_html", "\n")
    )
    # without the mark of a scheme there is no link to look for
    linked = F.filter(F.concat("_plain", "_html"), lambda t: t.contains("://"))
    df = df.withColumns(
        {
            "body_text": stripped(body),
            "urls": F.array_distinct(
                F.flatten(F.transform(linked, extract_mail_urls))
            ),
            "sender": header("from"),
            "recipient": header("to"),
            "subject": header("subject"),
        }
    )
    broken = blank(F.col("message_id")) | F.col("parts").isNull()
    return df.withColumn(
        "status",
        F.when(broken, F.lit("malformed"))
        .when(blank(F.col("body_text")), F.lit("missing_body"))
        .otherwise("extracted"),
    ).drop("_plain", "_html", "parts")


def mail_to_scans(mails: DataFrame) -> DataFrame:
    """Scan rows of extracted messages."""
    line = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(label), F.col(c)))
    text = F.concat_ws(
        "\n",
        line("Subject: ", "subject"),
        line("From: ", "sender"),
        line("To: ", "recipient"),
        F.lit(""),
        "body_text",
    )
    meta = F.map_filter(
        F.create_map(
            F.lit("gmail_message_id"), F.col("message_id"),
            F.lit("embedded_urls"), F.to_json("urls"),
            F.lit("recipient"), F.col("recipient"),
            F.lit("subject"), F.col("subject"),
        ),
        lambda k, v: v.isNotNull(),
    )
    keep = [c for c in ("ts", "arrival_seq", "client_id") if c in mails.columns]
    # a plain filter would decode every body again for the test of its status
    return keep_rows(mails, F.col("status") == "extracted").select(
        F.col("message_id").alias("scan_id"),
        text.alias("text"),
        F.try_element_at("urls", F.lit(1)).alias("url"),
        F.col("sender").alias("sender_id"),
        F.lit("gmail").alias("source_channel"),
        meta.alias("metadata"),
        *keep,
    )


def fetch_summary(mails: DataFrame) -> DataFrame:
    """One row: messages, skipped and outcome of a fetch; ids count once."""
    kept = mails.groupBy("message_id").agg(F.min("status").alias("status"))
    skipped = F.coalesce(
        F.sum(F.when(F.col("status") != "extracted", 1).otherwise(0)), F.lit(0)
    )
    row = kept.agg(
        F.count_if(F.col("status") == "extracted").alias("emails"),
        skipped.cast("bigint").alias("skipped_messages"),
    )
    return row.withColumn(
        "outcome",
        F.when(F.col("emails") > 0, F.lit("messages"))
        .when(F.col("skipped_messages") > 0, F.lit("no_readable_messages"))
        .otherwise("no_unread_messages"),
    )
