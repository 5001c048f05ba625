"""Mail-header rules over one row per message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow import dims
from riskflow.functions.columns import (
    engine_result,
    evidence_list,
    filled,
    flag_list,
    in_words,
    skipped_result,
)

# canonical column -> header names in order of preference (fixed values)
HEADER_NAMES = {
    "h_from": ["From", "from", "From-Address"],
    "h_reply_to": ["Reply-To", "reply_to", "reply-to"],
    "h_return_path": ["Return-Path", "return_path", "return-path"],
    "h_message_id": ["Message-ID", "message_id", "message-id"],
    "h_date": ["Date", "date"],
    "h_auth": ["Authentication-Results", "auth_results", "authentication-results"],
    "h_spf": ["spf", "SPF"],
    "h_dkim": ["dkim", "DKIM"],
    "h_dmarc": ["dmarc", "DMARC"],
    "h_received": ["Received", "received"],
}
ZONES = {
    "GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400",
    "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}


def with_headers(df: DataFrame) -> DataFrame:
    """Add the canonical header columns and ``has_headers`` from the maps of a scan row."""
    find = lambda names: F.coalesce(
        *[F.try_element_at(F.col(m), F.lit(n)) for n in names for m in ("headers", "metadata")]
    )
    df = df.withColumns({c: find(n) for c, n in HEADER_NAMES.items()})
    hops = F.coalesce(F.size("received") > 0, F.lit(False))
    any_header = F.coalesce(F.size("headers") > 0, F.lit(False)) | hops
    for c in HEADER_NAMES:
        any_header = any_header | filled(F.col(c))
    return df.withColumns(
        {
            "has_headers": any_header,
            "h_from": F.when(filled(F.col("h_from")), F.col("h_from")).otherwise(
                F.col("sender_id")
            ),
        }
    )


def mail_address(raw: Column) -> Column:
    inner = F.regexp_extract(raw, "<([^>]+)>", 1)
    return F.lower(F.trim(F.when(inner != "", inner).otherwise(raw)))


def mail_domain(address: Column) -> Column:
    return F.substring_index(address, "@", -1)


def mail_date_seconds(date: Column) -> Column:
    """Epoch seconds of an RFC 5322 date, null when it cannot be read; no zone means UTC."""
    text = F.trim(F.regexp_replace(F.regexp_replace(date, r"\([^)]*\)", ""), r"^\s*[A-Za-z]+,?\s+(?=\d)", ""))
    for name, offset in ZONES.items():
        text = F.regexp_replace(text, rf"\s{name}$", f" {offset}")
    text = F.regexp_replace(text, r"\s+", " ")
    stamp = F.coalesce(
        *[
            F.try_to_timestamp(text, F.lit(p))
            for p in (
                "d MMM yyyy HH:mm:ss xx",
                "d MMM yyyy HH:mm xx",
                "d MMM yyyy HH:mm:ss",
                "d MMM yyyy HH:mm",
            )
        ]
    )
    return stamp.cast("double")


def with_header_signals(df: DataFrame) -> DataFrame:
    """Add ``header_score`` (0-90), ``header_flags`` and ``header_evidence``.

    Reads the canonical columns; ``received`` (array of hops) and ``meta_ts`` (epoch
    seconds of the scan) are optional.
    """
    col = F.col
    df = df.withColumns(
        {
            "_h_fe": F.coalesce(mail_address(col("h_from")), F.lit("")),
            "_h_re": F.coalesce(mail_address(col("h_reply_to")), F.lit("")),
            "_h_pe": F.coalesce(mail_address(col("h_return_path")), F.lit("")),
            "_h_me": F.coalesce(mail_address(col("h_message_id")), F.lit("")),
            "_h_al": F.coalesce(F.lower("h_auth"), F.lit("")),
        }
    )
    df = df.withColumns({f"_h_{x}d": mail_domain(col(f"_h_{x}e")) for x in "frpm"})
    differs = lambda a, b: (col(a) != "") & (col(b) != "") & (col(a) != col(b))
    reply = filled(col("h_reply_to")) & differs("_h_re", "_h_fe")
    reply_domain = reply & differs("_h_rd", "_h_fd")
    bounce = filled(col("h_return_path")) & differs("_h_pd", "_h_fd")
    # failures named by their own header come before those of the summary header
    summary = lambda n: f"contains(_h_al, 'fail') AND contains(_h_al, '{n}')"
    failures = F.concat(
        flag_list(
            {
                "SPF": in_words("lower(h_spf)", dims.SPF_FAIL),
                "DKIM": in_words("lower(h_dkim)", dims.DKIM_FAIL),
                "DMARC": in_words("lower(h_dmarc)", dims.DMARC_FAIL),
            }
        ),
        flag_list({"SPF": summary("spf"), "DKIM": summary("dkim"), "DMARC": summary("dmarc")}),
    )
    df = df.withColumn("_h_fails", F.array_distinct(failures))
    failed = F.size("_h_fails") > 0
    id_missing = col("h_message_id").isNull()
    id_blank = ~id_missing & (F.trim("h_message_id") == "")
    id_other = ~id_missing & ~id_blank & differs("_h_md", "_h_fd")
    late = F.lit(False)
    if "meta_ts" in df.columns:
        sent = mail_date_seconds(col("h_date"))
        late = F.coalesce(
            (col("meta_ts") != 0) & (F.abs(col("meta_ts") - sent) > 7 * 86400), F.lit(False)
        )
    forged = F.coalesce(F.lower("h_received").contains("forged"), F.lit(False))
    hops = F.lit(False)
    if "received" in df.columns:
        hops = F.coalesce(
            F.exists(
                "received",
                lambda h: F.lower(h).contains("forged") | F.lower(h).contains("suspicious"),
            ),
            F.lit(False),
        )
    df = df.withColumns(
        {
            "_h_reply": reply, "_h_reply_dom": reply_domain, "_h_bounce": bounce,
            "_h_failed": failed, "_h_missing": id_missing, "_h_blank": id_blank,
            "_h_other": id_other, "_h_late": late, "_h_forged": forged, "_h_hops": forged | hops,
        }
    )
    id_odd = "(_h_missing OR _h_blank OR _h_other)"
    total = F.expr(
        "CASE WHEN _h_reply_dom THEN 0.3D WHEN _h_reply THEN 0.1D ELSE 0.0D END"
        " + if(_h_bounce, 0.3D, 0.0D) + if(_h_failed, 0.4D, 0.0D)"
        f" + if({id_odd}, 0.1D, 0.0D) + if(_h_late, 0.2D, 0.0D) + if(_h_hops, 0.3D, 0.0D)"
    )
    flags = F.concat(
        flag_list({"REPLY_TO_MISMATCH": "_h_reply", "RETURN_PATH_MISMATCH": "_h_bounce"}),
        F.expr("transform(_h_fails, f -> concat(f, '_FAILURE'))"),
        flag_list(
            {
                "AUTHENTICATION_FAILURE": "_h_failed",
                "MESSAGE_ID_ANOMALY": id_odd,
                "TIMESTAMP_ANOMALY": "_h_late",
                "RECEIVED_CHAIN_ANOMALY": "_h_hops",
            }
        ),
    )
    items = evidence_list(
        [
            ("reply_to_mismatch", "h_reply_to",
             "Reply-To domain ({_h_rd}) differs from From domain ({_h_fd})", "_h_reply_dom"),
            ("reply_to_mismatch", "h_reply_to",
             "Reply-To email ({_h_re}) differs from From email ({_h_fe})",
             "_h_reply AND NOT _h_reply_dom"),
            ("return_path_mismatch", "h_return_path",
             "Return-Path domain ({_h_pd}) differs from From domain ({_h_fd})", "_h_bounce"),
            ("authentication_failure", "array_join(_h_fails, ',')",
             "Authentication failed for: {array_join(_h_fails, ', ')}", "_h_failed"),
            ("message_id_anomaly", "''", "Message-ID header is missing entirely", "_h_missing"),
            ("message_id_anomaly", "''", "Message-ID header is missing or empty", "_h_blank"),
            ("message_id_anomaly", "h_message_id",
             "Message-ID domain ({_h_md}) does not match sender domain ({_h_fd})", "_h_other"),
            ("timestamp_anomaly", "h_date",
             "Email Date header differs significantly from scan reference time", "_h_late"),
            ("received_chain_anomaly", "'forged'", "Received chain contains signs of forging",
             "_h_forged"),
            ("received_chain_anomaly", "'suspicious'",
             "Received chain indicates suspicious hops", "_h_hops AND NOT _h_forged"),
        ]
    )
    df = df.withColumns(
        {
            "header_score": F.least(total, F.lit(0.9)) * 100.0,
            "header_flags": flags,
            "header_evidence": items,
        }
    )
    return df.drop(*[c for c in df.columns if c.startswith("_h_")])


def header_result() -> Column:
    count = F.size("header_flags")
    result = engine_result(
        dims.HEADER_ENGINE,
        F.col("header_score"),
        F.when(count > 0, 0.8).otherwise(1.0),
        F.col("header_flags"),
        F.col("header_evidence"),
        metadata=F.when(
            count > 0,
            F.create_map(F.lit("anomalies_detected"), count.cast("string")),
        ).otherwise(F.create_map().cast("map<string,string>")),
    )
    return F.when(F.col("has_headers"), result).otherwise(
        skipped_result(dims.HEADER_ENGINE, "No normalized header metadata found")
    )


