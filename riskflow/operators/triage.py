"""Offline triage: a second scorer with its own constants, no look-ups needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow import dims
from riskflow.functions.columns import (
    blank,
    contains_any,
    engine_result,
    evidence_list,
    flag_list,
    in_words,
    lookup,
    matched_words,
    skipped_result,
    words,
)
from riskflow.functions.files import extension
from riskflow.functions.urls import first_triage_url

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_IP = rf"(?:{_OCTET}\.){{3}}{_OCTET}"


def _points(*pairs: tuple[str, object]) -> Column:
    """Sum of the points whose SQL condition holds."""
    return F.expr(" + ".join(f"if({c}, cast({n} AS DOUBLE), 0.0D)" for c, n in pairs))


def _strict_host(url: Column) -> Column:
    """Host as a strict URI parser reports it, else the text up to slash, query and port."""
    legal = url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]*$")
    authority = F.regexp_extract(url, r"://(?:[^/?#@]*@)?([^/?#:@]+)(?::\d*)?(?:[/?#]|$)", 1)
    named = authority.rlike(
        r"^(?:(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)*"
        r"[A-Za-z](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.?|\d{1,3}(?:\.\d{1,3}){3})$"
    )
    rest = F.when(
        F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    ).otherwise(url)
    fallback = F.substring_index(
        F.substring_index(F.regexp_extract(rest, r"^([^/?]*)", 1), "@", -1), ":", 1
    )
    return F.when(legal & named, authority).otherwise(F.nullif(fallback, F.lit("")))


def with_triage_url(df: DataFrame, url: str = "url", text: str = "text") -> DataFrame:
    p = "_tu_"
    c = lambda n: F.col(p + n)
    df = df.withColumn(
        p + "url", F.trim(F.coalesce(F.col(url), first_triage_url(F.col(text))))
    )
    df = df.withColumns({p + "host": _strict_host(c("url")), p + "low": F.lower(c("url"))})
    host = c("host")
    chars = F.length(host)
    share = lambda ch: (chars - F.length(F.replace(host, ch, F.lit("")))) / chars
    df = df.withColumns(
        {
            p + "words": matched_words(c("low"), dims.TRIAGE_URL_WORDS),
            p + "dots": F.coalesce(F.regexp_count(host, F.lit(r"\.")), F.lit(0)),
            p + "tld": F.when(
                host.contains("."), F.lower(F.substring_index(host, ".", -1))
            ).otherwise(""),
            p + "isip": F.coalesce(host.rlike(f"^{_IP}$"), F.lit(False)),
            p + "entropy": F.coalesce(
                F.aggregate(
                    F.array_distinct(F.filter(F.split(host, ""), lambda x: x != "")),
                    F.lit(0.0),
                    lambda acc, ch: acc - share(ch) * F.log2(share(ch)),
                ),
                F.lit(0.0),
            ),
            p + "ratio": F.coalesce(
                F.regexp_count(host, F.lit(r"\p{Nd}")) / F.greatest(chars, F.lit(1)), F.lit(0.0)
            ),
        }
    )
    df = df.withColumns(
        {
            p + "ip": c("url").rlike(r"://\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}") | c("isip"),
            p + "http": F.when(
                c("url").rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"),
                F.lower(F.substring_index(c("url"), ":", 1)) == "http",
            ).otherwise(F.lit(True)),
            p + "badtld": F.expr(in_words("_tu_tld", dims.TRIAGE_TLDS)),
            p + "two": F.format_string("%.2f", c("entropy")),
            p + "pct": F.format_string("%.0f%%", c("ratio") * 100),
        }
    )
    at, words, deep = "contains(_tu_url, '@')", "size(_tu_words) > 0", "_tu_dots >= 3 AND NOT _tu_isip"
    random = "_tu_entropy > 4.0D"
    digits = "cast(_tu_ratio AS FLOAT) > cast(0.25 AS FLOAT) AND NOT _tu_isip"
    score = _points(
        ("_tu_ip", 35), (at, 30), ("_tu_http", 10), ("_tu_badtld", 25),
        (words, "least(35.0D, size(_tu_words) * 10.0D)"),
        (deep, 20), (random, 15), (digits, 15),
    )
    result = engine_result(
        dims.URL_ENGINE,
        F.least(score, F.lit(100.0)),
        0.90,
        flag_list(
            {
                "ip_based_host": "_tu_ip", "at_symbol_present": at,
                "http_without_https": "_tu_http", "suspicious_tld": "_tu_badtld",
                "suspicious_keywords": words, "subdomain_depth_anomaly": deep,
                "high_shannon_entropy": random, "high_digit_ratio": digits,
            }
        ),
        evidence_list(
            [
                ("HOST_TYPE", "'IPv4'",
                 "Host utilizes an IP address instead of a standard domain name.", "_tu_ip"),
                ("URL_OBFUSCATION", "'@ Symbol'",
                 "URL contains '@' userinfo symbol used to mask true destination.", at),
                ("PROTOCOL", "'Insecure HTTP'", "Protocol defaults to unencrypted HTTP.",
                 "_tu_http"),
                ("TOP_LEVEL_DOMAIN", "concat('.', _tu_tld)",
                 "Uses TLD associated with spam and malware campaigns: .{_tu_tld}", "_tu_badtld"),
                ("SUSPICIOUS_KEYWORDS", "to_json(_tu_words)",
                 "Detected credential and security keywords in URL: {array_join(_tu_words, ', ')}",
                 words),
                ("SUBDOMAIN_DEPTH", "_tu_dots",
                 "Hostname exhibits excessive subdomain nesting: {_tu_dots} levels.", deep),
                ("SHANNON_ENTROPY", "_tu_two",
                 "Hostname exhibits high randomness entropy: {_tu_two}", random),
                ("DIGIT_RATIO", "_tu_pct",
                 "Unusually high digit density in domain: {_tu_pct}", digits),
            ]
        ),
    )
    df = df.withColumn(
        "triage_url",
        F.when(blank(c("url")), skipped_result(dims.URL_ENGINE, "No URL provided")).otherwise(
            result
        ),
    )
    return df.drop(*[x for x in df.columns if x.startswith(p)])


def with_triage_text(df: DataFrame, text: str = "text") -> DataFrame:
    tlds = "|".join(dims.TRIAGE_TLDS)
    df = df.withColumns(
        {
            "_tt_low": F.lower(text),
            "_tt_link": first_triage_url(F.col(text)),
        }
    )
    df = df.withColumns(
        {
            "_tt_u": matched_words(F.col("_tt_low"), dims.TRIAGE_URGENCY),
            "_tt_h": matched_words(F.col("_tt_low"), dims.TRIAGE_HARVEST),
            "_tt_risky": F.coalesce(
                F.lower("_tt_link").rlike(rf"@|\.(?:{tlds})|^{_IP}$"), F.lit(False)
            ),
        }
    )
    urgent, harvest = "size(_tt_u) > 0", "size(_tt_h) > 0"
    result = engine_result(
        dims.TEXT_ENGINE,
        F.least(
            _points(
                (urgent, "least(40.0D, 25.0D + size(_tt_u) * 10.0D)"),
                (harvest, "least(40.0D, 30.0D + size(_tt_h) * 10.0D)"),
                ("_tt_risky", 25),
            ),
            F.lit(100.0),
        ),
        0.88,
        flag_list(
            {
                "urgency_and_fear_cues": urgent,
                "credential_harvesting_intent": harvest,
                "embedded_suspicious_url": "_tt_risky",
            }
        ),
        evidence_list(
            [
                ("URGENCY_TRIGGERS", "to_json(_tt_u)",
                 "Urgent psychological intimidation phrases: {array_join(_tt_u, ', ')}", urgent),
                ("HARVESTING_TRIGGERS", "to_json(_tt_h)",
                 "Demands sensitive credentials or verification: {array_join(_tt_h, ', ')}",
                 harvest),
                ("EMBEDDED_LINK", "_tt_link",
                 "Message contains deceptive or high-risk embedded link.", "_tt_risky"),
            ]
        ),
    )
    none = skipped_result(dims.TEXT_ENGINE, "No text provided")
    return df.withColumn(
        "triage_text", F.when(blank(F.col(text)), none).otherwise(result)
    ).drop("_tt_low", "_tt_link", "_tt_u", "_tt_h", "_tt_risky")


def with_triage_file(df: DataFrame, name: str = "file_name", content: str = "file_bytes") -> DataFrame:
    df = df.withColumn("_tf_low", F.lower(F.coalesce(name, F.lit(""))))
    low = F.col("_tf_low")
    df = df.withColumns(
        {
            "_tf_ext": F.when(low.contains("."), extension(low)).otherwise(""),
            "_tf_inner": F.when(
                F.regexp_count(low, F.lit(r"\.")) >= 2,
                F.substring_index(F.substring_index(low, ".", -2), ".", 1),
            ).otherwise(""),
        }
    )
    bad = in_words("_tf_ext", dims.TRIAGE_DANGEROUS_EXT)
    double = f"{in_words('_tf_inner', dims.TRIAGE_DOC_EXT)} AND {bad}"
    macro = in_words("_tf_ext", dims.TRIAGE_MACRO_EXT)
    result = engine_result(
        dims.MALWARE_ENGINE,
        F.least(_points((bad, 75), (double, 85), (macro, 45)), F.lit(100.0)),
        0.95,
        flag_list(
            {
                "dangerous_executable_extension": bad,
                "double_extension_anomaly": double,
                "macro_enabled_document": macro,
            }
        ),
        evidence_list(
            [
                ("FILE_EXTENSION", "upper(_tf_ext)",
                 "High-risk executable or script format: .{_tf_ext}", bad),
                ("DECEPTIVE_EXTENSION", "concat(_tf_inner, '.', _tf_ext)",
                 "Double extension masquerade attempting to mimic a document: {_tf_inner}.{_tf_ext}",
                 double),
                ("FILE_EXTENSION", "upper(_tf_ext)",
                 "Macro-enabled document format frequently leveraged for droppers: .{_tf_ext}",
                 macro),
            ]
        ),
    )
    has_bytes = F.coalesce(F.octet_length(content) > 0, F.lit(False))
    none = skipped_result(dims.MALWARE_ENGINE, "No file data provided")
    return df.withColumn(
        "triage_file", F.when(blank(F.col(name)) & ~has_bytes, none).otherwise(result)
    ).drop("_tf_low", "_tf_ext", "_tf_inner")


def with_triage_sender(df: DataFrame, sender: str = "sender_id") -> DataFrame:
    low = F.lower(F.trim(sender))
    df = df.withColumn(
        "_td_dom", F.when(low.contains("@"), F.substring_index(low, "@", -1)).otherwise("")
    )
    dom = F.col("_td_dom")
    df = df.withColumns(
        {
            "_td_tld": F.when(dom.contains("."), F.substring_index(dom, ".", -1)).otherwise(""),
            "_td_mimic": contains_any(dom, dims.TRIAGE_URL_WORDS)
            & contains_any(dom, ["update", "alert", "verify"]),
        }
    )
    risky = in_words("_td_tld", dims.TRIAGE_TLDS)
    result = engine_result(
        dims.SENDER_ENGINE,
        _points((risky, 30), ("_td_mimic", 35)),
        0.85,
        flag_list({"suspicious_sender_tld": risky, "sender_impersonation_mismatch": "_td_mimic"}),
        evidence_list(
            [
                ("SENDER_DOMAIN", "_td_dom",
                 "Sender uses high-abuse top-level domain: .{_td_tld}", risky),
                ("SENDER_REPUTATION", "_td_dom",
                 "Sender domain mimics official alert/security infrastructure.", "_td_mimic"),
            ]
        ),
    )
    none = skipped_result(dims.SENDER_ENGINE, "No sender provided")
    return df.withColumn(
        "triage_sender", F.when(blank(F.col(sender)), none).otherwise(result)
    ).drop("_td_dom", "_td_tld", "_td_mimic")


def triage(df: DataFrame) -> DataFrame:
    """Add the triage verdict of scan rows: ``results`` and the assessment columns.

    Absent input columns count as empty. Highest engine score, plus 15 when two
    engines reach 40.
    """
    for name, kind in (("url", "string"), ("text", "string"), ("file_name", "string"),
                       ("file_bytes", "binary"), ("sender_id", "string")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    df = with_triage_sender(with_triage_file(with_triage_text(with_triage_url(df))))
    df = df.withColumn(
        "results", F.array("triage_url", "triage_text", "triage_file", "triage_sender")
    )
    df = df.withColumn("_tg_ok", F.filter("results", lambda r: r["status"] == "success"))
    best = F.coalesce(
        F.array_max(F.transform("_tg_ok", lambda r: r["risk_score"])), F.lit(0.0)
    )
    several = F.size(F.filter("_tg_ok", lambda r: r["risk_score"] >= 40.0)) >= 2
    df = df.withColumns(
        {
            "risk_score": F.least(F.lit(100.0), best + F.when(several, 15.0).otherwise(0.0)),
            "flags": F.array_distinct(F.flatten(F.transform("_tg_ok", lambda r: r["flags"]))),
            "evidence": F.flatten(F.transform("_tg_ok", lambda r: r["evidence"])),
            "contributing_engines": F.transform("_tg_ok", lambda r: r["engine_name"]),
            "ignored_engines": F.transform(
                F.filter("results", lambda r: r["status"] != "success"), lambda r: r["engine_name"]
            ),
        }
    )
    s = F.col("risk_score")
    from_file = (F.col("triage_file")["status"] == "success") & (
        F.col("triage_file")["risk_score"] >= 80.0
    )
    df = df.withColumn(
        "classification",
        F.when((s >= 80.0) & from_file, F.lit("Malware"))
        .when(s >= 80.0, F.lit("Phishing"))
        .when(s >= 50.0, F.lit("Deceptive"))
        .when(s >= 25.0, F.lit("Suspicious"))
        .otherwise("Safe"),
    )
    reasons = F.array_distinct(
        F.array_compact(F.transform("flags", lambda f: lookup(f, dims.TRIAGE_REASONS)))
    )
    none = F.when(
        F.col("classification") == "Safe", dims.TRIAGE_REASON_CLEAN
    ).otherwise(dims.TRIAGE_REASON_OTHER)
    df = df.withColumn("_tg_reasons", reasons)
    return df.withColumns(
        {
            "confidence": F.lit(0.90),
            "reasons": F.when(F.size("_tg_reasons") == 0, F.array(none)).otherwise(
                F.col("_tg_reasons")
            ),
            "recommended_action": lookup(F.col("classification"), dims.TRIAGE_ACTIONS),
            "total_engines": F.greatest(F.size("results"), F.lit(4)),
            "completed_engines": F.size("_tg_ok"),
            "skipped_engines": F.size(
                F.filter("results", lambda r: r["status"] == "skipped")
            ),
            "warnings": F.array(F.lit(dims.TRIAGE_WARNING)),
        }
    ).drop("triage_url", "triage_text", "triage_file", "triage_sender", "_tg_ok", "_tg_reasons")


def with_fallback(triaged: DataFrame, verdicts: DataFrame, key: str = "scan_id") -> DataFrame:
    """Full verdict where one exists and is well formed, else the triage verdict.

    ``verdicts`` holds the accepted rows of the verdict contract check, one per key.
    """
    fields = ["risk_score", "classification", "recommended_action", "warnings"]
    full = verdicts.select(
        key, F.lit(True).alias("_full"), *[F.col(f).alias(f"_f_{f}") for f in fields]
    )
    joined = triaged.join(full, key, "left")
    chosen = {
        f: F.when(F.col("_full"), F.col(f"_f_{f}")).otherwise(F.col(f)) for f in fields
    }
    return (
        joined.withColumn("is_fallback", F.col("_full").isNull())
        .withColumns(chosen)
        .drop("_full", *[f"_f_{f}" for f in fields])
    )


