"""Link rules: lexical signals, domain age and the combined link score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow import dims
from riskflow.functions.columns import (
    contains_any,
    engine_result,
    evidence,
    evidence_list,
    filled,
    flag,
    flag_list,
    keep,
    matched_words,
    no_flags,
    skipped_result,
    text_of,
)
from riskflow.functions.urls import drop_url_parts, naive_host, url_host, with_url_parts
from riskflow.operators.joins import dim_join


def with_url_signals(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``lex_score`` (0-1), ``lex_flags`` and ``lex_evidence`` for a link column."""
    p = "_us_"
    c = lambda name: F.col(p + name)
    link = F.col(url)
    df = with_url_parts(df.withColumn(p + "nh", naive_host(link)), url, p)
    labels = F.size(F.split(c("nh"), r"\."))
    depth = F.greatest(labels - 2, F.lit(0)) - F.when(
        c("nh").startswith("www.") | (c("nh") == "www"), 1
    ).otherwise(0)
    scheme_at = F.instr(link, "://")
    chars = F.length(c("nh"))
    share = lambda ch: (chars - F.length(F.replace(c("nh"), ch, F.lit("")))) / chars
    entropy = F.aggregate(
        F.array_distinct(F.filter(F.split(c("nh"), ""), lambda x: x != "")),
        F.lit(0.0),
        lambda acc, ch: acc - share(ch) * F.log2(share(ch)),
    )
    digits = F.regexp_count(c("nh"), F.lit(r"\p{Nd}"))
    letters = F.regexp_count(c("nh"), F.lit(r"\p{L}"))
    value_of = lambda kv: F.replace(
        F.regexp_extract(kv, r"^[^=]*=(.*)$", 1), F.lit("+"), F.lit(" ")
    )
    decoded = lambda kv: F.coalesce(F.try_url_decode(value_of(kv)), value_of(kv))
    df = df.withColumns(
        {
            p + "hyphens": F.regexp_count(c("nh"), F.lit("-")),
            p + "length": F.length(link),
            p + "path_len": F.length(c("path")),
            p + "depth": F.greatest(depth, F.lit(0)),
            p + "words": matched_words(
                F.lower(F.concat(c("nh"), c("path"))), dims.URL_KEYWORDS
            ),
            p + "slashes": F.when(
                scheme_at > 0, _locate_after(link, scheme_at)
            ).otherwise(F.instr(link, "//"))
            - 1,
            p + "port": c("port_text").try_cast("int"),
            p + "entropy": F.coalesce(entropy, F.lit(0.0)),
            p + "ratio": F.when(letters > 0, digits / letters)
            .when(digits > 0, F.lit(1.0))
            .otherwise(F.lit(0.0)),
            p + "specials": F.regexp_count(link, F.lit("[?=&%_]")),
            p + "b64": F.when(
                c("query") != "",
                F.exists(
                    F.split(c("query"), "&"),
                    lambda kv: decoded(kv).rlike(r"^[A-Za-z0-9+/\-_]{30,}={0,2}$"),
                ),
            ).otherwise(F.lit(False)),
            p + "ip": link.rlike(r"://\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"),
            p + "at": link.contains("@"),
            p + "tld": c("nh").rlike(r"\.(?:" + "|".join(dims.SUSPICIOUS_TLDS) + r")$"),
        }
    )
    df = df.withColumns(
        {
            p + "odd_port": F.expr("coalesce(_us_port > 0 AND _us_port NOT IN (80, 443), false)"),
            p + "short": contains_any(c("nh"), dims.SHORTENERS),
            p + "spoofed": F.lower(c("nh")).contains("http"),
            p + "entropy2": F.round(c("entropy"), 2),
            p + "ratio_pct": F.round(c("ratio") * 100, 1),
        }
    )
    score = F.expr(
        "if(_us_ip, 0.3D, 0.0D) + if(_us_at, 0.2D, 0.0D)"
        " + if(_us_hyphens >= 3, 0.2D, 0.0D) + if(_us_tld, 0.4D, 0.0D)"
    )
    deep, worded, slashed = "_us_depth >= 2", "size(_us_words) > 0", "_us_slashes >= 0"
    plain, random, digity = "_us_scheme = 'http'", "_us_entropy >= 4.0D", "_us_ratio >= 0.2D"
    special = "_us_specials >= 5"
    flags = flag_list(
        {
            "ip_based_host": "_us_ip",
            "at_symbol_present": "_us_at",
            "high_hyphen_count({_us_hyphens})": "_us_hyphens >= 3",
            "suspicious_tld": "_us_tld",
            "url_shortener": "_us_short",
            "url_length_anomaly": "_us_length >= 75",
            "path_length_anomaly": "_us_path_len >= 20",
            "subdomain_depth_anomaly": deep,
            "suspicious_keywords": worded,
            "double_slash_redirect": slashed,
            "http_without_https": plain,
            "non_standard_port": "_us_odd_port",
            "https_in_hostname": "_us_spoofed",
            "high_shannon_entropy": random,
            "high_digit_ratio": digity,
            "special_char_overload": special,
            "base64_obfuscation": "_us_b64",
        }
    )
    items = evidence_list(
        [
            ("URL_LENGTH", "_us_length",
             "Total URL length is {_us_length} characters, exceeding normal limits.",
             "_us_length >= 75"),
            ("PATH_LENGTH", "_us_path_len",
             "URL path depth is {_us_path_len} characters.", "_us_path_len >= 20"),
            ("SUBDOMAIN_DEPTH", "_us_depth",
             "Hostname exhibits excessive subdomain nesting: {_us_depth} layers.", deep),
            ("SUSPICIOUS_KEYWORDS", "to_json(_us_words)",
             "Security-critical keywords detected in URL path/subdomain: "
             "{array_join(_us_words, ', ')}.", worded),
            ("DOUBLE_SLASH_REDIRECT", "_us_slashes",
             "Double-slash redirect artifact detected at index {_us_slashes}.", slashed),
            ("HTTP_WITHOUT_HTTPS", "true", "Protocol defaults to unencrypted HTTP.", plain),
            ("NON_STANDARD_PORT", "_us_port",
             "URL points to non-standard HTTP port: {_us_port}.", "_us_odd_port"),
            ("HTTPS_IN_HOSTNAME", "true",
             "Deceptive 'http/https' string found within the hostname payload.", "_us_spoofed"),
            ("SHANNON_ENTROPY", "_us_entropy2",
             "Hostname strings exhibits high character entropy: {_us_entropy2}.", random),
            ("DIGIT_TO_LETTER_RATIO", "round(_us_ratio, 3)",
             "Hostname comprises an unusual high density of numerical digits: {_us_ratio_pct}%.",
             digity),
            ("SPECIAL_CHAR_COUNT", "_us_specials",
             "Detected a massive load of query-modifier characters: {_us_specials} occurrences.",
             special),
            ("BASE64_OBFUSCATION", "true",
             "Detected Base64-encoded execution string inside the URL query payload.", "_us_b64"),
        ]
    )
    present = filled(link)
    df = df.withColumns(
        {
            "lex_score": F.when(present, F.least(score, F.lit(1.0))),
            "lex_flags": F.when(present, flags),
            "lex_evidence": F.when(present, items),
        }
    )
    scratch = [
        "nh", "hyphens", "length", "path_len", "depth", "words", "slashes", "port", "entropy",
        "ratio", "specials", "b64", "ip", "at", "tld", "odd_port", "short", "spoofed", "entropy2",
        "ratio_pct",
    ]
    return drop_url_parts(df, p).drop(*[p + s for s in scratch])


def _locate_after(link: Column, scheme_at: Column) -> Column:
    """1-based position of ``//`` behind the scheme mark, 0 when there is none."""
    rest = F.substring(link, scheme_at + 3, F.length(link))
    inside = F.instr(rest, "//")
    return F.when(inside > 0, inside + scheme_at + 2).otherwise(F.lit(0))


# ------------------------------------------------------------------ re-aimed look-ups
def registered_domains(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """host -> registered_domain by the longest matching public suffix.

    Works on distinct hosts. Rules may hold ``*.`` wildcards and ``!`` exceptions.
    """
    labels = F.split("host", r"\.")
    tail = lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    rules = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.size(labels)),
            lambda i: F.array(
                F.struct(tail(i).alias("suffix"), i.alias("at"), F.lit(0).alias("wins")),
                F.struct(
                    F.concat(F.lit("*."), tail(i + 1)).alias("suffix"),
                    i.alias("at"),
                    F.lit(0).alias("wins"),
                ),
                F.struct(
                    F.concat(F.lit("!"), tail(i)).alias("suffix"),
                    (i + 1).alias("at"),
                    F.lit(1).alias("wins"),
                ),
            ),
        )
    )
    candidates = (
        hosts.select("host").where("host <> ''").distinct()
        .select("host", F.inline(rules))
    )
    best = (
        dim_join(candidates, suffixes.select("suffix").distinct(), "suffix", "inner")
        .groupBy("host")
        .agg(F.max(F.struct("wins", -F.col("at"))).alias("b"))
        .select("host", (-F.col("b.col2")).alias("at"))
    )
    return best.where("at > 1").select(
        "host", F.array_join(F.slice(labels, F.col("at") - 1, F.size(labels)), ".").alias(
            "registered_domain")
    )


def with_domain_age(
    df: DataFrame, registrations: DataFrame, suffixes: DataFrame, as_of: str, url: str = "url"
) -> DataFrame:
    """Add ``domain_age`` in days at ``as_of``; null when unknown."""
    hosts = df.select(url_host(F.col(url)).alias("host"))
    known = registrations.groupBy(F.lower("domain").alias("registered_domain")).agg(
        F.min("created").alias("created")
    )
    age = F.greatest(
        F.floor(
            (F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("created")) / 86400
        ),
        F.lit(0),
    )
    ages = registered_domains(hosts, suffixes).join(known, "registered_domain").select(
        F.col("host").alias("_age_host"), age.cast("int").alias("domain_age")
    )
    return df.join(ages, url_host(F.col(url)) == F.col("_age_host"), "left").drop("_age_host")


def with_reputation(df: DataFrame, reputation: DataFrame | None, url: str = "url") -> DataFrame:
    """Add ``rep_score``, ``rep_threats`` and ``rep_error`` from a reputation table."""
    if reputation is None:
        return df.withColumns(
            {
                "rep_score": F.lit(0.0),
                "rep_threats": no_flags(),
                "rep_error": F.lit("GSB_API_KEY_NOT_CONFIGURED"),
            }
        )
    one = reputation.groupBy(F.col("url").alias("_rep_url")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("threat_types")))).alias("_rt"),
        F.max("http_status").alias("_rs"),
    )
    df = dim_join(df, one, F.col(url) == F.col("_rep_url"))
    failed = F.coalesce(F.col("_rs") != 200, F.lit(False))
    threats = F.when(failed, no_flags()).otherwise(F.coalesce(F.col("_rt"), no_flags()))
    return df.withColumns(
        {
            "rep_threats": threats,
            "rep_score": F.when(F.size(threats) > 0, 1.0).otherwise(0.0),
            "rep_error": F.when(failed, text_of("GSB_API_ERROR_", F.col("_rs"))),
        }
    ).drop("_rep_url", "_rt", "_rs")


def url_score(lex: Column, rep: Column, matched: Column, allowed: Column, evasive: Column):
    """(score 0-1, confidence) of a link."""
    trusted = allowed & ~evasive
    score = (
        F.when(matched, F.lit(1.0))
        .when(rep >= 1.0, F.least(F.lit(1.0), 0.90 + lex * 0.10))
        .when(rep > 0, lex * 0.4 + rep * 0.6)
        .when(trusted, F.least(lex * 0.25, F.lit(0.15)))
        .otherwise(lex * 0.7 + rep * 0.3)
    )
    confidence = (
        F.when(matched, F.lit(0.95))
        .when(rep >= 1.0, F.lit(0.85))
        .when(rep > 0, F.lit(0.80))
        .when(trusted, F.lit(0.90))
        .otherwise(F.lit(0.80))
    )
    return score, confidence


def url_result(df: DataFrame, url: str = "url") -> Column:
    """Engine result of a link row that carries the lex, rep, feed and allow-list columns.

    ``domain_age`` is optional.
    """
    matched, allowed = F.col("feed_hit").isNotNull(), F.col("allow_listed")
    hit = F.col("feed_hit")
    evasive = F.arrays_overlap(
        F.col("lex_flags"), F.array(F.lit("ip_based_host"), F.lit("at_symbol_present"))
    )
    score, confidence = url_score(F.col("lex_score"), F.col("rep_score"), matched, allowed, evasive)
    source = F.coalesce(hit["source"], F.lit("ThreatFeed"))
    threat = F.coalesce(hit["threat_type"], F.lit("malware_download"))
    aged = "domain_age" in df.columns
    age = F.col("domain_age") if aged else F.lit(None).cast("int")
    young = F.coalesce(age < 14, F.lit(False))
    listed = allowed & ~matched
    flags = F.concat(
        F.col("lex_flags"),
        F.col("rep_threats"),
        keep(
            flag("known_malicious_url", matched),
            flag(F.concat(F.lower(source), F.lit("_malicious")), matched),
            flag("whitelisted_trusted_domain", listed),
            flag("newly_registered_domain", young),
        ),
    )
    items = F.concat(
        F.col("lex_evidence"),
        keep(
            evidence(
                "THREAT_FEED_MATCH",
                F.to_json(
                    F.struct(
                        threat.alias("threat_type"),
                        source.alias("source"),
                        F.coalesce(hit["tags"], F.lit("")).alias("tags"),
                    )
                ),
                text_of("Confirmed active malicious URL in global ", source, " database (", threat, ")."),
                matched,
            ),
            evidence(
                "WHITELISTED_DOMAIN", "true",
                "Root domain is verified on global top trusted website whitelist.", listed,
            ),
            evidence(
                "DOMAIN_AGE_DAYS", age,
                F.when(young, text_of(
                    "Root domain is exceedingly new. Registered ", age, " days ago."))
                .otherwise(text_of("Root domain registered ", age, " days ago.")),
                age.isNotNull(),
            ),
        ),
    )
    partial = ~matched & F.col("rep_error").isNotNull()
    result = engine_result(
        dims.URL_ENGINE,
        score * 100.0,
        confidence,
        flags,
        items,
        status=F.when(partial, F.lit("partial")).otherwise("success"),
        error=F.when(partial, F.col("rep_error")),
        metadata=F.create_map(
            F.lit("lexical_score"), F.col("lex_score").cast("string"),
            F.lit("gsb_score"), F.col("rep_score").cast("string"),
        ),
    )
    return F.when(filled(F.col(url)), result).otherwise(
        skipped_result(dims.URL_ENGINE, "No URL provided")
    )


__all__ = [
    "registered_domains", "url_result", "url_score", "with_domain_age",
    "with_reputation", "with_url_signals",
]
