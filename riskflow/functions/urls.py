"""URL parsing, normalization, extraction and address tests as Column expressions.

``parse_url`` is not used: it returns null for hosts holding an underscore and
keeps the letter case, so the generic RFC 3986 split is applied by regex.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow import dims
from riskflow.functions.addresses import address_hex, is_public_number
from riskflow.functions.columns import keep, no_flags, text_of

_SPLIT = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_BLANKS = r"(?U)^\s+|\s+$"
_WRAPPERS = ["<>", "()", "[]", '""', "''"]


def with_url_parts(df: DataFrame, url: str, prefix: str) -> DataFrame:
    """Add ``<prefix>scheme, netloc, userinfo, host, port_text, path, params, query, fragment``.

    The URL is split once; later columns read the pieces. Each step is its own
    projection so that no piece is computed twice.
    """
    c = lambda name: F.col(prefix + name)
    mark = "\u0001"
    pieces = F.split(
        F.regexp_replace(
            F.regexp_replace(F.col(url), r"[\t\r\n\x01]", ""),
            _SPLIT,
            mark.join(f"${i}" for i in range(1, 6)),
        ),
        mark,
    )
    df = df.withColumn(prefix + "pieces", pieces)
    names = ["scheme", "netloc", "full_path", "query", "fragment"]
    df = df.withColumns(
        {prefix + n: F.try_element_at(c("pieces"), F.lit(i + 1)) for i, n in enumerate(names)}
    )
    df = df.withColumns(
        {
            prefix + "scheme": F.lower(c("scheme")),
            prefix + "userinfo": F.regexp_extract(c("netloc"), r"^(.*)@", 1),
            prefix + "host_port": F.regexp_replace(c("netloc"), r"^.*@", ""),
            prefix + "path": F.regexp_replace(c("full_path"), r";[^/]*$", ""),
            prefix + "params": F.regexp_extract(c("full_path"), r"(;[^/]*)$", 1),
        }
    )
    bracketed = c("host_port").startswith("[")
    df = df.withColumns(
        {
            prefix + "host": F.lower(
                F.when(
                    bracketed, F.regexp_extract(c("host_port"), r"^\[([^\]]*)\]?", 1)
                ).otherwise(F.substring_index(c("host_port"), ":", 1))
            ),
            prefix + "port_text": F.when(
                bracketed, F.regexp_extract(c("host_port"), r"\]:(.*)$", 1)
            ).otherwise(F.regexp_extract(c("host_port"), r"^[^:]*:(.*)$", 1)),
        }
    )
    return df.drop(prefix + "pieces", prefix + "full_path", prefix + "host_port")


URL_PART_NAMES = [
    "scheme", "netloc", "userinfo", "host", "port_text", "path", "params", "query", "fragment",
]


def drop_url_parts(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*[prefix + n for n in URL_PART_NAMES])


def url_host(url: Column) -> Column:
    """Lower-case host of a URL, empty when there is none."""
    netloc = F.regexp_extract(
        F.regexp_replace(url, r"[\t\r\n]", ""), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1
    )
    host = F.regexp_extract(netloc, r"^(?:.*@)?(?:\[([^\]]*)\]?|[^:]*)", 0)
    return F.coalesce(
        F.lower(F.regexp_replace(host, r"^.*@|[\[\]]", "")),
        F.lit(""),
    )


def naive_host(url: Column) -> Column:
    """Text between the last ``://`` and the next slash, user info and port included."""
    return F.substring_index(F.substring_index(url, "://", -1), "/", 1)


def _unwrapped(text: Column) -> Column:
    out = F.regexp_replace(text, _BLANKS, "")
    for first, last in _WRAPPERS:
        # a lone quote mark counts as both ends of itself and leaves nothing
        inner = rf"(?:(.*?)\s*\{last})" + ("?" if first == last else "")
        out = F.regexp_replace(out, rf"(?sU)^\{first}\s*{inner}$", "$1")
    return out


def normalize_url(df: DataFrame, url: str, out: str, max_chars: int | None = None) -> DataFrame:
    """Add ``<out>`` (clean URL or null), ``<out>_warnings`` and ``<out>_error``.

    ``<out>_error`` is null for an accepted URL; a null input is accepted. ``max_chars``
    rejects longer ones.
    """
    p = "_nu_"
    c = lambda name: F.col(p + name)
    df = df.withColumn(p + "text", _unwrapped(F.col(url)))
    df = df.withColumns(
        {
            p + "schemed": c("text").rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"),
            p + "pseudo": F.lower(F.substring_index(c("text"), ":", 1)),
        }
    )
    df = df.withColumn(
        p + "full",
        F.when(c("schemed"), c("text")).otherwise(F.concat(F.lit("http://"), c("text"))),
    )
    df = with_url_parts(df, p + "full", p)
    df = df.withColumns(
        {
            p + "port": c("port_text").try_cast("int"),
            p + "user": F.regexp_extract(c("userinfo"), r"^([^:]*)", 1),
            p + "password": F.regexp_extract(c("userinfo"), r"^[^:]*:(.*)$", 1),
        }
    )
    numeric = c("port_text").rlike(r"^\d+$")
    bad_port = (c("port_text") != "") & (~numeric | c("port").isNull() | (c("port") > 65535))
    port_message = F.when(
        ~numeric,
        text_of("Port could not be cast to integer value as '", c("port_text"), "'"),
    ).otherwise("Port out of range 0-65535")
    pseudo_blocked = (
        ~c("schemed")
        & c("text").contains(":")
        & ~c("text").rlike(r"^[/\\]")
        & c("pseudo").isin(dims.BLOCKED_SCHEMES)
    )
    error = (
        F.when(
            F.length(F.regexp_replace(F.col(url), _BLANKS, "")) > (max_chars or 2**31 - 1),
            F.lit("url_exceeds_max_length"),
        )
        .when(c("text") == "", F.lit("empty_url_after_stripping"))
        .when(
            c("text").rlike(r"[\x00-\x08\x0a-\x1f\x7f]"),
            F.lit("url_contains_control_characters"),
        )
        .when(pseudo_blocked, text_of("unsupported_scheme_", c("pseudo")))
        .when(
            c("netloc").contains("[") != c("netloc").contains("]"),
            F.lit("malformed_url_syntax"),
        )
        .when(~c("scheme").isin("http", "https"), text_of("unsupported_scheme_", c("scheme")))
        .when(c("host") == "", F.lit("missing_url_host"))
        .when(bad_port, text_of("preprocessing_error: ", port_message))
    )
    df = df.withColumn(out + "_error", error)
    default_port = ((c("scheme") == "http") & (c("port") == 80)) | (
        (c("scheme") == "https") & (c("port") == 443)
    )
    show_port = (c("port_text") != "") & ~default_port & (c("port") != 0)
    or_empty = lambda cond, value: F.when(cond, value).otherwise("")
    rebuilt = F.concat(
        c("scheme"),
        F.lit("://"),
        or_empty(c("user") != "", c("user")),
        or_empty(
            (c("user") != "") & (c("password") != ""), F.concat(F.lit(":"), c("password"))
        ),
        or_empty(c("user") != "", F.lit("@")),
        c("host"),
        or_empty(show_port, F.concat(F.lit(":"), c("port").cast("string"))),
        c("path"),
        or_empty(F.length(c("params")) > 1, c("params")),
        or_empty(c("query") != "", F.concat(F.lit("?"), c("query"))),
        or_empty(c("fragment") != "", F.concat(F.lit("#"), c("fragment"))),
    )
    warnings = keep(
        F.when(~c("schemed"), F.lit("url_scheme_defaulted_to_http")),
        F.when(
            (c("user") != "") | (c("password") != ""), F.lit("url_embedded_credentials_present")
        ),
    )
    failed = F.col(out + "_error")
    df = df.withColumns(
        {
            out + "_warnings": F.when(F.col(url).isNull(), no_flags())
            .when(failed.isNull(), warnings)
            .otherwise(F.array(failed)),
            out: F.when(failed.isNull(), rebuilt),
        }
    )
    scratch = ["text", "schemed", "pseudo", "full", "port", "user", "password"]
    return drop_url_parts(df, p).drop(*[p + n for n in scratch])


# ------------------------------------------------------------------ extraction
def extract_mail_urls(text: Column) -> Column:
    """Distinct links of a mail body in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(f"({dims.MAIL_URL})"), 1)
    cleaned = F.transform(found, lambda u: F.regexp_replace(u, dims.MAIL_URL_TAIL, ""))
    return F.array_distinct(F.filter(cleaned, lambda u: F.trim(u) != ""))


def extract_screen_urls(text: Column) -> Column:
    """Distinct links of visible text; bare domains count, scheme defaults to https."""
    tlds = "|".join(dims.SCREEN_TLDS)
    pattern = (
        r"(?i)(\b(?:https?://[^\s<>\"']+|www\d{0,3}\.[^\s<>\"']+"
        rf"|\b[a-zA-Z0-9.-]+\.(?:{tlds})(?:/[^\s<>\"']*)?))"
    )
    found = F.regexp_extract_all(text, F.lit(pattern), 1)
    bare = F.transform(
        found, lambda u: F.regexp_replace(u, r"^[(\[{<\"']+|[.,)\]}!?;:\"'>]+$", "")
    )
    usable = F.filter(bare, lambda u: F.trim(u) != "")
    full = F.transform(
        usable,
        lambda u: F.when(u.rlike(r"(?i)^https?://"), u).otherwise(F.concat(F.lit("https://"), u)),
    )
    return F.array_distinct(full)


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, f"({pattern})", 1), F.lit(""))


def first_image_url(text: Column) -> Column:
    return _first(text, dims.IMAGE_URL)


def first_share_url(text: Column) -> Column:
    return F.regexp_replace(_first(text, dims.MAIL_URL), dims.MAIL_URL_TAIL, "")


def first_triage_url(text: Column) -> Column:
    return _first(text, dims.TRIAGE_URL)


# ------------------------------------------------------------------ addresses
def is_ip_literal(host: Column) -> Column:
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return host.rlike(rf"^{octet}(?:\.{octet}){{3}}$") | (
        host.contains(":") & host.rlike(r"^[0-9a-f:.]+$")
    )


def is_public_address(address: Column) -> Column:
    """True for an IP literal reachable from the open internet, false otherwise."""
    return is_public_number(address_hex(address))
