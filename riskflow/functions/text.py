"""Text clean-up, redaction and on-screen phrase tests as Column expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow import dims
from riskflow.functions.columns import contains_any, keep


# Single Latin characters are looked up in one table of a pattern, ranges are tried one after the other;
# the outer range of the wide blanks spares all other characters the inner ones.
# blank characters other than the line feed and the plain blank (fixed values)
_BLANK = (
    r"[\t\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
)
_CONTROLS = "[" + "".join(rf"\x{c:02x}" for c in [*range(9), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F]) + "]"
_NEVER = "(?!)"
# all characters of Unicode's White_Space
_WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """Text without white space at its ends; unlike a pattern this tests no character between them."""
    return F.trim(text, F.lit(_WHITE))


@F.arrow_udf(T.StringType())
def _nfkc_series(values: pa.Array) -> pa.Array:
    # a few texts at a time as Python objects, however many a batch holds
    few = (values.slice(i, 100).to_pylist() for i in range(0, max(len(values), 1), 100))
    form = unicodedata.normalize
    return pa.concat_arrays(
        [pa.array([None if v is None else form("NFKC", v) for v in part], pa.string()) for part in few]
    )


def nfkc(text: Column) -> Column:
    """Unicode NFKC. ASCII text is already normal and never travels to Python:
    the argument is null for those rows, so only non-ASCII text crosses over."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, text).otherwise(_nfkc_series(F.when(~plain, text)))


def normalize_text(text: Column, max_chars: int | None = None) -> Column:
    """struct<text, warnings>. Texts of any length stay whole unless ``max_chars`` is given.

    The optimizer repeats the fields of a struct wherever they are read: use
    :func:`normalized_text` where the text is read more than once.
    """
    clean, warnings = normalized_text(text, max_chars)
    return F.struct(F.nullif(clean, F.lit("")).alias("text"), warnings.alias("warnings"))


def normalized_text(text: Column, max_chars: int | None = None) -> tuple[Column, Column]:
    """(clean text, which may be empty, warnings); see :func:`normalize_text`."""
    too_long = F.length(text) > max_chars if max_chars else F.lit(False)
    bounded = F.substring(text, 1, max_chars) if max_chars else text
    put = lambda c, old, new: F.replace(c, F.lit(old), F.lit(new))
    clean = F.regexp_replace(nfkc(bounded), _CONTROLS, "")
    clean = put(put(clean, "\r\n", "\n"), "\r", "\n")
    # runs of blanks become one blank, blanks around line ends disappear
    clean = F.regexp_replace(F.regexp_replace(clean, _BLANK, " "), " {2,}", " ")
    clean = put(put(clean, " \n", "\n"), "\n ", "\n")
    clean = F.regexp_replace(clean, r"\n{3,}", "\n\n")
    clean = F.trim(clean, F.lit(" \n"))
    warnings = keep(
        F.when(too_long, F.lit("text_truncated_to_max_length")),
        F.when(bounded.rlike(_CONTROLS), F.lit("control_characters_stripped")),
    )
    return clean, F.when(text.isNull(), F.array().cast("array<string>")).otherwise(warnings)


# every word the secret pattern can start with holds one of these (fixed values)
_SECRET_MARKS = ["passw", "passc", "otp", "code", "pin", "cvv", "cvc", "token", "api key"]


def redact(text: Column, max_chars: int | None = None) -> Column:
    """Mask secrets, links, addresses, phone numbers, tokens and short codes.

    The order of the replacements is part of the result. ``max_chars`` bounds the
    displayed output only; the whole text is masked first.
    """
    low = F.lower(text)
    # a pattern whose marks do not occur in the text is replaced by one that never matches
    only_if = lambda seen, pattern: F.when(seen, F.lit(pattern)).otherwise(F.lit(_NEVER))
    out = F.regexp_replace(
        text, only_if(contains_any(low, _SECRET_MARKS), dims.REDACT_SECRET), F.lit("$1: [redacted]")
    )
    links = low.contains("://") | low.contains("www.")
    out = F.regexp_replace(out, only_if(links, dims.REDACT_URL), F.lit("[link]"))
    out = F.regexp_replace(out, only_if(text.contains("@"), dims.REDACT_EMAIL), F.lit("[address]"))
    digits = text.rlike(r"\d")
    out = F.regexp_replace(out, only_if(digits, dims.REDACT_PHONE), F.lit("[number]"))
    out = F.regexp_replace(
        out, only_if(text.rlike(r"[A-Za-z0-9_+/=-]{32}"), dims.REDACT_TOKEN), F.lit("[redacted]")
    )
    out = F.regexp_replace(out, only_if(digits, dims.REDACT_DIGITS), F.lit("[number]"))
    out = F.regexp_replace(out, r"[\x00-\x08\x0b-\x1f]", "")
    out = F.regexp_replace(out, r"(?U)^\s+|\s+$", "")
    return F.substring(out, 1, max_chars) if max_chars else out


def mostly_redacted(original: Column, redacted: Column) -> Column:
    """True when masking left less than half of the trimmed original."""
    trimmed = F.regexp_replace(original, r"(?U)^\s+|\s+$", "")
    left = F.regexp_replace(redacted, r"\[(?:redacted|link|address|number)\]", "")
    left = F.regexp_replace(left, r"(?U)^\s+|\s+$", "")
    return F.coalesce(
        (F.length(trimmed) == 0) | (F.length(left) < F.length(trimmed) * 0.5), F.lit(True)
    )


def safe_key(value: Column, max_chars: int | None = None) -> Column:
    """Letters, digits and ``_.()-`` only; ``max_chars`` cuts longer keys."""
    out = F.regexp_replace(value, r"[^A-Za-z0-9_.()\-]", "_")
    return F.substring(out, 1, max_chars) if max_chars else out


def suspicious_snippet(
    text: Column, longest: int | None = None, shown: int | None = None
) -> Column:
    """Trimmed on-screen text holding a watched phrase, else null.

    ``longest`` leaves out longer texts and ``shown`` cuts the result; both are off by default.
    """
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    hit = (
        (F.length(trimmed) > 0)
        & (F.length(text) <= longest if longest else F.lit(True))
        & contains_any(F.lower(text), dims.SCREEN_PHRASES)
    )
    if not shown:
        return F.when(hit, trimmed)
    short = F.when(
        F.length(trimmed) > shown, F.concat(F.substring(trimmed, 1, shown), F.lit("..."))
    ).otherwise(trimmed)
    return F.when(hit, short)


def html_to_text(html: Column) -> Column:
    """Readable text of an HTML body; links keep their label and target."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(
        out, r"(?is)<a\b[^>]*href\s*=\s*([\"'])(.*?)\1[^>]*>(.*?)</a>", "$3 $2"
    )
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])\s*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    out = decode_entities(out)
    out = F.regexp_replace(out, r"[\t\r ]+", " ")
    out = F.regexp_replace(out, r" *\n *", "\n")
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def decode_entities(text: Column) -> Column:
    """Six named and all numeric character references, each decoded once.

    The text is cut at its references; every second piece is a reference. Text
    without an ampersand skips the cutting.
    """
    ref = r"(?i)&(#x[0-9a-f]+|#\d+|amp|lt|gt|quot|apos|nbsp);"
    mark = "\u0001"
    pieces = F.split(
        F.regexp_replace(F.regexp_replace(text, mark, ""), ref, f"{mark}&$1{mark}"), mark
    )

    def decode(piece: Column) -> Column:
        name = F.lower(F.regexp_extract(piece, r"^&(.*)$", 1))
        hexed = F.when(name.startswith("#x"), F.substring(name, F.lit(3), F.length(name))).otherwise(
            F.hex(F.substring(name, F.lit(2), F.length(name)).try_cast("bigint"))
        )
        short = F.regexp_replace(hexed, "^0+(?=.)", "")
        code = F.unhex(F.lpad(short, 8, "0"))
        number = F.conv(short, 16, 10).try_cast("bigint")
        char = F.when(
            (F.length(short) <= 8) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF),
            F.decode(code, "UTF-32"),
        )
        return (
            F.when(name == "amp", F.lit("&"))
            .when(name == "lt", F.lit("<"))
            .when(name == "gt", F.lit(">"))
            .when(name == "quot", F.lit('"'))
            .when(name == "apos", F.lit("'"))
            .when(name == "nbsp", F.lit(" "))
            .otherwise(F.coalesce(char, F.lit(" ")))
        )

    decoded = F.array_join(
        F.transform(pieces, lambda p, i: F.when(i % 2 == 1, decode(p)).otherwise(p)), ""
    )
    return F.when(text.contains("&"), decoded).otherwise(text)
