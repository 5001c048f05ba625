"""Scan requests: JSON ingest, base64 payloads, preprocessing gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.functions.columns import filled, keep, no_flags
from riskflow.functions.files import extension_mismatch
from riskflow.functions.text import nfkc, normalized_text
from riskflow.functions.urls import normalize_url
from riskflow.schemas import SCAN_REQUESTS, SCANS


def read_scan_requests(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON lines with the scan fields; unreadable lines carry ``_corrupt``."""
    reader = spark.readStream if stream else spark.read
    return (
        reader.schema(SCAN_REQUESTS + ", _corrupt string")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
    )


def parse_scan_requests(lines: DataFrame, column: str = "value") -> DataFrame:
    """The same from a text column, as a queue delivers requests; other columns are kept."""
    schema = SCAN_REQUESTS + ", _corrupt string"
    parsed = F.from_json(column, schema, {"columnNameOfCorruptRecord": "_corrupt"})
    rest = [c for c in lines.columns if c != column]
    return lines.withColumn("_request", parsed).select(*rest, "_request.*")


def promote_metadata(requests: DataFrame) -> DataFrame:
    """Requests with ``metadata`` as a map of texts and its nested parts in the columns of a scan.

    ``metadata.headers`` becomes ``headers``, its list of Received lines ``received``; ``attachments`` or
    ``files`` (a list or one object) become ``attachments``; a numeric ``timestamp`` in either form becomes
    ``meta_ts``. Columns that the request fills itself stay. Parts of another shape count as absent.
    """
    get = lambda path, kind: F.try_variant_get("metadata", path, kind)
    texts = "map<string,string>"

    def files(part: str) -> Column:
        one = "struct<file_name:string,filename:string,name:string,file_bytes:string,content:string,bytes:string>"
        named = lambda a: F.coalesce(F.nullif(a["file_name"], F.lit("")), F.nullif(a["filename"], F.lit("")), a["name"])
        body = lambda a: F.coalesce(F.nullif(a["file_bytes"], F.lit("")), F.nullif(a["content"], F.lit("")), a["bytes"])
        listed = F.coalesce(get(f"$.{part}", f"array<{one}>"), F.array(get(f"$.{part}", one)))
        found = F.transform(
            F.filter(listed, lambda a: a.isNotNull()), lambda a: F.struct(named(a).alias("name"), body(a).alias("content"))
        )
        return F.when(F.size(found) > 0, found)

    hops = [get(path, "array<string>") for path in (
        "$.headers.Received", "$.Received", "$.headers.received", "$.received")]
    return requests.withColumns({
        "headers": F.coalesce("headers", get("$.headers", texts)),
        "received": F.coalesce("received", *hops),
        "attachments": F.coalesce("attachments", files("attachments"), files("files")),
        "meta_ts": F.coalesce("meta_ts", get("$.timestamp", "double")),
        "metadata": get("$", texts),
    })


def decode_payload(value: Column, max_bytes: int | None = None) -> tuple[Column, Column]:
    """(bytes, error) of a base64 text in the standard or URL-safe alphabet.

    ``max_bytes`` rejects larger payloads; by default there is no bound.
    """
    max_encoded = 2**31 - 1 if max_bytes is None else ((max_bytes + 2) // 3) * 4 + 64
    compact = F.regexp_replace(value, r"(?U)\s+", "")
    size = F.length(compact)
    alphabet = compact.rlike(r"^[A-Za-z0-9+/=_\-]*$")
    standard = F.translate(compact, "-_", "+/")
    padded = F.concat(standard, F.repeat(F.lit("="), F.pmod(-size, F.lit(4))))
    shape = padded.rlike(r"^[A-Za-z0-9+/]*={0,2}$")
    content = F.when(shape, F.try_to_binary(padded, F.lit("base64")))
    error = (
        F.when(size > max_encoded, F.lit("exceeds the maximum supported encoded size."))
        .when(~alphabet, F.lit("must be base64-encoded when sent as a string."))
        .when((size > 0) & content.isNull(), F.lit("must be valid base64 when sent as a string."))
    )
    return F.when(error.isNull() & (size > 0), content), error


def decode_scans(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scan rows, rejected requests with ``reject_reason``)."""
    if requests.schema["metadata"].dataType.simpleString() == "variant":
        requests = promote_metadata(requests)
    file, file_error = decode_payload(F.col("file_bytes"))
    image, image_error = decode_payload(F.col("image_bytes"))
    named = lambda field, e: F.concat(F.lit(field + " "), e)
    attachments = F.transform(
        "attachments",
        lambda a: F.struct(
            a["name"].alias("name"), decode_payload(a["content"])[0].alias("content")
        ),
    )
    corrupt = (
        F.when(F.col("_corrupt").isNotNull(), F.lit("unreadable request"))
        if "_corrupt" in requests.columns
        else F.lit(None).cast("string")
    )
    rows = requests.withColumn(
        "reject_reason",
        F.coalesce(corrupt, named("file_bytes", file_error), named("image_bytes", image_error)),
    ).withColumns({"_file": file, "_image": image, "_att": attachments})
    good = (
        rows.where("reject_reason is null")
        .withColumns({"file_bytes": F.col("_file"), "image_bytes": F.col("_image"),
                      "attachments": F.col("_att")})
        .drop("_file", "_image", "_att", "reject_reason", "_corrupt")
    )
    bad = rows.where("reject_reason is not null").drop("_file", "_image", "_att")
    return good, bad


def complete_scans(df: DataFrame) -> DataFrame:
    """All scan columns, absent ones as null; missing values are taken from ``metadata``.

    A request without ``scan_id`` gets the hash of its content, so equal requests share it.
    """
    from pyspark.sql.types import StructType

    wanted = StructType.fromDDL(SCANS)
    df = df.select(
        *[
            F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in wanted
        ],
        *[c for c in df.columns if c not in wanted.fieldNames()],
    )
    meta = lambda k: F.nullif(F.trim(F.try_element_at("metadata", F.lit(k))), F.lit(""))
    content = F.to_json(F.struct(*[n for n in wanted.fieldNames() if n != "scan_id"]))
    return df.withColumns(
        {
            "scan_id": F.coalesce("scan_id", F.sha2(content, 256)),
            "meta_ts": F.coalesce("meta_ts", meta("timestamp").try_cast("double")),
            "sender_domain": F.coalesce("sender_domain", meta("sender_domain")),
            "client_id": F.coalesce("client_id", meta("client_id")),
        }
    )


def normalize_file_name(name: Column, max_chars: int | None = None) -> tuple[Column, Column]:
    """(clean base name or null, warnings); ``max_chars`` cuts longer names."""
    base = F.regexp_extract(F.replace(name, F.lit("\\"), F.lit("/")), r"(?s)([^/]*)$", 1)
    base = F.regexp_replace(base, r"(?U)^\s+|\s+$", "")
    plain = F.regexp_replace(base, r"[\x00-\x1f\x7f]", "")
    plain = F.regexp_replace(nfkc(plain), r"(?U)^\s+|\s+$", "")
    warnings = keep(
        F.when(
            base.rlike(r"[\x00-\x08\x0a-\x1f\x7f]"),
            F.lit("filename_control_characters_stripped"),
        ),
        F.when(
            F.length(plain) > (max_chars or 2**31 - 1), F.lit("filename_truncated_to_max_length")
        ),
    )
    plain = F.substring(plain, 1, max_chars) if max_chars else plain
    return F.nullif(plain, F.lit("")), F.coalesce(warnings, no_flags())


def clean_sender(sender: Column) -> Column:
    text = F.regexp_replace(sender, r"(?U)^\s+|\s+$", "")
    inner = F.regexp_extract(text, "<([^>]+)>", 1)
    return (
        F.when(inner != "", F.lower(F.trim(inner)))
        .when(text.contains("@"), F.lower(text))
        .otherwise(text)
    )


def preprocess(
    df: DataFrame,
    max_chars: int | None = None,
    max_name: int | None = None,
    max_headers: int | None = None,
    max_hops: int | None = None,
    max_bytes: int | None = None,
    max_url: int | None = None,
) -> DataFrame:
    """Normalize scan rows and add ``prep_status``, ``prep_error`` and ``prep_warnings``.

    Rejected rows keep their values; callers route them aside instead of scoring.
    ``sender_raw`` keeps the sender with its display name. The bounds on text, URL, file
    name, headers, received hops and file bytes are off unless given.
    """
    first = lambda items, n: F.slice(items, 1, n) if n else items
    df = complete_scans(df)
    raw_any = _scannable(df)
    text, text_warnings = normalized_text(F.col("text"), max_chars)
    df = df.withColumns({"_pp_any": raw_any, "_pp_text": text, "_pp_text_w": text_warnings})
    df = normalize_url(df, "url", "_pp_url", max_url)
    name, name_warnings = normalize_file_name(F.col("file_name"), max_name)
    df = df.withColumns({"_pp_name": name, "_pp_name_w": name_warnings})
    headers = F.map_from_entries(
        F.transform(
            first(F.map_entries("headers"), max_headers),
            lambda e: F.struct(
                F.trim(e["key"]).alias("key"),
                F.regexp_replace(
                    F.regexp_replace(e["value"], r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""),
                    r"(?U)^\s+|\s+$",
                    "",
                ).alias("value"),
            ),
        )
    )
    too_big = F.coalesce(F.octet_length("file_bytes") > (max_bytes or 2**31 - 1), F.lit(False))
    warnings = F.concat(
        F.col("_pp_text_w"),
        F.col("_pp_url_warnings"),
        F.when(too_big, F.array(F.lit("file_exceeds_10mb_limit"))).otherwise(F.col("_pp_name_w")),
        keep(
            F.when(F.size("metadata") > 100, F.lit("metadata_items_limit_exceeded")),
            F.when(
                F.size("received") > (max_hops or 2**31 - 1), F.lit("received_chain_hops_truncated")
            ),
        ),
    )
    df = df.withColumns(
        {
            "prep_warnings": warnings,
            "_pp_sender": clean_sender(F.col("sender_id")),
            "_pp_big": too_big,
        }
    )
    ok = lambda c: filled(F.col(c))
    some = lambda c: F.coalesce(F.octet_length(c) > 0, F.lit(False))
    anything = (
        ok("_pp_text") | ok("_pp_url") | some("file_bytes") | some("image_bytes")
        | ok("_pp_sender") | ok("_pp_name")
    )
    url_error = F.col("_pp_url_error")
    failed_port = url_error.startswith("preprocessing_error: ")
    error = (
        F.when(~F.col("_pp_any"), F.lit("ScanInput must contain at least one piece of scannable data."))
        .when(
            failed_port,
            F.concat(
                F.lit("Preprocessing failed: "),
                F.replace(url_error, F.lit("preprocessing_error: "), F.lit("")),
            ),
        )
        .when(
            url_error.isNotNull(), F.concat(F.lit("Invalid or rejected URL: "), url_error)
        )
        .when(F.col("_pp_big"), F.lit("File exceeds maximum allowed size of 10MB"))
        .when(~anything, F.lit("ScanInput contains no valid scannable content after normalization."))
    )
    df = df.withColumn("prep_error", error)
    good = F.col("prep_error").isNull()
    pick = lambda new, old: F.when(good, new).otherwise(F.col(old))
    df = df.withColumns(
        {
            "prep_status": F.when(~good, F.lit("rejected"))
            .when(F.size("prep_warnings") > 0, F.lit("partial"))
            .otherwise("success"),
            "sender_raw": F.col("sender_id"),
            "text": pick(F.nullif(F.col("_pp_text"), F.lit("")), "text"),
            "url": pick(F.col("_pp_url"), "url"),
            "file_name": pick(F.col("_pp_name"), "file_name"),
            "sender_id": pick(F.col("_pp_sender"), "sender_id"),
            "headers": pick(headers, "headers"),
            "received": pick(F.transform(first(F.col("received"), max_hops), lambda h: F.trim(h)), "received"),
            "client_id": pick(F.trim("client_id"), "client_id"),
        }
    )
    df = df.withColumn(
        "extension_mismatch", extension_mismatch("file_bytes", F.col("file_name"))
    )
    return df.drop(*[c for c in df.columns if c.startswith("_pp_")])


def _scannable(df: DataFrame) -> Column:
    has = [filled(F.col(c)) for c in ("text", "url", "sender_id", "file_name")]
    has += [F.coalesce(F.octet_length(c) > 0, F.lit(False)) for c in ("file_bytes", "image_bytes")]
    out = has[0]
    for h in has[1:]:
        out = out | h
    return out


def profile_name(df: DataFrame) -> Column:
    """Profile asked for by the row: own field, else two metadata keys."""
    pick = lambda c: F.nullif(c, F.lit(""))
    meta = lambda k: pick(F.try_element_at(F.col("metadata"), F.lit(k)))
    return F.coalesce(
        pick(F.col("classification_profile")), meta("classification_profile"), meta("profile")
    )
