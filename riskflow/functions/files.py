"""File names, file content signatures and archive listings."""

from __future__ import annotations

import io
import itertools
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow import dims
from riskflow.functions.columns import lookup, sql_text, words

RTLO = "\u202e"


def extension(name: Column) -> Column:
    """Lower-case text behind the last dot, the whole name when there is no dot."""
    return F.lower(F.substring_index(name, ".", -1))


def clean_name(name: Column) -> Column:
    """Base name with printable characters only."""
    base = F.trim(F.substring_index(F.replace(name, F.lit("\\"), F.lit("/")), "/", -1))
    printable = F.regexp_replace(base, r"[\p{C}\p{Z}&&[^ ]]", "")
    return F.trim(F.coalesce(printable, F.lit("")))


def double_extension(name: Column) -> Column:
    """A document extension hidden in front of a dangerous or archive extension."""
    parts = F.filter(F.transform(F.split(name, r"\."), F.trim), lambda p: p != "")
    inner = F.lower(F.try_element_at(parts, F.lit(-2)))
    last = F.lower(F.try_element_at(parts, F.lit(-1)))
    return F.coalesce(
        name.contains(RTLO)
        | (
            (F.size(parts) >= 3)
            & F.array_contains(words(dims.SAFE_DOC_EXT), inner)
            & F.array_contains(words([*dims.DANGEROUS_EXT, *dims.ARCHIVE_EXT]), last)
        ),
        F.lit(False),
    )


def suspicious_name(name: Column) -> Column:
    low = F.lower(name)
    ends = "|".join([*dims.DANGEROUS_EXT, *dims.ARCHIVE_EXT])
    padded = name.rlike(" {3}|_{3}") & low.rlike(rf"\.(?:{ends})$")
    lured = low.rlike("|".join(dims.LURE_WORDS)) & F.array_contains(
        words(dims.DANGEROUS_EXT), extension(low)
    )
    return F.coalesce(
        name.contains(RTLO) | name.contains("\x00") | padded | lured, F.lit(False)
    )


def _head(content: Column, n: int) -> Column:
    return F.hex(F.substring(content, 1, n))


def latin(content: Column) -> Column:
    """Bytes as text, one character per byte, for searches inside content."""
    return F.decode(content, "ISO-8859-1")


def signature(content: str, field: str) -> Column:
    """Extension or mime of the first matching public file signature of a content
    column, null if none."""
    cases = " ".join(
        f"WHEN hex(substring({content}, {offset + 1}, {len(prefix) // 2})) = '{prefix}'"
        f" THEN {sql_text(ext if field == 'ext' else mime)}"
        for prefix, offset, ext, mime in dims.FILE_SIGNATURES
    )
    return F.expr(f"CASE {cases} END")


def magic_type(content: str) -> Column:
    """Coarse content type of a content column by its leading bytes."""
    head = f"hex(substring({content}, 1, 16))"
    starts = lambda *hx: f"{head} RLIKE '^(?:{'|'.join(hx)})'"
    early = lambda n: f"decode(substring({content}, 1, {n}), 'ISO-8859-1')"
    return F.expr(
        f"""CASE
        WHEN {content} IS NULL OR octet_length({content}) = 0 THEN 'empty'
        WHEN {starts("4D5A")} THEN 'executable/pe'
        WHEN {starts("7F454C46")} THEN 'executable/elf'
        WHEN {starts("FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE")} THEN 'executable/macho'
        WHEN {starts("CAFEBABE")} THEN 'executable/java_class'
        WHEN contains({early(1024)}, '%PDF-') THEN 'document/pdf'
        WHEN {starts("D0CF11E0A1B11AE1")} THEN 'document/ole2'
        WHEN {starts("7B5C727466")} THEN 'document/rtf'
        WHEN {starts("504B0304", "504B0506", "504B0708")} THEN
          CASE WHEN contains({early(2048)}, '[Content_Types].xml')
                 OR {early(2048)} RLIKE 'word/|xl/|ppt/' THEN 'document/ooxml'
               ELSE 'archive/zip' END
        WHEN {starts("526172211A0700", "526172211A070100")} THEN 'archive/rar'
        WHEN {starts("377ABCAF271C")} THEN 'archive/7z'
        WHEN {starts("1F8B")} THEN 'archive/gzip'
        WHEN {starts("425A68")} THEN 'archive/bzip2'
        WHEN octet_length({content}) >= 512
             AND hex(substring({content}, 258, 5)) = '7573746172' THEN 'archive/tar'
        WHEN lower({early(512)}) RLIKE '^[ \\t\\r\\n]*(?:<!doctype html|<html|<[?]xml)' THEN 'document/html'
        WHEN {starts("2321")} THEN 'script/shebang'
        END"""
    )


def _any(head: Column, prefixes) -> Column:
    return head.rlike("^(?:" + "|".join(prefixes) + ")")


def is_zip(content: Column) -> Column:
    return _any(_head(content, 4), ("504B0304", "504B0506", "504B0708"))


def _ustar(content: Column) -> Column:
    return (F.octet_length(content) >= 512) & (
        F.hex(F.substring(content, 258, 5)) == "7573746172"
    )


def type_mismatch(declared: Column, detected: Column) -> Column:
    """Declared extension contradicts the detected type, aliases respected."""
    image = ["jpg", "jpeg", "png", "gif", "bmp"]
    program = detected.startswith("executable/")
    fits = (
        (declared.isin("jpg", "jpeg") & detected.contains("jpeg"))
        | ((declared == "png") & detected.contains("png"))
        | ((declared == "gif") & detected.contains("gif"))
        | ((declared == "pdf") & (detected == "document/pdf"))
        | (declared.isin("doc", "xls", "ppt") & (detected == "document/ole2"))
        | (
            declared.isin("docx", "xlsx", "pptx", "docm", "xlsm", "pptm")
            & detected.isin("document/ooxml", "archive/zip")
        )
        | ((declared == "rtf") & (detected == "document/rtf"))
        | (
            declared.isin("zip", "jar", "apk")
            & detected.isin("archive/zip", "document/ooxml")
        )
        | (declared.isin("html", "htm") & (detected == "document/html"))
        | ((declared == "txt") & ~program & ~detected.startswith("archive/"))
    )
    clash = (
        (F.array_contains(words(dims.SAFE_DOC_EXT), declared) & program)
        | (
            declared.isin("pdf", "jpg", "jpeg", "png", "txt", "csv")
            & (detected == "archive/zip")
        )
        | ((declared == "pdf") & (detected != "document/pdf"))
        | (declared.isin(image) & ~detected.startswith("image/"))
    )
    known = (declared != "") & ~detected.isin("unknown", "empty")
    return F.coalesce(known & ~fits & clash, F.lit(False))


def extension_mismatch(content: str, name: Column) -> Column:
    """Detected and declared extension are both known and differ beyond aliases."""
    actual = signature(content, "ext")
    declared = F.lower(F.regexp_extract(name, r"[^/.][^/]*\.([^./]*)$", 1))
    alias = lookup(declared, dims.EXT_ALIASES, "")
    return F.coalesce(
        (F.octet_length(F.col(content)) > 0)
        & actual.isNotNull()
        & (declared != "")
        & (declared != actual)
        & (alias != actual),
        F.lit(False),
    )


# ------------------------------------------------------------------ archive listings
LISTING = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("too_many", T.BooleanType()),
        T.StructField(
            "entries",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("size", T.LongType()),
                        T.StructField("packed", T.LongType()),
                        T.StructField("is_dir", T.BooleanType()),
                        T.StructField("encrypted", T.BooleanType()),
                        T.StructField("inner", T.ArrayType(T.StringType())),
                    ]
                )
            ),
        ),
    ]
)


def _upto(items, bound: int | None):
    return items if bound is None else itertools.islice(items, bound)


def _zip_listing(content: bytes, bounds: dict) -> dict:
    entries = []
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            opened = 0
            for info in _upto(archive.infolist(), bounds["max_entries"]):
                low = info.filename.lower().rstrip("/\\ ")
                inner = None
                if low.rsplit(".", 1)[-1] in dims.ARCHIVE_EXT:
                    opened += 1
                    few = bounds["max_inner"] is None or opened <= bounds["max_inner"]
                    small = bounds["max_inner_bytes"] is None or info.compress_size < bounds["max_inner_bytes"]
                    if few and small and low.endswith(".zip"):
                        inner = _inner_names(archive, info, bounds["max_inner_names"])
                entries.append(
                    {
                        "name": info.filename,
                        "size": info.file_size,
                        "packed": info.compress_size,
                        "is_dir": info.is_dir(),
                        "encrypted": bool(info.flag_bits & 1),
                        "inner": inner,
                    }
                )
        error = None
    except (zipfile.BadZipFile, zipfile.LargeZipFile) as exc:
        error = f"malformed_header ({type(exc).__name__})"
    except Exception as exc:  # noqa: BLE001 - a hostile archive must not end the job
        error = str(exc)[:100]
    return {"kind": "zip", "error": error, "too_many": False, "entries": entries}


def _inner_names(archive: zipfile.ZipFile, info: zipfile.ZipInfo, bound: int | None) -> list[str] | None:
    """Names of a zip held in a zip; it is read as a stream, so its size costs time but no memory."""
    try:
        with archive.open(info) as stream, zipfile.ZipFile(stream) as inner:
            return [i.filename for i in _upto(inner.infolist(), bound)]
    except Exception:  # noqa: BLE001
        return None


def _tar_listing(content: bytes, bounds: dict) -> dict:
    entries, error, too_many = [], None, False
    try:
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as archive:
            for member in archive:
                if len(entries) == bounds["max_entries"]:
                    too_many = True
                    break
                entries.append(
                    {
                        "name": member.name,
                        "size": member.size,
                        "packed": None,
                        "is_dir": member.isdir(),
                        "encrypted": False,
                        "inner": None,
                    }
                )
                archive.members = []  # the reader would keep every member
    except Exception as exc:  # noqa: BLE001
        error = f"malformed_header ({type(exc).__name__})"
    return {"kind": "tar", "error": error, "too_many": too_many, "entries": entries}


def _listing_of(bounds: dict):
    @F.pandas_udf(LISTING)
    def listing(content: pd.Series, zipped: pd.Series, forced: pd.Series) -> pd.DataFrame:
        rows = []
        for data, as_zip, as_tar in zip(content, zipped, forced):
            row = {"kind": None, "error": None, "too_many": False, "entries": []}
            if data is not None:
                data = bytes(data)
                if as_zip:
                    row = _zip_listing(data, bounds)
                elif as_tar or tarfile.is_tarfile(io.BytesIO(data)):
                    row = _tar_listing(data, bounds)
            rows.append(row)
        return pd.DataFrame(rows, columns=["kind", "error", "too_many", "entries"])

    return listing


#: bounds of a listing, off unless given: entries of an archive, zips in it that are opened, their
#: packed bytes and names
LISTING_BOUNDS = {"max_entries": None, "max_inner": None, "max_inner_bytes": None, "max_inner_names": None}


def archive_listing(content: Column, detected: Column, declared: Column, **bounds: int) -> Column:
    """Directory of a zip or tar file; null content for everything else stays in the JVM.

    Only candidates cross to Python: zip marks, tar marks, packed tars, a plausible
    tar checksum field, or a tar file name. ``bounds``: those of ``LISTING_BOUNDS``.
    """
    zipped = is_zip(content)
    forced = (
        detected.isin("archive/tar", "archive/gzip", "archive/bzip2")
        | _ustar(content)
        | declared.isin("tar", "tgz", "tbz2")
    )
    maybe_tar = _any(_head(content, 6), ("FD377A585A00", "5D0000")) | (
        (F.octet_length(content) >= 512)
        & F.hex(F.substring(content, 149, 8)).rlike("^(?:20|3[0-7]|00){8}$")
    )
    candidate = F.coalesce(zipped | forced | maybe_tar, F.lit(False))
    return _listing_of({**LISTING_BOUNDS, **bounds})(
        F.when(candidate, content),
        F.coalesce(zipped, F.lit(False)),
        F.coalesce(forced, F.lit(False)),
    )
