"""Static attachment rules over file name and content.

Only the directory of an archive is read by Python; every rule is an expression
over that listing (at most 200 entries), so nothing is exploded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow import dims
from riskflow.functions.columns import (
    engine_result,
    evidence,
    evidence_list,
    filled,
    flag_list,
    in_words,
    keep,
    lookup,
    no_evidence,
    no_flags,
    skipped_result,
    text_of,
    words,
)
from riskflow.functions.files import (
    archive_listing,
    clean_name,
    double_extension,
    extension,
    is_zip,
    latin,
    magic_type,
    signature,
    suspicious_name,
    type_mismatch,
    RTLO,
)


def pick_attachment(df: DataFrame) -> DataFrame:
    """Add ``att_name`` and ``att_bytes``: the file of the scan, else its first attachment."""
    own = filled(F.col("file_name")) | F.coalesce(F.octet_length("file_bytes") > 0, F.lit(False))
    first = F.try_element_at(F.col("attachments"), F.lit(1))
    return df.withColumns(
        {
            "att_name": F.when(own, F.col("file_name")).otherwise(first["name"]),
            "att_bytes": F.when(own, F.col("file_bytes")).otherwise(first["content"]),
        }
    )


def with_attachment_signals(
    df: DataFrame, max_script_chars: int | None = None, **bounds: int
) -> DataFrame:
    """Add ``att_flags`` (sorted), ``att_score``, ``att_confidence``, ``att_evidence``,
    ``att_partial`` and ``att_type`` for ``att_name`` and ``att_bytes``.

    Whole contents and archives are judged; ``max_script_chars`` bounds the look for scripts in
    HTML, ``bounds`` the archive listing (``LISTING_BOUNDS``).
    """
    c = lambda n: F.col("_at_" + n)
    body = F.col("att_bytes")
    df = df.withColumns(
        {
            "_at_name": clean_name(F.col("att_name")),
            "_at_rtlo": F.coalesce(F.col("att_name").contains(RTLO), F.lit(False)),
            "_at_has": F.coalesce(F.octet_length(body) > 0, F.lit(False)),
        }
    )
    df = df.withColumns(
        {
            "_at_ext": F.when(c("name").contains("."), extension(c("name"))).otherwise(""),
            "att_type": F.when(
                c("has"),
                F.coalesce(magic_type("att_bytes"), signature("att_bytes", "mime"), F.lit("unknown")),
            ).otherwise("unknown"),
            "_at_txt": F.when(c("has"), latin(body)),
        }
    )
    df = df.withColumn(
        "_at_list",
        archive_listing(F.when(c("has"), body), F.col("att_type"), c("ext"), **bounds),
    )
    kind, ext = F.col("att_type"), c("ext")
    office = (kind == "document/ooxml") | F.expr(in_words("_at_ext", dims.OFFICE_EXT))
    df = df.withColumns(
        {
            "_at_zip": F.coalesce(is_zip(body), F.lit(False)),
            "_at_arch": F.coalesce(c("list")["kind"].isNotNull() & ~office, F.lit(False)),
            "_at_ent": F.coalesce(c("list")["entries"], F.array().cast(df.schema["_at_list"].dataType["entries"].dataType)),
        }
    )
    entry_names = F.transform(c("ent"), lambda e: F.lower(e["name"]))
    vba = F.filter(c("ent"), lambda e: F.lower(e["name"]).rlike(r"vbaproject\.bin|vbadata\.xml|vba/"))
    objects = F.filter(
        c("ent"),
        lambda e: F.lower(e["name"]).rlike(
            r"embeddings/oleobject|\.(?:js|vbs|ps1|bat|cmd|exe)$"
        ),
    )
    ole = kind == "document/ole2"
    marker = F.coalesce(
        *[F.when(c("txt").contains(m), F.lit(m)) for m in dims.OLE_MACRO_MARKERS]
    )
    plain_zip = c("zip") & F.substring(c("txt"), 1, 4).eqNullSafe(F.lit("PK\x03\x04"))
    first_name = lambda hits: clean_name(F.element_at(hits, 1)["name"])
    macro = F.when(
        c("has") & F.expr(in_words("_at_ext", dims.MACRO_EXT)), text_of("macro_enabled_extension (.", ext, ")")
    ).when(
        c("has") & (kind.isin("document/ooxml", "archive/zip") | plain_zip) & (F.size(vba) > 0),
        text_of("ooxml_vba_part (", first_name(vba), ")"),
    ).when(c("has") & ole & marker.isNotNull(), text_of("ole2_vba_marker (", marker, ")"))
    script = F.when(
        kind == "document/pdf",
        F.when(c("txt").rlike(r"/(?:JavaScript|JS)\b"), F.lit("pdf_javascript"))
        .when(c("txt").rlike(r"/Launch\b"), F.lit("pdf_launch_action"))
        .when(c("txt").rlike(r"/EmbeddedFiles\b"), F.lit("pdf_embedded_files")),
    ).when(
        ((kind == "document/ooxml") | plain_zip) & (F.size(objects) > 0),
        text_of("ooxml_embedded_object (", first_name(objects), ")"),
    ).when(
        (kind == "document/rtf") & c("txt").rlike(r"\\(?:objdata|objocx|object)\b"),
        F.lit("rtf_embedded_object"),
    ).when(
        (kind == "document/html")
        & F.substring(c("txt"), 1, max_script_chars or 2**31 - 1).rlike(r"(?i)<script[\s>]|javascript:|onerror=|onload="),
        F.lit("html_script_tags"),
    )
    df = df.withColumns({"_at_macro": macro, "_at_script": script})
    df = _with_archive(df, bounds.get("max_entries"))

    df = df.withColumns(
        {
            "_at_double": double_extension(c("name")) | c("rtlo"),
            "_at_odd": suspicious_name(c("name")) | c("rtlo"),
            "_at_clash": c("has") & type_mismatch(ext, kind),
        }
    )
    named = "_at_name <> '' AND "
    exe_ext = named + in_words("_at_ext", dims.EXECUTABLE_EXT)
    script_ext = named + in_words("_at_ext", dims.SCRIPT_EXT)
    evasive = named + in_words("_at_ext", dims.EVASION_EXT)
    exe_magic = f"startswith(att_type, 'executable/') AND NOT ({exe_ext})"
    shebang = f"att_type = 'script/shebang' AND NOT ({script_ext})"
    flags = F.array_sort(
        F.array_distinct(
            F.concat(
                flag_list(
                    {
                        "DOUBLE_EXTENSION": named + "_at_double",
                        "SUSPICIOUS_FILENAME": named + "_at_odd",
                        "SUSPICIOUS_EXTENSION": evasive,
                        "EXECUTABLE_ATTACHMENT": f"({exe_ext}) OR ({exe_magic})",
                        "SCRIPT_ATTACHMENT": f"({script_ext}) OR ({shebang})",
                        "ATTACHMENT_TYPE_MISMATCH": named + "_at_clash",
                        "MACRO_PRESENT": "_at_macro IS NOT NULL",
                        "EMBEDDED_SCRIPT": "_at_script IS NOT NULL",
                    }
                ),
                c("aflags"),
            )
        )
    )
    items = F.concat(
        evidence_list(
            [
                ("double_extension", "_at_name",
                 "Attachment uses a deceptive double file extension: '{_at_name}'.",
                 named + "_at_double"),
                ("suspicious_filename", "_at_name",
                 "Attachment filename matches deceptive lure pattern: '{_at_name}'.",
                 named + "_at_odd"),
                ("suspicious_extension", "concat('.', _at_ext)",
                 "Attachment uses a high-risk or suspicious file extension: '.{_at_ext}'.", evasive),
                ("executable_extension", "concat('.', _at_ext)",
                 "Attachment declared as executable file type: '.{_at_ext}'.", exe_ext),
                ("script_extension", "concat('.', _at_ext)",
                 "Attachment declared as script file type: '.{_at_ext}'.", script_ext),
                ("executable_magic_bytes", "att_type",
                 "Attachment binary header matches executable format: '{att_type}'.", exe_magic),
                ("script_shebang", "'script/shebang'",
                 "Attachment content begins with executable script shebang.", shebang),
                ("attachment_type_mismatch",
                 "concat('declared=.', _at_ext, ', detected=', att_type)",
                 "Declared extension '.{_at_ext}' does not match detected type '{att_type}'.",
                 named + "_at_clash"),
                ("macro_present", "_at_macro",
                 "Office document attachment contains embedded VBA macros.",
                 "_at_macro IS NOT NULL"),
                ("embedded_script", "_at_script",
                 "Attachment contains embedded script or launch action: {_at_script}.",
                 "_at_script IS NOT NULL"),
            ]
        ),
        c("aitems"),
    )
    df = df.withColumns({"att_flags": flags, "att_evidence": F.array_sort(items)})
    weight = F.aggregate(
        "att_flags",
        F.lit(0.0),
        lambda acc, f: acc + lookup(f, dims.ATTACHMENT_WEIGHTS, dims.DEFAULT_ATTACHMENT_WEIGHT),
    )
    strong = F.arrays_overlap(
        "att_flags", words(dims.STRONG_ATTACHMENT_FLAGS)
    )
    pick = lambda with_bytes, without: F.when(c("has"), with_bytes).otherwise(without)
    df = df.withColumns(
        {
            "att_score": F.least(weight, F.lit(dims.ATTACHMENT_SCORE_CAP)),
            "att_confidence": F.when(F.size("att_flags") == 0, pick(1.0, 0.70))
            .when(strong, pick(0.95, 0.75))
            .otherwise(pick(0.85, 0.70)),
            "att_partial": c("arch") & c("list")["error"].isNotNull(),
            "att_present": (c("name") != "") | c("has") | filled(F.col("att_name")),
        }
    )
    return df.drop(*[x for x in df.columns if x.startswith("_at_")])


def _with_archive(df: DataFrame, max_entries: int | None) -> DataFrame:
    """Flags and evidence found in the directory of an archive."""
    c = lambda n: F.col("_at_" + n)
    is_tar = c("list")["kind"] == "tar"
    parts = lambda e: F.split(F.replace(e["name"], F.lit("\\"), F.lit("/")), "/")
    df = df.withColumn(
        "_at_info",
        F.transform(
            c("ent"),
            lambda e: F.struct(
                e["name"].alias("raw"),
                clean_name(e["name"]).alias("name"),
                extension(clean_name(e["name"])).alias("ext"),
                F.size(parts(e)).alias("depth"),
                (
                    F.array_contains(parts(e), "..")
                    | (F.coalesce(is_tar, F.lit(False)) & e["name"].rlike(r"^[/\\]"))
                ).alias("climbs"),
                e["encrypted"].alias("encrypted"),
                (~e["is_dir"]).alias("is_file"),
                e["inner"].alias("inner"),
            ),
        ),
    )
    payload = lambda x: F.array_contains(
        words([e for e in dims.DANGEROUS_EXT if e not in dims.ARCHIVE_EXT]), x
    )
    archive = lambda x: F.array_contains(words(dims.ARCHIVE_EXT), x)
    runs = lambda x: F.when(
        F.array_contains(words(dims.EXECUTABLE_EXT), x), F.lit("EXECUTABLE_ATTACHMENT")
    ).otherwise("SCRIPT_ATTACHMENT")
    sus, deep = "SUSPICIOUS_ARCHIVE", "ARCHIVE_DEPTH_ANOMALY"

    def of_entry(e: Column) -> Column:
        named = e["name"] != ""
        doubled = named & double_extension(e["name"])
        loaded = named & payload(e["ext"])
        nested = named & archive(e["ext"])
        depth = e["depth"].cast("string")
        shown = F.when(named, e["name"]).otherwise(
            F.when(F.coalesce(is_tar, F.lit(False)), e["raw"]).otherwise(""))
        item = lambda cond, flags, ev: F.when(
            cond, F.struct(flags.alias("flags"), ev.alias("ev"))
        )
        many = lambda *f: F.array(*[x if isinstance(x, Column) else F.lit(x) for x in f])
        return keep(
            item(e["climbs"], many(sus), evidence("archive_path_traversal", shown,
                 "Archive contains suspicious directory traversal entries.")),
            item(e["encrypted"], many(sus), evidence("archive_encrypted_entry", e["name"],
                 "Archive contains password-protected or encrypted entries.")),
            item(e["depth"] > 5, many(deep), evidence("archive_depth_anomaly",
                 text_of("depth=", depth), text_of(
                 "Archive directory structure exceeds safe nesting depth limit (", depth, ")."))),
            item(doubled, many("DOUBLE_EXTENSION", sus), evidence(
                "archive_contained_double_extension", e["name"], text_of(
                "Archive contains deceptive double extension: '", e["name"], "'."))),
            item(loaded, many(runs(e["ext"]), sus), evidence("archive_contained_payload",
                 text_of(e["name"], " (.", e["ext"], ")"), text_of(
                 "Archive contains executable or script payload: '", e["name"], "'."))),
            item(nested, many("NESTED_ARCHIVE"), evidence("nested_archive", e["name"], text_of(
                "Archive contains nested archive file: '", e["name"], "'."))),
        )

    def of_inner(e: Column) -> Column:
        """Names inside an inner zip; the first archive among them ends the look."""
        names = F.transform(F.coalesce(e["inner"], no_flags()), clean_name)
        stop = F.array_position(F.transform(names, lambda n: archive(extension(n))), True)
        seen = F.when(stop > 0, F.slice(names, 1, stop.cast("int"))).otherwise(names)
        finding = lambda n: F.when(
            archive(extension(n)),
            F.struct(
                F.array(F.lit(deep)).alias("flags"),
                evidence("archive_depth_anomaly", text_of("nested_level_2 (", n, ")"),
                         "Archive contains multiple nested archive layers exceeding depth limits."
                         ).alias("ev"),
            ),
        ).when(
            F.array_contains(words(dims.DANGEROUS_EXT), extension(n)),
            F.struct(
                F.array(F.lit(sus), runs(extension(n))).alias("flags"),
                evidence("nested_archive_payload", n, text_of(
                    "Nested archive contains payload: '", n, "'.")).alias("ev"),
            ),
        )
        return F.array_compact(F.transform(seen, finding))

    sum_of = lambda f: F.aggregate(
        c("ent"), F.lit(0).cast("bigint"), lambda acc, e: acc + F.coalesce(e[f], F.lit(0))
    )
    df = df.withColumns({"_at_total": sum_of("size"), "_at_packed": sum_of("packed")})
    ratio = F.when(
        c("total") > 0, c("total") / F.greatest(c("packed"), F.lit(1))
    ).otherwise(1.0)
    ok = c("list")["error"].isNull()
    huge = ok & (c("total") > dims.MAX_UNPACKED_BYTES)
    bomb = ok & ~is_tar & (
        huge | ((c("total") > 1_000_000) & (ratio > dims.MAX_EXPANSION_RATIO))
    )
    files = F.filter(c("info"), lambda e: e["is_file"] & (e["name"] != ""))
    only = F.try_element_at(files, F.lit(1))
    dropper = (
        ok & (F.size(files) == 1)
        & F.coalesce(F.array_contains(words(dims.DANGEROUS_EXT), only["ext"]), F.lit(False))
        & ~c("list")["too_many"]
    )
    one = lambda cond, name, ev: F.when(
        F.coalesce(cond, F.lit(False)),
        F.struct(F.array(F.lit(name)).alias("flags"), ev.alias("ev")),
    )
    shown_ratio = F.format_string("%.1f", ratio)
    total = c("total").cast("string")
    malformed = F.coalesce(c("list")["error"].startswith("malformed_header"), F.lit(False))
    whole = keep(
        one(bomb, "ARCHIVE_EXPANSION_ANOMALY", evidence(
            "archive_expansion_anomaly",
            text_of("ratio=", shown_ratio, ":1, uncompressed=", total, "B"),
            text_of("Archive exhibits suspicious compression expansion ratio (", shown_ratio,
                    ":1)."))),
        one(huge & is_tar, "ARCHIVE_EXPANSION_ANOMALY", evidence(
            "archive_expansion_anomaly", text_of("uncompressed=", total, "B"),
            text_of("Archive uncompressed size (", total, "B) exceeds safety boundary (",
                    str(dims.MAX_UNPACKED_BYTES), "B)."))),
        one(dropper, sus, evidence("archive_single_payload_dropper", only["name"],
            "Archive contains a solitary executable/script payload (classic dropper format).")),
        one(c("list")["too_many"], sus, evidence("archive_entry_limit_exceeded",
            f"entries_exceeded>{max_entries}",
            "Archive contains excessive entries exceeding safety limit "
            f"({max_entries}).")),
        one(~ok & malformed, sus, evidence("archive_malformed", c("list")["error"],
            "Archive header is corrupted, malformed, or invalid.")),
        one(~ok & ~malformed, sus, evidence("archive_read_error", c("list")["error"],
            "Unable to safely parse full archive structure.")),
    )
    findings = F.concat(
        F.flatten(F.transform(c("info"), of_entry)),
        F.flatten(F.transform(c("info"), of_inner)),
        whole,
    )
    df = df.withColumn("_at_find", F.when(c("arch"), findings))
    return df.withColumns(
        {
            "_at_aflags": F.coalesce(
                F.flatten(F.transform(c("find"), lambda x: x["flags"])), no_flags()
            ),
            "_at_aitems": F.coalesce(
                F.transform(c("find"), lambda x: x["ev"]), no_evidence()
            ),
        }
    )


def attachment_result() -> Column:
    result = engine_result(
        dims.ATTACHMENT_ENGINE,
        F.col("att_score"),
        F.col("att_confidence"),
        F.col("att_flags"),
        F.col("att_evidence"),
        status=F.when(F.col("att_partial"), F.lit("partial")).otherwise("success"),
        metadata=F.create_map(
            F.lit("detected_type"), F.col("att_type"),
            F.lit("anomalies_detected"), F.size("att_flags").cast("string"),
        ),
    )
    return F.when(F.col("att_present"), result).otherwise(
        skipped_result(dims.ATTACHMENT_ENGINE, "No attachment data to analyze")
    )
