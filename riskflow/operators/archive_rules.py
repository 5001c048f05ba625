"""Rules over the entries of archives, as a relation with parents.

``entries(file_id, entry_id, parent_id, kind, name, size, packed, is_dir, encrypted)``: one row per entry
of an archive; ``parent_id`` names the entry whose archive holds it (null in the outer one) and
``kind`` (zip or tar) is that of the outer archive. Rules of one entry are a projection, rules of an
archive are sums, minima and counts that combine before the shuffle; a file of very many entries is never
gathered. The level of a nested entry comes from pointer doubling over the entries that hold others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow import dims
from riskflow.functions.columns import lookup, words
from riskflow.functions.files import clean_name, double_extension, extension
from riskflow.operators.chains import follow

#: flags by finding; payloads also tell programs from scripts
FLAGS = {
    "archive_path_traversal": ["SUSPICIOUS_ARCHIVE"],
    "archive_encrypted_entry": ["SUSPICIOUS_ARCHIVE"],
    "archive_depth_anomaly": ["ARCHIVE_DEPTH_ANOMALY"],
    "archive_contained_double_extension": ["DOUBLE_EXTENSION", "SUSPICIOUS_ARCHIVE"],
    "archive_contained_payload": ["SUSPICIOUS_ARCHIVE"],
    "nested_archive": ["NESTED_ARCHIVE"],
    "nested_archive_payload": ["SUSPICIOUS_ARCHIVE"],
    "archive_expansion_anomaly": ["ARCHIVE_EXPANSION_ANOMALY"],
    "archive_single_payload_dropper": ["SUSPICIOUS_ARCHIVE"],
    "archive_entry_limit_exceeded": ["SUSPICIOUS_ARCHIVE"],
}


def with_levels(entries: DataFrame) -> DataFrame:
    """Add ``level``: 1 in the outer archive, one more per archive around; null where parents go round."""
    key = lambda part: F.struct("file_id", F.col(part).alias("entry_id"))
    holders = entries.where("parent_id IS NOT NULL").select("file_id", F.col("parent_id").alias("entry_id")).distinct()
    inner = entries.select("file_id", "entry_id", "parent_id").join(holders, ["file_id", "entry_id"], "left_semi")
    links = inner.where("parent_id IS NOT NULL").select(
        key("entry_id").alias("node"), key("parent_id").alias("next"), F.lit(True).alias("ok")
    )
    ends, _ = follow(links)
    depth = ends.select(
        F.col("node.file_id").alias("file_id"), F.col("node.entry_id").alias("parent_id"),
        F.when(~F.col("cyclic"), F.col("hops")).alias("_hops"), "cyclic",
    )
    level = F.when(F.col("parent_id").isNull(), 1).when(
        ~F.coalesce("cyclic", F.lit(False)), F.coalesce("_hops", F.lit(0)) + 2
    )
    return entries.join(depth, ["file_id", "parent_id"], "left").select(*entries.columns, level.cast("int").alias("level"))


def _has(names: list[str], ext: Column) -> Column:
    return F.array_contains(words(names), ext)


def entry_findings(entries: DataFrame) -> DataFrame:
    """``file_id, entry_id, key, value, program`` per finding of one entry; ``program`` (program or script) of payloads."""
    name, ext = F.col("_name"), F.col("_ext")
    steps = F.split(F.replace(F.coalesce("name", F.lit("")), F.lit("\\"), F.lit("/")), "/")
    df = with_levels(entries).withColumn("_name", clean_name(F.coalesce("name", F.lit(""))))
    df = df.withColumns({"_ext": extension(name), "_steps": steps, "_outer": F.col("level") == 1})
    # inside a nested archive the first archive ends the look
    stops = df.where(~F.col("_outer") & _has(dims.ARCHIVE_EXT, ext)).groupBy("file_id", "parent_id").agg(
        F.min("entry_id").alias("_stop")
    )
    df = df.join(stops, ["file_id", "parent_id"], "left")
    outer, named = F.col("_outer"), name != ""
    tar = F.coalesce(F.col("kind") == "tar", F.lit(False))
    climbs = F.array_contains("_steps", "..") | (tar & F.coalesce(F.col("name").rlike(r"^[/\\]"), F.lit(False)))
    payload = _has([e for e in dims.DANGEROUS_EXT if e not in dims.ARCHIVE_EXT], ext)
    depth = F.size("_steps").cast("string")
    seen = ~outer & (F.col("_stop").isNull() | (F.col("entry_id") <= F.col("_stop")))
    nested = _has(dims.ARCHIVE_EXT, ext)
    runs = F.when(_has(dims.EXECUTABLE_EXT, ext), "EXECUTABLE_ATTACHMENT").otherwise("SCRIPT_ATTACHMENT")
    shown = F.when(named, name).otherwise(F.when(tar, F.col("name")).otherwise(""))
    found = [
        (outer & climbs, "archive_path_traversal", shown, None),
        (outer & F.coalesce("encrypted", F.lit(False)), "archive_encrypted_entry", name, None),
        (outer & (F.size("_steps") > 5), "archive_depth_anomaly", F.concat(F.lit("depth="), depth), None),
        (outer & named & double_extension(name), "archive_contained_double_extension", name, None),
        (outer & named & payload, "archive_contained_payload", F.concat(name, F.lit(" (."), ext, F.lit(")")), runs),
        (outer & named & nested, "nested_archive", name, None),
        (seen & nested, "archive_depth_anomaly",
         F.concat(F.lit("nested_level_"), F.col("level").cast("string"), F.lit(" ("), name, F.lit(")")), None),
        (seen & ~nested & _has(dims.DANGEROUS_EXT, ext), "nested_archive_payload", name, runs),
        (F.col("level").isNull(), "archive_depth_anomaly", F.lit("nested_in_itself"), None),
    ]
    none = F.lit(None).cast("string")
    items = F.array_compact(F.array(*[
        F.when(F.coalesce(cond, F.lit(False)), F.struct(
            F.lit(key).alias("key"), value.alias("value"), (none if kind is None else kind).alias("program")
        )) for cond, key, value, kind in found
    ]))
    return df.select("file_id", "entry_id", F.explode(items).alias("x")).select("file_id", "entry_id", "x.*")


def _whole(entries: DataFrame, max_entries: int | None) -> DataFrame:
    """Findings of whole archives, from sums over their outer entries."""
    name = clean_name(F.coalesce("name", F.lit("")))
    is_file = ~F.coalesce("is_dir", F.lit(False)) & (name != "")
    sums = entries.where("parent_id IS NULL").groupBy("file_id").agg(
        F.max(F.coalesce(F.col("kind") == "tar", F.lit(False))).alias("tar"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce("size", F.lit(0))).alias("total"),
        F.sum(F.coalesce("packed", F.lit(0))).alias("packed"),
        F.count_if(is_file).alias("files"),
        F.min(F.when(is_file, F.struct("entry_id", name.alias("name"))))["name"].alias("only"),
    )
    ratio = F.when(F.col("total") > 0, F.col("total") / F.greatest("packed", F.lit(1))).otherwise(1.0)
    huge = F.col("total") > dims.MAX_UNPACKED_BYTES
    bomb = huge | ((F.col("total") > 1_000_000) & (ratio > dims.MAX_EXPANSION_RATIO))
    over = F.lit(False) if max_entries is None else F.col("tar") & (F.col("n") > max_entries)
    dropper = (F.col("files") == 1) & _has(dims.DANGEROUS_EXT, extension(F.col("only"))) & ~over
    total = F.col("total").cast("string")
    items = [
        (F.when(F.col("tar"), huge).otherwise(bomb), "archive_expansion_anomaly",
         F.when(F.col("tar"), F.concat(F.lit("uncompressed="), total, F.lit("B"))).otherwise(
             F.concat(F.lit("ratio="), F.format_string("%.1f", ratio), F.lit(":1, uncompressed="), total, F.lit("B")))),
        (dropper, "archive_single_payload_dropper", F.col("only")),
        (over, "archive_entry_limit_exceeded", F.lit(f"entries_exceeded>{max_entries}")),
    ]
    found = F.array_compact(F.array(*[
        F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(key).alias("key"), value.alias("value"))) for cond, key, value in items
    ]))
    return sums.select("file_id", F.explode(found).alias("x")).select(
        "file_id", F.lit(None).cast(entries.schema["entry_id"].dataType).alias("entry_id"), "x.*",
        F.lit(None).cast("string").alias("program"),
    )


def archive_findings(entries: DataFrame, max_entries: int | None = None) -> DataFrame:
    """``file_id, key, count, value, flags``: every kind of finding once per file, with its first value.

    ``max_entries`` reports tar archives of more entries; by default none are.
    """
    every = entry_findings(entries).unionByName(_whole(entries, max_entries))
    grouped = every.groupBy("file_id", "key").agg(
        F.count(F.lit(1)).alias("count"),
        F.min(F.struct("entry_id", "value"))["value"].alias("value"),
        F.array_compact(F.array(
            F.max(F.when(F.col("program") == "EXECUTABLE_ATTACHMENT", F.col("program"))),
            F.max(F.when(F.col("program") == "SCRIPT_ATTACHMENT", F.col("program"))),
        )).alias("_runs"),
    )
    base = F.element_at(F.create_map(*[x for k, f in FLAGS.items() for x in (F.lit(k), words(f))]), F.col("key"))
    return grouped.select("file_id", "key", "count", "value", F.array_sort(F.concat(base, "_runs")).alias("flags"))


def archive_verdicts(entries: DataFrame, max_entries: int | None = None) -> DataFrame:
    """``file_id, entries, flags, score``: one row per archive, clean ones too; at most one entry per finding is gathered."""
    found = archive_findings(entries, max_entries).groupBy("file_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("flags")
    )
    none = F.array().cast("array<string>")
    files = entries.groupBy("file_id").agg(F.count(F.lit(1)).alias("entries"))
    out = files.join(found, "file_id", "left").withColumn("flags", F.coalesce("flags", none))
    weight = F.aggregate(
        "flags", F.lit(0.0), lambda acc, f: acc + lookup(f, dims.ATTACHMENT_WEIGHTS, dims.DEFAULT_ATTACHMENT_WEIGHT)
    )
    return out.withColumn("score", F.least(weight, F.lit(dims.ATTACHMENT_SCORE_CAP)))
