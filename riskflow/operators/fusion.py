"""Fusion of per-engine results into one assessment per scan, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow import dims
from riskflow.functions.columns import lookup, words
from riskflow.operators.joins import dim_join
from riskflow.schemas import PROFILES


def _reliability(name: Column) -> Column:
    return lookup(name, dims.RELIABILITY, dims.DEFAULT_RELIABILITY)


def _usable(r: Column) -> Column:
    return r["status"].isin("success", "partial") & (r["confidence"] > 0.0)


def _factor(r: Column) -> Column:
    return _reliability(r["engine_name"]) * F.when(r["status"] == "partial", 0.5).otherwise(1.0)


def _malware_signal(r: Column) -> Column:
    flagged = F.arrays_overlap(r["flags"], words(dims.MALWARE_FLAGS))
    strong = (r["engine_name"] == dims.MALWARE_ENGINE) & (r["risk_score"] >= 90.0)
    return (r["confidence"] >= 0.5) & (strong | F.coalesce(flagged, F.lit(False)))


def _warning(r: Column) -> Column:
    malware = r["engine_name"] == dims.MALWARE_ENGINE
    message = F.when(
        malware,
        F.concat(
            F.lit("malware scan unavailable: "),
            F.coalesce(F.nullif(r["error_message"], F.lit("")), F.lit("service unavailable")),
        ),
    ).when(
        F.length(r["error_message"]) > 0,
        F.concat(r["engine_name"], F.lit(" scan unavailable: "), r["error_message"]),
    )
    return F.when(r["status"] == "error", message)


def fuse(df: DataFrame, results: str = "results") -> DataFrame:
    """Add the assessment columns for an array of engine results.

    ``risk_score``, ``confidence``, ``contributing_engines``, ``ignored_engines``,
    ``flags``, ``evidence``, ``warnings``, ``malware_signal`` and the engine counts.
    The order of the input array does not matter.
    """
    by_name = lambda a, b: (
        F.when(a["engine_name"] < b["engine_name"], -1)
        .when(a["engine_name"] > b["engine_name"], 1)
        .otherwise(0)
    )
    df = df.withColumn("_fz_all", F.array_sort(F.col(results), by_name))
    df = df.withColumn("_fz_use", F.filter("_fz_all", _usable))
    add = lambda value: F.aggregate(
        "_fz_use", F.lit(0.0), lambda acc, r: acc + value(r)
    )
    df = df.withColumns(
        {
            "_fz_sw": add(lambda r: r["risk_score"] * (r["confidence"] * _factor(r))),
            "_fz_w": add(lambda r: r["confidence"] * _factor(r)),
            "_fz_rel": add(_factor),
        }
    )
    names = lambda part: F.transform(part, lambda r: r["engine_name"])
    status = lambda s: F.size(F.filter("_fz_all", lambda r: r["status"] == s))
    return df.withColumns(
        {
            "risk_score": F.when(
                F.col("_fz_w") != 0, F.round(F.col("_fz_sw") / F.col("_fz_w"), 2)
            ).otherwise(F.lit(0.0)),
            "confidence": F.when(
                F.col("_fz_rel") != 0,
                F.round(F.least(F.lit(1.0), F.col("_fz_w") / F.col("_fz_rel")), 4),
            ).otherwise(F.lit(0.0)),
            "contributing_engines": names("_fz_use"),
            "ignored_engines": F.array_sort(
                F.array_distinct(names(F.filter("_fz_all", lambda r: ~_usable(r))))
            ),
            "flags": F.array_sort(
                F.array_distinct(F.flatten(F.transform("_fz_use", lambda r: r["flags"])))
            ),
            "evidence": F.flatten(F.transform("_fz_use", lambda r: r["evidence"])),
            "warnings": F.array_distinct(F.array_compact(F.transform("_fz_all", _warning))),
            "malware_signal": F.exists("_fz_use", _malware_signal),
            "total_engines": F.size("_fz_all"),
            "skipped_engines": status("skipped"),
            "completed_engines": F.size("_fz_all") - status("skipped"),
        }
    ).drop("_fz_all", "_fz_use", "_fz_sw", "_fz_w", "_fz_rel")


def fuse_long(results: DataFrame, scan_id: str = "scan_id") -> DataFrame:
    """Score and confidence from a long table, one row per (scan, engine result).

    Any engine name is welcome. Sums are combined map-side before the shuffle, so a
    scan with very many rows does not gather in one task.
    """
    r = F.struct(*[results[c] for c in results.columns])
    usable = _usable(r)
    weight = F.col("confidence") * _factor(r)
    sums = results.groupBy(scan_id).agg(
        F.sum(F.when(usable, F.col("risk_score") * weight)).alias("sw"),
        F.sum(F.when(usable, weight)).alias("w"),
        F.sum(F.when(usable, _factor(r))).alias("rel"),
        F.coalesce(F.bool_or(usable & _malware_signal(r)), F.lit(False)).alias("malware_signal"),
    )
    return sums.select(
        scan_id,
        F.coalesce(F.round(F.col("sw") / F.nullif("w", F.lit(0.0)), 2), F.lit(0.0)).alias(
            "risk_score"
        ),
        F.coalesce(
            F.round(F.least(F.lit(1.0), F.col("w") / F.nullif("rel", F.lit(0.0))), 4), F.lit(0.0)
        ).alias("confidence"),
        "malware_signal",
    )


# ------------------------------------------------------------------ classification
def default_profiles(spark) -> DataFrame:
    return spark.createDataFrame(dims.PROFILES, PROFILES)


def valid_profiles(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, rejected with ``reason``): named, bounds in 0-100 and strictly rising, one row a name.

    Of several usable rows of a name (case and blanks around it aside) the one with the least bounds is used.
    """
    bounds = ["safe_upper", "suspicious_upper", "deceptive_upper", "phishing_upper"]
    reason = F.coalesce(
        *[
            F.when(
                F.col(b).isNull() | ~F.col(b).between(0.0, 100.0),
                F.format_string(
                    f"Threshold '{b}' must be between 0.0 and 100.0, got %s",
                    F.col(b).cast("string"),
                ),
            )
            for b in bounds
        ],
        *[
            F.when(
                F.col(lo) >= F.col(hi),
                F.format_string(
                    f"Invalid threshold ordering: {lo} (%s) must be strictly less than {hi} (%s)",
                    F.col(lo).cast("string"),
                    F.col(hi).cast("string"),
                ),
            )
            for lo, hi in zip(bounds, bounds[1:])
        ],
    )
    unnamed = F.when(F.coalesce(F.trim("name"), F.lit("")) == "", F.lit("Profile has no name"))
    checked = profiles.withColumn("reason", F.coalesce(reason, unnamed))
    # one row a name, or the join would multiply scans
    first = F.row_number().over(Window.partitionBy(F.lower(F.trim("name"))).orderBy(*bounds, "name"))
    usable = checked.where("reason is null").withColumn("_first", first)
    twice = usable.where("_first > 1").withColumn("reason", F.lit("Profile name is taken"))
    return (
        usable.where("_first = 1").select(*profiles.columns),
        checked.where("reason is not null").unionByName(twice.drop("_first")),
    )


def classify(score: Column, signal: Column, profile: Column) -> Column:
    """Class of a score under a profile struct; bounds are exclusive."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
    return (
        F.when(s < profile["safe_upper"], F.lit("Safe"))
        .when(s < profile["suspicious_upper"], F.lit("Suspicious"))
        .when(s < profile["deceptive_upper"], F.lit("Deceptive"))
        .when(s < profile["phishing_upper"], F.lit("Phishing"))
        .when(profile["malware_requires_signal"] & ~signal, F.lit("Phishing"))
        .otherwise("Malware")
    )


def with_class(
    df: DataFrame,
    profiles: DataFrame,
    profile_name: Column | None = None,
    signal: Column | None = None,
) -> DataFrame:
    """Add ``classification`` under the named profile; unknown names fall to ``default``.

    Profiles that :func:`valid_profiles` rejects are never used, their names count as unknown.
    Without ``signal`` the malware flags of the row decide, which is how stored
    verdicts are classified again under another profile.
    """
    wanted = F.lower(F.trim(F.lit(None).cast("string") if profile_name is None else profile_name))
    if signal is None:
        signal = F.arrays_overlap(
            F.col("flags"), words(dims.MALWARE_FLAGS)
        )
    known = valid_profiles(profiles)[0].select(
        F.lower(F.trim("name")).alias("_pn"), F.struct(*[c for c in profiles.columns]).alias("_prof")
    )
    fields = [f.name for f in profiles.schema.fields]
    fallback = F.struct(*[F.lit(v).alias(n) for n, v in zip(fields, dims.PROFILES[0])])
    df = dim_join(df.withColumn("_want", wanted), known, F.col("_want") == F.col("_pn"))
    return df.withColumn(
        "classification", classify(F.col("risk_score"), signal, F.coalesce("_prof", fallback))
    ).drop("_want", "_pn", "_prof")
