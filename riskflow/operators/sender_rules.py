"""Sender-behaviour rules over a message table, in arrival order.

Expected columns: ``client_id``, ``sender_raw``, ``sender_domain`` (may be null),
``t_us`` (event time in microseconds), ``arrival_seq`` (unique, increasing),
``has_link`` and ``has_file``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow import dims
from riskflow.functions.columns import (
    engine_result,
    evidence_list,
    filled,
    flag_list,
    skipped_result,
)
from riskflow.operators.anchors import SLICE_US, with_anchor
from riskflow.operators.running import CHUNK_ROWS, with_running
from riskflow.session import cut

KEYS = ["client_id", "profile_key"]
NAME_KEYS = ["client_id", "display_name"]
HOUR_US = 3_600_000_000


def parse_sender(df: DataFrame) -> DataFrame:
    """Add ``profile_key``, ``email``, ``display_name``, ``domain``; default the client."""
    raw = F.col("sender_raw")
    inner = F.regexp_extract(raw, r"(?s)^(.*?)<([^>]+)>", 2)
    named = inner != ""
    email = F.lower(F.trim(F.when(named, inner).otherwise(raw)))
    name = F.lower(
        F.regexp_replace(
            F.regexp_extract(raw, r"(?s)^(.*?)<([^>]+)>", 1), "^[ \\t\"']+|[ \\t\"']+$", ""
        )
    )
    client = F.trim("client_id")
    df = df.withColumns(
        {
            "email": F.coalesce(email, F.lit("")),
            "display_name": F.coalesce(F.when(named, name), F.lit("")),
            "client_id": F.when(filled(client), client).otherwise("anonymous"),
        }
    )
    from_mail = F.when(F.col("email").contains("@"), F.substring_index("email", "@", -1))
    return df.withColumns(
        {
            "profile_key": F.when(F.col("email") != "", F.col("email")).otherwise(raw),
            "domain": F.coalesce(F.nullif("sender_domain", F.lit("")), from_mail, F.lit("")),
        }
    )


@dataclass(frozen=True)
class SenderState:
    """What earlier messages left: :func:`sender_snapshot` and :func:`name_snapshot`."""

    profiles: DataFrame
    names: DataFrame


def hour_mask(profiles: DataFrame) -> Column:
    """Bit per hour of day with messages, from ``hours`` or the keys of ``time_buckets``."""
    if "hours" in profiles.columns:
        return F.col("hours")
    return F.expr(
        "aggregate(map_keys(time_buckets), 0L, (bits, hour) -> bits | shiftleft(1L, cast(hour AS INT)))"
    )


def _with_profiles(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """Add the stored profile to the running values; stored messages are before all rows of ``df``."""
    old = profiles.select(
        *KEYS, F.col("message_count").alias("_o_count"), F.col("last_seen_us").alias("_o_last"),
        F.col("link_count").alias("_o_links"), F.col("file_count").alias("_o_files"),
        F.col("last_domain").alias("_o_domain"), hour_mask(profiles).alias("_o_hours"),
    )
    zero = F.lit(0).cast("bigint")

    def merged(new: str, stored: str, both) -> Column:
        a, b = F.coalesce(new, zero), F.coalesce(stored, zero)
        return F.when(F.col(new).isNotNull() | F.col(stored).isNotNull(), both(a, b))

    return df.join(old, KEYS, "left").withColumns({
        "prior_count": F.col("prior_count") + F.coalesce("_o_count", zero),
        "prior_last_us": F.greatest("prior_last_us", "_o_last"),
        "prior_links": merged("prior_links", "_o_links", lambda a, b: a + b),
        "prior_files": merged("prior_files", "_o_files", lambda a, b: a + b),
        "prior_domain": F.coalesce("prior_domain", "_o_domain"),
        "prior_hours": merged("prior_hours", "_o_hours", lambda a, b: a.bitwiseOR(b)),
    }).select(*df.columns)


def with_sender_history(
    df: DataFrame,
    chunk_rows: int = CHUNK_ROWS,
    slice_us: int = SLICE_US,
    state: SenderState | None = None,
) -> DataFrame:
    """Parsed rows with what was known about the sender before each message.

    Adds ``prior_count``, ``prior_last_us``, ``prior_links``, ``prior_files``,
    ``prior_domain``, ``prior_hours`` (bit per hour of day), ``hour``,
    ``recent_count`` (messages in the anchored hour, this one included),
    ``recent_start_us`` and ``name_domain`` (domain first tied to the display name).
    ``state`` is what messages before all of these left; it is joined by key, never collected.
    """
    df = parse_sender(df).withColumn(
        "hour", F.pmod(F.floor(F.col("t_us") / F.lit(HOUR_US)), F.lit(24)).cast("int")
    )
    df = with_running(
        df,
        KEYS,
        "arrival_seq",
        {
            "prior_count": ("count", F.lit(1)),
            "prior_last_us": ("max", F.col("t_us")),
            "prior_links": ("sum", F.col("has_link").cast("bigint")),
            "prior_files": ("sum", F.col("has_file").cast("bigint")),
            "prior_domain": ("last", F.col("domain")),
            "prior_hours": ("bit_or", F.expr("shiftleft(1L, hour)")),
        },
        chunk_rows,
    )
    start = None
    if state is not None:
        df = _with_profiles(df, state.profiles)
        start = state.profiles.select(
            *KEYS, F.col("recent_window_start_us").alias("anchor"), F.col("recent_count").alias("rows")
        )
    # late rows never restart the hour, so the running maximum decides as well
    df = df.withColumn("_clock", F.greatest("prior_last_us", "t_us"))
    # each step below reads its input twice, so the narrow rows are written once
    df = with_anchor(
        cut(df), KEYS, "_clock", ["arrival_seq"], HOUR_US, strict=True, slice_us=slice_us,
        start=start,
    )
    df = df.withColumn(
        "recent_start_us", F.when(F.col("is_anchor"), F.col("_clock")).otherwise(
            F.col("anchor_before"))
    ).withColumnRenamed("since_anchor", "recent_count").drop(
        "_clock", "anchor_before", "is_anchor"
    )
    df = with_running(
        cut(df),
        NAME_KEYS,
        "arrival_seq",
        {
            "name_domain": (
                "first",
                F.when(F.col("display_name") != "", F.nullif("domain", F.lit(""))),
            )
        },
        chunk_rows,
    )
    if state is None:
        return df
    known = state.names.select(*NAME_KEYS, F.nullif("last_domain", F.lit("")).alias("_o_name"))
    return df.join(known, NAME_KEYS, "left").withColumn(
        "name_domain", F.coalesce("_o_name", "name_domain")
    ).select(*df.columns)


def with_sender_signals(df: DataFrame) -> DataFrame:
    """Add ``sender_flags``, ``sender_score`` (0-100), ``sender_confidence``, evidence."""
    # a value that is null before the first message counts as "rule not met"
    rules = {
        "_s_new": "prior_count = 0",
        "_s_rapid": "prior_last_us > 0 AND _s_gap < 60",
        "_s_often": "prior_count > 5 AND recent_count > 10",
        "_s_hour": "prior_count > 5 AND (shiftright(prior_hours, hour) & 1L) = 0L",
        "_s_moved": "prior_domain <> '' AND domain <> '' AND prior_domain <> domain",
        "_s_link": "has_link AND prior_links = 0 AND prior_count > 3",
        "_s_file": "has_file AND prior_files = 0 AND prior_count > 3",
        "_s_name": "display_name <> '' AND domain <> '' AND name_domain <> domain",
    }
    df = df.withColumn("_s_gap", F.expr("(t_us - prior_last_us) / 1000000.0D"))
    df = df.withColumns({k: F.expr(f"coalesce({v}, false)") for k, v in rules.items()})
    drift = "_s_name AND NOT _s_moved"
    points = [
        ("_s_new", 0.2), ("_s_rapid", 0.3), ("_s_often", 0.2), ("_s_hour", 0.2),
        ("_s_moved", 0.4), ("_s_link", 0.3), ("_s_file", 0.3), (drift, 0.4),
    ]
    total = F.expr(" + ".join(f"if({c}, {n}D, 0.0D)" for c, n in points))
    out = df.withColumns(
        {
            "sender_flags": F.array_compact(
                F.array_distinct(
                    F.concat(
                        flag_list(
                            {
                                "new_sender": "_s_new",
                                "rapid_sender_activity": "_s_rapid",
                                "unusual_frequency": "_s_often",
                                "unusual_time": "_s_hour",
                                "sender_change": "_s_moved",
                                "out_of_character_link": "_s_link",
                                "out_of_character_file": "_s_file",
                            }
                        ),
                        flag_list({"sender_change": drift}),
                    )
                )
            ),
            "sender_score": F.least(total, F.lit(1.0)) * 100.0,
            "sender_confidence": F.expr("if(_s_new, 0.5D, 0.8D)"),
            "sender_evidence": evidence_list(
                [
                    ("new_sender", "true", "Sender has not been observed before", "_s_new"),
                    ("rapid_sender_activity", "_s_gap",
                     "Message received {format_string('%.1f', _s_gap)}s after previous", "_s_rapid"),
                    ("unusual_sender_frequency", "recent_count",
                     "Unusually high message volume recently", "_s_often"),
                    ("unusual_sender_time", "hour",
                     "Message arrived at an unusual hour for this sender", "_s_hour"),
                    ("sender_domain_change", "domain",
                     "Sender domain changed from {prior_domain} to {domain}", "_s_moved"),
                    ("sender_domain_change", "domain",
                     "Sender domain changed from {name_domain} to {domain}", drift),
                ]
            ),
        }
    )
    return out.drop("_s_gap", *rules)


def sender_result() -> Column:
    result = engine_result(
        dims.SENDER_ENGINE,
        F.col("sender_score"),
        F.col("sender_confidence"),
        F.col("sender_flags"),
        F.col("sender_evidence"),
        metadata=F.create_map(
            F.lit("previous_history_found"), (F.col("prior_count") > 0).cast("string")
        ),
    )
    return F.when(F.col("sender_flags").isNotNull(), result).otherwise(
        skipped_result(dims.SENDER_ENGINE, "No sender_id provided")
    )


def sender_snapshot(
    df: DataFrame,
    chunk_rows: int = CHUNK_ROWS,
    slice_us: int = SLICE_US,
    state: SenderState | None = None,
) -> DataFrame:
    """One profile row per (client, sender) after all messages, on top of a stored ``state``."""
    rows = with_sender_history(df, chunk_rows, slice_us, state)
    # partial aggregation by hour first: 24 rows at most per sender go on
    hourly = rows.groupBy(*KEYS, "hour").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("has_link").cast("bigint")).alias("links"),
        F.sum(F.col("has_file").cast("bigint")).alias("files"),
        F.max("t_us").alias("last_us"),
        F.min(F.struct("arrival_seq", "t_us")).alias("first_row"),
        F.max(F.struct("arrival_seq", "domain", "recent_count", "recent_start_us")).alias("tail"),
    )
    new = hourly.groupBy(*KEYS).agg(
        F.sum("n").alias("message_count"),
        F.sum("links").alias("link_count"),
        F.sum("files").alias("file_count"),
        F.min("first_row")["t_us"].alias("first_seen_us"),
        F.max("last_us").alias("last_seen_us"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct(F.col("hour").cast("string"), F.col("n"))))
        ).alias("time_buckets"),
        F.max("tail")["domain"].alias("last_domain"),
        F.max("tail")["recent_count"].alias("recent_count"),
        F.max("tail")["recent_start_us"].alias("recent_window_start_us"),
    )
    if state is None:
        return new
    zero, none = F.lit(0).cast("bigint"), F.expr("map_from_arrays(array(), array())")
    bucket = lambda side: F.coalesce(F.col(f"{side}.time_buckets"), none.cast("map<string,bigint>"))
    both = lambda c: F.coalesce(F.col(f"new.{c}"), zero) + F.coalesce(F.col(f"old.{c}"), zero)
    later = lambda c: F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).alias(c)
    return new.alias("new").join(state.profiles.alias("old"), KEYS, "full").select(
        *KEYS,
        *(both(c).alias(c) for c in ("message_count", "link_count", "file_count")),
        F.coalesce("old.first_seen_us", "new.first_seen_us").alias("first_seen_us"),
        F.greatest("old.last_seen_us", "new.last_seen_us").alias("last_seen_us"),
        F.map_zip_with(
            bucket("old"), bucket("new"), lambda k, a, b: F.coalesce(a, zero) + F.coalesce(b, zero)
        ).alias("time_buckets"),
        *map(later, ("last_domain", "recent_count", "recent_window_start_us")),
    )


def name_snapshot(df: DataFrame, state: SenderState | None = None) -> DataFrame:
    """One row per (client, display name): established domain, last mail, count."""
    rows = parse_sender(df).where("display_name <> ''")
    named = F.when(F.col("domain") != "", F.struct("arrival_seq", "domain"))
    new = rows.groupBy(*NAME_KEYS).agg(
        F.coalesce(F.min(named)["domain"], F.lit("")).alias("last_domain"),
        F.max(F.struct("arrival_seq", "email"))["email"].alias("last_email"),
        F.max("t_us").alias("last_seen_us"),
        F.count(F.lit(1)).alias("count"),
    )
    if state is None:
        return new
    zero, blank = F.lit(0).cast("bigint"), F.lit("")
    return new.alias("new").join(state.names.alias("old"), NAME_KEYS, "full").select(
        *NAME_KEYS,
        F.coalesce(F.nullif("old.last_domain", blank), "new.last_domain", blank).alias("last_domain"),
        F.coalesce("new.last_email", "old.last_email").alias("last_email"),
        F.greatest("old.last_seen_us", "new.last_seen_us").alias("last_seen_us"),
        (F.coalesce("new.count", zero) + F.coalesce("old.count", zero)).alias("count"),
    )


def sender_state(df: DataFrame, state: SenderState | None = None, **sizes: int) -> SenderState:
    """State after the messages ``df``, on top of an earlier one."""
    return SenderState(sender_snapshot(df, **sizes, state=state), name_snapshot(df, state))


def evict_oldest(
    profiles: DataFrame,
    keys: list[str],
    last_seen: str = "last_seen_us",
    limit: int | None = None,
    drop: int = 500,
    unseen_since_us: int | None = None,
) -> DataFrame:
    """Profiles without those unseen for long; a maintenance step that takes no part in scoring.

    ``unseen_since_us`` keeps the profiles seen at that time or later. ``limit`` is the size rule of a
    service with little memory: over so many rows, the ``drop`` longest unseen go, ties by key.
    Without either all stay.
    """
    if unseen_since_us is not None:
        profiles = profiles.where(F.col(last_seen) >= unseen_since_us)
    if limit is None:
        return profiles
    oldest = profiles.select(*keys, last_seen).orderBy(last_seen, *keys).limit(drop)
    # the size is found inside the plan, so no job runs while planning
    size = profiles.agg(F.count(F.lit(1)))
    return profiles.join(oldest.where(size.scalar() > limit).select(*keys), keys, "left_anti")
