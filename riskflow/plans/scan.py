"""The full scan: normalize, score with every engine, fuse, classify, explain."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow import dims
from riskflow.functions.columns import engine_result, error_result, filled, skipped_result
from riskflow.functions.urls import normalize_url
from riskflow.functions.text import normalize_text
from riskflow.operators.attachment_rules import (
    attachment_result,
    pick_attachment,
    with_attachment_signals,
)
from riskflow.operators.explain import explain
from riskflow.operators.file_signals import (
    apply_extension_mismatch,
    malware_result,
    with_file_report,
)
from riskflow.operators.fusion import default_profiles, fuse, with_class
from riskflow.operators.header_signals import header_result, with_header_signals, with_headers
from riskflow.operators.indicators import with_allow_list, with_feed_hit, with_hash_hit
from riskflow.operators.redirects import resolve_redirects
from riskflow.operators.sender_rules import (
    SenderState,
    sender_result,
    sender_state,
    with_sender_history,
    with_sender_signals,
)
from riskflow.operators.text_signals import text_result, with_text_signals
from riskflow.operators.url_signals import (
    url_result,
    with_domain_age,
    with_reputation,
    with_url_signals,
)
from riskflow.operators.visual_rules import visual_backfill, with_visual_signals
from riskflow.session import cut
from riskflow.sources.feeds import Indicators
from riskflow.sources.scans import complete_scans, preprocess, profile_name

Engine = Callable[[DataFrame], tuple[DataFrame, Column]]


# ------------------------------------------------------------------ built-in engines
def _url_engine(tables: Indicators, reputation=None, registrations=None, suffixes=None, as_of=None):
    def run(df: DataFrame):
        df = with_url_signals(df)
        df = with_feed_hit(df, tables.urls)
        df = with_allow_list(df, tables.allow)
        df = with_reputation(df, reputation)
        if registrations is not None and suffixes is not None:
            df = with_domain_age(df, registrations, suffixes, as_of)
        return df, url_result(df)

    return run


def _text_engine(df: DataFrame):
    return with_text_signals(df), text_result()


def _header_engine(df: DataFrame):
    return with_header_signals(with_headers(df)), header_result()


def _attachment_engine(df: DataFrame):
    return with_attachment_signals(pick_attachment(df)), attachment_result()


def _malware_engine(tables: Indicators, reports=None):
    def run(df: DataFrame):
        df = with_file_report(with_hash_hit(df, tables.hashes), reports)
        return df, malware_result(reports is not None)

    return run


def _message_time() -> Column:
    return F.coalesce((F.col("meta_ts") * 1_000_000).cast("bigint"), F.unix_micros("ts"))


def _messages(df: DataFrame, compat: bool) -> DataFrame:
    """Narrow copy of the rows that have a sender and a time, in order of arrival."""
    time = _message_time()
    raw = F.col("sender_id") if compat else F.col("sender_raw")
    return _in_order(df.where(filled(F.col("sender_id")) & time.isNotNull()).select(
        "_row",
        "arrival_seq",
        "client_id",
        raw.alias("sender_raw"),
        "sender_domain",
        time.alias("t_us"),
        filled(F.col("url")).alias("has_link"),
        (
            filled(F.col("file_name"))
            | F.coalesce(F.octet_length("file_bytes") > 0, F.lit(False))
        ).alias("has_file"),
    ))


def _sender_engine(compat: bool, senders: SenderState | None = None):
    def run(df: DataFrame):
        # only features come back
        scored = with_sender_signals(with_sender_history(_messages(df, compat), state=senders)).select(
            "_row", "sender_flags", "sender_score", "sender_confidence", "sender_evidence",
            "prior_count",
        )
        untimed = skipped_result(dims.SENDER_ENGINE, "No message time provided")
        result = F.when(
            filled(F.col("sender_id")) & _message_time().isNull(), untimed
        ).otherwise(sender_result())
        return df.join(cut(scored), "_row", "left"), result

    return run


def _numbered(scans: DataFrame, as_of: str | None, bounds: dict[str, int]) -> DataFrame:
    """Prepared requests with ``_row``; written once, since several steps read the same rows."""
    rows = complete_scans(scans)
    if as_of is not None:
        rows = rows.withColumn("ts", F.coalesce("ts", F.lit(as_of).cast("timestamp")))
    return cut(preprocess(rows, **bounds).withColumn("_row", F.monotonically_increasing_id()))


def senders_after(
    scans: DataFrame,
    senders: SenderState | None = None,
    as_of: str | None = None,
    strict_compat: bool = False,
    **bounds: int,
) -> SenderState:
    """Sender state after the requests that :func:`scan` accepts, on top of an earlier one."""
    rows = _numbered(scans, as_of, bounds).where("prep_status != 'rejected'")
    return sender_state(_messages(rows, strict_compat), senders)


def _in_order(messages: DataFrame) -> DataFrame:
    """Messages in order of arrival, renumbered: no number is missing, repeated or far from the next.

    Rows without ``arrival_seq`` come last, by time.
    """
    order = [F.col("arrival_seq").asc_nulls_last(), F.col("t_us"), F.col("_row")]
    placed = cut(messages.repartitionByRange(*order).sortWithinPartitions(*order))
    return placed.withColumn("arrival_seq", F.monotonically_increasing_id())


def python_engine(name: str, score: Callable[[dict], dict], columns: list[str]) -> Engine:
    """Engine from a Python function of one row.

    ``score`` gets the named columns and returns ``risk_score``, ``confidence`` and
    ``flags``. A row that raises becomes an error result and leaves the others alone.
    """
    kind = "struct<risk_score:double,confidence:double,flags:array<string>,error:string>"

    def run(df: DataFrame):
        @F.pandas_udf(kind)
        def score_rows(rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            for row in rows.to_dict("records"):
                try:
                    out.append({"flags": [], **score(row), "error": None})
                except Exception as exc:  # noqa: BLE001 - one bad row must not end the job
                    message = f"Unhandled exception: {type(exc).__name__}: {exc}"
                    out.append({"risk_score": 0.0, "confidence": 0.0, "flags": [], "error": message})
            return pd.DataFrame(out, columns=["risk_score", "confidence", "flags", "error"])

        own = f"_py_{name}"
        df = df.withColumn(own, score_rows(F.struct(*columns)))
        found = F.col(own)
        good = engine_result(name, found["risk_score"], found["confidence"], found["flags"])
        return df, F.when(found["error"].isNull(), good).otherwise(
            error_result(name, found["error"])
        )

    return run


class EngineRegistry:
    """Named engines: functions from rows to (rows with features, result Column)."""

    def __init__(self) -> None:
        self._engines: dict[str, Engine] = {}

    def register(self, name: str, engine: Engine) -> None:
        if name in self._engines:
            raise ValueError(f"engine '{name}' is already registered")
        self._engines[name] = engine

    def unregister(self, name: str) -> None:
        self._engines.pop(name, None)

    def get(self, name: str) -> Engine | None:
        return self._engines.get(name)

    def names(self) -> list[str]:
        return sorted(self._engines)

    def __len__(self) -> int:
        return len(self._engines)

    def run_all(self, df: DataFrame, exclude: Iterable[str] = ()) -> tuple[DataFrame, Column]:
        """Rows with all features and the array of results, sorted by engine name."""
        skip = set(exclude)
        results = []
        for name in self.names():
            if name in skip:
                continue
            df, result = self._engines[name](df)
            df = df.withColumn(f"_result_{name}", result)
            results.append(F.col(f"_result_{name}"))
        return df, F.array(*results)


def default_registry(
    tables: Indicators,
    reputation: DataFrame | None = None,
    registrations: DataFrame | None = None,
    suffixes: DataFrame | None = None,
    as_of: str | None = None,
    reports: DataFrame | None = None,
    strict_compat: bool = False,
    senders: SenderState | None = None,
) -> EngineRegistry:
    """The built-in engines. ``strict_compat`` drops display names before sender rules;
    ``senders`` is what earlier messages left."""
    registry = EngineRegistry()
    registry.register(
        dims.URL_ENGINE, _url_engine(tables, reputation, registrations, suffixes, as_of)
    )
    registry.register(dims.TEXT_ENGINE, _text_engine)
    registry.register(dims.HEADER_ENGINE, _header_engine)
    registry.register(dims.ATTACHMENT_ENGINE, _attachment_engine)
    registry.register(dims.MALWARE_ENGINE, _malware_engine(tables, reports))
    registry.register(dims.SENDER_ENGINE, _sender_engine(strict_compat, senders))
    return registry


def scan(
    scans: DataFrame,
    tables: Indicators,
    registry: EngineRegistry | None = None,
    profiles: DataFrame | None = None,
    images: DataFrame | None = None,
    redirects: DataFrame | None = None,
    exclude: Iterable[str] = (),
    as_of: str | None = None,
    senders: SenderState | None = None,
    **bounds: int,
) -> tuple[DataFrame, DataFrame]:
    """(verdicts, rejected rows).

    A verdict row carries ``results`` and the assessment columns of its scan. The
    sender engine is the only part that shuffles scan rows; everything else is one
    projection around look-up joins. ``as_of`` is the time of requests that carry none;
    without it their sender rules are skipped. Every row that is not rejected gets one
    verdict, also where ids repeat. ``senders``: state of the senders before these scans, which
    :func:`senders_after` gives. ``bounds`` are those of :func:`preprocess`.
    """
    prepared = _numbered(scans, as_of, bounds)
    rejected = prepared.where("prep_status = 'rejected'").drop("_row")
    df = prepared.where("prep_status != 'rejected'")

    with_images = dims.VISUAL_ENGINE not in set(exclude)
    if with_images:
        df = _with_images(df, images)
    if redirects is not None:
        df = resolve_redirects(df, redirects).withColumn("url", F.col("final_url")).drop(
            "final_url"
        )
    registry = registry or default_registry(tables, senders=senders)
    df, results = registry.run_all(df, exclude)
    if with_images:
        results = F.concat(F.array("visual_result"), results)
    df = df.withColumn("results", results)
    df = df.withColumn(
        "results", apply_extension_mismatch(F.col("results"), F.col("extension_mismatch"))
    )
    df = fuse(df)
    profiles = profiles if profiles is not None else default_profiles(df.sparkSession)
    df = explain(with_class(df, profiles, profile_name(df), F.col("malware_signal")))
    return df.select(
        "scan_id", "ts", "arrival_seq", "client_id", "source_channel", "text", "url",
        F.lit("completed").alias("status"), "prep_status", "prep_warnings", "results",
        "total_engines", "completed_engines", "skipped_engines", "risk_score", "classification",
        "confidence", "contributing_engines", "ignored_engines", "flags", "evidence", "reasons",
        "recommended_action", "warnings",
    ), rejected


def _with_images(df: DataFrame, images: DataFrame | None) -> DataFrame:
    df = df.withColumn(
        "has_image", F.coalesce(F.octet_length("image_bytes") > 0, F.lit(False))
    )
    if images is None:
        nothing = {
            "qr_text": "string", "ocr": "array<struct<text:string,conf:double>>",
            "input_fields": "int", "decode_ok": "boolean", "ocr_ok": "boolean",
        }
        df = df.withColumns({n: F.lit(None).cast(t) for n, t in nothing.items()})
    else:
        df = df.join(images, "scan_id", "left")
    df = with_visual_signals(df)
    df = df.withColumn("_img_text", normalize_text(F.col("extracted_text")))
    df = normalize_url(df, "extracted_url", "_img_url")
    return df.withColumns(
        {
            "text": visual_backfill(F.col("text"), F.col("_img_text.text")),
            "url": visual_backfill(F.col("url"), F.col("_img_url")),
        }
    ).drop("_img_text", "_img_url", "_img_url_warnings", "_img_url_error")
