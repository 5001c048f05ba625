"""Message-text rules: five phrase categories with the one-time-code exemption."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow import dims
from riskflow.functions.columns import (
    engine_result,
    evidence,
    filled,
    flag,
    keep,
    no_flags,
    skipped_result,
    text_of,
)


def with_text_signals(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``text_score`` (0-100), ``text_flags``, ``text_phrases`` and ``text_evidence``."""
    low = F.col("_tx_low")
    df = df.withColumn("_tx_low", F.lower(F.col(text)))

    def found(category: str) -> Column:
        stems = F.expr(
            " OR ".join(
                "(" + " AND ".join(f"contains(_tx_low, '{s}')" for s in parts) + ")"
                for parts in dims.TEXT_STEMS[category]
            )
        )
        hits = F.concat(
            *[
                F.regexp_extract_all(low, F.lit("(?U)" + p), 1)
                for p in dims.TEXT_CATEGORIES[category]
            ]
        )
        return F.when(stems, hits).otherwise(no_flags())

    df = df.withColumns({f"_tx_{c}": found(c) for c in dims.TEXT_CATEGORIES})
    # a safety notice ("never share your otp") is no request for the code
    secrets = F.col("_tx_credential_request")
    notice = F.when(F.size(secrets) > 0, low.rlike("(?U)" + dims.OTP_DISCLAIMER))
    has = lambda m, words: reduce(or_, [m.contains(w) for w in words])
    warning_only = F.filter(
        secrets, lambda m: ~(has(m, dims.OTP_WORDS) & has(m, dims.OTP_VERBS))
    )
    df = df.withColumn(
        "_tx_credential_request", F.when(notice, warning_only).otherwise(secrets)
    )
    df = df.withColumns(
        {
            f"_tx_{c}": F.array_sort(F.array_distinct(F.col(f"_tx_{c}")))
            for c in dims.TEXT_CATEGORIES
        }
    )
    hits = {c: F.col(f"_tx_{c}") for c in dims.TEXT_CATEGORIES}
    hit = {c: F.coalesce(F.size(m) > 0, F.lit(False)) for c, m in hits.items()}
    total = reduce(lambda a, b: a + b, [h.cast("int") for h in hit.values()])
    # 0.35 added once per category, as a repeated sum
    steps = [0.0, 0.35, 0.35 + 0.35, 1.0, 1.0, 1.0]
    score = F.element_at(F.array(*[F.lit(s * 100.0) for s in steps]), total + 1)
    df = df.withColumns(
        {
            "text_score": score,
            "text_flags": F.array_sort(keep(*[flag(f"nlp_{c}", h) for c, h in hit.items()])),
            "text_phrases": F.array_sort(F.array_distinct(F.concat(*hits.values()))),
            "text_evidence": keep(
                *[
                    evidence(
                        c,
                        F.to_json(hits[c]),
                        text_of(c.replace("_", "-"), " language was detected."),
                        hit[c],
                    )
                    for c in hits
                ]
            ),
        }
    )
    return df.drop("_tx_low", *[f"_tx_{c}" for c in hits])


def text_result(text: str = "text") -> Column:
    result = engine_result(
        dims.TEXT_ENGINE,
        F.col("text_score"),
        0.65,
        F.col("text_flags"),
        F.col("text_evidence"),
        metadata=F.create_map(F.lit("triggered_phrases"), F.to_json("text_phrases")),
    )
    return F.when(filled(F.col(text)), result).otherwise(
        skipped_result(dims.TEXT_ENGINE, "No text provided")
    )
