"""Image rules over already extracted content (QR payload, OCR lines, input boxes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow import dims
from riskflow.functions.columns import (
    contains_any,
    engine_result,
    error_result,
    evidence,
    filled,
    flag,
    keep,
    skipped_result,
    text_of,
)
from riskflow.functions.urls import first_image_url


def with_visual_signals(df: DataFrame) -> DataFrame:
    """Add ``visual_result``, ``extracted_text`` and ``extracted_url``.

    Reads ``has_image``, ``qr_text``, ``ocr``, ``input_fields``, ``decode_ok``, ``ocr_ok``;
    a null ``decode_ok`` means that nothing was extracted for the image.
    """
    lines = F.transform(F.filter("ocr", lambda o: o["conf"] > 0.3), lambda o: o["text"])
    ran = F.coalesce(F.col("ocr_ok"), F.lit(True))
    df = df.withColumns(
        {
            "_v_qr": filled(F.col("qr_text")),
            "_v_lines": F.when(ran, F.coalesce(F.size(lines), F.lit(0))).otherwise(0),
            "_v_ocr": F.when(ran, F.array_join(lines, " ")),
        }
    )
    qr, read = F.col("_v_qr"), F.col("_v_lines") > 0
    qr_url = F.when(qr, first_image_url(F.col("qr_text")))
    prompts = read & contains_any(F.lower("_v_ocr"), dims.CREDENTIAL_PHRASES)
    boxed = prompts & F.coalesce(F.col("input_fields") > 0, F.lit(False))
    bare = prompts & ~boxed
    score = (
        F.when(qr, 20.0).otherwise(0.0)
        + F.when(boxed, 60.0).when(bare, 30.0).otherwise(0.0)
    )
    text = F.trim(
        F.regexp_replace(
            F.concat(
                F.when(qr & qr_url.isNull(), F.concat("qr_text", F.lit("\n"))).otherwise(""),
                F.when(read, F.concat("_v_ocr", F.lit(" "))).otherwise(""),
            ),
            r"(?U)^\s+|\s+$",
            "",
        )
    )
    found = qr | read
    result = engine_result(
        dims.VISUAL_ENGINE,
        F.least(score, F.lit(100.0)),
        F.when(found, 0.85).otherwise(0.9),
        keep(
            flag("qr_code_detected", qr),
            flag("ocr_text_extracted", read),
            flag("visual_phishing_detected", boxed),
            flag("visual_credential_prompt", bare),
        ),
        keep(
            evidence("qr_data", F.col("qr_text"), "Successfully decoded QR code payload.", qr),
            evidence("ocr_data", F.col("_v_ocr"), text_of(
                "Extracted ", F.col("_v_lines"), " lines of text via OCR."), read),
            evidence("visual_fake_login",
                     text_of('{"input_fields_detected":', F.col("input_fields"), "}"),
                     "Image structurally resembles a credential-harvesting or fake login form.",
                     boxed),
            evidence("visual_credential_prompt", "true",
                     "Credential request language visually embedded in image payload.", bare),
        ),
    )
    usable = F.col("has_image") & F.coalesce(F.col("decode_ok"), F.lit(False)) & (ran | qr)
    return df.withColumns(
        {
            "visual_result": F.when(
                ~F.col("has_image"), skipped_result(dims.VISUAL_ENGINE, "No image provided")
            )
            .when(
                F.col("decode_ok").isNull() | (F.col("decode_ok") & ~ran & ~qr),
                skipped_result(
                    dims.VISUAL_ENGINE, "Visual OCR unavailable or memory exhausted"
                ),
            )
            .when(
                ~F.col("decode_ok"),
                error_result(dims.VISUAL_ENGINE, "Failed to decode image bytes"),
            )
            .otherwise(result),
            "extracted_text": F.when(usable & found, F.nullif(text, F.lit(""))),
            "extracted_url": F.when(
                usable,
                F.coalesce(qr_url, F.when(read, first_image_url(F.col("_v_ocr")))),
            ),
        }
    ).drop("_v_qr", "_v_lines", "_v_ocr")


def visual_backfill(text: Column, extracted: Column) -> Column:
    """Extracted content fills a field only where the field is empty."""
    return F.when(filled(text), text).otherwise(F.coalesce(extracted, text))
