"""Contract check of verdict documents that arrive as JSON text."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.schemas import VERDICT

_TEXT = ["scan_id", "status", "classification", "risk_assessment.classification",
         "risk_assessment.recommended_action"]
_NUMBERS = ["total_engines", "completed_engines", "skipped_engines", "risk_score",
            "risk_assessment.risk_score", "risk_assessment.confidence"]
_TEXT_LISTS = ["contributing_engines", "ignored_engines", "flags", "reasons"]


def check_verdicts(df: DataFrame, column: str = "body") -> tuple[DataFrame, DataFrame]:
    """(parsed rows with a ``verdict`` struct, malformed rows).

    The document is held as a variant, so the JSON type of each field is tested and
    a number in the place of a text counts as malformed.
    """
    df = df.withColumn("_doc", F.try_parse_json(F.col(column)))
    doc = F.col("_doc")

    def typed(source: Column, path: str, *types: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(source, f"$.{path}", "variant"))
        return F.coalesce(reduce(lambda a, b: a | b, [kind.startswith(t) for t in types]), F.lit(False))

    number = ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")
    texts = lambda source, path: typed(source, path, "ARRAY<STRING>", "ARRAY<VOID>") & (
        F.coalesce(
            F.forall(
                F.try_variant_get(source, f"$.{path}", "array<variant>"),
                lambda v: F.schema_of_variant(v) == "STRING",
            ),
            F.lit(False),
        )
    )

    def evidence_ok(source: Column) -> Column:
        items = F.try_variant_get(source, "$.evidence", "array<variant>")
        return F.coalesce(
            F.forall(
                items,
                lambda v: typed(v, "key", "STRING")
                & typed(v, "description", "STRING")
                & F.try_variant_get(v, "$.value", "variant").isNotNull(),
            ),
            F.lit(False),
        )

    def result_ok(v: Column) -> Column:
        message = F.try_variant_get(v, "$.error_message", "variant")
        return (
            typed(v, "engine_name", "STRING")
            & typed(v, "risk_score", *number)
            & typed(v, "confidence", *number)
            & texts(v, "flags")
            & evidence_ok(v)
            & typed(v, "status", "STRING")
            & (message.isNull() | F.is_variant_null(message) | typed(v, "error_message", "STRING"))
            & typed(v, "metadata", "OBJECT")
        )

    assessment = F.try_variant_get(doc, "$.risk_assessment", "variant")
    results = F.try_variant_get(doc, "$.results", "array<variant>")
    warnings = F.try_variant_get(doc, "$.warnings", "variant")
    rules = [typed(doc, p, "STRING") for p in _TEXT]
    rules += [typed(doc, p, *number) for p in _NUMBERS]
    rules += [texts(assessment, p) for p in _TEXT_LISTS]
    rules += [
        evidence_ok(assessment),
        F.coalesce(F.forall(results, result_ok), F.lit(False)),
        warnings.isNull() | F.is_variant_null(warnings) | texts(doc, "warnings"),
    ]
    df = df.withColumn("_good", F.coalesce(reduce(and_, rules), F.lit(False))).drop("_doc")
    good = df.where("_good").withColumn("verdict", F.from_json(F.col(column), VERDICT)).drop("_good")
    return good, df.where("not _good").drop("_good")
