"""Small Column builders shared by every rule set."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskflow.schemas import ENGINE_RESULT, EVIDENCE


def no_flags() -> Column:
    return F.array().cast("array<string>")


def no_evidence() -> Column:
    return F.array().cast(f"array<{EVIDENCE}>")


def flag(name: str | Column, when: Column) -> Column:
    """The flag where the condition holds, else null."""
    return F.when(when, F.lit(name) if isinstance(name, str) else name)


def evidence(key: str, value, description, when: Column | None = None) -> Column:
    item = F.struct(
        F.lit(key).alias("key"),
        (value if isinstance(value, Column) else F.lit(value)).cast("string").alias("value"),
        (description if isinstance(description, Column) else F.lit(description)).alias(
            "description"
        ),
    )
    return item if when is None else F.when(when, item)


def keep(*items: Column) -> Column:
    """Array of the items that are not null, in order."""
    return F.array_compact(F.array(*items))


def text_of(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def filled(column: Column) -> Column:
    """True where a text field holds at least one character (null counts as empty)."""
    return F.coalesce(F.length(column) > 0, F.lit(False))


def blank(column: Column) -> Column:
    return F.coalesce(F.trim(column), F.lit("")) == ""


def contains_any(column: Column, words: Iterable[str]) -> Column:
    """One pass over the text: alternation of literal words."""
    return column.rlike("|".join(re.escape(w) for w in words))


def sql_text(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def words(items: Iterable[str]) -> Column:
    """Constant array of texts."""
    return F.expr(f"array({', '.join(sql_text(w) for w in items)})")


def in_words(name: str, items: Iterable[str]) -> str:
    """SQL test ``name IN (...)``, false for null."""
    return f"coalesce({name} IN ({', '.join(sql_text(w) for w in items)}), false)"


def matched_words(column: Column, items: Iterable[str]) -> Column:
    """Words of the list found anywhere in the text, in list order."""
    return F.filter(words(items), lambda w: F.contains(column, w))


def lookup(key: Column, table: Mapping, default=None) -> Column:
    """Constant-table lookup; the map is folded into the plan once."""
    show = lambda v: sql_text(v) if isinstance(v, str) else f"{float(v)}D"
    pairs = ", ".join(f"{sql_text(k)}, {show(v)}" for k, v in table.items())
    found = F.try_element_at(F.expr(f"map({pairs})"), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def flag_list(rules: Mapping[str, str]) -> Column:
    """Names whose SQL condition holds, in order. A name may hold ``{column}`` marks."""
    items = [f"if({cond}, {template(name)}, null)" for name, cond in rules.items()]
    return F.expr(f"array_compact(array({', '.join(items)}))")


def evidence_list(rules: Iterable[tuple[str, str, str, str]]) -> Column:
    """Evidence of the rules that hold: (key, value SQL, description, condition SQL).

    The description may hold ``{column}`` marks.
    """
    items = [
        f"if({cond}, named_struct('key', {sql_text(key)}, 'value', cast({value} as string),"
        f" 'description', {template(text)}), null)"
        for key, value, text, cond in rules
    ]
    return F.expr(f"array_compact(array({', '.join(items)}))")


def template(text: str) -> str:
    """SQL concatenation of a text with ``{column}`` marks."""
    parts = re.split(r"\{([^{}]+)\}", text)
    if len(parts) == 1:
        return sql_text(text)
    shown = [
        f"cast({part} as string)" if i % 2 else sql_text(part)
        for i, part in enumerate(parts)
        if part
    ]
    return f"concat({', '.join(shown)})"


def engine_result(
    name: str,
    score: Column,
    confidence,
    flags: Column,
    evidence_items: Column | None = None,
    status="success",
    error: Column | None = None,
    metadata: Column | None = None,
) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(name).alias("engine_name"),
        score.cast("double").alias("risk_score"),
        as_col(confidence).cast("double").alias("confidence"),
        flags.alias("flags"),
        (no_evidence() if evidence_items is None else evidence_items).alias("evidence"),
        as_col(status).alias("status"),
        (F.lit(None).cast("string") if error is None else error).alias("error_message"),
        (
            F.create_map().cast("map<string,string>") if metadata is None else metadata
        ).alias("metadata"),
    ).cast(ENGINE_RESULT)


def _empty_result(name: str, status: str, message) -> Column:
    return engine_result(
        name,
        F.lit(0.0),
        0.0,
        no_flags(),
        status=status,
        error=message if isinstance(message, Column) else F.lit(message),
    )


def skipped_result(name: str, reason) -> Column:
    return _empty_result(name, "skipped", reason)


def error_result(name: str, message) -> Column:
    return _empty_result(name, "error", message)
