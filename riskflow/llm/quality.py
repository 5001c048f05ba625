"""Quality rules whose thresholds adapt to language and source.

Every text is measured once. Quantile sketches (KLL) of the measures are built per language
and source, map-side first, and merged upwards: a group with fewer than ``least`` texts uses
the sketch of its language, a small language that of all texts. A text fails a rule if its
measure lies beyond the fence ``q75 + reach * (q75 - q25) + slack`` (or below the mirrored
fence) of its group. No group excuses itself: its fence is at most that of its language, and that
one at most that of all texts, moved up by as much as the lower quartile of the group lies above
the parent's (mirrored for the lower fence). A source whose texts all differ from the others keeps
limits of its own; one that holds a share of junk has the quartile of its good texts and so the
limits of its parents. Where over a quarter of all texts is junk, no parent is left to tell.
Thresholds come back to the rows by a join on (language, source).

Defined results: a null text has no words; null language or source is a group of its own;
a text without words fails the base rule; repeated rows are measured one by one; all columns
of the input are kept, columns of the same names as measures are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import encoded, free, stage

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
NAMES = [m.split()[0] for m in MEASURES.split(", ")]
SYMBOL = re.compile(rb"[#*$%&|<>]")
BLANK = re.compile(rb"[\x20\x09-\x0D]+")
#: rule: (ratio in SQL, side it guards, slack added to the fence)
RULES = {
    "symbol_ratio": ("n_symbols / word_chars", "high", 0.05),
    "dup_line_ratio": ("n_dup_lines / n_words", "high", 0.1),
    "repeat_ratio": ("n_repeat_words / n_words", "high", 0.15),
    "word_length": ("word_chars / n_words", "both", 2.0),
}


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words covered by windows of ``width`` words that occur twice or more, first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    code = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, len(words))
    if len(code) == len(words):
        return 0
    window = ids[:n]
    for i in range(1, width):
        # ranks stay below n, so a pair fits 64 bits and equal ranks mean equal windows
        pair = window * len(code) + ids[i : i + n]
        window = np.unique(pair, return_inverse=True)[1]
    again = np.bincount(window)[window] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    data = encoded(text)
    words = data.split()
    if not words:
        return 0, 0, len(SYMBOL.findall(data)), 0, 0
    packed = b"".join(words)
    chars = len(packed.decode("utf-8", "replace"))
    lines = [line for line in data.split(b"\n") if line.split(None, 1)]
    return (
        len(words), chars, len(SYMBOL.findall(packed)), len(lines) - len(set(lines)), repeated_words(words),
    )


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the columns of ``MEASURES``."""
    kept = [c for c in df.columns if c not in NAMES]
    at = kept.index(text)
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + ", " + MEASURES

    def run(batches):
        for batch in batches:
            rows = [measures(t.as_py()) for t in batch.column(at)]
            new = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(NAMES)
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*kept, *NAMES])

    return df.select(*kept).mapInArrow(run, fields)


def thresholds(rows: DataFrame, least: int = 100, reach: float = 3.0, k: int = 400) -> DataFrame:
    """``lang, source`` and per rule ``<rule>_low`` / ``<rule>_high`` from merged sketches."""
    able = rows.where(F.col("n_words") > 0)
    sketches = [F.kll_sketch_agg_double(F.expr(sql).cast("double"), k).alias(r) for r, (sql, _, _) in RULES.items()]
    fine = able.groupBy("lang", "source").agg(F.count("*").alias("n"), *sketches)

    def merged(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.sum("n").alias(f"n_{tag}"), *[F.kll_merge_agg_double(r, k).alias(f"{r}_{tag}") for r in RULES]
        )

    by_lang, over_all = merged(fine, ["lang"], "lang"), merged(fine, [], "all")
    out = fine.join(
        by_lang.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang"))
    ).join(F.broadcast(over_all), F.lit(True))  # one row
    # rule by rule, from the corpus down: the quartiles in use and the fences
    for rule, (_, side, slack) in RULES.items():
        for tag in ("_all", "_lang", ""):
            out = out.withColumns({
                f"_{p}{tag}": F.kll_sketch_get_quantile_double(F.col(f"{rule}{tag}"), F.lit(p / 100)) for p in (25, 75)
            })
        low25, high75, high, low = F.col("_25_all"), F.col("_75_all"), *_fence("_all", reach, slack)
        for tag in ("_lang", ""):
            large = F.col(f"n{tag}") >= least
            own25, own75 = F.col(f"_25{tag}"), F.col(f"_75{tag}")
            own_high, own_low = _fence(tag, reach, slack)
            # a parent's fence moves with the quartile that lies away from what it guards against
            own_high = F.least(own_high, high + F.greatest(own25 - low25, F.lit(0.0)))
            own_low = F.greatest(own_low, low + F.least(own75 - high75, F.lit(0.0)))
            out = out.withColumns({
                f"_high{tag}": F.when(large, own_high).otherwise(high), f"_low{tag}": F.when(large, own_low).otherwise(low),
                f"_25u{tag}": F.when(large, own25).otherwise(low25), f"_75u{tag}": F.when(large, own75).otherwise(high75),
            })
            low25, high75, high, low = (F.col(f"{c}{tag}") for c in ("_25u", "_75u", "_high", "_low"))
        out = out.withColumns({f"{rule}_high": high, f"{rule}_low": low if side == "both" else F.lit(None).cast("double")})
    return out.select("lang", "source", *[f"{r}_{end}" for r in RULES for end in ("high", "low")])


def _fence(tag: str, reach: float, slack: float) -> tuple[Column, Column]:
    """Upper and lower fence from the quartiles of one level."""
    q25, q75 = F.col(f"_25{tag}"), F.col(f"_75{tag}")
    spread = (q75 - q25) * reach + slack
    return q75 + spread, q25 - spread


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Add ``base_failed`` and ``kept`` to measured rows."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    own = {c: free(f"_{c}", [*rows.columns, *limits.columns]) for c in limits.columns}
    limits = limits.withColumnsRenamed(own)
    joined = rows.join(
        limits, F.col("lang").eqNullSafe(F.col(own["lang"])) & F.col("source").eqNullSafe(F.col(own["source"])), "left"
    )
    broken = F.lit(False)
    for rule, (sql, _, _) in RULES.items():
        value = F.expr(f"try_divide({sql.replace(' / ', ', ')})")
        high, low = F.col(own[f"{rule}_high"]), F.col(own[f"{rule}_low"])
        broken = broken | F.coalesce((value > high) | (value < low), value > high, F.lit(False))
    return joined.select(*rows.columns, base.alias("base_failed"), (~base & ~broken).alias("kept"))


def rate(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without ``text``, with measures, ``base_failed`` and ``kept``."""
    rows = stage(measured(docs).drop("text"), "quality")
    # the table of limits has one row per language and source: written, so every reader sees the same cuts
    limits = stage(thresholds(rows, **options), "quality-limits")
    return judged(rows, limits)


def accept(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns. Only the small limits are joined."""
    own = {c: f"_own_{c}" for c in docs.columns if c in (*NAMES, "base_failed", "kept")}
    rows = stage(measured(docs.withColumnsRenamed(own)), "quality")
    limits = stage(thresholds(rows, **options), "quality-limits")
    kept = judged(rows, limits).where("kept").drop(*NAMES, "base_failed", "kept")
    return kept.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)
