"""URL filter: lists first, else the ratio of two character language models.

Two variable-order Markov models, one of accepted and one of rejected URLs, are counted over
all labelled URLs. A context of up to ``order`` characters is kept if it makes up at least
the share ``share`` of its class's characters, so a model has at most ``(order + 1) / share``
contexts and as many successors at any corpus size. Probabilities are interpolated from the
longest kept context down (Witten-Bell). The score is the difference of log-likelihoods per
character; the cut is calibrated on labelled URLs held out of the counts.

Defined results: a null URL or one without ``://`` has empty host and path, no rule, and its
characters are judged by the models (null like an empty text, score 0); without accepted
or rejected URLs to learn from, the score is 0 and the verdict ``allow``. Repeated rows and
other columns are kept.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "\x02", "\x03"


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest fitting rule ``(verdict, host, path)``, or nulls."""
    text = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def count_grams(labelled: DataFrame, order: int, share: float) -> DataFrame:
    """``label, gram, n`` of all kept grams (a gram of k+1 characters is a successor in context k)."""

    def grams(batches):
        for batch in batches:
            seen: Counter = Counter()
            for label, url in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                text = START + url + END
                for k in range(order + 1):
                    seen.update((label, text[i - k : i + 1]) for i in range(max(1, k), len(text)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*((l, g, n) for (l, g), n in seen.items()))]
                if seen
                else [pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.int64())],
                ["label", "gram", "n"],
            )

    counts = (
        labelled.select("label", "url").mapInArrow(grams, "label string, gram string, n long")
        .groupBy("label", "gram").agg(F.sum("n").alias("n"))
    )
    total = labelled.groupBy("label").agg(F.sum(F.length("url") + 1).alias("total"))
    return counts.join(F.broadcast(total), "label").where(F.col("n") >= F.col("total") * share).drop("total")


class Markov:
    """One class's model; ``grams`` maps a gram to its count."""

    def __init__(self, grams: dict[str, int], order: int, symbols: int = 256):
        self.order, self.floor = order, 1.0 / symbols
        self.n: dict[str, int] = Counter()
        self.kinds: dict[str, int] = Counter()
        self.grams = grams
        for gram, count in grams.items():
            self.n[gram[:-1]] += count
            self.kinds[gram[:-1]] += 1
        self.memo: dict[tuple[str, str], float] = {}

    def prob(self, context: str, char: str) -> float:
        key = (context, char)
        p = self.memo.get(key)
        if p is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            lower = self.prob(context[1:], char) if context else self.floor
            n, kinds = self.n.get(context, 0), self.kinds.get(context, 0)
            p = (self.grams.get(context + char, 0) + kinds * lower) / (n + kinds) if n else lower
            self.memo[key] = p
        return p

    def log10(self, url: str) -> float:
        text = START + url + END
        return sum(
            math.log10(self.prob(text[max(0, i - self.order) : i], text[i])) for i in range(1, len(text))
        )


def fit(labelled: DataFrame, order: int = 5, share: float = 2e-5) -> dict:
    """Models of ``allow`` and ``block`` rows of ``labelled(label, url)`` and the calibrated cut.

    One row in five (by hash of the URL) is held out; the cut is the one of 201 candidates
    between -1 and 1 with the best mean of both classes' accuracies.
    """
    labelled = labelled.where(F.col("url").isNotNull() & F.col("label").isNotNull())
    held = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    grams: dict[str, dict[str, int]] = {"allow": {}, "block": {}}
    for r in count_grams(labelled.where(~held), order, share).toLocalIterator():
        grams[r.label][r.gram] = r.n
    model = {"order": order, "grams": grams, "cut": 0.0}
    if not all(grams.values()):
        return model
    scored = score(labelled.where(held), model).select(
        "label", F.greatest(F.lit(-100), F.least(F.lit(100), F.floor(F.col("score") * 100))).alias("bin")
    )
    bins = {(r.label, r.bin): r["count"] for r in scored.groupBy("label", "bin").count().collect()}
    sums = {k: sum(n for (label, _), n in bins.items() if label == k) for k in grams}

    def accuracy(cut: int) -> float:
        good = sum(n for (k, b), n in bins.items() if k == "allow" and b >= cut) / max(sums["allow"], 1)
        return good + sum(n for (k, b), n in bins.items() if k == "block" and b < cut) / max(sums["block"], 1)

    best = max(map(accuracy, range(-100, 101)))
    level = [c for c in range(-100, 101) if accuracy(c) == best]
    model["cut"] = level[len(level) // 2] / 100
    return model


def score(df: DataFrame, model: dict) -> DataFrame:
    """Add ``score``: log10 ratio per character, above 0 for URLs like the accepted ones."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", score double"
    at = df.columns.index("url")

    def run(batches):
        own = sent.value
        models = {k: Markov(g, own["order"]) for k, g in own["grams"].items()}
        ready, memo = all(own["grams"].values()), {}
        for batch in batches:
            out = []
            for url in batch.column(at).to_pylist():
                if not url or not ready:
                    out.append(0.0)
                    continue
                if url not in memo:
                    if len(memo) > 20_000:
                        memo.clear()
                    memo[url] = (models["allow"].log10(url) - models["block"].log10(url)) / (len(url) + 1)
                out.append(memo[url])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "score"])

    return df.mapInArrow(run, fields)


def judge(df: DataFrame, rules: list[tuple[str, str, str]], order: int = 5, share: float = 2e-5) -> DataFrame:
    """Add ``host, path, rule, score, verdict``. What the rules decide is what the models learn from."""
    host, path = host_path(F.col("url"))
    named = df.select([c for c in df.columns if c not in {"host", "path", "rule", "score", "verdict", "_by_rule"}])
    named = named.withColumns({"host": host, "path": path})
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    ruled = named.withColumns({"rule": rule, "_by_rule": by_rule})
    model = fit(ruled.select(F.col("_by_rule").alias("label"), "url"), order, share)
    by_model = F.when(F.col("score") >= model["cut"], "allow").otherwise("block")
    return score(ruled, model).withColumn("verdict", F.coalesce("_by_rule", by_model)).drop("_by_rule")
