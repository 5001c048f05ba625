"""Toxicity: a logistic classifier whose scores may not change when identity terms are swapped.

Features are whole words, word beginnings and word endings, so insults count in any inflection. A text's value
of a feature grows with the number of its distinct words that have it and saturates with the text's length
(``c / (c + k)``, ``k`` linear in the length), so one chance hit in a long text weighs little.

Fit: labelled texts (one per distinct text) are read on Spark; a feature enters the model if the
log-likelihood ratio of its presence and the label exceeds ``2 ln(number of features)``, which chance
alone rarely does in any of them. Each labelled text with identity terms (muslim, gay, women, ...) also gives counterfactual copies,
all of its terms replaced by others of their group, the neutral one ("people") included. The loss is the mean log-loss, a small square
penalty on weights, and ``parity`` times the mean squared difference of the two log-odds (counterfactual logit pairing),
so words that merely name a group carry no score and neutral mentions aren't flagged.

Bounds of the fit (parameters): about ``sample`` labelled rows chosen by a hash, ``limit`` features.
Scoring reads every whole text. Labels, language, source and id never enter a score.

Defined results: null and empty texts have no features and get the base rate's score; a null id has no label and isn't held
out; several labels of one id count as toxic if one does; rows that share an id are scored one by one;
without labelled texts of both kinds every score is the smoothed base rate; other columns don't matter.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups of identity terms, the neutral one first; lower case, several languages.
IDENTITIES = [
    ["people", "muslims", "jews", "christians", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants",
     "blacks", "whites", "asians", "latinos", "arabs", "africans", "europeans", "americans", "mexicans", "chinese", "indians",
     "gays", "lesbians", "women", "men", "girls", "boys", "immigrants", "refugees", "migrants", "foreigners", "elders"],
    ["person", "muslim", "jew", "christian", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant", "woman", "man",
     "girl", "boy", "immigrant", "refugee", "migrant", "foreigner"],
    ["ordinary", "islamic", "jewish", "black", "white", "asian", "latino", "latina", "arab", "african", "european", "american", "mexican",
     "gay", "lesbian", "bisexual", "queer", "transgender", "trans", "straight", "homosexual", "heterosexual", "female", "male",
     "deaf", "blind", "disabled", "old", "young", "elderly"],
    ["menschen", "muslime", "juden", "christen", "frauen", "männer", "ausländer", "flüchtlinge", "schwule", "lesben", "türken", "behinderte"],
    ["gens", "musulmans", "juifs", "chrétiens", "femmes", "hommes", "étrangers", "réfugiés", "homosexuels", "lesbiennes", "arabes", "noirs"],
    ["gente", "musulmanes", "judíos", "cristianos", "mujeres", "hombres", "extranjeros", "refugiados", "homosexuales", "lesbianas", "negros"],
]
PARTS = 32


def words(text: str | None) -> list[str]:
    """Lower-case runs without the signs around and inside them."""
    out = []
    for raw in (text or "").lower().split():
        out.append(raw if raw.isalnum() else "".join(filter(str.isalnum, raw)))
    return [w for w in out if w]


def features(word: str) -> list[str]:
    n = len(word)
    return [f"={word}", *(f"^{word[:k]}" for k in range(3, min(n, 9))), *(f"{word[-k:]}$" for k in range(3, min(n, 6)))]


def values(counts: Counter, n: int) -> dict:
    """Saturated value of each feature in a text of ``n`` words."""
    k = 0.3 + 0.003 * n
    return {f: c / (c + k) for f, c in counts.items()}


def swaps(found: list[str], groups: list[list[str]]) -> list[tuple[float, dict[str, str]]]:
    """Shares and replacements of the identity terms ``found``: half of the weight goes to the copy with
    the neutral terms, the rest to the copies that take the next term of each group, the one after it, ..."""
    place = {t: (terms, i) for terms in groups for i, t in enumerate(terms)}
    size = max((len(place[t][0]) for t in found), default=1)
    turned = [{t: place[t][0][(place[t][1] + step) % len(place[t][0])] for t in found} for step in range(1, size)]
    return [(0.5, {t: place[t][0][0] for t in found}), *((0.5 / len(turned), new) for new in turned)] if turned else []


def held_out(id_column: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 3 == 1, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``text, y``: distinct learning texts with the mean of their labels; about ``sample`` labelled rows at most."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(~held_out("doc_id"))
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("double").alias("y"))
    # at most ``sample`` narrow rows, so the texts stay where they are
    chosen = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    return chosen.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.avg("y").alias("y"))


def presence(texts: DataFrame) -> DataFrame:
    """``feature, toxic, clean``: in how many labelled texts of either kind a feature is."""

    def run(batches):
        memo: dict[str, list[str]] = {}
        sums: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])

        def rows():
            names = list(sums)
            out = [pa.array(names, pa.string()), *(pa.array([sums[f][k] for f in names], pa.float64()) for k in (0, 1))]
            sums.clear()
            return pa.RecordBatch.from_arrays(out, ["feature", "toxic", "clean"])

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own: set[str] = set()
                for w in set(words(text)):
                    if w not in memo:
                        if len(memo) > 200_000:
                            memo.clear()
                        memo[w] = features(w)
                    own.update(memo[w])
                for f in own:
                    at = sums[f]
                    at[0] += y
                    at[1] += 1 - y
                if len(sums) > 500_000:
                    yield rows()
        yield rows()

    return (
        texts.select("text", "y").mapInArrow(run, "feature string, toxic double, clean double")
        .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )


def screened(counts: DataFrame, toxic: float, clean: float, limit: int) -> list[str]:
    """Features whose presence goes with the label beyond chance, the strongest first."""
    n = counts.count()

    def part(k: Column, total: float) -> Column:
        """log-likelihood of k hits in ``total`` texts at the rate of these texts, less that at the common rate"""
        rate, common = k / total, (F.col("toxic") + F.col("clean")) / (toxic + clean)
        hit = F.when(k > 0, k * F.ln(rate / common)).otherwise(0.0)
        return hit + F.when(total - k > 0, (total - k) * F.ln((1 - rate) / (1 - common))).otherwise(0.0)

    ratio = 2 * (part(F.col("toxic"), toxic) + part(F.col("clean"), clean))
    some = counts.where((F.col("toxic") + F.col("clean") >= 3) & (F.col("toxic") + F.col("clean") < toxic + clean))
    best = some.select("feature", ratio.alias("ratio")).where(F.col("ratio") > 2 * math.log(max(n, 2)))
    return [r.feature for r in best.orderBy(F.col("ratio").desc(), "feature").limit(limit).collect()]


def vectors(texts: DataFrame, known: dict[str, int], groups: list[list[str]]) -> DataFrame:
    """``y, at, value, other``: model features of each text; ``other``: those of its counterfactual copies."""
    sent = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        number = sent.value
        place = {t for terms in groups for t in terms}

        def vector(own: set[str], n: int):
            counts = Counter(number[f] for w in own for f in features(w) if f in number)
            v = values(counts, n)
            at = sorted(v)
            return at, [v[i] for i in at]

        for batch in batches:
            out = []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(text)
                own = set(found)
                at, value = vector(own, len(found))
                others = []
                for share, new in swaps(sorted(own & place), groups):
                    a, v = vector({new.get(w, w) for w in own}, len(found))
                    if (a, v) != (at, value):
                        others.append({"share": share, "at": a, "value": v})
                out.append((y, at, value, others))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (
                    pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64()),
                    pa.list_(pa.struct([("share", pa.float64()), ("at", pa.list_(pa.int32())), ("value", pa.list_(pa.float64()))]))))],
                ["y", "at", "value", "other"],
            )

    kind = "y double, at array<int>, value array<double>, other array<struct<share: double, at: array<int>, value: array<double>>>"
    return texts.select("text", "y").mapInArrow(run, kind)


class Sparse:
    """Rows of (columns, values), multiplied from both sides."""

    def __init__(self, rows: list, width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(self.n), [len(a) for a, _ in rows])
        self.col = np.array([i for a, _ in rows for i in a], np.int64)
        self.val = np.array([x for _, v in rows for x in v], float)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * r[self.row], self.width)


def descend(
    y: np.ndarray, x: Sparse, gap: Sparse, weight: np.ndarray, parity: float, ridge: float, steps: int = 400
) -> tuple[np.ndarray, float]:
    """Weights and intercept of the least loss; ``gap`` holds the differences to the copies, ``weight`` sums to the share of each."""
    w, b = np.zeros(x.width), math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    first, second = np.zeros(x.width + 1), np.zeros(x.width + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x.times(w) + b, -50, 50)))
        slope = (p - y) / len(y)
        grad = np.append(x.back(slope) + ridge * w, slope.sum())
        if gap.n:
            grad[:-1] += gap.back(2 * parity * weight * gap.times(w))
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        rate = 0.2 * min(1.0, 2 * (1 - step / (steps + 1)))
        move = rate * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def fit(
    docs: DataFrame, labels: DataFrame, groups: list[list[str]] = IDENTITIES,
    parity: float = 20.0, ridge: float = 2e-5, sample: int = 30_000, limit: int = 20_000,
) -> dict:
    """Model of the labelled texts outside the held-out third: ``weights`` by feature and ``base``.

    ``sample`` bounds the labelled rows that are learnt from (about), ``limit`` the features.
    """
    from riskflow.llm.common import drop, stage

    # one text per distinct one: narrow and bounded, written since three steps read it
    texts = stage(labelled_texts(docs, labels, sample).repartition(PARTS), "labelled-texts")
    n, toxic = texts.agg(F.count("*"), F.sum("y")).first()
    toxic = toxic or 0.0
    base = math.log((toxic + 1) / (n - toxic + 1))
    if not 0 < toxic < n:
        drop(texts)
        return {"weights": {}, "base": base}
    counts = stage(presence(texts), "label-features")
    names = screened(counts, toxic, n - toxic, limit)
    rows = vectors(texts, {f: i for i, f in enumerate(names)}, groups).collect() if names else []  # bounded by sample
    drop(texts, counts)
    if not names:
        return {"weights": {}, "base": base}
    rows.sort(key=lambda r: (r.y, r.at, r.value))
    x = Sparse([(r.at, r.value) for r in rows], len(names))
    gaps, weight = [], []
    for r in rows:
        for o in r.other:
            gaps.append((list(r.at) + list(o.at), list(r.value) + [-v for v in o.value]))
            weight.append(o.share)
    total = sum(weight)
    w, b = descend(
        np.array([r.y for r in rows]), x, Sparse(gaps, len(names)), np.array(weight) / max(total, 1.0), parity, ridge
    )
    return {"weights": {f: float(v) for f, v in zip(names, w) if v}, "base": float(b)}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, score`` of every row, from its whole text alone."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        names, base = sent.value["weights"], sent.value["base"]
        memo: dict[str, tuple] = {}
        for batch in batches:
            out = []
            for text in batch.column(1):
                found = words(text.as_py())
                counts: Counter = Counter()
                for w in set(found):
                    own = memo.get(w)
                    if own is None:
                        if len(memo) > 300_000:
                            memo.clear()
                        own = memo[w] = tuple(f for f in features(w) if f in names)
                    if own:
                        counts.update(own)
                v = values(counts, len(found))
                logit = math.fsum(names[f] * x for f, x in v.items()) + base
                out.append(round(1 / (1 + math.exp(-max(-50.0, min(50.0, logit)))), 9))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def judge(docs: DataFrame, labels: DataFrame, cut: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    return score(docs, fit(docs, labels)).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")
    )
