"""Ranked lexical search: accumulator-limited term-at-a-time over parts of the documents.

A term is a run of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII. Two
passes over the documents: the first sums what the weights need (documents, length, and
documents per query term), the second ranks. Every task indexes its own documents in blocks of at most ``BLOCK``
postings of query terms and answers all queries on each block: terms from the rarest on, one accumulator per
document that a term meets. The k-th best of the scores so far (final ones of the task's earlier blocks
and partial ones of this block) is compared with the bound of the terms still to come, the sum of weight times
the largest impact in the block; when the bound can't reach it any more no accumulators
are created, and those there are get their exact scores. A task gives k rows a query, merged in two steps.
No postings are shuffled, so a term of every document costs no more than its counting.

Queries are taken as distinct texts, in blocks of about ``QUERY_BYTES`` of text (by hash of the
text; a block is sent to the tasks and never exceeds ``2 * QUERY_BYTES`` unless one text does).

Defined results: null and empty texts hold no terms and match nothing; rows that share a doc_id are
ranked one by one; a null doc_id comes last among equal scores; repeated items get their rows each;
empty tables give no rows; other columns don't matter.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.common import encoded

#: bytes of terms as they count, all others blank
TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
BLOCK = 400_000
QUERY_BYTES = 8_000_000
SALTS = 32


def terms(text: str | None) -> list[bytes]:
    return encoded(text).translate(TERM).split()


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def statistics(docs: DataFrame, known: dict[bytes, int]) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, all their terms, and documents per number of ``known``.

    A task gives one row per number it met, so at most ``len(known) + 2`` rows come from each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        number = sent.value.get
        df: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                words = terms(text.as_py())
                if words:
                    df[-1] += 1
                    df[-2] += len(words)
                    own = set(map(number, words))
                    own.discard(None)
                    df.update(own)
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.int64()), pa.array(list(df.values()), pa.int64())], ["term", "n"])

    sums = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    got = {r.term: r.n for r in sums.collect()}  # bounded by the block of queries
    return got.pop(-1, 0), got.pop(-2, 0), got


class Index:
    """Postings of the query terms in one block of documents."""

    def __init__(self, ids: list, doc: list, term: list, tf: list, n: list, corpus: tuple[int, int]):
        documents, length = corpus
        self.ids = ids
        at, which, tf = (np.array(x, np.int64) for x in (doc, term, tf))
        m = 75 + (25 * np.array(n, np.int64) * documents) // max(length, 1)
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[at])
        order = np.argsort(which, kind="stable")
        self.at, self.impact = at[order], impact[order]
        kinds, starts = np.unique(which[order], return_index=True)
        ends = np.append(starts[1:], len(order))
        self.span = {int(k): (int(s), int(e)) for k, s, e in zip(kinds, starts, ends)}
        self.top = {k: int(self.impact[s:e].max()) for k, (s, e) in self.span.items()}

    def best(self, query: list[tuple[int, int]], k: int, before: list) -> list:
        """The best ``(-score, id is null, id)`` of ``before`` and of this block.

        ``query``: (term, weight times repeats), rarest first.
        """
        query = [(t, w) for t, w in query if t in self.span]
        rest = sum(w * self.top[t] for t, w in query)
        acc = np.zeros(len(self.ids), np.int64)
        old = np.array([-b[0] for b in before], np.int64)
        creating = True
        for t, w in query:
            if creating:
                level = np.concatenate([old, acc[acc > 0]])
                # an unseen document that only equals the k-th could still win by its id
                creating = len(level) < k or rest >= np.partition(level, len(level) - k)[len(level) - k]
            start, end = self.span[t]
            at, gain = self.at[start:end], self.impact[start:end] * w
            if creating:
                acc[at] += gain
            else:
                live = acc[at] > 0
                if not live.any() and not acc.any():
                    break
                acc[at[live]] += gain[live]
            rest -= w * self.top[t]
        some = np.flatnonzero(acc)
        if len(some) > k:
            level = np.partition(acc[some], len(some) - k)[len(some) - k]
            some = some[acc[some] >= level]
        new = [(-int(acc[i]), self.ids[i] is None, 0 if self.ids[i] is None else self.ids[i]) for i in some.tolist()]
        return heapq.nsmallest(k, before + new) if new else before


def ranked(docs: DataFrame, queries: dict, corpus: tuple[int, int], known: dict[bytes, int], k: int) -> DataFrame:
    """``query, doc_id, score`` of the best ``k`` documents of every task."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast((queries, known))

    def run(batches):
        asked, number = sent.value[0], sent.value[1].get
        best: dict = {q: [] for q in asked}
        ids, doc, term, tf, n = [], [], [], [], []
        arrow = None

        def close():
            index = Index(ids, doc, term, tf, n, corpus)
            for q, wanted in asked.items():
                best[q] = index.best(wanted, k, best[q])

        for batch in batches:
            arrow = batch.column(0).type
            for key, text in zip(batch.column(0), batch.column(1)):
                words = terms(text.as_py())
                counts = Counter(map(number, words))
                counts.pop(None, None)
                if not counts:
                    continue
                doc += [len(ids)] * len(counts)
                term += counts.keys()
                tf += counts.values()
                ids.append(key.as_py())
                n.append(len(words))
                if len(doc) >= BLOCK:
                    close()
                    ids, doc, term, tf, n = [], [], [], [], []
        if doc:
            close()
        rows = [(q, None if null else i, -s) for q, found in best.items() for s, null, i in found]
        if rows:
            types = (pa.string(), arrow, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["query", "doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"query string, doc_id {kind}, score long")


def top(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents with the highest score above 0 of every item."""
    asked = items.where(F.col("text").isNotNull()).select("text", F.sha2("text", 256).alias("query")).distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = size // QUERY_BYTES + 1
    found = []
    for part in range(parts):
        block = asked.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).collect()
        bags = {r.query: Counter(terms(r.text)) for r in block}
        known = {t: i for i, t in enumerate(sorted({t for bag in bags.values() for t in bag}))}
        documents, length, df = statistics(docs, known)
        level = {t: weight(documents, df[i]) for t, i in known.items() if i in df}
        queries = {
            q: [(known[t], bag[t] * level[t]) for t in sorted(bag, key=lambda t: (df.get(known[t], 0), t)) if level.get(t)]
            for q, bag in bags.items()
        }
        local = ranked(docs, queries, (documents, length), known, k).withColumn("salt", F.spark_partition_id() % SALTS)
        found.append(top(top(local, k, "query", "salt").drop("rank", "salt"), k, "query"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return items.select("item_id", F.sha2("text", 256).alias("query")).join(every, "query").select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format('text')} AS t FROM documents),
c AS (SELECT count(*) AS big, sum(len(t))::BIGINT AS len FROM d WHERE len(t) > 0),
q AS (SELECT i, item_id, term, count(*) AS reps FROM (
  SELECT row_number() OVER () AS i, item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * big + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
s AS (SELECT q.i, q.item_id, d.doc_id, d.r,
    sum(q.reps * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * len(d.t) * c.big) // c.len))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN d ON d.r = p.r, c GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""
