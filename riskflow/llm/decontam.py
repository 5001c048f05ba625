"""Benchmark items inside documents: size-partitioned MinHash containment search.

Items are partitioned by size (number of distinct shingles, powers of two); a size class
fixes how many of an item's smallest shingle hashes its sketch holds. A document contains the share ``t``
of an item's ``m`` shingles only if it misses at most ``m - ceil(t * m)``, so with one hash
more in the sketch at least one of them lies in the document: the search loses nothing,
however long the document is. Documents are streamed once; a shingle passes if a filter of fixed size
says that it may be in a sketch, and only such shingles are shuffled and joined.
Candidates are verified by exact containment of the shingles themselves.

Shingles: windows of ``width`` words of the text with A-Z in lower case; a text with fewer
words is one shingle. Defined results: null or empty texts have no shingles and match
nothing; a null id is matched under the id null but not verified across rows, so it is left
out; rows that share an id form one document; repeated items each get their pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import LOWER, encoded, flags, shingle_hashes, stage, word_hashes


def shingle_set(data: bytes, width: int) -> set[tuple[bytes, ...]]:
    words = data.translate(LOWER).split()
    k = min(width, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def sketches(items: DataFrame, ident: str, width: int, share: float) -> DataFrame:
    """``item, hash``: the smallest hashes of every item; their number follows from its size class."""

    def run(batches):
        for batch in batches:
            ids, hashes = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.unique(shingle_hashes(word_hashes(encoded(text.as_py()).translate(LOWER).split()), width))
                # the class holds sizes up to 2**j; its bound on what may be missing serves all of them
                top = 1 << (len(own) - 1).bit_length() if len(own) else 0
                keep = own[: top - int(np.ceil(share * top - 1e-9)) + 1]
                ids += [i] * len(keep)
                hashes.append(keep.view(np.int64))
            flat = np.concatenate(hashes) if hashes else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(flat)], ["item", "hash"])

    kind = items.schema[ident].dataType.simpleString()
    return items.where(F.col(ident).isNotNull()).select(ident, "text").mapInArrow(run, f"item {kind}, hash long")


def probes(docs: DataFrame, ident: str, width: int, table: np.ndarray) -> DataFrame:
    """``doc, hash`` of the shingles that may be in a sketch."""
    sent = docs.sparkSession.sparkContext.broadcast(table)
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches):
        marked = sent.value
        mask = np.uint64(len(marked) - 1)
        for batch in batches:
            found, counts = [], []
            for text in batch.column(1):
                h = shingle_hashes(word_hashes(encoded(text.as_py()).translate(LOWER).split()), width)
                h = np.unique(h[marked[(h & mask).astype(np.int64)]])
                counts.append(len(h))
                found.append(h.view(np.int64))
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            flat = np.concatenate(found) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(flat)], ["doc", "hash"])

    return docs.where(F.col(ident).isNotNull()).select(ident, "text").mapInArrow(run, f"doc {kind}, hash long")


def verified(pairs: DataFrame, width: int, share: float) -> DataFrame:
    """``doc, item, n_shingles, containment`` of the pairs (with ``doc_text, item_text``) that reach ``share``.

    Several texts of one ``doc`` count together: the shingles each of them holds are numbered and united.
    """
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("doc", "item")}

    def run(batches):
        for batch in batches:
            out = []
            memo: dict[str, dict] = {}
            for doc, item, text, query in zip(*(batch.column(c).to_pylist() for c in ("doc", "item", "doc_text", "item_text"))):
                if query not in memo:
                    memo[query] = {s: i for i, s in enumerate(sorted(shingle_set(encoded(query), width)))}
                q, words = memo[query], encoded(text).translate(LOWER).split()
                k = len(next(iter(q))) if q else 0
                if k < width and len(words) != k:
                    continue
                hit = sorted({q[s] for s in zip(*(words[i:] for i in range(k))) if s in q})
                if hit:
                    out.append((doc, item, query, len(q), hit))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 5, (
                    batch.column("doc").type, batch.column("item").type, pa.string(), pa.int64(), pa.list_(pa.int32())))],
                ["doc", "item", "query", "n_shingles", "hits"],
            )

    found = pairs.mapInArrow(run, f"doc {kinds['doc']}, item {kinds['item']}, query string, n_shingles long, hits array<int>")
    # a set of hits is at most as large as the item; equal ones of copies combine before the shuffle
    united = found.groupBy("doc", "item", F.sha2("query", 256).alias("query"), "n_shingles").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("hits")))).alias("n")
    )
    return united.where(F.col("n") >= share * F.col("n_shingles") - 1e-9).select(
        "doc", "item", "n_shingles", (F.col("n") / F.col("n_shingles")).alias("containment")
    )


def search(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id",
    width: int = 5, share: float = 0.8, bits: int = 20,
) -> DataFrame:
    """Pairs ``doc, item`` where the document holds at least ``share`` of the item's shingles."""
    sketch = stage(sketches(items, item_id, width, share), "sketch")
    # flags of the hashes' low bits: a filter of fixed size, whatever the number of items
    table = flags(sketch.select(F.col("hash").bitwiseAND((1 << bits) - 1).alias("low")), "low", bits)
    hits = probes(docs, doc_id, width, table).join(sketch, "hash")
    pairs = stage(hits.select("doc", "item").distinct(), "leak-candidates")
    texts = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), F.col("text").alias("doc_text"))
    queries = items.select(F.col(item_id).alias("item"), F.col("text").alias("item_text"))
    # only documents with a candidate move
    found = texts.join(pairs, "doc").join(queries, "item")
    return verified(found, width, share).groupBy("doc", "item").agg(
        F.max("n_shingles").alias("n_shingles"), F.max("containment").alias("containment")
    )


SQL = r"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
bs AS (SELECT DISTINCT id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM bs GROUP BY id)
SELECT ds.id AS doc_id, bs.id AS item_id, any_value(n.n) AS n_shingles, count(*) / any_value(n.n) AS containment
FROM bs JOIN ds ON ds.s = bs.s JOIN n ON n.id = bs.id GROUP BY 1, 2 HAVING count(*) >= 0.8 * any_value(n.n)
"""
