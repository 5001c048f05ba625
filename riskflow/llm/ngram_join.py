"""Similarity join of documents on word n-grams: exact Jaccard links and their components.

Documents with equal shingle sets form a class; only classes are compared. Shingles are
ordered rare-first by a count table of fixed size (shingles are hashed into ``2**bits``
counters over all classes; any order is exact, frequent shingles merely have to come last).
The prefix of a class holds so many of its first shingles that two linked classes share at
least one. Classes meet on prefix shingles; a meeting survives the length filter, the
positional filter and a suffix filter (counts of shingles per hash range bound the overlap),
and every surviving pair is verified once on the whole sets.

Only components are wanted, so no group emits all its pairs. Groups of up to ``small`` rows
do; in a larger one each row first meets a few others in a fixed order. What the parities of both
sets leave of these pairs is verified on the whole sets, one pair per class
first, then those of the others that still lie between components. After these
links are joined, larger groups are met in full between rows of *different*
components only, in blocks of bounded size. Their rows carry the whole sets: what the parities of
the shingles per hash slot (a bound of the difference that is nearly tight) leave is decided there,
and a block gives only links that join components which its other links do not join already. No
link between components is lost.

Defined results: null or empty texts have no shingles, a component of their own, and no
links; a row without id has a null component and links nothing; rows that share an id are
one node; repeated rows appear once each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import LOWER, drop, encoded, flags, shingle_hashes, stage, word_hashes

RING = (1, 2, 4, 8)
RANGES = 16
#: shingles that a block of a larger group holds, about; 32 MB of sets
HELD = 4_000_000
POSTING = "gram long, key binary, n int, at int, low long, high long"
POSTING_NAMES = [f.split()[0] for f in POSTING.split(", ")]


def shingles(text: str | None, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(encoded(text).translate(LOWER).split()), width))


def key_of(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def first_pass(docs: DataFrame, ident: str, width: int, bits: int) -> DataFrame:
    """Two kinds of rows: ``ident, n_shingles, key`` per document, ``slice, counts`` per task.

    The counters cover all texts with an id; a task sends its ``2**bits`` counters in slices.
    """
    size, step = 1 << bits, min(1024, 1 << bits)
    kind = docs.schema[ident].dataType.simpleString()
    names = [ident, "n_shingles", "key", "slice", "counts"]

    def run(batches):
        table, of = np.zeros(size, np.uint32), None
        for batch in batches:
            of, sizes, keys = batch.column(0).type, [], []
            for row, text in zip(batch.column(0), batch.column(1)):
                grams = shingles(text.as_py(), width)
                sizes.append(len(grams))
                keys.append(key_of(grams) if len(grams) else None)
                if row.is_valid:
                    np.add.at(table, (grams & np.uint64(size - 1)).astype(np.int64), np.uint32(1))
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                names,
            )
        filled = [i for i in range(size // step) if table[i * step : (i + 1) * step].any()]
        parts = [table[i * step : (i + 1) * step].tobytes() for i in filled]
        n = len(filled)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, of), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(filled, pa.int32()), pa.array(parts, pa.binary())],
                names,
            )

    schema = f"`{ident}` {kind}, n_shingles long, key binary, slice int, counts binary"
    return docs.select(ident, "text").mapInArrow(run, schema)


def count_table(slices: DataFrame, bits: int) -> np.ndarray:
    """The sum of all tasks' counters, added up as they stream in; the driver receives one table."""
    size, step = 1 << bits, min(1024, 1 << bits)

    def add(batches):
        now, total = None, None
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i != now:
                    if now is not None:
                        yield one(now, total)
                    now, total = i, np.zeros(step, np.int64)
                total += np.frombuffer(part.as_py(), np.uint32)
        if now is not None:
            yield one(now, total)

    def one(i: int, total: np.ndarray) -> pa.RecordBatch:
        part = np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part], pa.binary())], ["slice", "counts"])

    parts = int(slices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = slices.select("slice", "counts").repartition(parts, "slice").sortWithinPartitions("slice")
    out = np.zeros(size, np.uint32)
    for r in dealt.mapInArrow(add, "slice int, counts binary").collect():
        out[r["slice"] * step : (r["slice"] + 1) * step] = np.frombuffer(r.counts, np.uint32)
    return out


def spread_of(grams: np.ndarray) -> tuple[int, int]:
    """Counts of shingles in 16 hash ranges, modulo 256, as two longs."""
    counts = np.bincount((grams >> np.uint64(60)).astype(np.int64), minlength=RANGES)
    return tuple(int(v) for v in counts.astype(np.uint8).view(np.int64))


def postings(texts: DataFrame, width: int, percent: int, table: np.ndarray) -> DataFrame:
    """Prefix shingles of every class met in a task, with position, set size and range counts."""
    sent = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        counts = sent.value
        low = np.uint64(len(counts) - 1)
        seen: set[bytes] = set()  # copies within a task; the rest of them goes after the shuffle
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                cols: list[list] = [[], [], [], [], [], []]
                for text in batch.column(0).slice(start, 500):
                    grams = shingles(text.as_py(), width)
                    n, key = len(grams), key_of(grams)
                    if not n or key in seen:
                        continue
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(key)
                    prefix = n - (percent * n + 99) // 100 + 1
                    rare = np.lexsort((grams, counts[(grams & low).astype(np.int64)]))[:prefix]
                    a, b = spread_of(grams)
                    cols[0].append(grams[rare].view(np.int64))
                    cols[1] += [key] * prefix
                    for c, v in zip(cols[2:], (np.full(prefix, n), np.arange(prefix), np.full(prefix, a), np.full(prefix, b))):
                        c.append(v)
                if cols[1]:
                    kinds = (np.int64, None, np.int32, np.int32, np.int64, np.int64)
                    made = [pa.array(c, pa.binary()) if t is None else pa.array(np.concatenate(c).astype(t)) for c, t in zip(cols, kinds)]
                    yield pa.RecordBatch.from_arrays(made, POSTING_NAMES)

    return texts.mapInArrow(run, POSTING)


def may_link(a: dict, i: np.ndarray, b: dict, j: np.ndarray, percent: int) -> np.ndarray:
    """Length, positional and suffix filter for the rows ``i`` of ``a`` and ``j`` of ``b``."""
    na, nb = a["n"][i].astype(np.int64), b["n"][j].astype(np.int64)
    ok = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    i, j, na, nb = i[ok], j[ok], na[ok], nb[ok]
    need = -(-percent * (na + nb) // (100 + percent))
    best = np.minimum(na - a["at"][i], nb - b["at"][j]) + np.minimum(a["at"][i], b["at"][j])
    apart = a["spread"][i] - b["spread"][j]  # modulo 256: never more than the true difference
    apart = np.minimum(apart, -apart).astype(np.int64).sum(axis=1)
    good = (best >= need) & (na + nb - 2 * need >= apart) & (a["key"][i] != b["key"][j])
    ok[ok] = good
    return ok


def rows_of(batch: pa.RecordBatch) -> dict:
    col = {n: batch.column(n) for n in batch.schema.names}
    spread = np.stack([col["low"].to_numpy(), col["high"].to_numpy()], axis=1).view(np.uint8)
    out = {n: col[n].to_numpy() for n in ("gram", "n", "at")}
    return out | {"spread": spread, "key": np.array(col["key"].to_pylist(), dtype=object)}


def pair_batch(left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    swap = left > right
    a, b = np.where(swap, right, left), np.where(swap, left, right)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def with_nulls(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    have = dict(zip(batch.schema.names, batch.columns))
    return pa.RecordBatch.from_arrays([have.get(f.name, pa.nulls(batch.num_rows, f.type)) for f in schema], schema=schema)


def first_meetings(rows: DataFrame, percent: int, small: int) -> DataFrame:
    """Candidate pairs ``a, b``: all of small groups, ring neighbours of larger ones.

    The rows of larger groups come out as well, with null ``a`` and ``b``.
    """
    kinds = [("a", pa.binary()), ("b", pa.binary()), *zip(POSTING_NAMES, (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))]
    schema = pa.schema(kinds)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turn = rows.withColumn("_turn", F.xxhash64("key")).repartition(parts, "gram")
    turn = turn.sortWithinPartitions("gram", "_turn", "key").drop("_turn")

    def meet(r: dict, size: np.ndarray):
        for step in range(1, min(len(size), small)):
            near = r["gram"][step:] == r["gram"][:-step]
            if not near.any():
                break
            if step not in RING:
                near &= size[step:] <= small
            i = np.flatnonzero(near)
            i = i[may_link(r, i, r, i + step, percent)]
            if len(i):
                yield pair_batch(r["key"][i], r["key"][i + step])

    def run(batches):
        held, large, told = None, False, 0  # rows of the last group, which may go on; those that came out
        for batch in batches:
            if not batch.num_rows:
                continue
            r = rows_of(batch)
            opened = held["gram"][0] if held is not None else None
            if held is not None:
                r = {k: np.concatenate([held[k], r[k]]) for k in r}
            new = np.r_[True, (r["gram"][1:] != r["gram"][:-1]) | (r["key"][1:] != r["key"][:-1])]
            r = {k: v[new] for k, v in r.items()}
            edge = np.flatnonzero(np.r_[True, r["gram"][1:] != r["gram"][:-1]])
            length = np.diff(np.r_[edge, len(r["gram"])])
            size = np.repeat(length, length)
            if large:  # most of the open group's rows are gone
                size[r["gram"] == opened] = small + 1
            last = r["gram"] == r["gram"][-1]
            large = bool(size[-1] > small)
            hot = size > small
            hot[:told] = False
            if hot.any():
                spread = np.ascontiguousarray(r["spread"][hot]).view(np.int64)
                cols = (r["gram"], r["key"], r["n"], r["at"])
                rows_out = [pa.array(c[hot], t) for c, (_, t) in zip(cols, kinds[2:])] + [pa.array(spread[:, i].copy()) for i in (0, 1)]
                yield with_nulls(pa.RecordBatch.from_arrays(rows_out, POSTING_NAMES), schema)
            done = np.ones(len(last), bool) if large else ~last
            for pairs in meet({k: v[done] for k, v in r.items()}, size[done]):
                yield with_nulls(pairs, schema)
            tail = np.flatnonzero(last)[-max(RING) :] if large else np.flatnonzero(last)
            held = {k: v[tail] for k, v in r.items()}
            told = len(tail) if large else 0
        if held is not None and not large:
            for pairs in meet(held, np.full(len(held["gram"]), len(held["gram"]))):
                yield with_nulls(pairs, schema)

    return turn.mapInArrow(run, "a binary, b binary, " + POSTING)


def parity(grams: np.ndarray) -> bytes:
    """One bit for each of at least ``4 * len(grams)`` hash slots: is its number of shingles odd?

    Two sets differ in at least as many shingles as their parities do in bits.
    """
    slots = max(512, 1 << (4 * len(grams) - 1).bit_length())
    at = (grams & np.uint64(slots - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=slots) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Parities (uint64, last axis) with ``size`` numbers: slots with equal low bits are united."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


class Parities:
    """The parities of a block's rows, as one table for each size."""

    def __init__(self, rows: list[bytes]):
        self.size = np.array([len(r) // 8 for r in rows])
        self.at = np.zeros(len(rows), np.int64)
        self.tables = {}
        for size in np.unique(self.size).tolist():
            here = np.flatnonzero(self.size == size)
            self.at[here] = np.arange(len(here))
            self.tables[size] = np.frombuffer(b"".join(rows[i] for i in here), np.uint64).reshape(-1, size)

    def apart(self, one: bytes, rows: np.ndarray) -> np.ndarray:
        """In how many bits ``one`` and each of ``rows`` differ."""
        mine, out = np.frombuffer(one, np.uint64), np.zeros(len(rows), np.int64)
        for size, table in self.tables.items():
            here = np.flatnonzero(self.size[rows] == size)
            least = min(size, len(mine))
            for start in range(0, len(here), 512):
                part = here[start : start + 512]
                other = folded(table[self.at[rows[part]]], least)
                out[part] = np.bitwise_count(other ^ folded(mine, least)).sum(axis=1)
        return out


def later_meetings(hot: DataFrame, labels: DataFrame, docs: DataFrame, leads: DataFrame, ident: str, width: int, percent: int, block: int) -> DataFrame:
    """Links ``a, b`` that join what the larger groups, whose rows ``hot`` are, hold of different components.

    The rows carry their sets, so a pair is decided where it meets. Of each block's links only those
    come out that join two components which its earlier links have not joined: fewer than its rows.
    """
    hot = hot.dropDuplicates(["gram", "key"])
    named = hot.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    groups = named.groupBy("gram").agg(
        F.count("*").alias("_n"), F.sum("n").alias("_all"), F.min("label").alias("_a"), F.max("label").alias("_b")
    ).where(F.col("_a") != F.col("_b")).select(
        "gram", F.ceil(F.greatest(F.col("_n") / block, F.col("_all") / HELD)).cast("int").alias("_blocks")
    )
    mine = F.pmod(F.xxhash64("key"), F.col("_blocks")).cast("int")
    hot = stage(named.join(groups, "gram").withColumn("_mine", mine), "ngram-hot")
    grams = class_sets(hot.select("key").distinct(), docs, leads, ident, width, np.ndarray.tobytes, "ngram-sets")
    full = hot.join(grams.withColumnRenamed("grams", "own"), "key")
    held = full.select(*POSTING_NAMES, "own", "label", F.col("_mine").alias("_block"), F.lit(0).alias("_side"))
    # each block meets itself and those before it
    met = full.where(F.col("_mine") + 1 < F.col("_blocks")).select(
        *POSTING_NAMES, "own", "label", F.explode(F.sequence(F.col("_mine") + 1, F.col("_blocks") - 1)).alias("_block"), F.lit(1).alias("_side")
    )
    parts = int(hot.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = held.unionByName(met).repartition(parts, "gram", "_block").sortWithinPartitions("gram", "_block", "_side", "key")

    def run(batches):
        now, store, cell = None, [], None
        for batch in batches:
            r = rows_of(batch)
            r["label"] = np.array(batch.column("label").to_pylist(), dtype=object)
            r["own"] = np.array(batch.column("own").to_pylist(), dtype=object)
            side, where = batch.column("_side").to_numpy(), batch.column("_block").to_numpy()
            cuts = np.flatnonzero(
                np.r_[True, (r["gram"][1:] != r["gram"][:-1]) | (where[1:] != where[:-1]) | (side[1:] != side[:-1])]
            ) if len(side) else []
            for a, b in zip(cuts, [*cuts[1:], len(side)]):
                part = {k: v[a:b] for k, v in r.items()}
                name = (part["gram"][0], where[a])
                if name != now:
                    if store:
                        yield from Cell(store, percent).inner()
                    now, store, cell = name, [], None
                if side[a] == 0:
                    store.append(part)
                    continue
                if store:
                    cell, store = Cell(store, percent), []
                    yield from cell.inner()
                if cell is not None:
                    yield from cell.outer(part)
        if store:
            yield from Cell(store, percent).inner()

    found = stage(both.mapInArrow(run, "a binary, b binary").distinct(), "ngram-later")
    drop(hot, grams)
    return found


class Cell:
    """The rows of a block that are held; yields the links which join components not joined before."""

    def __init__(self, parts: list[dict], percent: int):
        self.rows = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        self.percent = percent
        self.odd = [parity(np.frombuffer(s, np.uint64)) for s in self.rows["own"]]
        self.odds = Parities(self.odd)
        self.number: dict[bytes, int] = {}
        self.tree = np.empty(0, np.int64)
        self.label = self.numbers(self.rows["label"])

    def numbers(self, labels: np.ndarray) -> np.ndarray:
        """Number of each label; new labels are trees of their own."""
        out = np.array([self.number.setdefault(x, len(self.number)) for x in labels], np.int64)
        self.tree = np.r_[self.tree, np.arange(len(self.tree), len(self.number))]
        return out

    def inner(self):
        for i in range(1, len(self.label)):
            yield from self.meet(self.rows, i, self.label[i], self.odd[i], i)

    def outer(self, part: dict):
        for i, label in enumerate(self.numbers(part["label"])):
            yield from self.meet(part, i, label, parity(np.frombuffer(part["own"][i], np.uint64)), len(self.label))

    def meet(self, part: dict, i: int, label: int, odd: bytes, upto: int):
        """Row ``i`` of ``part`` and the first ``upto`` rows held, the least different first."""
        other = np.flatnonzero(self.tree[self.label[:upto]] != self.tree[label])
        other = other[may_link(part, np.full(len(other), i), self.rows, other, self.percent)]
        apart = self.odds.apart(odd, other)
        able = apart <= most_apart(part["n"][i].astype(np.int64) + self.rows["n"][other], self.percent)
        linked = []
        for j in other[able][np.argsort(apart[able], kind="stable")].tolist():
            mine, yours = self.tree[label], self.tree[self.label[j]]
            if mine != yours and overlaps(part["own"][i], self.rows["own"][j], self.percent):
                self.tree[self.tree == yours] = mine
                linked.append(j)
        if linked:
            yield pair_batch(np.full(len(linked), part["key"][i], object), self.rows["key"][linked])


def overlaps(x: bytes, y: bytes, percent: int) -> bool:
    """Do the sets reach the threshold?"""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def class_sets(keys: DataFrame, docs: DataFrame, leads: DataFrame, ident: str, width: int, form, name: str) -> DataFrame:
    """``key, grams`` of the classes ``keys``: ``form`` of the set. ``leads``: ``key`` and one id of the class.

    The sets are made anew from the texts; only those of ids that pass a filter, sized by the
    number of classes up to ``2**26`` slots, are shuffled, and once.
    """
    ids = stage(leads.join(keys, "key"), "ngram-wanted")
    bits = min(26, max(20, (16 * ids.count()).bit_length()))
    slot = F.xxhash64(ident).bitwiseAND((1 << bits) - 1).alias("slot")
    sent = docs.sparkSession.sparkContext.broadcast(flags(ids.select(slot), "slot", bits))

    def sets(batches):
        for batch in batches:
            batch = batch.filter(pa.array(sent.value[batch.column("slot").to_numpy()]))
            for start in range(0, batch.num_rows, 500):
                own = [shingles(t.as_py(), width) for t in batch.column("text").slice(start, 500)]
                own = [g for g in own if len(g)]
                yield pa.RecordBatch.from_arrays([pa.array(map(key_of, own), pa.binary()), pa.array(map(form, own), pa.binary())], ["key", "grams"])

    made = docs.where(F.col(ident).isNotNull()).select("text", slot).mapInArrow(sets, "key binary, grams binary")
    out = stage(made.groupBy("key").agg(F.first("grams").alias("grams")).join(ids.select("key"), "key", "left_semi"), name)
    drop(ids)
    return out


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()


def most_apart(n: np.ndarray, percent: int) -> np.ndarray:
    """In how many shingles two linked sets with ``n`` shingles together may differ."""
    # 100 * overlap >= percent * (n - overlap)
    return n - 2 * -(-percent * n // (100 + percent))


def likely(pairs: DataFrame, docs: DataFrame, leads: DataFrame, ident: str, width: int, percent: int) -> DataFrame:
    """The pairs that may be links by their parities, which are a sixteenth of the sets."""
    odd = class_sets(ends_of(pairs), docs, leads, ident, width, lambda g: len(g).to_bytes(8, "little") + parity(g), "ngram-parity")
    left, right = (odd.withColumnsRenamed({"key": s, "grams": f"g{s}"}) for s in "ab")

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("ga"), batch.column("gb")):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                least = min(len(x), len(y)) - 1
                apart = np.bitwise_count(folded(x[1:], least) ^ folded(y[1:], least)).sum()
                ok.append(bool(apart <= most_apart(int(x[0]) + int(y[0]), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ga", "gb")
    out = stage(both.mapInArrow(run, "a binary, b binary"), "ngram-likely")
    drop(odd)
    return out


def verify(pairs: DataFrame, docs: DataFrame, leads: DataFrame, ident: str, width: int, percent: int) -> DataFrame:
    """The pairs whose sets reach the threshold."""
    grams = class_sets(ends_of(pairs), docs, leads, ident, width, np.ndarray.tobytes, "ngram-sets")
    left, right = (grams.withColumnsRenamed({"key": s, "grams": f"g{s}"}) for s in "ab")

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("ga"), batch.column("gb")):
                ok.append(overlaps(x.as_py(), y.as_py(), percent))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ga", "gb")
    links = stage(both.mapInArrow(run, "a binary, b binary"), "ngram-links")
    drop(grams)
    return links


def between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose ends lie in different components."""
    own = [labels.select(F.col("key").alias(s), F.col("label").alias(f"l{s}")) for s in "ab"]
    met = pairs.join(own[0], "a", "left").join(own[1], "b", "left")
    return met.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``key, label``: the smallest key of each linked class's component.

    Alternates large-star and small-star until no edge changes; both only ever regroup edges by
    one end, and each node keeps a single edge to its minimum.
    """
    edges = links.select("a", "b").where(F.col("a") != F.col("b")).distinct()
    edges, mark = stage(edges, "edges"), None
    while True:
        # large star: every larger neighbour moves to the smallest node in reach
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").where("a != b").distinct()
        # small star: smaller neighbours of a node, and the node, move to the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y"))
        new = stage(small.where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        mark, before = new.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first(), mark
        same = mark == before
        drop(edges)
        edges = new
        if same:
            break
    return edges.select(F.col("b").alias("key"), F.col("a").alias("label")).union(
        edges.select(F.col("a").alias("key"), F.col("a").alias("label")).distinct()
    )


def link(
    docs: DataFrame, ident: str = "doc_id", width: int = 3, percent: int = 90, bits: int = 20,
    small: int = 32, block: int = 2048,
) -> DataFrame:
    """``ident, n_shingles, component_id`` of every row of ``docs`` (columns ``ident, text``)."""
    made = stage(first_pass(docs, ident, width, bits), "ngram-classes")
    members = made.where("slice is null").select(ident, "n_shingles", "key")
    able = members.where(F.col("key").isNotNull() & F.col(ident).isNotNull())
    leads = able.groupBy("key").agg(F.min(ident).alias(ident))
    table = count_table(made.where("slice is not null"), bits)
    rows = postings(docs.where(F.col(ident).isNotNull()).select("text"), width, percent, table)
    first = stage(first_meetings(rows, percent, small), "ngram-first")
    met = stage(first.where("a is not null").select("a", "b").distinct(), "ngram-pairs")
    pairs = likely(met, docs, leads, ident, width, percent)
    drop(met)
    # one pair per class first: most others lie inside the components these links make
    tried = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = verify(tried, docs, leads, ident, width, percent)
    labels = stage(components(links), "ngram-labels")
    open_pairs = stage(between(pairs, labels).join(tried, ["a", "b"], "left_anti"), "ngram-open")
    links = links.union(verify(open_pairs, docs, leads, ident, width, percent))
    drop(pairs, open_pairs, labels)
    labels = stage(components(links), "ngram-labels")
    later = later_meetings(first.where("a is null").select(*POSTING_NAMES), labels, docs, leads, ident, width, percent, block)
    links = links.union(later)
    drop(first, labels)
    # an id with several texts is one node
    shared = able.groupBy(ident).agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a != z")
    same = able.join(shared, ident).select("a", F.col("key").alias("b")).where("a != b")
    labels = components(links.union(same))
    named = able.select(ident, "key").distinct().join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    roots = named.groupBy("label").agg(F.min(ident).alias("component_id"))
    by_key = named.select("key", "label").distinct().join(roots, "label").select("key", "component_id")
    out = members.join(by_key, "key", "left")
    own = F.when(F.col(ident).isNotNull(), F.coalesce("component_id", ident))
    return out.select(ident, "n_shingles", own.alias("component_id"))


#: DuckDB SQL of the query: shingles as texts, all links, and what each document reaches by them
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id != b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
  GROUP BY 1, 2 HAVING 100 * count(*) >= 90 * (any_value(x.n) + any_value(y.n) - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
