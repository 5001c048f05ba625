"""Conversation structure repair: depth-first branch-and-bound over the edits of each conversation.

A repaired conversation is empty or an optional system row followed by pairs of user and
assistant rows (only the first letter of a role counts). Edits: Keep (0), Rerole to user or
assistant (2), Delete (3, the only edit of blank and duplicate rows), Insert an empty row (2);
a truncated row that stays adds 1. Of the cheapest edit strings the least in ASCII order is taken.

A node of the search is (rows done, state of the role pattern). The search keeps an explicit
stack, the best (cost, audit) that reached each node (a worse prefix of the same node can't
win), a lower bound of each suffix (forced deletes, truncated rows, and one per illegal pair of
neighbours, since an edit of cost 2 mends two pairs at most) and the incumbent (cost, audit) of
each end; it ends when the stack is empty. Conversations longer than ``SPAN`` rows are cut: every span is
searched from each entry state to each exit state and the results are chained. Inserts before
a row belong to its span, so no audit of a span is a prefix of another of the same cost, and the chained string
is the least one. Work is linear in the number of rows.

Rows are partitioned by conversation, sorted by (turn with nulls first, role, text) with spilling sorts, and streamed;
a row is held until all open alternatives agree on its span. A conversation of any length therefore passes
through one task as a stream; its hash in the report is one chain over its text, which can't be split.

Defined results: a null role or text is one space; a null conversation id is a conversation of
its own; null turns come first; equal rows are duplicates; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SPAN = 24
#: next state by (state, role letter); states: start, system, user, assistant
NEXT = {("-", "s"): "s", ("-", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
#: what an inserted or renamed row must be
TURN = {"-": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")


def bounds(rows: str) -> list[int]:
    """Lower bound of the cost of every suffix of ``rows`` (two letters a row: role, fault)."""
    n = len(rows) // 2
    out, after = [0] * (n + 1), ""
    for i in range(n - 1, -1, -1):
        role, fault = rows[2 * i], rows[2 * i + 1]
        if fault == "x":
            out[i] = out[i + 1] + 3
        else:
            out[i] = out[i + 1] + (fault == "t") + (bool(after) and role + after not in LEGAL)
            after = role
    return out


@lru_cache(maxsize=100_000)
def search(rows: str, entry: str, last: bool) -> dict[str, tuple[int, str]]:
    """Cheapest ``(cost, audit)`` per exit state; ``last``: only ends of a whole conversation.

    ``rows`` has two letters a row: s, u, a or o (other) and x (must go), t (truncated) or k.
    """
    n, low = len(rows) // 2, bounds(rows)
    exits = ("-", "a") if last else ("-", "s", "u", "a")
    best: dict[str, tuple[int, str]] = {}
    table: dict[tuple[int, str], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    ceiling = None  # cost beyond which no exit can be improved
    while stack:
        i, state, cost, audit = stack.pop()
        if ceiling is not None and cost + low[i] > ceiling:
            continue
        known = table.get((i, state))
        if known is not None and known <= (cost, audit):
            continue
        table[i, state] = (cost, audit)
        if i == n and state in exits:
            if state not in best or (cost, audit) < best[state]:
                best[state] = (cost, audit)
                if last:
                    top = min(best.values())
                    best = {k: v for k, v in best.items() if v == top}
                    ceiling = top[0]
                elif len(best) == 4 or (entry != "-" and len(best) == len(exits) - (2 if entry in "ua" else 1)):
                    ceiling = max(c for c, _ in best.values())
        turn = TURN[state]
        moves = []
        if i < n or last:
            moves.append((i, turn, cost + 2, audit + "I"))
        if i < n:
            role, fault = rows[2 * i], rows[2 * i + 1]
            moves.append((i + 1, state, cost + 3, audit + "D"))
            if fault != "x":
                more = fault == "t"
                moves.append((i + 1, turn, cost + 2 + more, audit + "R"))
                kept = NEXT.get((state, role))
                if kept:
                    moves.append((i + 1, kept, cost + more, audit + "K"))
        # the cheapest bound is on top of the stack
        moves.sort(key=lambda m: (-m[2] - low[m[0]], -m[0]))
        stack += moves
    return best


class Chain:
    """One conversation while it is streamed: open alternatives and the spans they don't agree on yet."""

    def __init__(self):
        self.front: dict[str, tuple[int, list[tuple[str, str]]]] = {"-": (0, [])}
        self.spans: list[list] = []

    def add(self, rows: list, last: bool):
        """Take a span; give ``(rows, entry state, audit)`` of the spans that are settled."""
        code = "".join(r[0] for r in rows)
        found: dict[str, tuple[int, list]] = {}
        for entry, (cost, path) in self.front.items():
            for end, (more, audit) in search(code, entry, last).items():
                new = (cost + more, [*path, (entry, audit)])
                old = found.get(end)
                if old is None or new[0] < old[0] or (
                    new[0] == old[0] and "".join(a for _, a in new[1]) < "".join(a for _, a in old[1])
                ):
                    found[end] = new
        if last:
            win = min(found.values(), key=lambda v: (v[0], "".join(a for _, a in v[1])))
            found = {"a": win}
        # an alternative that another overtakes by more than the states' difference can't win:
        # the assistant state offers what the others do, save keeping a system row (3)
        for state, slack in (("s", 0), ("-", 3)):
            if "a" in found and state in found and found[state][0] > found["a"][0] + slack:
                del found[state]
        self.front = found
        self.spans.append(rows)
        while self.spans:
            first = {path[0] for _, path in found.values()}
            if len(first) > 1:
                break
            (entry, audit), rows = first.pop(), self.spans.pop(0)
            for _, path in found.values():
                del path[0]
            yield rows, entry, audit


def applied(rows: list, state: str, audit: str):
    """``row or None, edit, role, text, cost`` of one span."""
    at = iter(rows)
    for edit in audit:
        row = None if edit == "I" else next(at)
        if edit == "D":
            yield row, edit, None, None, 3
            continue
        role = NAMES[TURN[state]] if edit in "IR" else row[3]
        state = NEXT[state, role[:1]]
        yield row, edit, role, "" if row is None else row[4], (0 if edit == "K" else 2) + (row is not None and row[0][1] == "t")


EDITS = "pos long, turn long, fault string, illegal boolean, edit string, role string, text string, cost int"


def faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with ``fault`` (blank, duplicate, truncated or null), in order of the conversations."""
    held = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    ).repartition("conv_id")
    copy = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    tail = F.rtrim("text", F.lit(SPACES))
    fault = (
        F.when(tail == "", "blank").when(copy > 1, "duplicate").when(~F.right(tail, F.lit(1)).isin(".", "!", "?"), "truncated")
    )
    return held.withColumn("fault", fault).sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"
    )


def repair(rows: DataFrame) -> DataFrame:
    """Edits of every conversation of ``conv_id, turn, role, text``, in order within each partition.

    One row per edit: ``pos`` from 0, the original ``turn``, ``fault`` and ``illegal`` (role pair with
    the row before it; null for inserts), ``edit`` (K, R, D, I), repaired ``role`` and ``text`` (null if deleted), ``cost``.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        chain, span, conv, pos, before, some = None, [], None, 0, None, False
        out: list[tuple] = []

        def settle(last):
            nonlocal span, pos
            for done, state, audit in chain.add(span, last):
                for row, edit, role, text, cost in applied(done, state, audit):
                    own = (None, None, None) if row is None else (row[1], row[2], row[5])
                    out.append((conv, pos, *own, edit, role, text, cost))
                    pos += 1
            span = []

        for batch in batches:
            names = ["conv_id", "turn", "role", "text", "fault"]
            arrow = batch.schema.field("conv_id").type
            for key, turn, role, text, fault in zip(*(batch.column(c).to_pylist() for c in names)):
                if not some or key != conv:
                    if some:
                        settle(True)
                    chain, conv, pos, before, some = Chain(), key, 0, None, True
                elif len(span) == SPAN:
                    settle(False)
                letter = role[:1]
                gone = fault in ("blank", "duplicate")
                code = (letter if letter and letter in "sua" else "o") + ("x" if gone else "t" if fault else "k")
                illegal = before is not None and before + letter not in LEGAL
                # what must go needs no text
                span.append((code, turn, fault, role, None if gone else text, illegal))
                before = letter
            if out:
                yield _batch(out, arrow)
                out = []
        if some:
            settle(True)
            yield _batch(out, arrow)

    return faults(rows).mapInArrow(run, f"conv_id {kind}, {EDITS}")


def _batch(out: list[tuple], kind) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int32()]
    names = ["conv_id", *(f.split()[0] for f in EDITS.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
REPORT = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"


def report(edits: DataFrame) -> DataFrame:
    """One row per conversation of :func:`repair`: counts, cost, edit string and hash of the repaired rows.

    Reads the edits as :func:`repair` streams them, so it needs no shuffle.
    """
    kind = edits.schema["conv_id"].dataType.simpleString()

    def run(batches):
        conv, some = None, False
        out: list[tuple] = []
        arrow = None

        def close():
            gaps = high - low + 1 - turns if turns else 0
            out.append((conv, gaps, *(counts[c] for c in COUNTS[1:]), "".join(audit), digest.hexdigest()))

        for batch in batches:
            arrow = batch.schema.field("conv_id").type
            for key, turn, fault, illegal, edit, role, text, cost in zip(*(
                batch.column(c).to_pylist() for c in ("conv_id", "turn", "fault", "illegal", "edit", "role", "text", "cost")
            )):
                if not some or key != conv:
                    if some:
                        close()
                    conv, some, audit, digest, first = key, True, [], hashlib.sha256(), True
                    counts, low, high, turns = dict.fromkeys(COUNTS, 0), None, None, 0
                audit.append(edit)
                counts["cost"] += cost
                if fault:
                    counts[fault] += 1
                counts["illegal"] += bool(illegal)
                if turn is not None and edit != "I" and turn != high:
                    low, high, turns = turn if low is None else low, turn, turns + 1
                if edit != "D":
                    digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode("utf-8", "replace"))
                    first = False
            if out:
                yield _rows(out, arrow)
                out = []
        if some:
            close()
            yield _rows(out, arrow)

    return edits.mapInArrow(run, f"conv_id {kind}, {REPORT}")


def _rows(out: list[tuple], kind) -> pa.RecordBatch:
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    types = [kind, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def key_text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """Rows with planted faults by crc32 of ``conv_id:turn``: drop, empty, unfinished, repeated, wrong role."""
    code = F.crc32(F.concat(key_text("conv_id"), F.lit(":"), key_text("turn"))) % 20
    text = F.coalesce("text", F.lit(" "))
    return (
        rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), code.alias("code"))
        .where(F.col("code") != 0)
        .select(
            "conv_id", "turn",
            F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
        )
        .drop("copy")
    )


def audit(conversations: DataFrame) -> DataFrame:
    """Report of every conversation of the damaged table; one without rows is empty already."""
    done = report(repair(damage(conversations)))
    ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    zero = F.lit(0).cast("long")
    return ids.join(done, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"), *(F.coalesce(c, zero).alias(c) for c in COUNTS),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
