import hashlib
import random
import re
import zlib
from itertools import product

from riskflow.llm import repair
from riskflow.llm.common import read

PATTERN = re.compile(r"(s?(ua)+)?")


def brute_search(rows):
    """All edit strings of a short conversation, at most two inserts before each row."""
    best = None
    for edits in product("KRD", repeat=len(rows)):
        for ins in product(range(3), repeat=len(rows) + 1):
            cost = 2 * sum(ins)
            letters = []
            for (role, fault), e, k in zip(rows, edits, ins):
                letters += ["?"] * k
                if fault == "x" and e != "D":
                    cost = None
                    break
                cost += {"K": 0, "R": 2, "D": 3}[e] + (e != "D" and fault == "t")
                letters += {"K": [role], "R": ["?"], "D": []}[e]
            if cost is None or (best and cost > best[0]):
                continue
            letters += ["?"] * ins[-1]
            # a free letter is the only one that fits: u after nothing, s or a, else a
            text = ""
            for c in letters:
                text += ("a" if text[-1:] == "u" else "u") if c == "?" else c
            if PATTERN.fullmatch(text):
                audit = "".join("I" * k + e for k, e in zip(ins, [*edits, ""]))
                best = min(best, (cost, audit)) if best else (cost, audit)
    return best


def brute(rows):
    """(cost, audit) by a table of all prefixes."""
    now = {"-": (0, "")}

    def inserts(now):
        for _ in range(4):
            for q, (c, a) in list(now.items()):
                new = (c + 2, a + "I")
                t = "a" if q == "u" else "u"
                if t not in now or new < now[t]:
                    now[t] = new
        return now

    for role, fault in rows:
        after = {}
        for q, (c, a) in inserts(now).items():
            t = "a" if q == "u" else "u"
            ways = [(q, c + 3, "D")]
            if fault != "x":
                ways.append((t, c + 2 + (fault == "t"), "R"))
                if role == t or (q == "-" and role == "s"):
                    ways.append((role, c + (fault == "t"), "K"))
            for end, cost, e in ways:
                if end not in after or (cost, a + e) < after[end]:
                    after[end] = (cost, a + e)
        now = after
    return min(v for q, v in inserts(now).items() if q in "-a")


def brute_audit(rows):
    ids = {r[0] for r in rows}
    out = {}
    for i in ids:
        got = []
        for conv, turn, role, text in rows:
            if conv != i:
                continue
            role, text = (" " if v is None else v for v in (role, text))
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            code = zlib.crc32(key.encode()) % 20
            if code == 0:
                continue
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            got += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in got:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        code = [(r[1][:1], {"blank": "x", "duplicate": "x", "truncated": "t", "": "k"}[f]) for r, f in zip(got, faults)]
        cost, audit = brute(code)
        lines, state, at = [], "", iter(got)
        for e in audit:
            row = None if e == "I" else next(at)
            if e != "D":
                role = row[1] if e == "K" else "assistant" if state == "u" else "user"
                lines.append(f"{role}:{row[2] if row else ''}")
                state = role[:1]
        turns = [r[0] for r in got if r[0] is not None]
        pairs = [a[0] + b[0] for a, b in zip(code, code[1:])]
        out[i] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def found(df):
    return {r.conv_id: tuple(r)[1:] for r in df.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def test_search_is_optimal():
    rnd = random.Random(1)
    for _ in range(250):
        rows = [(rnd.choice("suao"), rnd.choice("kkkktx")) for _ in range(rnd.randrange(5))]
        code = "".join(r + f for r, f in rows)
        best = min(repair.search(code, "-", True).values())
        assert best == brute(rows) == brute_search(rows)


def test_chained_spans(monkeypatch):
    rnd = random.Random(2)
    for span in (1, 2, 5, 24):
        monkeypatch.setattr(repair, "SPAN", span)
        for _ in range(300):
            letters = rnd.choice(["suao", "ua", "u", "oa"])
            rows = [(rnd.choice(letters), rnd.choice(rnd.choice(["k", "kktx", "t", "x"]))) for _ in range(rnd.randrange(1, 40))]
            chain, cost, audit = repair.Chain(), 0, ""
            for i in range(0, len(rows), span):
                part = [(r + f, 0, None, r, "", False) for r, f in rows[i : i + span]]
                for done, state, edits in chain.add(part, i + span >= len(rows)):
                    audit += edits
                    cost += sum(e[4] for e in repair.applied(done, state, edits))
            assert (cost, audit) == brute(rows)


def test_whole_table(spark):
    rows = [tuple(r) for r in read(spark, "/root/testdata/sf0.01", "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = repair.audit(read(spark, "/root/testdata/sf0.01", "conversations"))
    assert found(got) == brute_audit(rows)


def test_odd_rows(spark):
    rnd = random.Random(3)
    rows = []
    for conv in [None, *range(60)]:
        for _ in range(rnd.choice([1, 2, 6, 30, 120])):
            turn = rnd.choice([None, *range(-3, 60)])
            role = rnd.choice([None, "", "user", "assistant", "system", "tool", "Süd"])
            rows.append((conv, turn, role, rnd.choice([None, "", " \t", "Yes.", "no", "öffne!", "a?\n", "x ", "long " * 500])))
    rows += rows[:40]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, pos int, fault string")
    assert found(repair.audit(df)) == brute_audit(rows)
    assert repair.audit(df.limit(0)).count() == 0


def test_one_long_conversation_streams(spark):
    rows = [(7, t, "user" if t % 3 else "assistant", f"turn {t}." if t % 5 else "same") for t in range(6000)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    assert found(repair.audit(df)) == brute_audit(rows)
    edits = repair.repair(df)
    assert edits.where("edit = 'D'").where("text IS NOT NULL").count() == 0
