import random

from riskflow.llm import decontam


def brute(docs, items):
    out = {}
    for d, text in docs:
        for i, query in items:
            q = decontam.shingle_set((query or "").encode(), 5)
            have = decontam.shingle_set((text or "").encode(), 5)
            if q and d is not None and len(q & have) >= 0.8 * len(q) - 1e-9:
                out[d, i] = max(out.get((d, i), 0), len(q & have) / len(q))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, text(rnd.choice([3, 5, 6, 9, 20, 40, 70]))) for i in range(60)]
    docs = []
    for d in range(300):
        body = text(rnd.choice([10, 100, 3000])).split()
        query = rnd.choice(items)[1].upper().split()
        for _ in range(rnd.choice([0, 0, 1, 2])):
            query[rnd.randrange(len(query))] = "changed"
        at = rnd.randrange(len(body))
        docs.append((d, " ".join(body[:at] + query + body[at:]) if d % 2 else text(50)))
    docs += [(900, None), (901, ""), (902, items[0][1]), (902, items[0][1]), (None, items[1][1])]
    items += [(100, None), (101, ""), (102, "two words"), (0, items[0][1])]
    docs.append((903, "Two\nWORDS"))
    got = decontam.search(
        spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id int, text string, item int, hash string"),
        spark.createDataFrame(items, "item_id int, text string"), bits=12,
    ).collect()
    want = brute(docs, items)
    assert {(r.doc, r.item): r.containment for r in got} == want
    assert len(got) == len(want) > 60 and (903, 102) in want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id int, text string")
    assert decontam.search(docs, items).count() == 0
    some = spark.createDataFrame([(1, "a b c d e f")], "doc_id int, text string")
    assert decontam.search(some, items.limit(0)).count() == 0


def test_rows_of_one_id_count_together(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "k l m n o p q r")], "item_id int, text string")
    docs = spark.createDataFrame(
        [(7, "x a b c d e f g"), (7, "d e f g h i j y"), (8, "a b c d e f g"), (None, "k l m n o p q r"), (9, "k l m n o p q r"), (9, "other")],
        "doc_id int, text string",
    )
    got = {(r.doc, r.item): r.containment for r in decontam.search(docs, items).collect()}
    assert got == {(7, 1): 1.0, (9, 2): 1.0}
