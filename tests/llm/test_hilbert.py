import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from riskflow.llm import hilbert
from riskflow.llm.queries import op8_hilbert


@pytest.mark.parametrize(("n", "bits"), [(1, 3), (2, 1), (2, 4), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(spark, n, bits):
    cells = list(itertools.product(range(1 << bits), repeat=n))
    df = spark.createDataFrame([(list(c),) for c in cells], "x array<int>")
    rows = {r.h: r.x for r in df.select("x", F.expr(hilbert.curve(n, bits)).alias("h")).collect()}
    assert sorted(rows) == list(range(len(cells)))
    for i in range(len(cells) - 1):
        assert sum(abs(a - b) for a, b in zip(rows[i], rows[i + 1])) == 1


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op8_hilbert(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        data = d.text.encode()
        assert (got[d.doc_id].size, got[d.doc_id].text_crc32) == (len(data) + 8, zlib.crc32(data))
    slots = [[r.slot for r in got.values() if r.shard == s] for s in range(24)]
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(map(len, slots)) - min(map(len, slots)) <= 1
    order = sorted(got.values(), key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in order] == sorted(r.hilbert for r in order)


def test_nulls_ties_repeats_and_empty_tables(spark):
    rows = [(1, None, None, 5), (None, "", "x", None), (2, "a", "y", 1), (2, "a", "y", 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, shard long").drop("shard")
    out = hilbert.shard(hilbert.with_index(df, ["lang", "doc_id"]), 5, "hilbert", "doc_id")
    counts = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert sum(counts) == 12 and len(counts) == 5 and max(counts) - min(counts) <= 1
    empty = hilbert.shard(hilbert.with_index(df.limit(0), ["lang", "doc_id"]), 5, "hilbert", "doc_id")
    assert empty.count() == 0
