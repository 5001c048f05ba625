"""Feed files read in splits, versions with a manifest, feeds that land as a stream."""

import pytest
from pyspark.sql import functions as F

from riskflow.sources import feeds, snapshots
from riskflow.sources.snapshots import SnapshotConflict, open_snapshot, publish, retain, versions
from riskflow.streaming import flows


def test_a_file_is_read_by_many_tasks_in_order(spark, tmp_path):
    rng = [(i, f"https://h{i * 7919 % 500}.example.com/p") for i in range(5000)]
    text = "".join(f"https://h.example.com/{i * 7919 % 500}{chr(13) if i % 3 else ''}\n" + ("# no link\n" if i % 5 == 0 else "\n") for i, _ in rng)
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.txt").write_text("https://h.example.com/3\n")
    key, open_cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    spark.conf.set(key, "4096")
    spark.conf.set(open_cost, "1")
    try:
        lines = feeds.feed_lines(spark, str(tmp_path / "*.txt"))
        assert lines.rdd.getNumPartitions() > 20
        got = [r.value for r in lines.where("value like 'http%'").orderBy("line_at").collect()]
        want = [f"https://h.example.com/{i * 7919 % 500}" for i, _ in rng] + ["https://h.example.com/3"]
        assert got == want
        load = feeds.read_openphish(spark, str(tmp_path / "*.txt"), "2024-01-01")
        # the last line of a link wins
        marked = load.withColumn("tags", F.concat_ws("|", F.regexp_extract("line_at.file", "([^/]*)$", 1), F.col("url")))
        stored = spark.createDataFrame([], feeds.FEED_URLS)
        out = {r.url: r.tags for r in feeds.upsert(stored, [marked], "url").collect()}
        assert len(out) == 500 and out["https://h.example.com/3"].startswith("b.txt") and out["https://h.example.com/4"].startswith("a.txt")
        first = feeds.read_openphish(spark, str(tmp_path / "*.txt"), "2024-01-01", max_rows=7).select("url").collect()
        assert sorted(r.url for r in first) == sorted(want[:7])
    finally:
        spark.conf.unset(key)
        spark.conf.unset(open_cost)


def test_versions(spark, tmp_path):
    root = str(tmp_path / "snap")
    table = lambda n: spark.range(n)
    assert open_snapshot(spark, root) is None and versions(spark, root) == []
    publish(spark, root, {"t": table(1), "u": table(5)}, {"as_of": "x"})
    pinned = open_snapshot(spark, root)
    broken = table(3).select(F.raise_error(F.concat(F.lit("no "), F.col("id").cast("string"))).alias("id"))
    with pytest.raises(Exception, match="no "):
        publish(spark, root, {"t": table(2), "u": broken})
    assert versions(spark, root) == [0] and open_snapshot(spark, root).read("t").count() == 1
    second = publish(spark, root, {"t": table(2), "u": table(6)})
    # a reader between two refreshes keeps to its version
    assert (pinned.version, pinned.read("t").count(), pinned.facts) == (0, 1, {"as_of": "x"})
    assert (second.version, open_snapshot(spark, root).read("u").count()) == (1, 6)
    # a version is written once; a repeated job gets what is there
    assert publish(spark, root, {"t": table(9)}, version=1).read("t").count() == 2
    third = publish(spark, root, {"t": second.read("t").union(table(1))})
    with pytest.raises(SnapshotConflict):
        publish(spark, root, {"t": table(1)}, version=-1)
    retain(spark, root, 2)
    assert versions(spark, root) == [1, 2] and not (tmp_path / "snap" / "v=0").exists()
    assert third.read("t").count() == 3 and open_snapshot(spark, root, 0) is None
    with pytest.raises(KeyError):
        third.read("u")


def test_feeds_that_land_as_a_stream(spark, tmp_path):
    land, root, done = tmp_path / "land", str(tmp_path / "snap"), tmp_path / "done"
    land.mkdir()

    def once():
        query = (
            flows.landed_links(spark, str(land), str(done)).writeStream
            .foreachBatch(flows.feed_batch(root, "2024-01-01"))
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        query.awaitTermination(240)
        assert query.exception() is None

    (land / "one.txt").write_text("https://a.example.com/x\nnothing\nhttps://b.example.org/y\n")
    once()
    before = flows.stored_indicators(spark, root, "2024-01-01")
    (land / "two.txt").write_text("https://c.example.org/z\nhttps://a.example.com/x\n")
    once()
    after = flows.stored_indicators(spark, root, "2024-01-01")
    assert (before.urls.count(), after.urls.count(), len(versions(spark, root))) == (2, 3, 2)
    assert after.hashes.count() == before.hashes.count() > 0
    # the same batch again changes nothing
    again = spark.createDataFrame([("https://d.example.org/", None, "f", 0)], "value string, landed timestamp, file string, start long")
    flows.feed_batch(root, "2024-01-01")(again, versions(spark, root)[-1])
    assert flows.stored_indicators(spark, root, "2024-01-01").urls.count() == 3
    assert snapshots.open_snapshot(spark, root).facts == {"as_of": "2024-01-01"}
