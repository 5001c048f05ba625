"""Archive rules over entries with parents; archive bytes without default bounds."""

import io
import zipfile

from pyspark.sql import functions as F

from riskflow.operators import archive_rules as rules
from riskflow.operators import attachment_rules as ar
from riskflow.plans import queries

DDL = "file_id string, entry_id long, parent_id long, kind string, name string, size long, packed long, is_dir boolean, encrypted boolean"


def verdicts(spark, rows, **bounds):
    df = spark.createDataFrame(rows, DDL)
    found = {(r.file_id, r.key): (r["count"], r.value) for r in rules.archive_findings(df, **bounds).collect()}
    return found, {r.file_id: (r.entries, list(r.flags), r.score) for r in rules.archive_verdicts(df, **bounds).collect()}


def entry(file, i, name, parent=None, kind="zip", size=10, packed=10, is_dir=False, locked=False):
    return (file, i, parent, kind, name, size, packed, is_dir, locked)


def test_entries(spark):
    many = [entry("many", i, f"f{i}.txt", kind="tar") for i in range(300)]
    late = [entry("late", i, f"f{i}.txt") for i in range(5000)] + [entry("late", 5000, "x/run.exe")]
    rows = many + late + [
        entry("clean", 0, "a.txt"), entry("clean", 1, "b", is_dir=True), entry("drop", 0, "d/", is_dir=True), entry("drop", 1, "update.js"),
        entry("deep", 0, "in.zip"), entry("deep", 1, "two.zip", 0), entry("deep", 2, "three.zip", 1), entry("deep", 3, "y.exe", 2), entry("deep", 4, "z.exe", 0),
        entry("deep", 5, "note.txt"), entry("in", 0, "in.zip"), entry("in", 1, "y.exe", 0), entry("in", 2, "ok.txt"),
        entry("round", 0, "a.zip", 1), entry("round", 1, "b.zip", 0), entry("round", 2, "c.txt"), entry("round", 3, "d.txt"),
        entry("bomb", 0, "z.txt", size=2_000_000, packed=10_000), entry("bomb", 1, "y.txt"), entry("abs", 0, "/etc/x", kind="tar"),
        entry("abs", 1, "b", kind="tar"), entry("odd", 0, None, size=None, packed=None, locked=None), entry("odd", 1, ""), entry("odd", 2, "..\\up"),
    ]
    found, got = verdicts(spark, rows)
    S = "SUSPICIOUS_ARCHIVE"
    assert got["clean"] == (2, [], 0.0) and got["many"] == (300, [], 0.0)
    assert got["late"] == (5001, ["EXECUTABLE_ATTACHMENT", S], 80.0)
    assert got["drop"][1] == ["SCRIPT_ATTACHMENT", S] and found["drop", "archive_single_payload_dropper"] == (1, "update.js")
    # the first archive inside ends the look, so z.exe is not judged, deeper archives are
    assert got["deep"][1] == ["ARCHIVE_DEPTH_ANOMALY", "EXECUTABLE_ATTACHMENT", "NESTED_ARCHIVE", S]
    assert found["deep", "archive_depth_anomaly"] == (2, "nested_level_2 (two.zip)") and found["deep", "nested_archive_payload"] == (1, "y.exe")
    assert found["in", "nested_archive_payload"] == (1, "y.exe") and got["in"][1] == ["EXECUTABLE_ATTACHMENT", "NESTED_ARCHIVE", S]
    assert found["round", "archive_depth_anomaly"][1] == "nested_in_itself"
    assert got["bomb"][1] == ["ARCHIVE_EXPANSION_ANOMALY"] and got["abs"][1] == got["odd"][1] == [S]
    found, got = verdicts(spark, many, max_entries=200)
    assert found == {("many", "archive_entry_limit_exceeded"): (1, "entries_exceeded>200")} and got["many"][1] == [S]
    assert verdicts(spark, []) == ({}, {})


def test_every_rule_fires_in_the_query(spark):
    out = queries.archive_rules(spark, "/root/testdata/sf0.01")
    flags = {f for r in out.select(F.explode(F.split("flags", ","))).distinct().collect() for f in r}
    keys = out.selectExpr("explode(split(findings, '; ')) AS x").selectExpr("split(x, '=')[0] AS k").distinct()
    assert {"", *rules.FLAGS} == {r.k for r in keys.collect()}
    assert flags == {"", "EXECUTABLE_ATTACHMENT", "SCRIPT_ATTACHMENT", *(f for fs in rules.FLAGS.values() for f in fs)}


def test_bytes_without_default_bounds(spark):
    def zipped(entries):
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
            for n, d in entries:
                z.writestr(n, d)
        return buf.getvalue()

    plain = [(f"f{i}.txt", "x") for i in range(250)]
    inner = zipped([*((f"n{i}.txt", "x") for i in range(80)), ("late.exe", "x")])
    cases = {
        "late.zip": zipped([*plain, ("run.exe", "x")]),
        "fourth.zip": zipped([*((f"in{i}.zip", zipped([("a.txt", "x")])) for i in range(4)), ("in5.zip", inner), ("b.txt", "y")]),
        "page.html": b"<html>" + b" " * 40_000 + b"<script>x</script>",
        "tail.pdf": b"%PDF-1.4 " + b" " * 5000 + b"/JavaScript",
    }
    df = spark.createDataFrame(list(cases.items()), "att_name string, att_bytes binary")
    got = {r.att_name: set(r.att_flags) for r in ar.with_attachment_signals(df).collect()}
    assert {"EXECUTABLE_ATTACHMENT", "SUSPICIOUS_ARCHIVE"} <= got["late.zip"]
    assert {"EXECUTABLE_ATTACHMENT", "NESTED_ARCHIVE"} <= got["fourth.zip"]
    assert "EMBEDDED_SCRIPT" in got["page.html"] and "EMBEDDED_SCRIPT" in got["tail.pdf"]
    bounded = {r.att_name: set(r.att_flags) for r in ar.with_attachment_signals(df, max_entries=200, max_inner=3, max_script_chars=16_384).collect()}
    assert "EXECUTABLE_ATTACHMENT" not in bounded["late.zip"] | bounded["fourth.zip"] and "EMBEDDED_SCRIPT" not in bounded["page.html"]
