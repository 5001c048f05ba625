"""Versioned tables: a version counts once its manifest is there, and a reader keeps to one version.

``root/v=<n>/<table>`` holds the rows and ``root/manifest/<n>.json`` names the tables and facts of version ``n``.
The manifest is written last, under another name, and renamed, so a refresh that fails leaves
the version before it in force, and two writers can't both publish one number.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


class SnapshotConflict(Exception):
    """Another writer has published the same version."""


@dataclass(frozen=True)
class Snapshot:
    """One version, pinned: later publications don't change what it reads."""

    spark: SparkSession
    root: str
    version: int
    tables: list[str]
    facts: dict = field(default_factory=dict)

    def read(self, table: str) -> DataFrame:
        if table not in self.tables:
            raise KeyError(table)
        return self.spark.read.parquet(f"{self.root}/v={self.version}/{table}")


def _at(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, folder: str, before: str, after: str) -> list[int]:
    path, fs = _at(spark, folder)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    found = [n[len(before):len(n) - len(after)] for n in names if n.startswith(before) and n.endswith(after)]
    return sorted(int(n) for n in found if n.isdigit())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Published versions, rising."""
    return _numbers(spark, f"{root}/manifest", "", ".json")


def open_snapshot(spark: SparkSession, root: str, version: int | None = None) -> Snapshot | None:
    """The given or the latest published version; none if there is none."""
    known = versions(spark, root)
    if not known or (version is not None and version not in known):
        return None
    version = known[-1] if version is None else version
    text = "\n".join(r[0] for r in spark.read.text(f"{root}/manifest/{version}.json").collect())
    body = json.loads(text)
    return Snapshot(spark, root, version, body["tables"], body["facts"])


def publish(
    spark: SparkSession, root: str, tables: dict[str, DataFrame], facts: dict | None = None,
    version: int | None = None,
) -> Snapshot:
    """Write the tables as a new version and put it in force.

    ``version`` is the next free number by default; a job that may be repeated passes its own (such as a batch
    id), and a version already published is then returned as it is. The tables may read from an earlier
    version. Folders that a failed writer left under the same number are overwritten.
    """
    known = versions(spark, root)
    if version is None:
        version = known[-1] + 1 if known else 0
    elif version in known:
        return open_snapshot(spark, root, version)
    elif known and version < known[-1]:
        raise SnapshotConflict(f"version {version} is older than {known[-1]}")
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{root}/v={version}/{name}")
    # hidden from listings until renamed
    draft, fs = _at(spark, f"{root}/manifest/.{version}.draft")
    final, _ = _at(spark, f"{root}/manifest/{version}.json")
    out = fs.create(draft, True)
    out.write(json.dumps({"tables": list(tables), "facts": facts or {}}).encode())
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise SnapshotConflict(f"version {version} exists")
    return open_snapshot(spark, root, version)


def retain(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Drop all but the last ``keep`` versions, manifest first, and folders older than them that were never published.

    Readers pinned to a dropped version fail on their next read, so ``keep`` covers the longest of them.
    """
    known = versions(spark, root)
    kept = known[-keep:]
    for old in known[:-keep]:
        path, fs = _at(spark, f"{root}/manifest/{old}.json")
        fs.delete(path, False)
    for number in _numbers(spark, root, "v=", ""):
        if kept and number < kept[0]:
            path, fs = _at(spark, f"{root}/v={number}")
            fs.delete(path, True)
