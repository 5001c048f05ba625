"""Session settings used by the bench, the tests and the examples.

A cluster job normally brings its own session; nothing here overrides a
setting that the cluster already made.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def local_session(cores: str = "8", app: str = "riskflow") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        # call-site capture costs several round trips per expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context."""
    context = spark.sparkContext
    if getattr(context, "_riskflow_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="riskflow-code-"), "riskflow")
    archive = shutil.make_archive(
        target, "zip", root_dir=os.path.dirname(home), base_dir=os.path.basename(home)
    )
    context.addPyFile(archive)
    context._riskflow_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """Give every core work when a source has fewer splits than the cluster has cores.

    A large source has far more splits than cores and passes through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and streaming progress.

    The cluster names it in ``spark.checkpoint.dir``. Only a local-mode run
    without that setting falls back to a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="riskflow-checkpoint-")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """New folder name below the shared checkpoint folder; what is written there goes when the session ends."""
    path = f"{checkpoint_root(spark).rstrip('/')}/riskflow/{name}-{uuid.uuid4().hex[:12]}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(jpath)
    fs.deleteOnExit(jpath)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialize narrow rows in the shared checkpoint folder and continue from there.

    Used where several steps read the same intermediate rows more than once; the
    written rows survive the loss of executors.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint(eager=True)
