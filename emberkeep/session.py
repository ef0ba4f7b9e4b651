"""Session construction and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "emberkeep") -> SparkSession:
    """A local session for tests and the benchmark, with a work folder of its own; clusters bring theirs."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='emberkeep-')}")  # one folder for all of the session's tables
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    The setting names storage that every executor sees.  Only a local master
    may run without it; a cluster without one is an error rather than a silent
    write to some machine's own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="emberkeep-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
