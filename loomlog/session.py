"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SQL_SETTINGS = {
    # Days, windows and text-to-time conversion are all in UTC.
    "spark.sql.session.timeZone": "UTC",
    # A key that occurs twice in an attribute list takes its last value ...
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # ... and so does a key that occurs twice in a nested JSON value.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Upper and lower case by the JVM: equal results, and no second-long start of ICU.
    "spark.sql.icu.caseMappings.enabled": "false",
    # Requests differ in size: a batch handed to Python is bounded in bytes, not rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session that somebody else built."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", app: str = "loomlog", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the cluster's shared checkpoint folder.

    A machine-local folder is used only where no shared one is set and the
    session is a local one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="loomlog-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/loomlog/{label}-{uuid.uuid4().hex}"
