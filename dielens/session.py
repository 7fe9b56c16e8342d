"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_ROOTS: set[str] = set()


def session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators are planned for.

    On a cluster leave both arguments out: the master comes from spark-submit
    and AQE coalesces the shuffle partitions the cluster defaults to.
    """
    builder = (
        SparkSession.builder.appName("dielens")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.driver.memory", "12g")
            .config("spark.ui.enabled", "false")
        )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new path below the folder the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder is used only where that setting is absent and the
    master is this machine, as in local tests; on a cluster its absence is an
    error.  The folders of a session lie below one root, which the file system
    removes when the session's JVM ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not base:
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{tempfile.gettempdir()}/dielens"
    root = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _ROOTS.add(root)
    return f"{root}/{purpose}-{uuid.uuid4().hex}"
