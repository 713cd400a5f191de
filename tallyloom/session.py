"""Session settings and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = 8, app: str = "tallyloom") -> SparkSession:
    """Session for one machine; on a cluster pass the cluster's own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the one the session names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyloom-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Lists that note the (folder, table of the catalog or None) written while a ``scratch`` is open.
_SCRATCH: list[list[tuple[str, str | None]]] = []


def note(path: str, table: str | None = None) -> None:
    """Leave a folder, and the table of the catalog that lies there, to the open ``scratch``es."""
    for written in _SCRATCH:
        written.append((path, table))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list]:
    """Delete, at the end, the intermediate tables that operators have written meanwhile.

    For callers that have used or written their result by then: what is lazily read from those
    tables later is lost.

        with scratch(spark):
            features.all_features(orders)[0].write.parquet(path)
    """
    written: list[tuple[str, str | None]] = []
    _SCRATCH.append(written)
    try:
        yield written
    finally:
        _SCRATCH.remove(written)
        for path, table in written:
            if table:
                spark.sql(f"DROP TABLE IF EXISTS `{table}`")
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder through Hadoop's file system; whether there was one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def copy(spark: SparkSession, source: str, target: str) -> None:
    """Copy a small folder through Hadoop's file system."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = spark._jvm.org.apache.hadoop.fs
    a, b = hadoop.Path(source), hadoop.Path(target)
    hadoop.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)


def settle(df: DataFrame, name: str = "rows") -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Used where later steps must all see the very same rows (row numbering) or where
    recomputing would be dear. Cuts the lineage, survives the loss of executors, and the
    columnar table lets later steps read only the columns they use.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    note(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
