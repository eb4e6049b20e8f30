"""Where a job may keep what several of its steps read, and a session for tests."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Tables of each session that are still there.
_kept: dict[SparkSession, set[str]] = {}


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.host": "127.0.0.1",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lodeweave")
    return builder.config(map={**base, **conf}).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor reaches.

    It is the one that the cluster names in spark.checkpoint.dir. Where that is unset and the master is
    this machine alone, as in tests, a temporary folder takes its place; on a cluster that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.split("[")[0] == "local":
            raise ValueError("name a folder that all executors reach in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="lodeweave-")
        context.setCheckpointDir(named)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a Parquet table in the shared folder: later steps read it and lost executors cost no recomputation.

    The table goes when dropped() is called with it, at the latest when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodeweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # Spark deletes the shuffle files of finished steps when the driver collects their owners, by itself only every half hour
    spark._jvm.System.gc()
    _kept.setdefault(spark, set()).add(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def kept_root(spark: SparkSession, name: str) -> str:
    """A folder of that name for tables that several jobs of the session read; it goes with the application."""
    path = f"{shared_dir(spark)}/lodeweave/{name}"
    _kept.setdefault(spark, set()).add(path)
    return path


def fingerprint(spark: SparkSession, path: str) -> str:
    """A name for the files below path, or the file, as they are now: their names, sizes and times of change."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
    seen = []
    while files.hasNext():
        one = files.next()
        seen.append(f"{one.getPath()} {one.getLen()} {one.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:16]


def is_stored(table: DataFrame) -> bool:
    """Whether stored() made this table: it is read, not computed, when it is used again."""
    return "_stored_at" in table.__dict__


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that stored() made and that no later step reads."""
    for table in tables:
        if path := table.__dict__.get("_stored_at"):
            _kept.get(table.sparkSession, set()).discard(path)
            _remove(table.sparkSession, path)


@atexit.register
def _remove_all() -> None:
    for spark, paths in _kept.items():
        for path in paths:
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have gone first; the folder belongs to the application
        pass
