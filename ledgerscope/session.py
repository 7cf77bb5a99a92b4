"""Spark session and checkpoint-directory helpers."""
from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

# Settings every job relies on: AQE re-plans joins at runtime (broadcast when a
# shuffled side turns out small, splits skewed partitions of sort-merge joins),
# ANSI stays on, the UI stays off.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(
    master: str | None = None,
    app: str = "ledgerscope",
    shuffle_partitions: int | None = None,
    extra: dict | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is.  Only a local master without it (tests) gets a fresh folder; any other
    master is refused, as its executors could not see the driver's folders.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = os.environ.get("LEDGERSCOPE_SCRATCH", tempfile.gettempdir())
    path = tempfile.mkdtemp(prefix="ledgerscope-ckpt-", dir=base)
    sc.setCheckpointDir(path)
    return path


_SCOPE: contextvars.ContextVar[list | None] = contextvars.ContextVar("scratch", default=None)


def files_of(spark: SparkSession, path: str) -> tuple:
    """File system and path object of a path, on any store that Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Owns the tables that :func:`materialize` writes inside: they are deleted at the end, also after a failure.

    Results must be written out before; a frame that is returned lazily still needs its tables.  Scopes may be nested.
    """
    paths: list = []
    token = _SCOPE.set(paths)
    try:
        yield paths
    finally:
        _SCOPE.reset(token)
        for path in paths:
            fs, where = files_of(spark, path)
            fs.delete(where, True)


def materialize(df, name: str = "table"):
    """Write ``df`` as parquet under the checkpoint directory and read it back.

    Used to share one computed table between several branches of a plan (each
    later read gets column pruning and filter push-down), to cut long plans,
    and to survive executor loss without recomputing the lineage.  Inside
    :func:`scratch` the table is deleted with its scope, else it stays.  The folder
    is the cluster's shared ``spark.checkpoint.dir``; only a local master may go
    without one and gets a temporary folder.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    if (owner := _SCOPE.get()) is not None:
        owner.append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


AT_ONCE = 5              # independent jobs that the driver submits side by side
ROWS_AT_ONCE = 6_000_000  # rows of all the fits that run side by side: each keeps its binned rows in the executors


def together(tasks: list[Callable], at_once: int = AT_ONCE) -> list:
    """Results of independent tasks in their order; ``at_once`` of them submit their Spark jobs from threads of the driver.

    A job whose tasks do not fill the cores leaves room for the next one's; what each task computes stays the same.  Threads see
    the caller's :func:`scratch` and local properties.  The first failure is raised; tasks not yet begun are dropped then.
    """
    tasks = list(tasks)
    if at_once <= 1 or len(tasks) <= 1:
        return [t() for t in tasks]
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(min(at_once, len(tasks))) as pool:
        futures = [pool.submit(contextvars.copy_context().run, inherit(t)) for t in tasks]
        try:
            return [f.result() for f in futures]
        except BaseException:
            pool.shutdown(wait=False, cancel_futures=True)
            raise


def fits_at_once(rows: int, most: int = AT_ONCE) -> int:
    """How many fits over ``rows`` rows each run side by side: one at least, and two while their rows are no more than twice
    ``ROWS_AT_ONCE`` (some 0.7 KB a row), as the tasks of one seldom fill the cores to the end of a pass."""
    return max(1, min(most, max(ROWS_AT_ONCE // max(rows, 1), 2 if rows <= ROWS_AT_ONCE else 1)))
