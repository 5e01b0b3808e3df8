"""Session defaults and lineage cutting."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(app: str = "graphlake", master: str | None = None, conf: dict | None = None) -> SparkSession:
    """The active session, or a new one with the library's defaults under ``conf``."""
    builder = SparkSession.builder.appName(app).config(map=DEFAULTS | (conf or {}))
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``. Only a local session may do without: it gets a temporary folder; on a cluster a machine's own folder would be read by no other machine, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='graphlake-')}"
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(_drop, root.removeprefix("file://"))
    return root.rstrip("/")


def _drop(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


_scopes: list[list[str]] = []


def cut(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back: the plan is cut, and a lost executor loses nothing."""
    path = f"{scratch_root(df.sparkSession)}/graphlake/{uuid.uuid4().hex}"
    for paths in _scopes:
        paths.append(path)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def drop_scratch(*frames: DataFrame) -> None:
    """Delete what :func:`cut` wrote for frames that no later plan reads."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path:
            _delete(df.sparkSession, path)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Deletes at its end whatever :func:`cut` wrote within, but for frames given to the function that it yields.

    Results are lazy and read what operators wrote for them: write or :func:`cut` (and keep) them within the scope.
    """
    paths: list[str] = []
    _scopes.append(paths)
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._scratch)
        return df

    try:
        yield keep
    finally:
        _scopes.remove(paths)
        for path in paths:
            if path not in kept:
                _delete(spark, path)


def plan_bytes(df: DataFrame, default: int = 64 << 20) -> int:
    """The optimizer's size estimate of ``df`` in bytes; ``default`` where it has none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else default


def fan_out(df: DataFrame, bytes_each: int, least: int = 8) -> int:
    """A partition count that follows the input: one per ``bytes_each`` estimated bytes."""
    return max(least, -(-plan_bytes(df) // bytes_each))


def spread(df: DataFrame, *keys: str, like: DataFrame | None = None, bytes_each: int = 2 << 20) -> DataFrame:
    """``df`` by hash of ``keys`` in tasks whose number follows the stored size of ``like`` (``df`` itself, if it was read from files), so that a task's share stays the same as the input grows."""
    return df.repartition(fan_out(df if like is None else like, bytes_each, least=4), *keys)
