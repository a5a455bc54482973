"""Session factory and the folder shared by driver and executors."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
#: Folders that ``shared_dir`` has named, in their order.
_NAMED: list[str] = []


def get_session(app_name: str = "curata", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and skew handling on; ``conf`` overrides."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    return builder.config(map=settings).getOrCreate()


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and host that Hadoop's settings give it, so that Spark and pyarrow mean the same file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone by then
        _remove(spark, path)


def _root(spark: SparkSession) -> str:
    """This application's own folder below ``spark.checkpoint.dir``; it is removed when the process ends."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="curata-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
        context.setCheckpointDir(base)
    key = f"{base.rstrip('/')}/curata-{context.applicationId}"
    if key not in _ROOTS:
        _ROOTS[key] = qualified(spark, key)
        atexit.register(_remove_at_exit, spark, _ROOTS[key])
    return _ROOTS[key]


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path for one intermediate table, in the folder named by ``spark.checkpoint.dir``.

    Where that setting is absent a local session (tests) gets a temporary folder, which is
    set as the checkpoint directory; a cluster session is refused.
    """
    _NAMED.append(f"{_root(spark)}/{name}-{uuid.uuid4().hex}")
    return _NAMED[-1]


def named_folders() -> list[str]:
    """The folders that ``shared_dir`` has named so far."""
    return list(_NAMED)


def release_folders(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders of ``shared_dir`` that nothing that will still run reads."""
    for folder in folders:
        _remove(spark, folder)


def filesystem(path: str):
    """pyarrow's file system for a folder's URI, as ``qualified`` gives it, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.options(**options).parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._curata_path = path
    return written


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing that will still run reads them."""
    for table in tables:
        _remove(table.sparkSession, table._curata_path)
