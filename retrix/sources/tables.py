"""Table access by directory and name, and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Setting by which a statement's shuffle files are removed when it has ended.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
T = TypeVar("T")


_PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _let_workers_import(spark: SparkSession) -> None:
    """Python workers look for this package where the driver has it; a cluster that ships it is not disturbed."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _PACKAGE_ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, _PACKAGE_ROOT])


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``directory``."""
    _let_workers_import(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def _version(spark: SparkSession, directory: str) -> tuple:
    """Names, times and sizes of what lies in a folder: it changes when a table does."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((s.getPath().getName(), s.getModificationTime(), s.getLen()) for s in listed))


def _there(spark: SparkSession, value: object) -> bool:
    """Whether the copies that something was built on still lie where ``cut`` wrote them."""
    frames = [value] if isinstance(value, DataFrame) else list(getattr(value, "__dict__", {}).values())
    folders = [f._retrix_folder for f in frames if isinstance(f, DataFrame) and hasattr(f, "_retrix_folder")]
    paths = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder) for folder in folders]
    return all(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path) for path in paths)


def kept(build: Callable[[SparkSession, str], T]) -> Callable[[SparkSession, str], T]:
    """Builds something from the tables of a folder once a session, and anew when the folder has changed or its own copies
    are gone."""
    held: dict[tuple, T] = {}

    @wraps(build)
    def get(spark: SparkSession, directory: str) -> T:
        key = (spark.sparkContext.applicationId, directory)
        version = _version(spark, directory)
        if key not in held or held[key][0] != version or not _there(spark, held[key][1]):
            held[key] = (version, build(spark, directory))
        return held[key][1]

    return get


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; one of its own only where none is configured and all runs on one machine, as in tests."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get(_CHECKPOINT_CONF, None) or context.getConf().get(_CHECKPOINT_CONF)
    if not configured and not context.master.startswith("local"):
        raise RuntimeError(f"{_CHECKPOINT_CONF} is not set: a cluster needs a folder that all executors share")
    folder = configured or os.path.join(tempfile.gettempdir(), f"retrix-checkpoints-{os.getuid()}")
    context.setCheckpointDir(folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session is gone, and its folder with it
        pass


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table into the checkpoint folder and go on from the written copy.

    The copy lies in the folder all executors share, so losing an executor loses nothing, and later steps
    read only the columns they need. It is removed when the driver's process ends. The files of the shuffles that led to
    it are removed as soon as it is written: nothing will read them any more.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    atexit.register(_remove, spark, folder)
    copy = spark.read.schema(df.schema).parquet(folder)
    copy._retrix_folder = folder
    return copy


def folder_of(copy: DataFrame) -> str:
    """The folder of a table that ``cut`` wrote."""
    return copy._retrix_folder


def release(copy: DataFrame) -> None:
    """Remove a table that ``cut`` wrote, once nothing will read it any more; other frames are left alone."""
    folder = getattr(copy, "_retrix_folder", None)
    if folder:
        _remove(copy.sparkSession, folder)
