"""Getting this package to the executors, and tables that are written on the way."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's modules to the executors, once an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="readloom-code-")  # executors of a local session read it in place
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = Path(folder) / "readloom.zip"
    with zipfile.ZipFile(name, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, f"readloom/{path.relative_to(root).as_posix()}")
    context.addPyFile(str(name))
    _SHIPPED.add(context.applicationId)


_FOLDERS: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, in ``spark.checkpoint.dir``; it goes with the process.  Where that is unset, a local
    session gets a temporary folder; a cluster must set it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="readloom-")
    _FOLDERS.append(f"{root.rstrip('/')}/readloom-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


@atexit.register
def _clear() -> None:
    try:
        jvm = SparkContext._jvm
        for folder in _FOLDERS if jvm is not None else ():
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
    except (Py4JError, OSError):  # the JVM went first
        pass


#: Spark's setting by which a query's shuffle files go once its result is written, not when the driver's memory is cleared some time later.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back: computed once, whatever is lost later.  What was shuffled for it doesn't stay on disk."""
    spark, path = df.sparkSession, f"{scratch(df.sparkSession)}/{name}"
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def drop(table: DataFrame) -> None:
    """Deletes a table that was ``written`` and that nothing reads any more."""
    path = SparkContext._jvm.org.apache.hadoop.fs.Path(table.written_at)
    path.getFileSystem(SparkContext._jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
