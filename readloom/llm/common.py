"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds more than 1/HOT_SHARE of all rows is hot; so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000
#: A table of at most so many narrow rows may be broadcast whole.
BROADCAST_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a temporary folder; a cluster must set it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="readloom-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/readloom-{uuid.uuid4().hex}/{name}"


#: Folders of tables that this process wrote and has not deleted, in order.
_WRITTEN: list[str] = []


def _delete(paths: list[str]) -> None:
    """Through Hadoop's file systems, which reach the shared folder wherever it is."""
    jvm = SparkContext._jvm
    for path in paths:
        if path in _WRITTEN:
            _WRITTEN.remove(path)
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(jvm.org.apache.hadoop.conf.Configuration() if SparkContext._active_spark_context is None else SparkContext._active_spark_context._jsc.hadoopConfiguration()).delete(place, True)


def release(*tables: DataFrame) -> None:
    """Deletes materialised tables that nothing reads any more."""
    _delete([path for t in tables if (path := vars(t).get("written_at"))])


def settled(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """Builds a table and writes it, and deletes what was materialised on the way."""
    before = set(_WRITTEN)
    out = materialise(build(), name)
    _delete([path for path in _WRITTEN if path not in before and path != vars(out)["written_at"]])
    return out


@atexit.register
def _delete_all() -> None:
    """What is left goes with the process, as its results do."""
    try:
        if _WRITTEN and SparkContext._jvm is not None:
            _delete(list(_WRITTEN))
    except (Py4JError, OSError):  # the JVM went first
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later stages don't compute it again, and a lost
    executor costs a read, not a recomputation.  ``release`` deletes it; what is not released goes when the process ends."""
    path = scratch(df.sparkSession, name)
    _WRITTEN.append(path.rpartition("/")[0])
    df.write.parquet(path, compression="zstd")
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = _WRITTEN[-1]
    return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def id_fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % folds


def sampled(hashes: Column, wanted: int, of: int) -> Column:
    """Whether a 64-bit hash is among the smallest, so that about twice as many as wanted of so many are: a top-k over these
    needs a few rows of each task, however many tasks there are."""
    share = 2 * wanted / max(of, 1)
    return F.lit(True) if share >= 1 else hashes < F.lit(int(-(2**63) + share * 2**64))


def join_by_key(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, spread: Column, how: str = "left", right_rows: int | None = None) -> DataFrame:
    """Joins rows of left to the one row that right has for their key, whatever share of left one key holds.

    ``right[weight]`` is how many rows of left have the key and ``total`` is left's row count.  Keys with
    over 1/HOT_SHARE of the rows, fewer than HOT_SHARE, are broadcast, and their rows are dealt out by ``spread``
    (an expression over left) instead of the key; the others meet in a shuffled join.  A null key finds nothing.
    how: left or inner.  right_rows: right's row count, if known; up to BROADCAST_ROWS, all of it is broadcast.
    """
    if right_rows is not None and right_rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key, how).select(*left.columns, *(c for c in right.columns if c != key))
    others = [c for c in right.columns if c != key]
    is_hot = F.col(weight) * HOT_SHARE > F.lit(total)
    hot = right.filter(is_hot).select(F.col(key), F.struct(*others).alias("__rl_hot"))
    # a literal 0 would be folded into a filter, and the join would deal out by the key alone
    zero = F.least(F.col(weight).cast("int"), F.lit(0))
    cold = right.filter(~is_hot).select(F.col(key), zero.alias("__rl_salt"), F.struct(*others).alias("__rl_cold"))
    salted = left.join(F.broadcast(hot), key, "left").withColumn(
        "__rl_salt", F.when(F.col("__rl_hot").isNotNull() | F.col(key).isNull(), 1 + F.pmod(spread, F.lit(10 * HOT_SHARE))).otherwise(0).cast("int")
    )
    met = salted.join(cold, [key, "__rl_salt"], "left").withColumn("__rl_got", F.coalesce("__rl_hot", "__rl_cold"))
    if how == "inner":
        met = met.filter(F.col("__rl_got").isNotNull())
    return met.select(*left.columns, *(F.col(f"__rl_got.{c}").alias(c) for c in others))
