"""Exact dedup by two-pass Bloom filtering.

Pass one puts a 64-bit hash of each text in a filter of repeated hashes (``bloom``).  Pass two tests each row:
one whose hash can't occur twice passes straight through; only the narrow rows (id, digest) of the others
shuffle, and are grouped by the SHA-256 of the whole text, so a false positive of the filter costs a row's shuffle
and changes no result.  A group of any size is reduced on the map side, and the answer of a hot group goes
back to its rows by a broadcast of fewer than 1000 groups.

Null text is empty text; all empty texts are equal.  Of rows with equal text, exactly one stays: that with
the largest id, null ids being smallest; of repeated rows with that id, any one.  Empty tables give no rows.
Other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.bloom import MAX_LOG2, RepeatFilter
from readloom.llm.common import join_by_key, materialise, text_of


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_log2: int = MAX_LOG2) -> DataFrame:
    """One row per row of docs: <id_col>, keep_id, group_size, kept, text_sha256."""
    text = text_of(text_col)
    n = docs.count()
    repeats = RepeatFilter.build(docs.select(F.xxhash64(text).alias("h")), n, max_log2)
    rows = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            F.sha2(text, 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"),
            repeats.test(F.xxhash64(text)).alias("maybe"),
        ),
        "exact_dedup_rows",
    )
    once = rows.filter(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = rows.filter("maybe").drop("maybe")
    groups = maybe.groupBy("text_sha256").agg(F.max(F.struct("id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    grouped = join_by_key(maybe, groups, "text_sha256", "group_size", n, F.col("row"), "inner").select(
        "id", F.col("keep.id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256"
    )
    return once.unionByName(grouped).withColumnRenamed("id", id_col)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_log2: int = MAX_LOG2) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    text = text_of(text_col)
    n = docs.count()
    repeats = RepeatFilter.build(docs.select(F.xxhash64(text).alias("h")), n, max_log2)
    marked = docs.withColumn("__rl_maybe", repeats.test(F.xxhash64(text)))
    once = marked.filter(~F.col("__rl_maybe")).drop("__rl_maybe")
    maybe = marked.filter("__rl_maybe").drop("__rl_maybe").withColumn("__rl_sha", F.sha2(text, 256))
    groups = maybe.groupBy("__rl_sha").agg(F.max(id_col).alias("__rl_keep"), F.count(F.lit(1)).alias("__rl_size"))
    met = join_by_key(maybe, groups, "__rl_sha", "__rl_size", n, F.xxhash64(id_col), "inner")
    kept = met.filter(F.col(id_col).eqNullSafe(F.col("__rl_keep"))).dropDuplicates(["__rl_sha"])
    return once.unionByName(kept.select(*docs.columns))
