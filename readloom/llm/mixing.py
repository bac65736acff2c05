"""Mixing sources to target weights by hash-threshold histograms.

Each source's words are summed; targets are shares of ``share`` times all words by weight, cut at ``most`` times the
source's words, the excess reshared by weight until none is above.  A source takes every document
floor(target / words) times, and once more those whose hash lies below a threshold at which the words reach the rest of the
target.  The threshold is found without sorting: words are summed by source and leading hash bits, a running
sum finds the bucket in which the rest runs out, and only that bucket's documents are summed again by the next
bits, until it holds few.  Of those few, taken in hash order, each goes that still fits, and a last one if that brings
the source nearer to its target.  So a source misses its target by half its smallest document left
out at most, if that few; hashes depend on ids and texts alone, and reruns agree.

Sources are weighed in code-point order, null last, by ``weights`` repeating.  Null text has no words.  Documents
without words take none.  Repeated rows have one hash and are taken or left together.  Empty tables give no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import BROADCAST_ROWS, join_by_key, materialise, text_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Hash bits a level, and the documents that a boundary bucket may hold at the end.
LEVEL_BITS = 12
FEW = 64
WORD = r"[^\x20\x09-\x0D]+"


def word_count(column: Column) -> Column:
    return F.regexp_count(column, F.lit(WORD)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources: source, source_size, docs.  Adds target.  Nothing of it comes to the driver but sums."""
    spark = sources.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(sources.repartitionByRange(tasks, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    in_part = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = in_part.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("before") + F.col("nth"), F.lit(len(weights))) + 1).cast("int"))
    weighed = materialise(placed.withColumn("nth", nth).join(F.broadcast(before), "part").withColumn("weight", weight).drop("nth", "before", "part"), "weights")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    full = most * F.col("source_size")
    level = 0.0
    while True:  # the level of the water rises until no source is above its brim
        brim = full <= F.col("weight") * level
        row = weighed.agg(F.sum(F.when(brim, full)).alias("held"), F.sum(F.when(~brim, F.col("weight"))).alias("open")).first()
        nxt = (share * total - (row["held"] or 0)) / row["open"] if row["open"] else level
        if nxt <= level:
            break
        level = nxt
    return weighed.withColumn("target", F.least(full.cast("double"), F.col("weight") * F.lit(float(level)))).drop("weight")


def _threshold_bucket(rows: DataFrame, shift: int, level: DataFrame) -> DataFrame:
    """rows: key, h, size; level: key, prefix (the hash bits so far), rest (words to go), w.  Per key the first bucket of
    the next bits in which the running sum passes rest: prefix, docs, rest (less what comes before), w; stop: the last
    bucket up to which there are few documents from there on."""
    bucket = F.shiftrightunsigned("h", shift).bitwiseAND(F.lit((1 << LEVEL_BITS) - 1))
    sums = rows.groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
    running = F.sum("words").over(Window.partitionBy("key").orderBy("bucket"))
    over = sums.withColumn("upto", running).join(level, "key").filter("upto > rest")
    prefix = F.shiftleft("prefix", LEVEL_BITS).bitwiseOR(F.col("bucket"))
    rest = F.col("rest") - F.col("upto") + F.col("words")
    over = over.withColumn("on", F.sum("docs").over(Window.partitionBy("key").orderBy("bucket")))
    first = F.min_by(F.struct(prefix.alias("prefix"), "docs", rest.alias("rest"), "w"), "bucket").alias("b")
    return over.groupBy("key").agg(first, F.max(F.when(F.col("on") <= FEW, prefix)).alias("stop")).select("key", "b.*", "stop")


def _last_few(group: pd.DataFrame) -> pd.DataFrame:
    """Which of a boundary bucket's hashes go."""
    by_hash = group.iloc[group["h"].to_numpy().view("uint64").argsort(kind="stable")]
    rest, taken = float(group["rest"].iloc[0]), []
    for size in by_hash["size"]:
        taken.append(size <= rest)
        rest -= size * taken[-1]
    left = [(size, i) for i, (size, t) in enumerate(zip(by_hash["size"], taken)) if not t]
    if left and abs(min(left)[0] - rest) < rest:
        taken[min(left)[1]] = True
    return pd.DataFrame({"key": group["key"].iloc[0], "h": by_hash["h"].to_numpy()[taken], "last": True})


def _plan(rows: DataFrame, n: int, weights: tuple[int, ...], share: float, most: float) -> tuple[DataFrame, int]:
    """rows: key, size, h.  Per key, how often all its documents go and where the threshold lies."""
    sources = rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("w"))
    sources = sources.withColumn("source", F.when(F.col("key") != "n", F.substring("key", 2, 1 << 30)))
    sources = source_targets(sources, weights, share, most)
    times = F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).cast("long")
    sources = materialise(sources.withColumn("times", times).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size")), "targets")
    n_sources = sources.count()

    open_, shift, settled = rows.select("key", "h", "size").filter("size > 0"), 64 - LEVEL_BITS, None
    level = sources.select("key", "rest", "w", F.lit(0).cast("long").alias("prefix"))
    while True:
        cut = _threshold_bucket(open_, shift, level)
        few = (F.col("docs") <= FEW) | F.lit(shift < LEVEL_BITS)
        cut = materialise(cut.withColumn("shift", F.lit(shift)).withColumn("few", few), "thresholds")
        done = cut.filter("few").select("key", "prefix", "stop", "rest", "shift")
        settled = done if settled is None else settled.unionByName(done)
        level = cut.filter("not few").select("key", "rest", "w", "prefix")
        if level.isEmpty():
            break
        met = join_by_key(rows.select("key", "h", "size"), level.drop("rest"), "key", "w", n, F.col("h"), "inner", n_sources)
        open_ = met.filter((F.shiftrightunsigned("h", shift) == F.col("prefix")) & (F.col("size") > 0)).select("key", "h", "size")
        shift -= LEVEL_BITS
    return materialise(sources.select("key", "source_size", "target", "times", "w").join(settled, "key", "left"), "settled"), n_sources


def _decided(rows: DataFrame, n: int, plan: DataFrame, n_sources: int) -> DataFrame:
    """rows: key, size, h, others.  Adds source_size, target and copies."""
    met = join_by_key(rows, plan, "key", "w", n, F.col("h"), "left", n_sources)
    top = F.expr("shiftrightunsigned(h, shift)")
    return met.withColumn("at", F.when(F.col("prefix").isNull(), 1).when(top < F.col("prefix"), -1).when(top <= F.greatest("prefix", "stop"), 0).otherwise(1))


def _mixed(rows: DataFrame, narrow: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Adds source_size, target, copies to rows; narrow: their key, size, h, materialised."""
    n = narrow.count()
    plan, n_sources = _plan(narrow, n, weights, share, most)
    boundary = _decided(narrow.select("key", "size", "h"), n, plan, n_sources).filter("at = 0 and size > 0")
    boundary = boundary.groupBy("key", "h").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))  # repeated rows are one row
    last = materialise(boundary.groupBy("key").applyInPandas(_last_few, "key string, h long, last boolean"), "last")
    n_last = last.count()
    met = _decided(rows, n, plan, n_sources)
    last = last.select(F.col("key").alias("last_key"), F.col("h").alias("last_h"), "last")
    met = met.join(F.broadcast(last) if n_last <= BROADCAST_ROWS else last, (met["key"] == last["last_key"]) & (met["h"] == last["last_h"]), "left")
    copies = F.col("times") + F.when((F.col("at") < 0) | F.col("last"), 1).otherwise(0)
    return met.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    text, source = text_of(text_col), F.col(source_col).cast("string")
    key = F.concat(F.when(source.isNull(), "n").otherwise("s"), F.coalesce(source, F.lit("")))  # never null
    return [key.alias("key"), word_count(text).alias("size"), F.xxhash64(F.lit("mix"), id_col, text).alias("h")]


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
) -> DataFrame:
    """One row per row of docs: <id_col>, size, source_size, target, taken (a multiple of size)."""
    rows = materialise(docs.select(F.col(id_col).alias("id"), *_keyed(docs, id_col, text_col, source_col)), "sizes")
    mixed = _mixed(rows, rows, weights, share, most)
    return mixed.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), *_keyed(docs, id_col, text_col, source_col))
    mixed = _mixed(keyed, materialise(keyed.drop("doc"), "sizes"), weights, share, most)
    copies = mixed.filter("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return copies.select("doc.*")
