"""Counting as files arrive: the batch plan on a stream of alignment files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from readloom.operators.counting import CountOptions, assign, count_table, single_fragments


def count_stream(spark: SparkSession, folder: str, schema: str, features: DataFrame, target: str, checkpoint: str, options: CountOptions = CountOptions()) -> StreamingQuery:
    """Alignments that land in folder as Parquet are counted a micro-batch at a time; each batch's counts go to
    target/batch=<n>, overwritten if the batch is run again, so that a restart counts nothing twice."""

    def count(batch: DataFrame, number: int) -> None:
        counted = count_table(assign(single_fragments(batch), features, options))
        counted.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, target: str) -> DataFrame:
    """key, units, count over all batches."""
    return spark.read.parquet(target).groupBy("key").agg(F.sum("units").alias("units"), F.sum("count").alias("count"))
