"""Contigs are made of names, so Spark takes them for small and broadcast them whole through the driver: 928 MB over 0.5 GB of documents."""

import re

import pytest
from pyspark.sql import functions as F

from readloom.operators import align as A
from readloom.operators import long_reads as L
from readloom.operators.simulate import simulate_reads
from readloom.plans import queries as Q


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("ids"))
    spark.range(50).selectExpr("id AS doc_id", "'x' AS text").write.parquet(f"{at}/documents.parquet")
    return at


def _broadcast(df):
    """What the plan broadcasts: the lines below each exchange, up to one that isn't deeper."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    depth = lambda x: len(re.match(r"[\s:|+*-]*", x)[0])
    out = []
    for i, x in enumerate(plan):
        if "BroadcastExchange" in x:
            below = next((j for j in range(i + 1, len(plan)) if depth(plan[j]) <= depth(x)), len(plan))
            out.append("\n".join(plan[i:below]))
    return out


def test_places_meet_chunks_without_a_broadcast(spark, folder):
    chunks = Q._chunks(spark, folder)
    places = spark.createDataFrame([(i, f"chr{i}", 101) for i in range(50)], "rid long, chr string, begin long").withColumn("need", F.lit(100))
    met = A._with_reference(places, chunks, "begin", "need", "ref", 1000)
    assert not _broadcast(met) and met.filter("length(ref) = 100").count() == 50


def test_long_reads_meet_chunks_without_a_broadcast(spark, folder):
    chunks = Q._chunks(spark, folder)
    reads = Q._contigs(spark, folder).select(F.col("chr").alias("rid"), F.substring("seq", 101, 496).alias("seq"))
    records = L.long_records(L.align_long(reads, A.build_index(chunks, chunk=1000)), reads, chunks, 1000)
    assert not any("Generate" in x for x in _broadcast(records)) and records.filter("pos = 101 AND cigar = '496M'").count() == 50


def test_transcripts_are_not_broadcast(spark, folder):
    made = simulate_reads(Q._contigs(spark, folder).select(F.col("chr").alias("transcript_id"), "seq", F.lit(1.0).alias("expression")), 500, 75)
    assert not any("MapInArrow" in x for x in _broadcast(made)) and made.count() == 500
