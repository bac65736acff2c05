"""Genomic views of the driver's tables, in Spark and, as text, in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-end alignments: one of each line item.  nh counts the records of a name."""
    li = table(spark, sf_dir, "lineitem")
    qty = F.col("l_quantity").cast("int")
    flag = F.when(F.col("l_returnflag") == "R", 16).otherwise(0) + F.when(F.col("l_discount") >= 0.095, 4).otherwise(0) + F.when(F.col("l_tax") >= 0.075, 1024).otherwise(0) + F.when(F.col("l_linenumber") == 7, 256).otherwise(0)
    cigar = F.when(qty > 40, F.concat(F.lit("10M"), (F.col("l_linenumber") * 100).cast("string"), F.lit("N"), (qty - 10).cast("string"), F.lit("M"))).otherwise(F.concat(qty.cast("string"), F.lit("M")))
    out = li.select(
        F.col("l_linestatus").alias("file"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("qname"), flag.cast("int").alias("flag"), F.concat(F.lit("chr"), F.col("l_suppkey") % 5).alias("chr"),
        (F.col("l_partkey") * 50 + F.col("l_linenumber") * 7).cast("int").alias("pos"), (F.col("l_suppkey") % 60).cast("int").alias("mapq"), cigar.alias("cigar"), F.lit(0).alias("tlen"), qty.alias("len"),
        F.monotonically_increasing_id().alias("fid"),
    )
    return out.withColumn("nh", F.count(F.lit(1)).over(Window.partitionBy("qname")).cast("int"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments without their spliced part: one section of len bases, all mapped."""
    return alignments(spark, sf_dir).withColumn("flag", F.col("flag").bitwiseAND(F.lit(16))).withColumn("cigar", F.concat(F.col("len").cast("string"), F.lit("M")))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    start = k * 50 + (k % 3) * 20
    return p.select(
        k.alias("feature_id"), F.concat(F.lit("G"), F.expr("p_partkey div 4")).alias("gene_id"), F.concat(F.lit("chr"), k % 5).alias("chr"), start.cast("int").alias("start"),
        (start + F.col("p_size") * 6).cast("int").alias("end"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"), F.col("p_brand").alias("transcript_id"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired ends: of each order and pair of line numbers, the cheapest line of the odd number is end 1, of the even end 2; a seventh line has no mate."""
    li = table(spark, sf_dir, "lineitem")
    key = F.struct("l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    one = li.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct(key.alias("k"), F.struct("l_returnflag", "l_discount", "l_tax").alias("v"))).alias("m"))
    one = one.select("l_orderkey", "l_linenumber", "m.k.*", "m.v.*")
    chrom = F.concat(F.lit("chr"), F.col("l_suppkey") % 2)
    flag = 1 + F.when(F.col("l_linenumber") % 2 == 1, 64).otherwise(128) + F.when(F.col("l_returnflag") == "R", 16).otherwise(0) + F.when(F.col("l_discount") >= 0.085, 4).otherwise(0)
    return one.select(
        "l_orderkey", F.expr("(l_linenumber + 1) div 2").alias("pair"), flag.cast("int").alias("flag"), chrom.alias("chr"), (F.col("l_partkey") * 50 + F.col("l_linenumber") * 7).cast("int").alias("pos"),
        (F.col("l_suppkey") % 60).cast("int").alias("mapq"), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("M")).alias("cigar"), (F.col("l_partkey") % 800).cast("int").alias("tlen"), F.lit(1).alias("nh"),
    )


def umis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read of each event: sample, cell, gene, umi of four bases."""
    e = table(spark, sf_dir, "events")
    n = F.pmod(F.col("event_id") * 7 + F.expr("event_id div 16"), F.lit(256))
    base = lambda k: F.substring(F.lit("ACGT"), (F.pmod(F.floor(n / 4**k), F.lit(4)) + 1).cast("int"), F.lit(1))
    return e.select(F.lit(1).alias("sample"), F.col("user_id").alias("cell"), F.col("event_type").alias("gene"), F.concat(*(base(k) for k in range(4))).alias("umi"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as sequences: chr, seq, with every character but ACGT made N."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("chr"), "doc_id").alias("chr"), F.col("doc_id"), F.regexp_replace(F.translate("text", "acgt", "ACGT"), "[^ACGT]", "N").alias("seq"))


def chunks(contigs: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """chr, start, seq of contigs (chr, seq), in steps of size bases, and last, where the contig's last chunk begins."""
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(size)))
    cut = contigs.select("chr", "seq", at.alias("a"))
    return cut.select("chr", (F.col("a") + 1).cast("long").alias("start"), F.substring("seq", F.col("a") + 1, F.lit(size + overlap)).alias("seq"), F.expr(f"greatest(length(seq) - 1, 0) div {size} * {size} + 1").alias("last"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant rows: a file per event type."""
    e = table(spark, sf_dir, "events")
    ref = F.substring(F.lit("ACGT"), (F.col("user_id") % 4 + 1).cast("int"), F.lit(1))
    alt = F.when(F.col("event_id") % 5 == 0, "G,T").otherwise("T")
    return e.select(
        F.col("event_type").alias("file"), F.col("event_id").alias("ordinal"), F.concat(F.lit("chr"), F.col("user_id") % 3).alias("chrom"), (F.col("user_id") % 50).alias("pos"), ref.alias("ref"), alt.alias("alt"),
        F.floor("value").cast("int").alias("qual"), F.when(F.col("event_id") % 7 == 0, "INDEL;DP=3").otherwise("DP=3").alias("info"),
    )


#: The same views for the oracle.
SQL = """
l AS (
    SELECT l_linestatus AS file, l_orderkey || '-' || l_linenumber AS qname,
           (CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END + CASE WHEN l_discount >= 0.095 THEN 4 ELSE 0 END + CASE WHEN l_tax >= 0.075 THEN 1024 ELSE 0 END + CASE WHEN l_linenumber = 7 THEN 256 ELSE 0 END) AS flag,
           'chr' || (l_suppkey % 5) AS chr, l_partkey * 50 + l_linenumber * 7 AS pos, l_suppkey % 60 AS mapq, l_linenumber,
           l_quantity::INT AS len, row_number() OVER () AS fid, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS nh,
           CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand
    FROM lineitem
), f AS (
    SELECT p_partkey AS feature_id, 'G' || (p_partkey // 4) AS gene_id, 'chr' || (p_partkey % 5) AS chr, p_partkey * 50 + (p_partkey % 3) * 20 AS s,
           p_partkey * 50 + (p_partkey % 3) * 20 + p_size * 6 AS e, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, p_brand AS transcript_id
    FROM part
)"""
