"""Column functions on sequences, CIGAR strings and flags; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: FLAG bits of the alignment format (fixed values).
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, SECOND, SECONDARY, DUPLICATE = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20, 0x40, 0x80, 0x100, 0x400


def has(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def count_bases(seq: Column, bases: str) -> Column:
    """How often any of bases (upper case) occurs, whatever the case."""
    return F.length(seq) - F.length(F.translate(F.upper(seq), bases, ""))


def hamming(a: Column, b: Column) -> Column:
    """Differing places of two strings of equal length; null if lengths differ."""
    differ = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.length(a) == F.length(b), differ)


def phred(qual: Column, offset: int = 33) -> Column:
    """A quality string as an array of scores."""
    return F.transform(F.split(qual, ""), lambda c: F.ascii(c) - offset)


def cigar_parts(cigar: Column) -> Column:
    """array<struct<len:int, op:string>>"""
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHPX=])"), F.lit(1)), lambda x: F.struct(F.regexp_extract(x, r"\d+", 0).cast("int").alias("len"), F.right(x, F.lit(1)).alias("op")))


def bases_of(cigar: Column, ops: str) -> Column:
    """How many bases the operations of a CIGAR string take, of those named in ops."""
    return F.aggregate(F.transform(F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{ops}]"), F.lit(1)), lambda x: x.cast("int")), F.lit(0), lambda s, x: s + x)


def reference_span(cigar: Column) -> Column:
    """Bases of the reference from the first aligned to the last."""
    return F.when(cigar.rlike("^[1-9][0-9]{0,8}M$"), F.rtrim(cigar, F.lit("M")).cast("int")).otherwise(bases_of(cigar, "MDN=X"))


def cigar_sections(cigar: Column, pos: Column) -> Column:
    """Aligned sections: array<struct<start, end, read_start, after>>; N, D and I end one and are named in ``after``."""
    section = "array<struct<start:int,end:int,read_start:int,after:string>>"
    start = F.struct(pos.cast("int").alias("at"), F.lit(0).alias("read"), F.lit(0).alias("run"), F.array().cast(section).alias("done"))

    def closed(acc: Column, after: Column) -> Column:
        one = F.struct(acc["at"].alias("start"), (acc["at"] + acc["run"] - 1).alias("end"), acc["read"].alias("read_start"), after.alias("after"))
        return F.when(acc["run"] > 0, F.concat(acc["done"], F.array(one).cast(section))).otherwise(acc["done"])

    def step(acc: Column, x: Column) -> Column:
        n, op = x["len"], x["op"]
        match, skips, inserts, clips = op.isin("M", "=", "X"), op.isin("N", "D"), op == "I", op == "S"
        cuts = skips | inserts
        return F.struct(
            (acc["at"] + F.when(cuts, acc["run"]).otherwise(0) + F.when(skips, n).otherwise(0)).alias("at"),
            (acc["read"] + F.when(cuts, acc["run"]).otherwise(0) + F.when(inserts | clips, n).otherwise(0)).alias("read"),
            F.when(match, acc["run"] + n).when(cuts, F.lit(0)).otherwise(acc["run"]).alias("run"),
            F.when(cuts, closed(acc, op)).otherwise(acc["done"]).alias("done"),
        )

    whole = F.aggregate(cigar_parts(cigar), start, step, lambda acc: closed(acc, F.lit(None).cast("string")))
    at = pos.cast("int")
    plain = F.array(F.struct(at.alias("start"), (at + F.rtrim(cigar, F.lit("M")).cast("int") - 1).alias("end"), F.lit(0).alias("read_start"), F.lit(None).cast("string").alias("after"))).cast(section)
    return F.when(cigar.rlike("^[1-9][0-9]{0,8}M$"), plain).otherwise(whole)  # most are one match, which needs no parsing


def chromosome_match(contigs, annotation_contigs, aliases=None):
    """rname -> chr as the annotation spells it: exact, alias, without a leading chr, with one if at most 2 characters.

    contigs: rname; annotation_contigs: chr; aliases: chr, rname.  All are tables of distinct names and may be broadcast.
    """
    known = annotation_contigs.select("chr").distinct()
    c = contigs.select("rname").distinct()
    via = c.join(known.withColumnRenamed("chr", "a"), c["rname"] == F.col("a"), "left")
    if aliases is not None:
        by_alias = aliases.join(known, "chr", "left_semi").groupBy("rname").agg(F.min("chr").alias("b"))
        via = via.join(by_alias, "rname", "left")
    else:
        via = via.withColumn("b", F.lit(None).cast("string"))
    via = via.join(known.withColumnRenamed("chr", "c"), (F.left(F.col("rname"), F.lit(3)) == "chr") & (F.expr("substring(rname, 4)") == F.col("c")), "left")
    via = via.join(known.withColumnRenamed("chr", "d"), (F.length("rname") <= 2) & (F.concat(F.lit("chr"), "rname") == F.col("d")), "left")
    return via.select("rname", F.coalesce("a", "b", "c", "d").alias("chr")).filter("chr is not null")


def register(spark: SparkSession) -> None:
    """SQL functions: revcomp, gc_count."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION revcomp(s STRING) RETURNS STRING RETURN reverse(translate(s, 'ACGTacgt', 'TGCAtgca'))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION gc_count(s STRING) RETURNS INT RETURN length(s) - length(translate(upper(s), 'GC', ''))")
