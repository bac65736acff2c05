"""Indel and junction events, what supports and contradicts them, and clusters of breakpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.dna import UNMAPPED, cigar_sections, has
from readloom.operators.intervals import islands, islands_in_bins, overlap_join


def indel_events(alignments: DataFrame) -> DataFrame:
    """chr, pos (last base before), kind (I or D), length, support, from the CIGAR strings of mapped records."""
    mapped = alignments.filter(~has(F.col("flag"), UNMAPPED) & F.col("cigar").rlike("[ID]"))
    s = mapped.select("chr", cigar_sections(F.col("cigar"), F.col("pos")).alias("s")).filter(F.size("s") > 1)
    near = F.transform(F.sequence(F.lit(0), F.size("s") - 2), lambda i: F.struct(F.get("s", i).alias("a"), F.get("s", i + 1).alias("b")))
    p = s.select("chr", F.explode(near).alias("p")).filter(F.col("p.a.after").isin("I", "D"))
    read_end = F.col("p.a.read_start") + F.col("p.a.end") - F.col("p.a.start") + 1
    length = F.when(F.col("p.a.after") == "I", F.col("p.b.read_start") - read_end).otherwise(F.col("p.b.start") - F.col("p.a.end") - 1)
    return p.groupBy("chr", F.col("p.a.end").alias("pos"), F.col("p.a.after").alias("kind"), length.alias("length")).agg(F.count(F.lit(1)).alias("support"))


def event_counts(alignments: DataFrame) -> DataFrame:
    """file, junctions, indels: different junctions and indels that a file's mapped records show."""
    mapped = alignments.filter(~has(F.col("flag"), UNMAPPED) & F.col("cigar").rlike("[NID]"))
    s = mapped.select("file", "chr", cigar_sections(F.col("cigar"), F.col("pos")).alias("s")).filter(F.size("s") > 1)
    near = F.transform(F.sequence(F.lit(0), F.size("s") - 2), lambda i: F.struct(F.get("s", i).alias("a"), F.get("s", i + 1).alias("b")))
    p = s.select("file", "chr", F.explode(near).alias("p"))
    length = F.when(F.col("p.a.after") == "I", F.col("p.b.read_start") - F.col("p.a.read_start")).otherwise(F.col("p.b.start"))
    each = p.select("file", "chr", F.col("p.a.after").alias("kind"), F.col("p.a.end").alias("left"), length.alias("to")).distinct()
    found = each.groupBy("file").agg(F.count_if(F.col("kind") == "N").alias("junctions"), F.count_if(F.col("kind") != "N").alias("indels"))
    return alignments.select("file").distinct().join(found, "file", "left").na.fill(0)


def prune_neighbours(events: DataFrame, within: int = 5) -> DataFrame:
    """Of events of a contig that follow each other within so many bases, the best supported."""
    runs = islands_in_bins(events.withColumn("to", F.col("pos")), ["chr"], "pos", "to", within)
    w = Window.partitionBy("chr", "__island").orderBy(F.col("support").desc(), "pos", "kind", "length")
    return runs.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r", "to", "__island")


def anti_support(events: DataFrame, alignments: DataFrame, margin: int = 1) -> DataFrame:
    """Adds against: aligned sections that run through an event's place, margin bases on both sides, without a cut."""
    s = alignments.filter(~has(F.col("flag"), UNMAPPED)).select("chr", F.explode(cigar_sections(F.col("cigar"), F.col("pos"))).alias("s")).select("chr", F.col("s.start").alias("start"), F.col("s.end").alias("stop"))
    key = [c for c in events.columns if c != "support"]
    at = events.select(*key, (F.col("pos") - margin + 1).alias("f_start"), (F.col("pos") + margin).alias("f_end"))
    through = overlap_join(s, at, ["chr"], ("start", "stop")).filter((F.col("start") <= F.col("f_start")) & (F.col("stop") >= F.col("f_end")))
    against = through.groupBy(*key).agg(F.count(F.lit(1)).alias("against"))
    return events.join(against, key, "left").na.fill({"against": 0})


def annotated_introns(exons: DataFrame) -> DataFrame:
    """chr, left, right of introns between the exons of each transcript (gene_id, transcript_id, chr, strand, start, end)."""
    w = Window.partitionBy("gene_id", "transcript_id", "chr", "strand").orderBy("start", "end")
    nxt = exons.withColumn("right", F.lead("start").over(w))
    return nxt.filter(F.col("right") > F.col("end") + 1).select("chr", F.col("end").alias("left"), "right").distinct()


def guided_junctions(found: DataFrame, introns: DataFrame) -> DataFrame:
    """Found junctions (chr, left, right, support) and annotated ones, which need no support; known tells them apart."""
    known = introns.select("chr", "left", "right", F.lit(True).alias("known"))
    return found.join(known, ["chr", "left", "right"], "full").na.fill({"support": 0, "known": False})


def breakpoint_clusters(pairs: DataFrame, within: int = 500) -> DataFrame:
    """kind, chr1, pos1 (first), end1, chr2, pos2, end2, support of breakpoints whose both sides lie near each other's.

    pairs: kind, chr1, pos1, chr2, pos2."""
    each = pairs.groupBy("kind", "chr1", "pos1", "chr2", "pos2").agg(F.count(F.lit(1)).alias("n"))  # a locus with most pairs is few rows
    runs = islands_in_bins(each.withColumn("a", F.col("pos1")).withColumn("b", F.col("pos1")), ["kind", "chr1", "chr2"], "a", "b", within).withColumnRenamed("__island", "one").drop("a", "b")
    runs = islands(runs.withColumn("a", F.col("pos2")).withColumn("b", F.col("pos2")), ["kind", "chr1", "chr2", "one"], "a", "b", within)
    return runs.groupBy("kind", "chr1", "chr2", "one", "__island").agg(
        F.min("pos1").alias("pos1"), F.max("pos1").alias("end1"), F.min("pos2").alias("pos2"), F.max("pos2").alias("end2"), F.sum("n").alias("support")
    ).drop("one", "__island")
