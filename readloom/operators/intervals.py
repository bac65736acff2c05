"""Interval algebra on closed 1-based genomic ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.session import written

#: Base pairs of a bin, and how many bins a range may cover before it goes to bins BIN_FACTOR times as wide.
BIN = 2048
BIN_FACTOR = 64


def _binned(df: DataFrame, start: str, end: str, width: int, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))


def overlap_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_range: tuple[str, str] = ("start", "end"), right_range: tuple[str, str] = ("f_start", "f_end"), bin_width: int = BIN
) -> DataFrame:
    """Inner join of ranges that share a base, with equality on ``on``.

    Both sides are cut into bins, so the join is an equi-join that Spark can hash or sort; a pair is kept only in the
    first bin that both have, so none comes twice.  Right ranges over BIN_FACTOR bins long (gene bodies)
    meet in wide bins, so their copies stay few.
    """
    (ls, le), (rs, re) = left_range, right_range

    def level(right: DataFrame, width: int) -> DataFrame:
        a, b = _binned(left, ls, le, width, "__bin"), _binned(right, rs, re, width, "__bin")
        met = a.join(b, [*on, "__bin"])
        first = F.greatest(F.floor(F.col(ls) / width), F.floor(F.col(rs) / width)) == F.col("__bin")
        return met.filter((F.col(rs) <= F.col(le)) & (F.col(re) >= F.col(ls)) & first).drop("__bin")

    long = F.col(re) - F.col(rs) >= bin_width * BIN_FACTOR
    return level(right.filter(~long), bin_width).unionByName(level(right.filter(long), bin_width * BIN_FACTOR))


def islands(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", gap: int = 1) -> DataFrame:
    """Adds __island: ranges of a key that overlap or lie less than gap apart share it (1: adjacent ones too)."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0)
    return df.withColumn("__new", fresh).withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def islands_in_bins(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", gap: int = 1, width: int = 1 << 20) -> DataFrame:
    """The same for keys that may hold most rows (contigs): each bin of ``width`` places is a task's work, and what earlier bins reach comes from
    aggregates a bin.  An island is named by the start of its first range.  Keys and ends are not null."""
    df = written(df.withColumn("__bin", F.floor(F.col(start) / width)), "binned")
    earlier = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda rows, value: rows.groupBy(*keys, "__bin").agg(value.alias("__v")).select(*keys, "__bin", F.max("__v").over(earlier).alias("__carried"))
    order = Window.partitionBy(*keys, "__bin").orderBy(start, end)
    reached = F.greatest(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("__carried"))  # nulls don't count
    met = df.join(ahead(df, F.max(end)), [*keys, "__bin"]).withColumn("__reached", reached)
    fresh = F.when(F.col("__reached").isNull() | (F.col(start) > F.col("__reached") + gap), F.col(start))
    met = written(met.withColumn("__fresh", fresh).drop("__carried", "__reached"), "fresh")
    whole = met.join(ahead(met, F.max("__fresh")), [*keys, "__bin"])
    island = F.coalesce(F.max("__fresh").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.col("__carried"))  # equal ranges see each other
    return whole.withColumn("__island", island).drop("__fresh", "__carried", "__bin")


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys, start, end: overlapping and adjacent ranges made one."""
    return islands(df, keys, start, end).groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def union_length(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", name: str = "length") -> DataFrame:
    """Bases covered per key, each once."""
    return merge_intervals(df, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start) + 1).alias(name))


def sweep(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", tag: Column | None = None) -> DataFrame:
    """Segments between cut points: keys, start, end, depth (ranges that cover it) and the sum of their tags."""
    tag = F.lit(0).cast("long") if tag is None else tag.cast("long")
    tagged = df.withColumn("__tag", tag)
    edge = F.explode(F.array(
        F.struct(F.col(start).cast("long").alias("pos"), F.lit(1).alias("d"), F.col("__tag").alias("t")),
        F.struct((F.col(end) + 1).cast("long").alias("pos"), F.lit(-1).alias("d"), (-F.col("__tag")).alias("t")),
    ))
    points = tagged.select(*keys, edge.alias("e")).groupBy(*keys, F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d"), F.sum("e.t").alias("t"))
    order = Window.partitionBy(*keys).orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return points.select(*keys, F.col("pos").alias(start), (F.lead("pos").over(order) - 1).alias(end), F.sum("d").over(upto).alias("depth"), F.sum("t").over(upto).alias("tags")).filter("depth > 0")


def chop_intervals(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Disjoint pieces cut at every start and end."""
    return sweep(df, keys, start, end).select(*keys, start, end)


def flatten_annotation(features: DataFrame, method: str = "merge") -> DataFrame:
    """SAF rows (gene_id, chr, start, end, strand) of merged or chopped exons, in order of gene, chromosome and strand."""
    keys = ["gene_id", "chr", "strand"]
    flat = {"merge": merge_intervals, "chop": chop_intervals}[method](features, keys)
    return flat.select("gene_id", "chr", F.col("start").cast("long"), F.col("end").cast("long"), "strand").orderBy(*keys, "start")


def unique_transcript_bases(exons: DataFrame) -> DataFrame:
    """gene_id, transcript_id, unique_bases, all_bases.  A base is unique if one transcript of its gene covers it.

    Transcripts are numbered within their gene; where the depth is 1, the sum of the numbers names the transcript, so
    segments need no join back to the exons."""
    tx = ["gene_id", "transcript_id", "chr", "strand"]
    flat = merge_intervals(exons, tx)
    nth = F.dense_rank().over(Window.partitionBy("gene_id", "chr", "strand").orderBy("transcript_id"))
    flat = flat.withColumn("nth", nth.cast("long"))
    alone = sweep(flat, ["gene_id", "chr", "strand"], tag=F.col("nth")).filter("depth = 1")
    alone = alone.groupBy("gene_id", "chr", "strand", F.col("tags").alias("nth")).agg(F.sum(F.col("end") - F.col("start") + 1).alias("u"))
    each = flat.groupBy(*tx, "nth").agg(F.sum(F.col("end") - F.col("start") + 1).alias("a"))
    met = each.join(alone, ["gene_id", "chr", "strand", "nth"], "left")
    return met.groupBy("gene_id", "transcript_id").agg(F.coalesce(F.sum("u"), F.lit(0)).cast("long").alias("unique_bases"), F.sum("a").cast("long").alias("all_bases"))


def promoter_regions(exons: DataFrame, upstream: int = 3000, downstream: int = 2000) -> DataFrame:
    """gene_id, chr, start, end, strand of the region around each gene's start."""
    limit = (2**31 - 1) // 2
    up, down = min(max(upstream, 0), limit), min(max(downstream, 0), limit)
    genes = exons.groupBy("chr", "gene_id").agg(F.min("start").alias("s"), F.max("end").alias("e"), F.min_by("strand", F.struct("start", "end", "strand")).alias("strand"))
    plus = F.col("strand") == "+"
    start = F.when(plus, F.greatest(F.col("s") - up, F.lit(1))).otherwise(F.greatest(F.col("e") - down, F.col("s")))
    end = F.when(plus, F.least(F.col("s") + down, F.col("e"))).otherwise(F.col("e") + up)
    return genes.select("gene_id", "chr", start.cast("long").alias("start"), end.cast("long").alias("end"), "strand")


def gaps(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Ranges between a key's merged ranges."""
    order = Window.partitionBy(*keys).orderBy(start)
    merged = merge_intervals(df, keys, start, end)
    return merged.select(*keys, (F.col(end) + 1).alias("g"), (F.lead(start).over(order) - 1).alias(end)).filter(F.col("g") <= F.col(end)).withColumnRenamed("g", start)


def fixed_bins(df: DataFrame, width: int, start: str = "start", end: str = "end") -> DataFrame:
    """Whole bins of width from each range's start; what is left over is dropped."""
    whole = F.floor((F.col(end) - F.col(start) + 1) / width)
    cut = df.filter(whole > 0).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)))
    return cut.withColumn(start, F.col(start) + F.col("__k") * width).withColumn(end, F.col(start) + width - 1).drop("__k")


def stab(points: DataFrame, ranges: DataFrame, on: Sequence[str], pos: str = "pos", right_range: tuple[str, str] = ("f_start", "f_end"), bin_width: int = BIN) -> DataFrame:
    """Points joined to the ranges that hold them."""
    return overlap_join(points, ranges, on, (pos, pos), right_range, bin_width)


def process_exons(annotation: DataFrame, group_label: str, chromosomes: dict[str, str] | None = None) -> DataFrame:
    """Merged CDS and UTR ranges per gene, from (group_label, feature_type, chr, start, end, strand, gene_id)."""
    kept = annotation.filter((F.col("group_label") == group_label) & F.col("feature_type").isin("CDS", "UTR"))
    if chromosomes:
        names = F.create_map(*(F.lit(x) for pair in chromosomes.items() for x in pair))
        kept = kept.withColumn("chr", F.coalesce(names[F.col("chr")], F.col("chr")))
    return merge_intervals(kept, ["gene_id", "chr", "strand"])
