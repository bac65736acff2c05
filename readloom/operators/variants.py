"""Pile-up, background test, SNP rows and variants common to files."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.dna import UNMAPPED, cigar_sections, has
from readloom.functions.stats import fisher_one_sided
from readloom.operators.intervals import overlap_join


@dataclass(frozen=True)
class SnpOptions:
    window: int = 5
    min_phred: int = 13
    trim: int = 3
    min_reads: int = 1
    min_alt_bases: int = 1
    min_fraction: float = 0.0
    max_reads: int | None = None
    base_depth: int = 50
    q_value: int = 12
    phred_offset: int = 33


def aligned_bases(alignments: DataFrame, o: SnpOptions = SnpOptions()) -> DataFrame:
    """fid, end, chr, pos, base, qual: each aligned base outside the trimmed ends, one row."""
    s = alignments.filter(~has(F.col("flag"), UNMAPPED)).select("fid", "end", "chr", "seq", "qual", F.explode(cigar_sections(F.col("cigar"), F.col("pos"))).alias("s"))
    first = F.greatest(F.col("s.read_start"), F.lit(o.trim))
    n = F.least(F.col("s.read_start") + F.col("s.end") - F.col("s.start") + 1, F.length("seq") - o.trim) - first
    part = lambda c: F.split(F.substring(c, first + 1, n), "")  # noqa: E731  # split once, so that a long read costs its length
    kept = s.filter(n > 0).select("fid", "end", "chr", (F.col("s.start") + first - F.col("s.read_start")).alias("from"), part(F.col("seq")).alias("bases"), part(F.col("qual")).alias("quals"))
    each = kept.select("fid", "end", "chr", "from", "quals", F.posexplode("bases").alias("i", "base"))
    return each.select("fid", "end", "chr", (F.col("from") + F.col("i")).alias("pos"), F.upper("base").alias("base"), (F.ascii(F.coalesce(F.get("quals", F.col("i")), F.lit(""))) - o.phred_offset).alias("q"))


def mates_resolved(bases: DataFrame) -> DataFrame:
    """Of two mates' bases at one place, that of higher quality; the first mate's where equal."""
    return bases.groupBy("fid", "chr", "pos").agg(F.max_by(F.struct("base", "q"), F.struct("q", -F.col("end"))).alias("b")).select("fid", "chr", "pos", "b.base", "b.q")


def reference_at(places: DataFrame, chunks: DataFrame, length: str = "1", name: str = "ref", chunk: int = 65_536) -> DataFrame:
    """Adds name: ``length`` reference bases from pos on, in upper case.  chunks: chr, start (1, 1 + chunk, ...), seq, overlapping by as
    many.  A place meets one chunk; the reference is never taken apart into bases."""
    c = chunks.select("chr", F.floor((F.col("start") - 1) / chunk).alias("__c"), F.col("start").alias("__s"), F.col("seq").alias("__q"))
    met = places.withColumn("__c", F.floor((F.col("pos") - 1) / chunk)).join(c, ["chr", "__c"])
    return met.withColumn(name, F.expr(f"upper(substring(__q, CAST(pos - __s + 1 AS INT), CAST({length} AS INT)))")).drop("__c", "__s", "__q")


def pileup(bases: DataFrame, reference: DataFrame, o: SnpOptions = SnpOptions(), chunk: int = 65_536) -> DataFrame:
    """chr, pos, ref, a, c, g, t, depth.  reference: chunks (chr, start, seq); places whose reference is no base are left out.

    Depth over max_reads is scaled down in proportion (the order of reads decides nothing)."""
    good = bases.filter(F.col("base").isin(*"ACGT") & (F.col("q") >= o.min_phred))
    counts = good.groupBy("chr", "pos").agg(*(F.count_if(F.col("base") == b).alias(b.lower()) for b in "ACGT"))
    counts = reference_at(counts, reference, chunk=chunk).filter(F.col("ref").isin(*"ACGT")).select("chr", "pos", "ref", "a", "c", "g", "t")
    depth = F.col("a") + F.col("c") + F.col("g") + F.col("t")
    if o.max_reads:
        scale = F.least(F.lit(1.0), F.lit(float(o.max_reads)) / depth)
        counts = counts.select("chr", "pos", "ref", *((F.floor(F.col(b) * scale)).alias(b) for b in "acgt"))
    return counts.withColumn("depth", depth)


#: Places of a window's task; each task has a halo of the window's width on both sides.
BACKGROUND_BIN = 1 << 20


def background(piled: DataFrame, known: DataFrame | None = None, o: SnpOptions = SnpOptions(), bin_width: int = BACKGROUND_BIN) -> DataFrame:
    """Adds match, mismatch (here) and bg_match, bg_mismatch (within the window, without this place and known sites)."""
    match = F.element_at(F.create_map(*(x for b in "ACGT" for x in (F.lit(b), F.col(b.lower())))), F.col("ref"))
    out = piled.withColumn("match", match).withColumn("mismatch", F.col("depth") - F.col("match"))
    if known is not None:
        out = out.join(known.select("chr", "pos", F.lit(True).alias("known")), ["chr", "pos"], "left").na.fill({"known": False})
    else:
        out = out.withColumn("known", F.lit(False))
    # a place goes to its own bin, and to a neighbour's halo where its window reaches that
    at = lambda shift: F.floor((F.col("pos") + shift) / bin_width)
    out = out.withColumn("__bin", F.explode(F.array_distinct(F.array(at(0), at(-o.window), at(o.window)))))
    near = Window.partitionBy("chr", "__bin").orderBy("pos").rangeBetween(-o.window, o.window)
    free = lambda c: F.when(F.col("known"), 0).otherwise(F.col(c))
    for c in ("match", "mismatch"):
        out = out.withColumn(f"bg_{c}", F.sum(free(c)).over(near) - free(c))
    return out.filter(at(0) == F.col("__bin")).drop("__bin")


def fisher_p(a: str, b: str, c: str, d: str) -> Column:
    """One-sided Fisher test of four count columns."""

    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([fisher_one_sided(*x) for x in zip(a, b, c, d)])

    return p(a, b, c, d)


def call_snps(piled: DataFrame, known: DataFrame | None = None, o: SnpOptions = SnpOptions()) -> DataFrame:
    """chr, pos, ref, alt, qual, info of places whose mismatches stand out from their surroundings."""
    b = background(piled, known, o)
    width = 2 * o.window + 1
    mean_depth = (F.col("bg_match") + F.col("bg_mismatch") + F.col("depth")) / width
    cutoff = F.greatest(F.lit(1e-323), F.least(F.lit(0.005), F.pow(F.lit(10.0), -(mean_depth / (o.base_depth / o.q_value)))))
    calm = F.col("bg_match") * 20 > 16 * (F.col("bg_match") + F.col("bg_mismatch"))
    tested = b.filter((F.col("mismatch") > 0) & (F.col("depth") >= o.min_reads) & calm)
    tested = tested.withColumn("p", fisher_p("mismatch", "bg_mismatch", "match", "bg_match")).filter(F.col("p") < cutoff)
    alts = F.filter(F.array(*(F.struct(F.lit(x).alias("base"), F.col(x.lower()).alias("n")) for x in "ACGT")), lambda v: (v["base"] != F.col("ref")) & (v["n"] >= o.min_alt_bases))
    called = tested.withColumn("alts", alts).filter(F.size("alts") > 0)
    supporting = F.aggregate("alts", F.lit(0).cast("long"), lambda s, v: s + v["n"])
    called = called.withColumn("mm", supporting).filter(F.col("mm") / F.col("depth") >= o.min_fraction)
    info = F.concat(F.lit("DP="), "depth", F.lit(";MMsum="), "mm", F.lit(";MM="), F.array_join(F.transform("alts", lambda v: v["n"].cast("string")), ","), F.lit(";BGTOTAL="), F.col("bg_match") + F.col("bg_mismatch"), F.lit(";BGMM="), "bg_mismatch")
    qual = -F.log10(F.greatest(F.lit(1e-40), F.col("p")))
    return called.select("chr", "pos", "ref", F.array_join(F.transform("alts", lambda v: v["base"]), ",").alias("alt"), qual.alias("qual"), "p", "depth", "mm", info.alias("info"))


def compare_with_control(tumour: DataFrame, control: DataFrame) -> DataFrame:
    """Pile-ups side by side: match, mismatch, control_match, control_mismatch, 0 where one has no reads, and vs_p, the p-value of tumour
    against control."""
    def sums(df: DataFrame, prefix: str) -> DataFrame:
        match = F.element_at(F.create_map(*(x for b in "ACGT" for x in (F.lit(b), F.col(b.lower())))), F.col("ref"))
        return df.select("chr", "pos", "ref", match.alias(f"{prefix}match"), (F.col("depth") - match).alias(f"{prefix}mismatch"))

    both = sums(tumour, "").join(sums(control, "control_"), ["chr", "pos", "ref"], "full").na.fill(0)
    return both.withColumn("vs_p", fisher_p("mismatch", "control_mismatch", "match", "control_match"))


def with_control(calls: DataFrame, tumour: DataFrame, control: DataFrame) -> DataFrame:
    """SNP rows with the control's counts and VS_QV in their INFO."""
    vs = compare_with_control(tumour, control).select("chr", "pos", "control_match", "control_mismatch", "vs_p")
    more = F.concat(F.lit(";CTRL_DP="), F.col("control_match") + F.col("control_mismatch"), F.lit(";CTRL_MM="), "control_mismatch", F.lit(";VS_QV="), F.format_string("%.4f", -F.log10(F.greatest(F.lit(1e-40), F.least(F.lit(1.0), "vs_p")))))
    return calls.join(vs, ["chr", "pos"], "left").withColumn("info", F.concat("info", F.coalesce(more, F.lit("")))).drop("control_match", "control_mismatch", "vs_p")


def common_variants(variants: DataFrame) -> DataFrame:
    """Variants that all files have.  variants: file, ordinal, chrom, pos, ref, alt, qual, info.

    ALT lists are taken apart; a variant is its kind (I if INFO has INDEL, else S), place and alleles.  The row with the lowest
    whole quality stands for it, the first on ties; a repeat within a file counts once."""
    n = variants.select("file").distinct()
    each = variants.withColumn("alt", F.explode(F.split("alt", ","))).withColumn("kind", F.when(F.col("info").contains("INDEL"), "I").otherwise("S"))
    key = ["kind", "chrom", "pos", "ref", "alt"]
    per = each.groupBy(*key).agg(F.count_distinct("file").alias("files"), F.min_by(F.struct("qual", "info"), F.struct(F.col("qual").cast("int"), "file", "ordinal")).alias("r"))
    total = n.agg(F.count(F.lit(1)).alias("total"))
    return per.join(F.broadcast(total), F.col("files") == F.col("total")).select(*key, "r.qual", "r.info")


def snp_bitmap(variants: DataFrame) -> DataFrame:
    """chr, pos of known single-base variants."""
    return variants.filter((F.length("ref") == 1) & ~F.col("info").contains("INDEL")).select(F.col("chrom").alias("chr"), "pos").distinct()


def indel_alleles(alignments: DataFrame, chunks: DataFrame, o: SnpOptions = SnpOptions(), chunk: int = 65_536) -> DataFrame:
    """Indel events of mapped records (chr, pos, cigar, seq, qual): chr, pos (last base before), ref, alt, support, depth, quality_n (of good
    bases beside it, summed over its reads)."""
    mapped = alignments.filter(~has(F.col("flag"), UNMAPPED) & F.col("cigar").rlike("[ID]"))
    s = mapped.select("chr", "seq", "qual", cigar_sections(F.col("cigar"), F.col("pos")).alias("s")).filter(F.size("s") > 1)
    near = F.transform(F.sequence(F.lit(0), F.size("s") - 2), lambda i: F.struct(F.get("s", i).alias("a"), F.get("s", i + 1).alias("b")))
    p = s.select("chr", "seq", "qual", F.explode(near).alias("p")).filter(F.col("p.a.after").isin("I", "D"))
    end = F.col("p.a.read_start") + F.col("p.a.end") - F.col("p.a.start") + 1  # bases read before it
    insert = F.col("p.a.after") == "I"
    more = F.when(insert, F.substring("seq", end + 1, F.col("p.b.read_start") - end)).otherwise("")
    gone = F.when(insert, 0).otherwise(F.col("p.b.start") - F.col("p.a.end") - 1)
    good = (F.ascii(F.substring("qual", end, F.lit(1))) - o.phred_offset >= o.min_phred).cast("int")
    found = p.groupBy("chr", F.col("p.a.end").cast("long").alias("pos"), F.upper(more).alias("more"), gone.alias("gone")).agg(F.count(F.lit(1)).alias("support"), F.sum(good).alias("quality_n"))
    through = overlap_join(_sections_of(alignments), found.select("chr", "pos", "more", "gone", F.col("pos").alias("f_start"), (F.col("pos") + 1).alias("f_end")), ["chr"], ("start", "stop"))
    against = through.filter((F.col("start") <= F.col("f_start")) & (F.col("stop") >= F.col("f_end"))).groupBy("chr", "pos", "more", "gone").agg(F.count(F.lit(1)).alias("against"))
    met = found.join(against, ["chr", "pos", "more", "gone"], "left")
    met = reference_at(met, chunks, "gone + 1", "ref", chunk)
    return met.select("chr", "pos", "ref", F.concat(F.left("ref", F.lit(1)), "more").alias("alt"), "support", (F.col("support") + F.coalesce("against", F.lit(0))).alias("depth"), "quality_n")


def _sections_of(alignments: DataFrame) -> DataFrame:
    s = alignments.filter(~has(F.col("flag"), UNMAPPED)).select("chr", F.explode(cigar_sections(F.col("cigar"), F.col("pos"))).alias("s"))
    return s.select("chr", F.col("s.start").alias("start"), F.col("s.end").alias("stop"))


def indel_rows(events: DataFrame) -> DataFrame:
    """Indel events (chr, pos, ref, alt, support, depth, quality_n) as variant rows."""
    quality = F.pow(F.lit(0.5), F.greatest(30 - F.col("quality_n"), F.lit(0)))
    qual = F.floor(F.greatest(F.lit(1.0), 250 + 10 * F.log(quality))).cast("int")
    return events.select("chr", "pos", "ref", "alt", qual.alias("qual"), F.concat(F.lit("INDEL;DP="), "depth", F.lit(";SR="), "support").alias("info"))
