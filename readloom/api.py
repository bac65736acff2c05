"""The engine's functions by task, on files or DataFrames.

Each reads its inputs with ``readloom.sources``, applies one operator and returns DataFrames; nothing is written unless a
path is given.  Files of one call are told apart by the column ``file``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.operators import align as _align
from readloom.operators import counting as _counting
from readloom.operators import events as _events
from readloom.operators import intervals as _intervals
from readloom.operators import long_reads as _long
from readloom.operators import readtools as _tools
from readloom.operators import second_pass as _second
from readloom.operators import singlecell as _cells
from readloom.operators import variants as _variants
from readloom.operators.reassembly import reassemble
from readloom.operators.simulate import simulate_reads
from readloom.session import written
from readloom.sources import tables
from readloom.sources.bam import read_bam, read_header, write_bam
from readloom.sources.files import probe
from readloom.sources.sequences import barcode_reads, read_barcode_folder, read_barcode_pairs, read_fasta, read_fastq

#: Bases of a reference's chunk and what consecutive ones share.  To take bases out of a chunk costs their place in it, so chunks are short.
CHUNK, OVERLAP = 16_384, 2048
#: Places of each mate from which a pair is chosen.
MATE_PLACES = 4
#: Bases of a transcript, which is one row.
TRANSCRIPT = 1 << 26


def read_alignments(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """SAM and BAM files, by their content.  A file goes by its base name, or by its path where base names repeat."""
    out, paths = None, [paths] if isinstance(paths, str) else list(paths)
    base = [p.rstrip("/").rpartition("/")[2] for p in paths]
    for path, name in zip(paths, base):
        one = read_bam(spark, path) if probe(path) == "bam" else tables.read_sam(spark, path)
        if base.count(name) > 1:
            one = one.withColumn("file", F.lit(path))
        out = one if out is None else out.unionByName(one)
    return out


def annotation(spark: SparkSession, given: str | DataFrame, is_gtf: bool = False, feature_types: str = "exon", gene_attribute: str = "gene_id", extra: tuple[str, ...] = ()) -> DataFrame:
    if isinstance(given, DataFrame):
        return tables.saf(given)
    return tables.read_gtf(spark, given, feature_types, gene_attribute, True, extra) if is_gtf else tables.read_saf(spark, given)


def feature_counts(
    spark: SparkSession, files: str | Sequence[str] | DataFrame, annot: str | DataFrame, is_gtf: bool = False, feature_types: str = "exon", gene_attribute: str = "gene_id", aliases: str | None = None,
    by_read_group: bool = False, junction_counts: bool = False, genome: str | None = None, extra: tuple[str, ...] = (), options: _counting.CountOptions = _counting.CountOptions(),
) -> dict[str, DataFrame]:
    """counts (key, a column a library), annotation (exon lists, lengths and the ``extra`` attributes, each value once), summary (status, a
    column a library), assigned (per fragment; equal records, or pairs of records, count each), and with junction_counts junctions, in eleven columns and one a library, with strands if a genome is given.

    Shifts and extensions end at the contigs' lengths, which the files' headers give."""
    reads = files if isinstance(files, DataFrame) else read_alignments(spark, files)
    features = annotation(spark, annot, is_gtf, feature_types, gene_attribute, extra)
    library = F.concat_ws(":", "file", "rg") if by_read_group else F.col("file")
    if by_read_group:
        reads = reads.filter("rg is not null")
    if not options.paired and reads.filter(F.col("flag").bitwiseAND(F.lit(1)) != 0).limit(1).count():
        raise ValueError("paired reads in a library that is declared single-end")
    if (options.shift or options.extend_5 or options.extend_3) and not isinstance(files, DataFrame):
        reads = reads.join(F.broadcast(contig_lengths(spark, files)), "chr", "left")
    names = _chromosomes(spark, reads, features, aliases)
    reads = reads.withColumn("library", library).join(F.broadcast(names.withColumnRenamed("chr", "known")), reads["chr"] == F.col("rname"), "left").withColumn("chr", F.coalesce("known", "chr")).drop("known", "rname")
    carry = ("library",)
    if options.paired:
        place = F.least(F.struct("chr", "pos"), F.struct(F.when(F.col("rnext") == "=", F.col("chr")).otherwise(F.col("rnext")).alias("chr"), F.col("pnext").alias("pos")))
        reads = reads.withColumn("at", F.concat_ws(":", place["chr"], place["pos"]))
        fragments = _counting.fragments_of(reads, ["library", "qname", "at", "hi"], carry)
    else:
        # equal records are fragments of their own: files are read in the same order each time, so a record keeps its number
        numbered = reads.withColumn("fid", F.concat_ws("\x1f", "library", "qname", "flag", "chr", "pos", "cigar", "hi", F.monotonically_increasing_id()))
        fragments = _counting.single_fragments(numbered, carry=carry)
    assigned = written(_counting.assign(fragments, features, options, carry), "assigned")  # counts, summary and the fragments' own table read it
    each = assigned.filter("status = 'Assigned'").select("library", F.explode("targets").alias("key"), "units").groupBy("library", "key").agg((F.sum("units") / _counting.UNIT).alias("count"))
    table = _counting.gene_table(features, each.groupBy("key").agg(F.sum("count").alias("count")), extra) if options.gene_level else features
    out = {
        "counts": _counting.wide(each, "library"), "annotation": table, "assigned": assigned,
        "summary": tables.summary_rows(assigned.groupBy("library", "status").agg(F.count(F.lit(1)).alias("n")), _counting.statuses(options)),
    }
    if junction_counts:
        per = _counting.junctions(fragments, carry).groupBy("library", "chr", "left", "right").agg(F.count(F.lit(1)).alias("support"))
        sites = per.groupBy("chr", "left", "right").agg(F.sum("support").alias("support"))
        exons = features if "transcript_id" in features.columns else features.withColumn("transcript_id", F.col("attrs")["transcript_id"] if "attrs" in features.columns else F.col("gene_id"))
        classes = _counting.classify_junctions(sites, exons)
        if genome:
            classes = _counting.junction_strand(classes, read_fasta(spark, genome, CHUNK, OVERLAP).select("chr", "start", "seq"), CHUNK)
        out["junctions"], out["junction_counts"] = _counting.junction_table(classes, per), per
    return out


def contig_lengths(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """chr, chr_length by the headers of SAM and BAM files; the least where they differ."""
    out = None
    for path in [paths] if isinstance(paths, str) else paths:
        one = spark.createDataFrame(read_header(path)[1], "chr string, chr_length int") if probe(path) == "bam" else tables.contig_lengths(spark, path)
        out = one if out is None else out.unionByName(one)
    return out.groupBy("chr").agg(F.min("chr_length").alias("chr_length"))


def _chromosomes(spark, reads: DataFrame, features: DataFrame, aliases: str | None) -> DataFrame:
    from readloom.functions.dna import chromosome_match

    return chromosome_match(reads.select(F.col("chr").alias("rname")).filter("chr != '*'"), features.select("chr"), tables.read_aliases(spark, aliases) if aliases else None)


def build_index(spark: SparkSession, reference: str, target: str, gapped: bool = False, threshold: int = 100, converted: bool = False) -> None:
    """Writes kmers/ (in files by kmer), chunks/ (bases) and step/ (one place in step has a 16-mer; the chunks' length) to target.

    converted: for reads of bisulfite-treated DNA, in two alphabets of three letters; ``align`` then takes reads for such."""
    chunks = read_fasta(spark, reference, CHUNK, OVERLAP).select("chr", "start", "seq")
    _align.check_reference(chunks)
    chunks.write.parquet(f"{target}/chunks")
    chunks = spark.read.parquet(f"{target}/chunks")
    step = 3 if gapped else 1
    spark.range(1).select(F.lit(step).alias("step"), F.lit(CHUNK).alias("chunk")).write.parquet(f"{target}/step")
    (_align.build_converted_index if converted else _align.build_index)(chunks, step, threshold, CHUNK).write.parquet(f"{target}/kmers")


def _read_index(spark: SparkSession, index: str) -> tuple[DataFrame, DataFrame, int, int]:
    """16-mers, bases, step and chunks' length; an index without a stored step shows it by its places."""
    kmers, chunks = spark.read.parquet(f"{index}/kmers"), spark.read.parquet(f"{index}/chunks")
    try:
        stored = spark.read.parquet(f"{index}/step").first().asDict()
    except AnalysisException:
        stored = {"step": 1 if kmers.filter((F.col("pos") - 1) % 3 != 0).limit(1).count() else 3}
    if "chunk" not in stored:
        stored["chunk"] = chunks.filter("start > 1").agg(F.min(F.col("start") - 1)).first()[0] or CHUNK
    return kmers, chunks, stored["step"], stored["chunk"]


def align(
    spark: SparkSession, index: str, reads: str, mates: str | None = None, options: _align.AlignOptions = _align.AlignOptions(), kind: str = "rna", annot: str | DataFrame | None = None, is_gtf: bool = False, support: int = 2,
    phred: int = 33,
) -> DataFrame:
    """Alignments of FASTQ reads, whose quality letters begin at phred (33 or 64); with mates, records of both ends with mate fields.

    A second pass aligns the ends of reads over junctions and indels that at least ``support`` reads show (0: no second pass), and over the introns
    of an annotation (GTF, or exons with transcript_id), if one is given.  Mates that no seed finds are looked for beside the other end.

    kind: "dna" reads have no introns, so they map without junctions, and more mismatches pass, as the reference's whole read has to fit.

    With an index of converted bases, reads have T for C and mates A for G, as libraries that keep the strand do; these map in one pass, mates by seeds only."""
    if kind not in ("rna", "dna"):
        raise ValueError("kind is rna or dna")
    if kind == "dna":
        options = replace(options, junctions=False, max_mismatches=max(options.max_mismatches, 3))
    kmers, chunks, step, chunk = _read_index(spark, index)

    converted = "letters" in kmers.columns
    if converted and annot is not None:
        raise ValueError("converted reads are not aligned over introns")
    marked = lambda letters, o: replace(o, converted=letters) if converted else o

    def one(path: str, o: _align.AlignOptions) -> DataFrame:
        r = read_fastq(spark, path).select(F.regexp_replace("name", "/[12]$", "").alias("rid"), "seq", _tools.phred_33(F.col("qual"), phred).alias("qual"))
        return written(_align.align(r, kmers, chunks, o, chunk, step), "first_pass")

    def second(*first: DataFrame) -> list[DataFrame]:
        if converted or (not support and introns is None):
            return list(first)
        shown = reduce(DataFrame.unionByName, first).filter("hi = 1")
        events = written(_second.shown_events(shown if support else shown.limit(0), max(support, 1), introns), "events")
        return [_second.realign(f, events, chunks, options, chunk) for f in first]

    introns = None
    if annot is not None:
        exons = annotation(spark, annot, is_gtf, extra=("transcript_id",) if is_gtf else ())
        introns = _events.annotated_introns(exons if "transcript_id" in exons.columns else exons.withColumn("transcript_id", F.col("gene_id")))
    if mates is None:
        return second(one(reads, marked("CT", options)))[0]
    several = replace(options, best=max(options.best, MATE_PLACES), unique=False, threshold=min(options.threshold, max(options.mate_threshold, 1)))
    ends = [written(end, "second_pass") for end in second(one(reads, marked("CT", several)), one(mates, marked("GA", several)))]
    if converted:
        return _align.mate_records(_align.pair_up(*ends, options))
    return _align.mate_records(_second.rescue_mates(*ends, chunks, options, chunk))


def subjunc(
    spark: SparkSession, index: str, reads: str, mates: str | None = None, options: _align.AlignOptions = _align.AlignOptions(seeds=14, threshold=1, mate_threshold=1), annot: str | DataFrame | None = None, is_gtf: bool = False, support: int = 2,
) -> DataFrame:
    """As align, with exon junctions."""
    return align(spark, index, reads, mates, replace(options, junctions=True), annot=annot, is_gtf=is_gtf, support=support)


def align_to_files(
    spark: SparkSession, index: str, reads: str, target: str, mates: str | None = None, form: str = "bam", by_place: bool = False, read_group: str | None = None, group_fields: Sequence[str] = (),
    junctions: bool = False, **how,
) -> DataFrame:
    """Writes the records of ``align`` (of ``subjunc`` with junctions; how: their other arguments) to SAM or BAM files in the folder target, and
    returns their mapping summary.

    by_place: sorted, BAM with an index beside each file.  Contigs are in the header by name.  read_group: the RG of each record, with group_fields
    (such as "SM:a") in the header's line."""
    if form not in ("sam", "bam"):
        raise ValueError("form is sam or bam")
    if group_fields and read_group is None:
        raise ValueError("fields of a read group need its name")
    mapped = (subjunc if junctions else align)(spark, index, reads, mates, **how)
    records = mapped if mates is not None else _align.single_records(mapped)
    if read_group is not None:
        records = _align.with_read_group(records, read_group)
    records = written(records, "records")
    _, chunks, _, _ = _read_index(spark, index)
    length = chunks.groupBy("chr").agg(F.max(F.col("start") + F.length("seq") - 1).alias("n")).orderBy("chr")
    contigs = {r["chr"]: r["n"] for r in length.collect()}  # a header is held whole
    (write_bam if form == "bam" else tables.write_sam)(records, target, contigs, by_place, [] if read_group is None else ["\t".join(["@RG", f"ID:{read_group}", *group_fields])])
    return tables.mapping_summary(records.withColumn("file", F.lit(target)))


def fusions(spark: SparkSession, index: str, reads: str, options: _align.AlignOptions = _align.AlignOptions(), support: int = 2) -> DataFrame:
    """Breakpoints, to the base, between contigs or strands that at least ``support`` single reads run over."""
    kmers, chunks, step, chunk = _read_index(spark, index)
    r = read_fastq(spark, reads).select(F.col("name").alias("rid"), "seq", "qual")
    return _second.fusions(_second.split_reads(_second.all_places(r, kmers, chunks, options, chunk, step), r), support)


def insertions(
    spark: SparkSession, index: str, reads: str, mates: str | None = None, options: _align.AlignOptions = _align.AlignOptions(), support: int = 2, shortest: int = 6, longest: int = 300,
) -> DataFrame:
    """chr, pos, ref, alt, support: insertions that no read's gap covers, put together from the clipped and unmapped ends of FASTQ reads."""
    _, chunks, _, chunk = _read_index(spark, index)
    records = written(align(spark, index, reads, mates, options, kind="dna", support=0), "records")
    return reassemble(records, chunks, chunk, support=support, shortest=shortest, longest=longest, max_fragment=options.max_fragment)


def trim_reads(spark: SparkSession, reads: str) -> DataFrame:
    """name, seq, qual, trimmed_5 of FASTQ reads without the ends of low quality."""
    return _tools.trim_ends(read_fastq(spark, reads).select("name", "seq", "qual"))


def sublong(spark: SparkSession, index: str, reads: str) -> DataFrame:
    """Records of long FASTQ reads, gaps between seeds filled, ends clipped."""
    r = read_fastq(spark, reads).select(F.col("name").alias("rid"), "seq")
    kmers, chunks, _, chunk = _read_index(spark, index)
    return _long.long_records(_long.align_long(r, kmers), r, chunks, chunk)


def structural_variants(spark: SparkSession, index: str, reads: str, mates: str, options: _align.AlignOptions = _align.AlignOptions()) -> DataFrame:
    """Deletions, inversions and translocations that mate pairs show."""
    kmers, chunks, step, chunk = _read_index(spark, index)

    def one(path: str) -> DataFrame:
        r = read_fastq(spark, path).select(F.regexp_replace("name", "/[12]$", "").alias("rid"), "seq", "qual")
        return _align.align(r, kmers, chunks, replace(options, best=MATE_PLACES), chunk, step)

    return _align.structural_variants(_align.pair_up(one(reads), one(mates), options), options)


def exact_snp(
    spark: SparkSession, alignments: str, reference: str, known: str | None = None, options: _variants.SnpOptions = _variants.SnpOptions(), control: str | None = None, indels: bool = True,
) -> DataFrame:
    """SNP rows chr, pos, ref, alt, qual, info and indel rows; with a control's alignments, its counts are in the INFO of SNPs."""
    ref = read_fasta(spark, reference, CHUNK, OVERLAP).select("chr", "start", "seq")

    def piled(path: str) -> tuple[DataFrame, DataFrame]:
        reads = read_alignments(spark, path).withColumn("fid", F.concat_ws("\x1f", "file", "qname", "hi")).withColumn("end", F.when(F.col("flag").bitwiseAND(F.lit(128)) != 0, 2).otherwise(1))
        return reads, _variants.pileup(_variants.mates_resolved(_variants.aligned_bases(reads, options)), ref, options, CHUNK)

    reads, pile = piled(alignments)
    seen = _variants.snp_bitmap(tables.read_vcf(spark, known)) if known else None
    rows = _variants.call_snps(pile, seen, options)
    if control:
        rows = _variants.with_control(rows, pile, piled(control)[1])
    rows = rows.select("chr", "pos", "ref", "alt", "qual", "info")
    if indels:
        found = _variants.indel_rows(_variants.indel_alleles(reads, ref, options, CHUNK))
        rows = rows.unionByName(found.withColumn("qual", F.col("qual").cast("double")))
    return rows


def find_common_variants(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    out = None
    for path in files:
        one = tables.read_vcf(spark, path)
        out = one if out is None else out.unionByName(one)
    return _variants.common_variants(out)


def flatten_gtf(spark: SparkSession, path: str, feature_type: str = "exon", gene_attribute: str = "gene_id", method: str = "merge") -> DataFrame:
    return _intervals.flatten_annotation(tables.read_gtf(spark, path, feature_type, gene_attribute), method)


def tx_unique(spark: SparkSession, path: str, feature_type: str = "exon", gene_attribute: str = "gene_id", transcript_attribute: str = "transcript_id") -> DataFrame:
    exons = tables.read_gtf(spark, path, feature_type, gene_attribute, extra=(transcript_attribute,)).withColumnRenamed(transcript_attribute, "transcript_id")
    return _intervals.unique_transcript_bases(exons).orderBy("gene_id", "transcript_id")


def promoter_regions(spark: SparkSession, annot: str | DataFrame, upstream: int = 3000, downstream: int = 2000) -> DataFrame:
    return _intervals.promoter_regions(annotation(spark, annot), upstream, downstream).orderBy("chr", "start")


def get_in_built_annotation(spark: SparkSession, genome: str, folder: str) -> DataFrame:
    return tables.built_in_annotation(spark, genome, folder)


process_exons = _intervals.process_exons


def detection_call_annotation(spark: SparkSession, exons: DataFrame | str, reference: str, bin_width: int = 2000) -> dict[str, DataFrame]:
    """exons (a table, or a GTF file) and bins between genes with their GC, AT and N counts."""
    exons = annotation(spark, exons, is_gtf=True) if isinstance(exons, str) else exons
    contigs = read_fasta(spark, reference, _tools.GC_CHUNK).select("chr", "start", "seq")
    genes = exons.groupBy("chr", "gene_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return {"exons": _tools.gc_content(exons, contigs, ["gene_id", "chr"]), "bins": _tools.gc_content(_tools.intergenic_bins(genes, bin_width), contigs, ["chr"])}


def detection_call(spark: SparkSession, alignments: str, exons: DataFrame, bins: DataFrame, seed: int = 42) -> DataFrame:
    """exons and bins as detection_call_annotation gives them."""
    starts = read_alignments(spark, alignments).filter("chr != '*'").select("chr", "pos")
    in_exons = _tools.reads_in_ranges(starts, exons.select("chr", "gene_id", "start", "end"), ["gene_id"])
    counted = exons.join(in_exons, ["chr", "gene_id", "start", "end"], "left").na.fill({"reads": 0})
    in_bins = _tools.reads_in_ranges(starts, bins.select("chr", "start", "end"), [])
    background = bins.join(in_bins, ["chr", "start", "end"], "left").na.fill({"reads": 0}).select((F.col("gc") / (F.col("length") - F.col("n"))).alias("gc_percent"), F.col("reads").alias("count"))
    return _tools.detection_call(_tools.gene_rollup(counted), background, seed)


def propmapped(spark: SparkSession, files: str | Sequence[str], count_fragments: bool = True, properly_paired: bool = False) -> DataFrame:
    return _tools.proportion_mapped(read_alignments(spark, files), count_fragments, properly_paired)


def quality_scores(spark: SparkSession, path: str, wanted: int = 10000, offset: int = 33) -> DataFrame:
    """path: FASTQ, SAM or BAM."""
    if probe(path).startswith("fastq"):
        reads, split = read_fastq(spark, path).withColumn("flag", F.lit(0)), ["file", "offset"]
    else:  # numbered once: read again, the tasks could differ
        reads, split = written(read_alignments(spark, path).select("flag", "qual", F.spark_partition_id().alias("split"), F.monotonically_increasing_id().alias("m")), "records"), ["split"]
        reads = reads.withColumn("ordinal", F.col("m").bitwiseAND(F.lit((1 << 33) - 1)))
    # a record's number is its number within its split and how many the splits before hold
    sizes = reads.groupBy(*split).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    numbered = reads.join(F.broadcast(before), split).withColumn("ordinal", F.col("ordinal") + F.col("before"))
    return _tools.quality_scores(numbered.select("ordinal", "flag", "qual"), wanted, offset)


def atgc_content(spark: SparkSession, path: str, by_position: bool = False) -> DataFrame:
    seqs = read_fastq(spark, path) if probe(path).startswith("fastq") else read_alignments(spark, path)
    return _tools.base_content_by_position(seqs).filter("position is not null") if by_position else _tools.base_content(seqs)


def remove_dup_reads(spark: SparkSession, path: str, threshold: int = 50) -> DataFrame:
    return _tools.remove_duplicate_positions(read_alignments(spark, path), threshold)


def repair(spark: SparkSession, path: str, add_dummy: bool = True, full_data: bool = True) -> DataFrame:
    out = _tools.repair(read_alignments(spark, path).drop("tags"), add_dummy)
    return out if full_data else out.drop("seq", "qual")


def sam2bed(spark: SparkSession, path: str) -> DataFrame:
    return _tools.to_bed(read_alignments(spark, path))


def scan_fasta(spark: SparkSession, path: str) -> DataFrame:
    return _tools.fasta_summary(transcripts(spark, path))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """transcript_id, seq; one of over TRANSCRIPT bases is an error."""
    long = F.when(F.col("start") > 1, F.raise_error(F.concat(F.lit("too long a transcript: "), "chr"))).otherwise(F.col("seq"))
    return read_fasta(spark, path, TRANSCRIPT).select(F.col("chr").alias("transcript_id"), long.alias("seq"))


def sim_reads(spark: SparkSession, path: str, expression: DataFrame, reads: int, **options) -> DataFrame:
    """expression: transcript_id, expression."""
    tx = transcripts(spark, path).join(expression, "transcript_id", "left")
    return simulate_reads(tx, reads, **options)


def cell_counts(
    spark: SparkSession, index: str, sheet: DataFrame, barcodes: DataFrame, annot: str | DataFrame, cutoff: float | None = None, barcode_length: int = 16, umi_length: int = 12, rescue: bool = True, is_gtf: bool = False,
) -> dict[str, DataFrame]:
    """sheet: SampleName and BarcodeUMIFile with ReadFile, or FastqDirectory (files ..._R1_... and ..._R2_... of each lane), or BAMFile
    (raw barcodes and UMIs in tags CR and UR); barcodes: barcode, ordinal.  counts (long), cells, and samples."""
    mode = next((m for m in ("fastq", "fastq-dir", "bam") if set(_cells.SHEET_COLUMNS[m]) <= set(sheet.columns)), "fastq")
    _cells.check_sheet(sheet.columns, mode)
    features, hits = annotation(spark, annot, is_gtf), None
    kmers, chunks, step, chunk = _read_index(spark, index)
    read = {
        "fastq": lambda row: read_barcode_pairs(spark, row["BarcodeUMIFile"], row["ReadFile"], barcode_length, umi_length),
        "fastq-dir": lambda row: read_barcode_folder(spark, row["FastqDirectory"], barcode_length, umi_length),
        "bam": lambda row: barcode_reads(read_alignments(spark, row["BAMFile"]), barcode_length, umi_length),
    }[mode]
    for row in sheet.collect():
        pairs = read(row)
        fixed = _cells.correct_barcodes(pairs.select(F.col("barcode").alias("raw")).distinct(), barcodes).withColumnRenamed("barcode", "cell")
        placed = _align.align(pairs.select(F.col("name").alias("rid"), "seq", "qual"), kmers, chunks, _align.AlignOptions(max_mismatches=10), chunk, step)
        reads = placed.filter("chr != '*'").select(F.col("rid").alias("fid"), "flag", "chr", "pos", "mapq", "cigar", F.lit(0).alias("tlen"), "nh")
        genes = _counting.assign(_counting.single_fragments(reads), features, _counting.CountOptions(strand=1)).filter("status = 'Assigned'")
        met = genes.select(F.col("fid").alias("name"), F.get("targets", F.lit(0)).alias("gene")).join(pairs.select("name", "barcode", "umi"), "name").join(fixed.withColumnRenamed("raw", "barcode"), "barcode")
        one = met.select(F.lit(row["SampleName"]).alias("sample"), "cell", "gene", "umi")
        hits = one if hits is None else hits.unionByName(one)
    counts = _cells.umi_counts(_cells.resolve_genes(_cells.merge_umis(_cells.umi_evidence(hits))))
    called = _cells.call_cells(counts, cutoff)
    saved = _cells.rescue(counts, _cells.rescue_candidates(called), _cells.ambient_profile(counts, called)) if rescue and cutoff is None else None
    cells = called.filter("high").select("sample", "cell")
    if saved is not None:
        cells = cells.unionByName(saved.filter("rescued").select("sample", "cell"))
    return {"counts": _cells.cell_matrix(counts, cells), "cells": called, "samples": _cells.sample_stats(called, saved)}
