"""Text formats through Spark's own readers: alignments, annotations, variants, ranges, matrices; and their writers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.session import written

GENOMES = ("mm9", "mm10", "mm39", "hg19", "hg38")


def _file() -> Column:
    return F.substring_index(F.input_file_name(), "/", -1)  # a pattern would be tried from each place of the path, for each line


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """file, qname, flag, chr, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, tags, nh (1 if absent), hi, rg, kinds: the type of each tag, a letter."""
    lines = spark.read.text(path).withColumn("file", _file()).filter(~F.col("value").startswith("@") & (F.length("value") > 0))
    p = F.split("value", "\t")
    tags = F.expr("map_from_entries(array_distinct(transform(slice(p, 12, greatest(size(p) - 11, 0)), t -> struct(substring(t, 1, 2) AS k, substring(t, 6) AS v))))")
    names = [("qname", "string"), ("flag", "int"), ("chr", "string"), ("pos", "int"), ("mapq", "int"), ("cigar", "string"), ("rnext", "string"), ("pnext", "int"), ("tlen", "int"), ("seq", "string"), ("qual", "string")]
    out = lines.withColumn("p", p).withColumn("tags", tags)
    kinds = F.expr("map_from_entries(array_distinct(transform(slice(p, 12, greatest(size(p) - 11, 0)), t -> struct(substring(t, 1, 2) AS k, substring(t, 4, 1) AS v))))")
    out = out.select("file", *(F.get("p", F.lit(i)).cast(t).alias(n) for i, (n, t) in enumerate(names)), "tags", kinds.alias("__kinds"))
    out = out.withColumn("nh", F.coalesce(F.col("tags")["NH"].cast("int"), F.lit(1))).withColumn("hi", F.col("tags")["HI"].cast("int")).withColumn("rg", F.col("tags")["RG"])
    return out.withColumn("kinds", F.col("__kinds")).drop("__kinds")


def contig_lengths(spark: SparkSession, path: str) -> DataFrame:
    """chr, chr_length of a SAM file's header."""
    head = spark.read.text(path).filter(F.col("value").startswith("@SQ\t"))
    tag = lambda k: F.regexp_extract("value", rf"\t{k}:([^\t]+)", 1)
    return head.select(tag("SN").alias("chr"), tag("LN").cast("int").alias("chr_length")).distinct()


def read_gtf(spark: SparkSession, path: str, feature_types: str = "exon", gene_attribute: str = "gene_id", strict_strand: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """feature_id, gene_id, chr, start, end, strand, attrs of rows of these types (a comma list).

    A kept row without the gene attribute is an error.  A strand other than + and - counts as +, or as "." if strict."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.length(F.trim("value")) > 0)).withColumn("ordinal", F.monotonically_increasing_id()).select(p.alias("p"), "ordinal")
    rows = rows.filter(F.col("p")[2].isin(*[t.strip() for t in feature_types.split(",")]))
    pairs = F.expr("map_from_entries(array_distinct(transform(regexp_extract_all(p[8], '(\\\\S+ +\"[^\"]*\"|[^ ;=]+=[^;]+)', 1), x -> struct(regexp_extract(x, '^([^ =]+)', 1) AS k, trim(BOTH '\"' FROM regexp_extract(x, '^[^ =]+[ =]+(.*)$', 1)) AS v))))")
    rows = rows.withColumn("attrs", pairs)
    gene = F.col("attrs")[gene_attribute]
    gene = F.when(gene.isNull(), F.raise_error(F.concat(F.lit(f"no {gene_attribute} in: "), F.col("p")[8]))).otherwise(gene)
    strand = F.when(F.col("p")[6].isin("+", "-"), F.col("p")[6]).otherwise("." if strict_strand else "+")
    return rows.select(F.col("ordinal").alias("feature_id"), gene.alias("gene_id"), F.col("p")[0].alias("chr"), F.col("p")[3].cast("int").alias("start"), F.col("p")[4].cast("int").alias("end"), strand.alias("strand"), *(F.col("attrs")[x].alias(x) for x in extra), "attrs")


def saf(df: DataFrame) -> DataFrame:
    """An annotation table with SAF columns in any case and order."""
    by = {c.lower(): c for c in df.columns}
    if missing := [c for c in ("geneid", "chr", "start", "end", "strand") if c not in by]:
        raise ValueError(f"the annotation lacks {', '.join(missing)}")
    kinds = {"geneid": "string", "chr": "string", "start": "int", "end": "int", "strand": "string"}
    out = df.select(F.monotonically_increasing_id().alias("feature_id"), *(F.col(by[c]).cast(t).alias("gene_id" if c == "geneid" else c) for c, t in kinds.items()))
    return out.withColumn("strand", F.when(F.col("strand") == "-", "-").otherwise("+"))


def read_saf(spark: SparkSession, path: str) -> DataFrame:
    return saf(spark.read.csv(path, sep="\t", header=True))


def built_in_annotation(spark: SparkSession, genome: str, folder: str) -> DataFrame:
    """The exons of a genome from <folder>/<genome>_RefSeq_exon.txt; the files are the user's."""
    if genome not in GENOMES:
        raise ValueError(f"genome is one of {', '.join(GENOMES)}")
    return read_saf(spark, f"{folder}/{genome}_RefSeq_exon.txt")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """chr (the annotation's name), rname (the reads' name)."""
    p = F.split("value", ",")
    return spark.read.text(path).filter(~F.col("value").startswith("#") & F.col("value").contains(",")).select(F.trim(p[0]).alias("chr"), F.trim(p[1]).alias("rname"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal, chrom, pos, id, ref, alt, qual, filter, info; further columns are dropped."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).select(_file().alias("file"), F.monotonically_increasing_id().alias("ordinal"), "value").filter(~F.col("value").startswith("#") & (F.length("value") > 0)).withColumn("p", p)
    names = [("chrom", "string"), ("pos", "long"), ("id", "string"), ("ref", "string"), ("alt", "string"), ("qual", "double"), ("filter", "string"), ("info", "string")]
    return rows.select("file", "ordinal", *(F.try_element_at("p", F.lit(i + 1)).try_cast(t).alias(n) for i, (n, t) in enumerate(names)))


def read_matrix_market(spark: SparkSession, folder: str) -> DataFrame:
    """gene, cell, umis from matrix.mtx, genes.tsv and barcodes.tsv of a folder."""
    lines = spark.read.text(f"{folder}/matrix.mtx").select("value", F.monotonically_increasing_id().alias("o"))
    head = lines.filter(F.col("value").startswith("%")).agg(F.max("o")).first()[0]
    body = lines.filter(~F.col("value").startswith("%")).select(F.split("value", r"\s+").alias("p"), "o")
    first = body.filter(F.col("o") > (-1 if head is None else head)).agg(F.min("o")).first()[0]  # the line of sizes follows the comments, whatever file comes first
    t = body.filter(F.col("o") != first).select(F.col("p")[0].cast("long").alias("g"), F.col("p")[1].cast("long").alias("c"), F.col("p")[2].cast("long").alias("umis"))
    side = lambda n, k: spark.read.csv(f"{folder}/{n}", sep="\t", schema=f"{k} long, name string")
    return t.join(side("genes.tsv", "g").withColumnRenamed("name", "gene"), "g").join(side("barcodes.tsv", "c").withColumnRenamed("name", "cell"), "c").select("gene", "cell", "umis")


def write_matrix_market(counts: DataFrame, folder: str) -> None:
    """counts: gene, cell, umis -> a folder of matrix.mtx, genes.tsv and barcodes.tsv (each a Spark text folder); ids are dense
    and come from ranges of sorted names."""
    spark = counts.sparkSession

    def numbered(name: str) -> DataFrame:
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # written once, with the numbers of the ranges: computed again, the ranges could differ
        part = written(counts.select(name).distinct().repartitionByRange(tasks, name).sortWithinPartitions(name).withColumn("part", F.spark_partition_id()), "numbered")
        before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offset = part.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before)
        nth = F.row_number().over(Window.partitionBy("part").orderBy(name))
        return part.withColumn("nth", nth).join(F.broadcast(offset), "part").select((F.col("nth") + F.col("before")).alias(f"{name}_id"), name)

    genes, cells = numbered("gene"), numbered("cell")
    met = counts.join(genes, "gene").join(cells, "cell")
    n = met.count()
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate integer general",), (f"{genes.count()} {cells.count()} {n}",)], "value string").coalesce(1)
    met.select(F.concat_ws(" ", "gene_id", "cell_id", "umis").alias("value")).transform(head.unionByName).write.text(f"{folder}/matrix.mtx")
    for df, name in ((genes, "genes"), (cells, "barcodes")):
        df.select(F.concat_ws("\t", *df.columns).alias("value")).write.text(f"{folder}/{name}.tsv")


def _tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.csv(path, sep="\t", header=header, quote="", escape="", emptyValue="", nullValue="NA")


def as_count(units: Column, unit: int = 65536) -> Column:
    """Whole counts as such, others with two decimals, ties to the even one."""
    cents, rest = F.floor(units * 100 / unit), (units * 100) % unit
    cents = cents + F.when((rest * 2 > unit) | ((rest * 2 == unit) & (cents % 2 == 1)), 1).otherwise(0)
    text = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return F.when(units % unit == 0, F.floor(units / unit).cast("string")).otherwise(text)


def write_counts(table: DataFrame, path: str) -> None:
    _tsv(table, path)


def summary_rows(summaries: DataFrame, statuses: list[str]) -> DataFrame:
    """status and a column per library, all statuses in order.  summaries: library, status, n."""
    spark = summaries.sparkSession
    order = spark.createDataFrame(list(enumerate(statuses)), "__order int, status string")
    wide = summaries.groupBy("status").pivot("library").sum("n")
    return order.join(wide, "status", "left").orderBy("__order").drop("__order").na.fill(0)


def write_report(assigned: DataFrame, path: str) -> None:
    """Per fragment: name, status, number of targets, targets or NA."""
    _tsv(assigned.select("fid", "status", F.size("targets").alias("n"), F.when(F.size("targets") > 0, F.array_join("targets", ",")).otherwise("NA").alias("targets")), path, header=False)


def tagged_sam(alignments: DataFrame, assigned: DataFrame) -> DataFrame:
    """Alignment columns with tags XS (status), XN and XT where there are targets.  alignments carry fid."""
    met = alignments.join(assigned.select("fid", "status", "targets"), "fid", "left")
    more = F.create_map(F.lit("XS"), "status")
    counted = F.create_map(F.lit("XN"), F.size("targets").cast("string"), F.lit("XT"), F.array_join("targets", ","))
    return met.withColumn("tags", F.map_concat(F.col("tags"), F.when(F.size("targets") > 0, F.map_concat(more, counted)).otherwise(more))).drop("status", "targets")


#: Types of tags that hold whole numbers (fixed values).
INTEGER_TAGS = ("NH", "HI", "NM", "XN", "AS", "MQ")


def sam_lines(alignments: DataFrame) -> DataFrame:
    """Records as text; types of tags are those in the column kinds, if there is one, else by the tag's name."""
    listed = ",".join(f"'{t}'" for t in INTEGER_TAGS)
    known = "kinds[x.key]" if "kinds" in alignments.columns else "CAST(NULL AS STRING)"
    tags = F.expr(f"transform(map_entries(tags), x -> concat(x.key, ':', coalesce({known}, CASE WHEN x.key IN ({listed}) THEN 'i' ELSE 'Z' END), ':', x.value))")
    fixed = ["qname", "flag", "chr", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
    return alignments.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("*")) for c in fixed), F.coalesce(tags, F.array())).alias("value"))


def in_header_order(alignments: DataFrame, contigs: Iterable[str]) -> DataFrame:
    """Rows dealt out and sorted by place: contigs in the header's order, then those it doesn't name, then records without a place."""
    order = alignments.sparkSession.createDataFrame([(c, i) for i, c in enumerate(contigs)], "chr string, __order int")
    at = alignments.join(F.broadcast(order), "chr", "left")  # a header is held whole by whoever writes or reads it
    last = F.when(F.coalesce(F.col("chr"), F.lit("*")) == "*", 1 << 30).otherwise((1 << 30) - 1)
    keys = "__order", "chr", "pos", "qname", "flag"
    at = at.withColumn("__order", F.coalesce("__order", last))
    return at.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*alignments.columns)


def write_sam(alignments: DataFrame, path: str, contigs: dict[str, int], by_place: bool = False, more: Sequence[str] = ()) -> None:
    """Header and lines; sorted by place over the whole folder if asked.  more: lines of the header that follow the contigs."""
    if by_place:
        alignments = in_header_order(alignments, contigs)
    sam_lines(alignments).write.text(path)
    order = "coordinate" if by_place else "unsorted"
    head = [f"@HD\tVN:1.6\tSO:{order}", *(f"@SQ\tSN:{c}\tLN:{n}" for c, n in contigs.items()), *more]
    alignments.sparkSession.createDataFrame([(x,) for x in head], "value string").coalesce(1).write.mode("append").text(path)


def write_bed(rows: DataFrame, path: str) -> None:
    _tsv(rows.select("chr", "start", "end", "name", "score", "strand"), path, header=False)


def junction_bed(counts: DataFrame, anchor: int = 1) -> DataFrame:
    """Junctions (chr, left, right, support, strand) as 12 columns with two blocks; colour by strand."""
    start, end = F.col("left") - anchor, F.col("right") + anchor - 1
    colour = F.when(F.col("strand") == "-", "0,0,255").otherwise("255,0,0")
    name = F.format_string("JUNC%08d", F.row_number().over(Window.partitionBy("chr").orderBy("left", "right")))
    return counts.select("chr", start.alias("start"), end.alias("end"), name.alias("name"), F.col("support").alias("score"), F.coalesce("strand", F.lit(".")).alias("strand"), start.alias("thick_start"), end.alias("thick_end"), colour.alias("rgb"), F.lit(2).alias("blocks"), F.lit(f"{anchor},{anchor}").alias("sizes"), F.concat(F.lit("0,"), F.col("right") - 1 - start).alias("starts"))


def breakpoint_rows(events: DataFrame) -> DataFrame:
    """Breakpoints (id, chr1, pos1, chr2, pos2, same_strand, support) as two mated rows each."""
    sides = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.col(f"chr{a}").alias("chrom"), F.col(f"pos{a}").alias("pos"), F.col(f"chr{b}").alias("oc"), F.col(f"pos{b}").alias("op")) for m, a, b in ((1, 1, 2), (2, 2, 1)))))
    e = events.select("id", "same_strand", "support", sides.alias("s"))
    place = F.concat("s.oc", F.lit(":"), "s.op")
    alt = F.when(F.col("same_strand"), F.concat(F.lit("N["), place, F.lit("["))).otherwise(F.concat(F.lit("N]"), place, F.lit("]")))
    mate = F.concat(F.lit("bnd_"), "id", F.lit("_"), 3 - F.col("s.m"))
    return e.select("s.chrom", "s.pos", F.concat(F.lit("bnd_"), "id", F.lit("_"), "s.m").alias("id"), F.lit("N").alias("ref"), alt.alias("alt"), F.lit(".").alias("qual"), F.lit(".").alias("filter"), F.concat(F.lit("SVTYPE=BND;MATEID="), mate, F.lit(";SR="), "support").alias("info"))


def write_vcf(rows: DataFrame, path: str) -> None:
    cols = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info"]
    have = {c.lower() for c in rows.columns}
    out = rows.select(*(F.col(c).cast("string").alias(c) if c in have else F.lit(".").alias(c) for c in cols))
    head = rows.sparkSession.createDataFrame([("##fileformat=VCFv4.1",), ("#" + "\t".join(c.upper() for c in cols),)], "value string").coalesce(1)
    head.unionByName(out.select(F.concat_ws("\t", *(F.coalesce(c, F.lit(".")) for c in cols)).alias("value"))).write.text(path)


def mapping_summary(alignments: DataFrame, min_fragment: int = 50, max_fragment: int = 600) -> DataFrame:
    """Counts over primary records: total, mapped, uniquely and multi-mapping, unmapped, and of pairs: proper ones, ends that map alone,
    ends on two contigs, and, of other pairs on one contig (by their first ends), those on one strand, of a wrong length, or turned
    away from each other.  Junctions and indels: ``operators.events.event_counts``."""
    flag = F.col("flag")
    bit = lambda b: flag.bitwiseAND(F.lit(b)) != 0
    first = alignments.filter(~bit(256))
    mapped = ~bit(4)
    odd = bit(1) & bit(64) & mapped & ~bit(8) & ~bit(2) & ((F.col("rnext") == "=") | (F.col("rnext") == F.col("chr")))
    one_strand, fits = bit(16) == bit(32), F.abs("tlen").between(min_fragment, max_fragment)
    return first.groupBy("file").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(mapped).alias("mapped"), F.count_if(mapped & (F.col("nh") == 1)).alias("uniquely_mapped"), F.count_if(mapped & (F.col("nh") > 1)).alias("multi_mapping"),
        F.count_if(~mapped).alias("unmapped"), F.count_if(bit(1) & bit(2)).alias("properly_paired"), F.count_if(bit(1) & mapped & bit(8)).alias("singleton"),
        F.count_if(bit(1) & mapped & ~bit(8) & ~F.col("rnext").isin("=", "*") & (F.col("rnext") != F.col("chr"))).alias("more_than_one_chr"),
        F.count_if(odd & one_strand).alias("unexpected_strandness"), F.count_if(odd & ~one_strand & ~fits).alias("unexpected_template_length"), F.count_if(odd & ~one_strand & fits).alias("inversed_mapping"),
    )
