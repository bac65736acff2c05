"""Queries that write the driver's tables in a format and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom import api
from readloom.functions.dna import chromosome_match
from readloom.operators import counting as C
from readloom.operators import readtools as R
from readloom.plans import views
from readloom.plans.queries import ANY, ONE_GENE, PAIRS, RESOLVED, SEQ, UMI
from readloom.plans.registry import query
from readloom.plans.views import SQL
from readloom.session import scratch, written
from readloom.sources import bam, bam_index, files, sequences, tables

CONTIGS = {f"chr{i}": 1_000_000_000 for i in range(5)}


def _records(spark, sf_dir) -> DataFrame:
    """Alignments as whole records."""
    a = views.alignments(spark, sf_dir)
    seq = F.rpad(F.lit("ACGTTGCA"), F.col("len"), "ACGTTGCA")
    return a.withColumns({"rnext": F.lit("*"), "pnext": F.lit(0), "seq": seq, "qual": F.rpad(F.lit("5I:F"), F.col("len"), "5I:F"), "tags": F.create_map(F.lit("NH"), F.col("nh").cast("string"), F.lit("RG"), F.concat(F.lit("g"), F.col("mapq") % 3))})


RECORDS = f"""WITH {SQL} SELECT qname, flag::INT AS flag, chr, pos::INT AS pos, mapq::INT AS mapq, CASE WHEN len > 40 THEN '10M' || (l_linenumber * 100) || 'N' || (len - 10) || 'M' ELSE len || 'M' END AS cigar,
    substr(repeat('ACGTTGCA', 8), 1, len) AS seq, substr(repeat('5I:F', 16), 1, len) AS qual, nh::INT AS nh, 'g' || (mapq % 3) AS rg FROM l"""
RECORD_COLUMNS = ["qname", "flag", "chr", "pos", "mapq", "cigar", "seq", "qual", "nh", "rg"]


@query(RECORDS)
def sam_round_trip(spark, sf_dir):
    path = f"{scratch(spark)}/a.sam"
    tables.write_sam(_records(spark, sf_dir), path, CONTIGS, by_place=True)
    return tables.read_sam(spark, path).select(*RECORD_COLUMNS)


@query(RECORDS)
def bam_round_trip(spark, sf_dir):
    path = f"{scratch(spark)}/a.bam"
    bam.write_bam(_records(spark, sf_dir), path, CONTIGS, by_place=True)
    return bam.read_bam(spark, path, 200_000).select(*RECORD_COLUMNS)


REGIONS = [("chr0", 1, 20_000), ("chr1", 30_000, 30_400), ("chr1", 30_300, 90_000), ("chr3", 50_000, 50_000)]
_met = lambda span: " OR ".join(f"(chr = '{c}' AND pos <= {b} AND pos + {span} - 1 >= {a})" for c, a, b in REGIONS)


@query(f"SELECT * FROM ({RECORDS}) WHERE " + _met("CASE WHEN contains(cigar, 'N') THEN 10 + split_part(split_part(cigar, 'M', 2), 'N', 1)::INT + length(seq) - 10 ELSE length(seq) END"))
def bam_regions(spark, sf_dir):
    """Records of sorted, indexed BAM files that overlap a few regions, by the blocks that the indexes name."""
    path = f"{scratch(spark)}/a.bam"
    bam.write_bam(_records(spark, sf_dir), path, CONTIGS, by_place=True)
    return bam_index.read_bam_regions(spark, path, REGIONS).select(*RECORD_COLUMNS)


@query(f"WITH {SQL} SELECT chr, (max(pos) + 100)::INT AS chr_length FROM l GROUP BY chr")
def header_contigs(spark, sf_dir):
    """Contigs as the header of a file has them, as long as the records need."""
    path, records = f"{scratch(spark)}/a.sam", _records(spark, sf_dir)
    lengths = records.groupBy("chr").agg((F.max("pos") + 100).alias("n")).orderBy("chr").collect()  # a header's contigs
    tables.write_sam(records, path, {r["chr"]: r["n"] for r in lengths})
    return tables.contig_lengths(spark, path)


ELEVEN = {f"chr{i}": 1_000_000_000 for i in range(11)}


@query(f"""WITH {SQL}, m AS (SELECT CASE WHEN s.l_discount >= 0.09 THEN '*' ELSE 'chr' || (s.l_suppkey % 11) END AS chr, CASE WHEN s.l_discount >= 0.09 THEN 0 ELSE (s.l_partkey * 50)::INT END AS pos,
    CASE WHEN s.l_discount >= 0.09 THEN 99 ELSE s.l_suppkey % 11 END AS k FROM lineitem s)
SELECT row_number() OVER (ORDER BY k, pos) AS n, chr, pos FROM m""")
def sorted_places(spark, sf_dir):
    """The n-th record's place in files that are sorted by place: eleven contigs in the header's order, then what has no place."""
    out, li = f"{scratch(spark)}/sorted.bam", views.table(spark, sf_dir, "lineitem")
    lost = F.col("l_discount") >= 0.09
    r = li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("qname"), F.when(lost, 4).otherwise(0).alias("flag"), F.when(lost, "*").otherwise(F.concat(F.lit("chr"), F.col("l_suppkey") % 11)).alias("chr"),
        F.when(lost, 0).otherwise(F.col("l_partkey") * 50).cast("int").alias("pos"), F.lit(9).alias("mapq"), F.when(lost, "*").otherwise("4M").alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).alias("pnext"),
        F.lit(0).alias("tlen"), F.lit("ACGT").alias("seq"), F.lit("IIII").alias("qual"), F.create_map(F.lit("NH"), F.lit("1")).alias("tags"),
    )
    paths = bam.write_bam(r, out, ELEVEN, by_place=True)
    files_ = spark.createDataFrame(list(enumerate(paths)), "f int, path string").repartition(max(len(paths), 1), "f")
    back = files_.mapInArrow(bam.records_in_order, "f int, k long, chr string, pos int")
    back = written(back, "places")
    sizes, before, begin = {x["f"]: x["n"] for x in back.groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()}, 0, []  # a number a file
    for f in range(len(paths)):
        begin.append((f, before))
        before += sizes.get(f, 0)
    at = back.join(F.broadcast(spark.createDataFrame(begin, "f int, b long")), "f")
    return at.select((F.col("b") + F.col("k") + 1).alias("n"), "chr", "pos")


@query("""WITH x AS (SELECT l_suppkey % 7 AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT 'single' AS kind, 'G' || k AS key, 3 * n AS n FROM x UNION ALL SELECT 'paired', 'G' || k, 2 * n FROM x""")
def count_equal_records(spark, sf_dir):
    """Files in which equal records stand several times, through the function by task: each counts."""
    li = views.table(spark, sf_dir, "lineitem").select(F.expr("l_suppkey % 7").alias("k"))
    folder = scratch(spark)
    genes = spark.range(7).select(F.concat(F.lit("G"), "id").alias("gene_id"), F.concat(F.lit("chr"), "id").alias("chr"), F.lit(1).alias("start"), F.lit(5000).alias("end"), F.lit("+").alias("strand"))
    base = {"qname": F.lit("r"), "chr": F.concat(F.lit("chr"), "k"), "mapq": F.lit(40), "cigar": F.lit("4M"), "rnext": F.lit("*"), "pnext": F.lit(0), "tlen": F.lit(0), "seq": F.lit("ACGT"), "qual": F.lit("IIII"), "tags": F.create_map(F.lit("NH"), F.lit("1"))}
    single = li.withColumn("i", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumns(base | {"flag": F.lit(0), "pos": F.lit(101)})
    ends = F.explode(F.array(*(F.struct(F.lit(f).alias("flag"), F.lit(p).alias("pos"), F.lit(m).alias("pnext"), F.lit(t).alias("tlen")) for f, p, m, t in ((99, 101, 301, 204), (147, 301, 101, -204)))))
    paired = li.withColumn("i", F.explode(F.array(F.lit(1), F.lit(2)))).withColumns(base | {"rnext": F.lit("=")}).drop("pnext", "tlen").withColumn("e", ends).select("*", "e.*").drop("e")
    out = None
    for kind, records, o in (("single", single, C.CountOptions()), ("paired", paired, C.CountOptions(paired=True))):
        tables.write_sam(records, f"{folder}/{kind}.sam", ELEVEN)
        counted = api.feature_counts(spark, f"{folder}/{kind}.sam", genes.withColumnRenamed("gene_id", "GeneID"), options=o)["assigned"]
        one = counted.filter("status = 'Assigned'").select(F.lit(kind).alias("kind"), F.explode("targets").alias("key")).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {SEQ} SELECT 'd' || doc_id AS name, seq, repeat('I', length(seq)) AS qual FROM q WHERE length(seq) > 0")
def fastq_round_trip(spark, sf_dir):
    path = f"{scratch(spark)}/r.fastq"
    q = views.sequences(spark, sf_dir).filter(F.length("seq") > 0)
    sequences.write_fastq(q.select(F.concat(F.lit("d"), "doc_id").alias("name"), "seq", F.repeat(F.lit("I"), F.length("seq")).alias("qual")), path)
    return sequences.read_fastq(spark, path, 100_000).select("name", "seq", "qual")


@query(f"""WITH {SEQ}, k AS (SELECT chr, seq, unnest(range(0, CASE WHEN length(seq) >= 1050 THEN (length(seq) - 50) // 1000 ELSE 0 END + 1)) AS k FROM q)
SELECT chr, 1000 * k + 1 AS start, substr(seq, 1000 * k + 1, 1050) AS seq FROM k""")
def fasta_chunks(spark, sf_dir):
    path = f"{scratch(spark)}/g.fa"
    sequences.write_fasta(views.sequences(spark, sf_dir), path)
    return sequences.read_fasta(spark, path, 1000, 50).select("chr", "start", "seq")


FEATURES = f"""WITH {SQL} SELECT gene_id, chr, s::INT AS start, e::INT AS "end", strand{{more}} FROM f"""


@query(FEATURES.format(more=", transcript_id"))
def gtf_features(spark, sf_dir):
    path = f"{scratch(spark)}/a.gtf"
    line = F.concat_ws("\t", "chr", F.lit("s"), F.lit("exon"), "start", "end", F.lit("."), "strand", F.lit("."), F.concat(F.lit('gene_id "'), "gene_id", F.lit('"; transcript_id "'), "transcript_id", F.lit('";')))
    rows = views.features(spark, sf_dir).select(F.explode(F.array(line, F.lit("# a comment"), F.replace(line, F.lit("\texon\t"), F.lit("\tgene\t")))).alias("value"))
    rows.write.text(path)
    return tables.read_gtf(spark, path, extra=("transcript_id",)).select("gene_id", "chr", "start", "end", "strand", "transcript_id")


def _saf(spark, sf_dir, path):
    f = views.features(spark, sf_dir)
    f.select(F.col("gene_id").alias("GeneID"), F.col("chr").alias("Chr"), F.col("start").alias("Start"), F.col("end").alias("End"), F.col("strand").alias("Strand")).write.csv(path, sep="\t", header=True)


@query(FEATURES.format(more=""))
def saf_features(spark, sf_dir):
    path = f"{scratch(spark)}/a.saf"
    _saf(spark, sf_dir, path)
    return tables.read_saf(spark, path).drop("feature_id")


@query(FEATURES.format(more=""))
def built_in_features(spark, sf_dir):
    folder = scratch(spark)
    _saf(spark, sf_dir, f"{folder}/hg38_RefSeq_exon.txt")
    return tables.built_in_annotation(spark, "hg38", folder).drop("feature_id")


@query("""WITH r AS (SELECT unnest(['contig_' || i, i::VARCHAR, 'chr' || i, 'x' || i, 'chrchr' || i]) AS rname, i FROM (SELECT DISTINCT s_suppkey % 7 AS i FROM supplier) t), k AS (SELECT DISTINCT 'chr' || (p_partkey % 5) AS chr FROM part)
SELECT rname, chr FROM r JOIN k ON chr = 'chr' || i AND rname[1:1] <> 'x'""")
def aliased_contigs(spark, sf_dir):
    i = (F.col("s_suppkey") % 7).cast("string")
    path, ids = f"{scratch(spark)}/aliases.csv", views.table(spark, sf_dir, "supplier").select(i.alias("i")).distinct()
    ids.select(F.concat(F.lit("chr"), "i", F.lit(",contig_"), "i").alias("value")).write.text(path)
    names = ids.select(F.explode(F.array(F.concat(F.lit("contig_"), "i"), F.col("i"), F.concat(F.lit("chr"), "i"), F.concat(F.lit("x"), "i"), F.concat(F.lit("chrchr"), "i"))).alias("rname"))
    return chromosome_match(names, views.features(spark, sf_dir), tables.read_aliases(spark, path))


@query("""SELECT 'chr' || (user_id % 3) AS chrom, user_id % 50 AS pos, substr('ACGT', (user_id % 4 + 1)::INT, 1) AS ref, CASE WHEN event_id % 5 = 0 THEN 'G,T' ELSE 'T' END AS alt, floor(value) AS qual,
    CASE WHEN event_id % 7 = 0 THEN 'INDEL;DP=3' ELSE 'DP=3' END AS info FROM events""")
def vcf_round_trip(spark, sf_dir):
    path = f"{scratch(spark)}/a.vcf"
    tables.write_vcf(views.variants(spark, sf_dir), path)
    return tables.read_vcf(spark, path).select("chrom", "pos", "ref", "alt", "qual", "info")


LETTERS = "translate({0}, '0123456789abcdef', 'ACGTACGTACGTACGT')"


@query(f"""SELECT 'r' || c_custkey AS name, substr({LETTERS.format("md5(c_custkey::VARCHAR)")}, 1, 16) AS barcode, substr({LETTERS.format("md5(c_custkey::VARCHAR)")}, 17, 12) AS umi, {LETTERS.format("sha256(c_custkey::VARCHAR)")} AS seq FROM customer""")
def barcode_pairs(spark, sf_dir):
    folder = scratch(spark)
    letters = lambda c: F.translate(c, "0123456789abcdef", "ACGTACGTACGTACGT")
    k = F.col("c_custkey").cast("string")
    c = views.table(spark, sf_dir, "customer").select(F.concat(F.lit("r"), k).alias("n"), letters(F.md5(k)).alias("a"), letters(F.sha2(k, 256)).alias("b"))
    for no, seq in ((1, "a"), (2, "b")):
        sequences.write_fastq(c.select(F.concat("n", F.lit(f"/{no}")).alias("name"), F.col(seq).alias("seq"), F.repeat(F.lit("F"), F.length(seq)).alias("qual")), f"{folder}/{no}.fastq")
    return sequences.read_barcode_pairs(spark, f"{folder}/1.fastq", f"{folder}/2.fastq").select("name", "barcode", "umi", "seq")


@query(f"""WITH {SQL} SELECT substr({LETTERS.format("md5(qname)")}, 1, 16) AS name, count(*)::INT AS x FROM l WHERE flag & 256 = 0 GROUP BY ALL""")
def barcodes_from_bam(spark, sf_dir):
    """Records with raw barcodes in their tags: how many have each."""
    letters = F.translate(F.md5("qname"), "0123456789abcdef", "ACGTACGTACGTACGT")
    tagged = _records(spark, sf_dir).withColumn("tags", F.create_map(F.lit("CR"), F.left(letters, F.lit(16)), F.lit("UR"), F.substring(letters, 17, 12)))
    path = f"{scratch(spark)}/cells.bam"
    bam.write_bam(tagged, path, CONTIGS)
    return sequences.barcode_reads(bam.read_bam(spark, path)).groupBy(F.col("barcode").alias("name")).agg(F.count(F.lit(1)).cast("int").alias("x"))


@query("SELECT unnest(['bam', 'sam', 'fastq', 'fasta', 'vcf', 'saf', 'gtf']) AS kind")
def file_kinds(spark, sf_dir):
    """What kind each format's file is found to be, by its content."""
    folder, q = scratch(spark), views.sequences(spark, sf_dir).filter(F.length("seq") > 0)
    made = bam.write_bam(_records(spark, sf_dir), f"{folder}/0", CONTIGS)[:1]
    sam_lines = tables.sam_lines(_records(spark, sf_dir))
    sam_lines.write.text(f"{folder}/1")
    sequences.write_fastq(q.select(F.col("chr").alias("name"), "seq", F.repeat(F.lit("I"), F.length("seq")).alias("qual")), f"{folder}/2")
    sequences.write_fasta(q, f"{folder}/3")
    views.variants(spark, sf_dir).select(F.concat(F.lit("##fileformat=VCFv4.1\n"), "chrom").alias("value")).write.text(f"{folder}/4")
    _saf(spark, sf_dir, f"{folder}/5")
    views.features(spark, sf_dir).select(F.concat_ws("\t", "chr", F.lit("s"), F.lit("exon"), "start", "end", F.lit("."), "strand", F.lit("."), F.lit('gene_id "g"'))).write.text(f"{folder}/6")
    reads = [*made, *(next(name for name, size in files.files_under(f"{folder}/{i}") if size) for i in range(1, 7))]
    return spark.createDataFrame([(files.probe(p),) for p in reads], "kind string")


@query(f"""WITH {ANY}, g AS ({ONE_GENE}), s AS (SELECT CASE WHEN k IS NULL THEN 'Unassigned_NoFeatures' WHEN k = 1 THEN 'Assigned' ELSE 'Unassigned_Ambiguity' END AS status, coalesce(CASE WHEN k = 1 THEN key END, 'NA') AS targets FROM l LEFT JOIN g USING (fid))
SELECT status, (targets <> 'NA')::INT::VARCHAR AS n, targets, count(*) AS reads FROM s GROUP BY ALL""")
def assigned_report(spark, sf_dir):
    path = f"{scratch(spark)}/report.tsv"
    tables.write_report(C.assign(C.single_fragments(views.reads(spark, sf_dir)), views.features(spark, sf_dir)), path)
    back = spark.read.csv(path, sep="\t", schema="fid string, status string, n string, targets string")
    return back.groupBy("status", "n", "targets").agg(F.count(F.lit(1)).alias("reads"))


@query(f"""WITH {SQL}, sec AS (
    SELECT *, pos AS a, CASE WHEN len > 40 THEN pos + 9 ELSE pos + len - 1 END AS b FROM l UNION ALL SELECT *, pos + 10 + l_linenumber * 100, pos + l_linenumber * 100 + len - 1 FROM l WHERE len > 40
), j AS (SELECT *, CASE WHEN flag & 4 > 0 THEN 'Unassigned_Unmapped' WHEN len > 40 THEN 'Unassigned_Split' END AS st FROM l),
k AS (SELECT sec.fid, count(DISTINCT gene_id) AS k FROM sec JOIN f ON sec.chr = f.chr AND f.s <= sec.b AND f.e >= sec.a GROUP BY sec.fid),
r AS (SELECT file, coalesce(st, CASE WHEN k IS NULL THEN 'Unassigned_NoFeatures' WHEN k = 1 THEN 'Assigned' ELSE 'Unassigned_Ambiguity' END) AS status FROM j LEFT JOIN k USING (fid)),
o AS (SELECT unnest(['Assigned', 'Unassigned_Unmapped', 'Unassigned_Read_Type', 'Unassigned_Singleton', 'Unassigned_MappingQuality', 'Unassigned_Chimera', 'Unassigned_FragmentLength', 'Unassigned_Duplicate', 'Unassigned_MultiMapping', 'Unassigned_Secondary', 'Unassigned_Split', 'Unassigned_NoFeatures', 'Unassigned_Overlapping_Length', 'Unassigned_Ambiguity']) AS status)
SELECT status, count(*) FILTER (file = 'F') AS "F", count(*) FILTER (file = 'O') AS "O" FROM o LEFT JOIN r USING (status) GROUP BY status""")
def summary_file(spark, sf_dir):
    """The status summary of two libraries, with split reads left out, written and read back."""
    o = C.CountOptions(non_split_only=True)
    a = views.alignments(spark, sf_dir).withColumnRenamed("file", "library")
    done = C.assign(C.single_fragments(a, carry=("library",)), views.features(spark, sf_dir), o, ("library",))
    path = f"{scratch(spark)}/counts.summary"
    tables.write_counts(tables.summary_rows(done.groupBy("library", "status").agg(F.count(F.lit(1)).alias("n")), C.statuses(o)), path)
    return spark.read.csv(path, sep="\t", header=True, schema="status string, F long, O long")


@query(f"""WITH {ANY}, g AS ({ONE_GENE}), s AS (SELECT CASE WHEN k IS NULL THEN 'Unassigned_NoFeatures' WHEN k = 1 THEN 'Assigned' ELSE 'Unassigned_Ambiguity' END AS xs, CASE WHEN k = 1 THEN key END AS xt FROM l LEFT JOIN g USING (fid))
SELECT xs, CASE WHEN xt IS NOT NULL THEN '1' END AS xn, xt, count(*) AS reads FROM s GROUP BY ALL""")
def tagged_records(spark, sf_dir):
    """Records with their assignment in tags, written as lines and read back."""
    reads = views.reads(spark, sf_dir).withColumn("fid", F.concat("file", F.col("fid").cast("string")))
    full = reads.withColumns({"rnext": F.lit("*"), "pnext": F.lit(0), "seq": F.lit("*"), "qual": F.lit("*"), "tags": F.create_map(F.lit("NH"), F.col("nh").cast("string"))})
    # ids of rows are numbered anew in each plan: join on what is written
    path = f"{scratch(spark)}/a"
    full.write.parquet(path)
    full = spark.read.parquet(path)
    tagged = tables.tagged_sam(full, C.assign(C.single_fragments(full), views.features(spark, sf_dir)))
    tables.write_sam(tagged, f"{path}.sam", CONTIGS)
    tag = lambda k: F.col("tags")[k].alias(k.lower())
    return tables.read_sam(spark, f"{path}.sam").groupBy(tag("XS"), tag("XN"), tag("XT")).agg(F.count(F.lit(1)).alias("reads"))


@query(f"""WITH {SQL} SELECT chr, (pos - 1)::INT AS start, (pos - 1 + len)::INT AS "end", '.' AS name, mapq::INT AS score, CASE WHEN flag & 16 > 0 THEN '-' ELSE '+' END AS strand FROM l""")
def bed_file(spark, sf_dir):
    path = f"{scratch(spark)}/a.bed"
    tables.write_bed(R.to_bed(_records(spark, sf_dir)), path)
    return spark.read.csv(path, sep="\t", schema="chr string, start int, end int, name string, score int, strand string")


@query(f"""WITH {SQL}, j AS (SELECT DISTINCT fid, chr, pos + 9 AS "left", pos + 10 + l_linenumber * 100 AS "right" FROM l WHERE len > 40 AND flag & 4 = 0), jc AS (SELECT chr, "left", "right", count(*) AS support FROM j GROUP BY ALL)
SELECT chr, ("left" - 1)::INT AS start, "right"::INT AS "end", printf('JUNC%08d', row_number() OVER (PARTITION BY chr ORDER BY "left", "right")) AS name, support AS score, '.' AS strand, '255,0,0' AS rgb, '0,' || ("right" - "left") AS starts FROM jc""")
def junction_bed_rows(spark, sf_dir):
    counts = C.junction_counts(C.junctions(C.single_fragments(views.alignments(spark, sf_dir)))).withColumn("strand", F.lit(None).cast("string"))
    return tables.junction_bed(counts).select("chr", "start", "end", "name", "score", "strand", "rgb", "starts")


@query("""SELECT CASE WHEN m = 1 THEN 'chr' || (o_orderkey % 5) ELSE 'chr' || (o_custkey % 5) END AS chrom, CASE WHEN m = 1 THEN o_orderkey ELSE o_custkey END AS pos, 'bnd_' || o_orderkey || '_' || m AS id,
    'N' || CASE WHEN o_orderkey % 2 = 0 THEN '[' ELSE ']' END || CASE WHEN m = 1 THEN 'chr' || (o_custkey % 5) || ':' || o_custkey ELSE 'chr' || (o_orderkey % 5) || ':' || o_orderkey END || CASE WHEN o_orderkey % 2 = 0 THEN '[' ELSE ']' END AS alt,
    'SVTYPE=BND;MATEID=bnd_' || o_orderkey || '_' || (3 - m) || ';SR=' || (o_custkey % 9) AS info
FROM orders, (SELECT unnest([1, 2]) AS m) t""")
def breakpoint_vcf_rows(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    e = o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("chr"), F.col("o_orderkey") % 5).alias("chr1"), F.col("o_orderkey").alias("pos1"), F.concat(F.lit("chr"), F.col("o_custkey") % 5).alias("chr2"), F.col("o_custkey").alias("pos2"),
        (F.col("o_orderkey") % 2 == 0).alias("same_strand"), (F.col("o_custkey") % 9).alias("support"),
    )
    return tables.breakpoint_rows(e).select("chrom", "pos", "id", "alt", "info")


@query(f"WITH {UMI}{RESOLVED} SELECT gene, cell::VARCHAR AS cell, umis FROM uc")
def matrix_market_round_trip(spark, sf_dir):
    from readloom.operators import singlecell as S

    folder = f"{scratch(spark)}/m"
    tables.write_matrix_market(S.umi_counts(S.resolve_genes(S.umi_evidence(views.umis(spark, sf_dir)))).select("gene", F.col("cell").cast("string").alias("cell"), "umis"), folder)
    return tables.read_matrix_market(spark, folder)


@query(f"""WITH {SQL}, p AS (SELECT * FROM l WHERE flag & 256 = 0)
SELECT file, count(*) AS total, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 4 = 0 AND nh = 1) AS uniquely_mapped, count(*) FILTER (flag & 4 = 0 AND nh > 1) AS multi_mapping, count(*) FILTER (flag & 4 > 0) AS unmapped FROM p GROUP BY file""")
def mapping_summary_rows(spark, sf_dir):
    return tables.mapping_summary(_records(spark, sf_dir)).select("file", "total", "mapped", "uniquely_mapped", "multi_mapping", "unmapped")


@query(f"""WITH {ANY}, g AS (SELECT DISTINCT fid, nh, gene_id FROM h), k AS (SELECT *, count(*) OVER (PARTITION BY fid) AS k FROM g), u AS (SELECT gene_id AS key, sum((65536 // nh) // k)::BIGINT AS units FROM k GROUP BY key),
c AS (SELECT key, units, units * 100 // 65536 AS q, units * 100 % 65536 AS r FROM u), d AS (SELECT key, units, q + CASE WHEN r > 32768 OR r = 32768 AND q % 2 = 1 THEN 1 ELSE 0 END AS q FROM c)
SELECT key, CASE WHEN units % 65536 = 0 THEN (units // 65536)::VARCHAR ELSE (q // 100) || '.' || lpad((q % 100)::VARCHAR, 2, '0') END AS count FROM d""")
def count_text(spark, sf_dir):
    """Fractional counts as they are written: whole, or with two decimals, ties to the even one."""
    o = C.CountOptions(allow_multi_overlap=True, fraction=True)
    t = C.count_table(C.assign(C.single_fragments(views.reads(spark, sf_dir)), views.features(spark, sf_dir), o))
    return t.select("key", tables.as_count(F.col("units")).alias("count"))


#: Pairs with their mates' places; a lone end has none.
MATED = "WITH " + PAIRS.format(both="").split("), pr AS (")[0] + """), m AS (
    SELECT a.*, b.chr AS mchr, b.pos AS mpos FROM ends a LEFT JOIN ends b ON a.fid = b.fid AND a.no <> b.no
)"""


@query(f"""{MATED}, lone AS (SELECT * FROM m WHERE mchr IS NULL)
SELECT false AS dummy, no::INT AS "end", count(*) AS n, sum(pos)::BIGINT AS places FROM m GROUP BY no UNION ALL SELECT true, (3 - no)::INT, count(*), 0 FROM lone GROUP BY no""")
def repaired_pairs(spark, sf_dir):
    """Mates brought together, with a dummy for each lone end."""
    p = views.pairs(spark, sf_dir).withColumn("qname", F.concat_ws("-", "l_orderkey", "pair")).drop("l_orderkey", "pair")
    mate = p.select("qname", F.col("chr").alias("mchr"), F.col("pos").alias("mpos"), F.col("flag").bitwiseAND(F.lit(64)).alias("first"))
    met = p.withColumn("first", 64 - F.col("flag").bitwiseAND(F.lit(64))).join(mate, ["qname", "first"], "left")
    full = met.select(
        F.lit("f").alias("file"), "qname", "flag", "chr", "pos", "mapq", "cigar", F.coalesce("mchr", F.lit("*")).alias("rnext"), F.coalesce("mpos", F.lit(0)).alias("pnext"), "tlen", F.lit("A").alias("seq"), F.lit("I").alias("qual"), "nh", F.lit(1).alias("hi"),
    )
    return R.repair(full).groupBy("dummy", "end").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("places"))


@query(f"""WITH {SQL}, e AS (SELECT DISTINCT file, chr, pos, l_linenumber FROM l WHERE len > 40 AND flag & 4 = 0) SELECT file, count(*) AS junctions, 0::BIGINT AS indels FROM e GROUP BY file""")
def mapping_events(spark, sf_dir):
    """Different junctions and indels of each file."""
    from readloom.operators import events as E

    return E.event_counts(views.alignments(spark, sf_dir))


@query(f"""{MATED}, p AS (SELECT *, rev, mchr = chr AS one FROM m),
f AS (SELECT a.no, a.un, a.rev, a.tlen AS t0, a.one, b.un AS mun, b.rev AS mrev FROM p a JOIN p b ON a.fid = b.fid AND a.no <> b.no WHERE a.no = 1 AND NOT a.un AND NOT b.un AND a.one)
SELECT count(*) FILTER (rev = mrev) AS unexpected_strandness, count(*) FILTER (rev <> mrev AND NOT t0 BETWEEN 50 AND 600) AS unexpected_template_length, count(*) FILTER (rev <> mrev AND t0 BETWEEN 50 AND 600) AS inversed_mapping FROM f""")
def mapping_summary_of_pairs(spark, sf_dir):
    """Pairs on one contig that are not proper, by what is wrong with them."""
    p = views.pairs(spark, sf_dir).withColumn("first", F.col("flag").bitwiseAND(F.lit(64)))
    mate = p.select("l_orderkey", "pair", (64 - F.col("first")).alias("first"), F.col("flag").alias("mflag"), F.col("chr").alias("mchr"))
    met = p.join(mate, ["l_orderkey", "pair", "first"], "left")
    flag = F.col("flag") + F.when(F.col("mflag").bitwiseAND(F.lit(4)) != 0, 8).otherwise(0) + F.when(F.col("mflag").bitwiseAND(F.lit(16)) != 0, 32).otherwise(0)
    full = met.withColumn("flag", F.when(F.col("mflag").isNull(), F.col("flag") + 8).otherwise(flag)).withColumn("rnext", F.when(F.col("mchr") == F.col("chr"), "=").otherwise(F.coalesce("mchr", F.lit("*")))).withColumn("file", F.lit("f"))
    return tables.mapping_summary(full).select("unexpected_strandness", "unexpected_template_length", "inversed_mapping")
