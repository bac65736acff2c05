"""More counting: libraries, read groups, geometry at contig ends, insertions, junction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.operators import counting as C
from readloom.operators import events as E
from readloom.operators import intervals as I
from readloom.plans import views
from readloom.plans.queries import ANY, JUNCTIONS, ONE_GENE, SEQ
from readloom.plans.registry import query
from readloom.plans.views import SQL


def _by_library(a, features, o=C.CountOptions()):
    done = C.assign(C.single_fragments(a, carry=("library",)), features, o, ("library",))
    each = done.filter("status = 'Assigned'").select("library", F.explode("targets").alias("key"), "units")
    return each.groupBy("library", "key").agg((F.sum("units") / C.UNIT).alias("count"))


@query(f"""WITH {ANY}, g AS ({ONE_GENE}) SELECT file || ':g' || (mapq % 3) AS library, key, count(*)::DOUBLE AS count FROM g JOIN l USING (fid) WHERE k = 1 GROUP BY ALL""")
def count_by_read_group(spark, sf_dir):
    a = views.reads(spark, sf_dir).withColumn("library", F.concat_ws(":", "file", F.concat(F.lit("g"), F.col("mapq") % 3)))
    return _by_library(a, views.features(spark, sf_dir))


@query(f"""WITH {ANY}, g AS ({ONE_GENE}) SELECT key, (count(*) FILTER (file = 'F'))::DOUBLE AS "F", (count(*) FILTER (file = 'O'))::DOUBLE AS "O" FROM g JOIN l USING (fid) WHERE k = 1 GROUP BY key""")
def count_matrix(spark, sf_dir):
    """A column a library."""
    return C.wide(_by_library(views.reads(spark, sf_dir).withColumnRenamed("file", "library"), views.features(spark, sf_dir)), "library")


def _moved(start: str, end: str) -> str:
    return f"""WITH {SQL}, m AS (SELECT fid, chr, {start} AS a, {end} AS b FROM (SELECT *, CASE WHEN strand = '+' THEN 1 ELSE -1 END AS d, pos + len - 1 AS e, 90000 AS z FROM l)),
k AS (SELECT m.fid, min(gene_id) AS key, count(DISTINCT gene_id) AS k FROM m JOIN f ON m.chr = f.chr AND f.s <= m.b AND f.e >= m.a AND m.a <= m.b GROUP BY m.fid) SELECT key, count(*)::DOUBLE AS count FROM k WHERE k = 1 GROUP BY key"""


def _at_ends(spark, sf_dir, **options):
    a = views.reads(spark, sf_dir).withColumn("chr_length", F.lit(90_000))
    return C.count_table(C.assign(C.single_fragments(a), views.features(spark, sf_dir), C.CountOptions(**options))).select("key", "count")


SHIFT = "CASE WHEN d * 300 < 0 THEN greatest(d * 300, 1 - pos) WHEN e + 300 > z THEN z - e ELSE 300 END"


@query(_moved(f"pos + {SHIFT}", f"e + {SHIFT}"))
def count_shifted_at_contig_ends(spark, sf_dir):
    return _at_ends(spark, sf_dir, shift=300, shift_type="downstream")


@query(_moved("pos - least(CASE WHEN d > 0 THEN 100 ELSE 400 END, pos - 1)", "e + CASE WHEN e + CASE WHEN d > 0 THEN 400 ELSE 100 END > z THEN z - e WHEN d > 0 THEN 400 ELSE 100 END"))
def count_extended_at_contig_ends(spark, sf_dir):
    return _at_ends(spark, sf_dir, extend_5=100, extend_3=400)


@query(_moved("CASE WHEN d > 0 THEN e + 7 + 11 ELSE pos - 7 - 11 END", "CASE WHEN d > 0 THEN e + 7 + 11 ELSE pos - 7 - 11 END"))
def count_moved_in_order(spark, sf_dir):
    """Shifted downstream, extended and then reduced to the 3' end."""
    o = C.CountOptions(shift=7, shift_type="downstream", extend_5=5, extend_3=11, reduce_to=3)
    return C.count_table(C.assign(C.single_fragments(views.reads(spark, sf_dir)), views.features(spark, sf_dir), o)).select("key", "count")


@query(f"""WITH {SQL}, m AS (SELECT fid, chr, pos AS a, pos + len - 1 - CASE WHEN ins THEN 2 ELSE 0 END AS b, len + CASE WHEN ins THEN 18 ELSE 0 END AS n FROM (SELECT *, len > 30 AND len % 2 = 0 AS ins FROM l)),
u AS (SELECT fid, gene_id, any_value(n) AS n, sum(greatest(0, x2 - greatest(x1, coalesce(p, x1 - 1) + 1) + 1)) AS shared FROM (
    SELECT *, max(x2) OVER (PARTITION BY fid, gene_id ORDER BY x1, x2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p
    FROM (SELECT fid, gene_id, n, greatest(a, s) AS x1, least(b, e) AS x2 FROM m JOIN f ON m.chr = f.chr AND f.s <= m.b AND f.e >= m.a)) GROUP BY fid, gene_id),
w AS (SELECT fid, count(*) FILTER (shared >= ceil(n * 0.6 - 0.001)) AS k FROM u GROUP BY fid)
SELECT CASE WHEN k IS NULL THEN 'Unassigned_NoFeatures' WHEN k = 0 THEN 'Unassigned_Overlapping_Length' WHEN k = 1 THEN 'Assigned' ELSE 'Unassigned_Ambiguity' END AS status, count(*) AS n FROM l LEFT JOIN w USING (fid) GROUP BY status""")
def count_with_insertions(spark, sf_dir):
    """A fragment's length counts what was inserted: an insertion of 20 bases in every other longer read."""
    cut = F.when((F.col("len") > 30) & (F.col("len") % 2 == 0), F.concat(F.lit("10M20I"), F.col("len") - 12, F.lit("M"))).otherwise(F.col("cigar"))
    a = views.reads(spark, sf_dir).withColumn("cigar", cut)
    return C.summary_table(C.assign(C.single_fragments(a), views.features(spark, sf_dir), C.CountOptions(frac_overlap=0.6)))


@query(f"""WITH {SQL}{JUNCTIONS}, body AS (SELECT chr, gene_id, min(s) AS s, max(e) AS e FROM f GROUP BY ALL),
g1 AS (SELECT jc.chr, "left", "right", body.gene_id AS g, (SELECT min("left" - f.e) FROM f WHERE f.chr = body.chr AND f.gene_id = body.gene_id AND f.e <= "left") AS d FROM jc JOIN body ON jc.chr = body.chr AND body.s <= "left" AND body.e >= "left"),
g2 AS (SELECT jc.chr, "left", "right", body.gene_id AS g, (SELECT min(f.s - "right") FROM f WHERE f.chr = body.chr AND f.gene_id = body.gene_id AND f.s >= "right") AS d FROM jc JOIN body ON jc.chr = body.chr AND body.s <= "right" AND body.e >= "right"),
kn AS (SELECT jc.chr, jc."left", jc."right", string_agg(DISTINCT a.transcript_id, ',' ORDER BY a.transcript_id) AS tx, string_agg(DISTINCT a.gene_id, ',' ORDER BY a.gene_id) AS gs
       FROM jc JOIN f a ON a.chr = jc.chr AND a.e = jc."left" JOIN f b ON b.chr = jc.chr AND b.s = jc."right" AND a.transcript_id = b.transcript_id GROUP BY ALL),
both0 AS (SELECT chr, "left", "right", g1.g, g1.d AS a, g2.d AS b, (coalesce(g1.d, 1) = 0)::INT + (coalesce(g2.d, 1) = 0)::INT AS n FROM g1 JOIN g2 USING (chr, "left", "right") WHERE g1.g = g2.g),
both1 AS (SELECT *, max(n) OVER (PARTITION BY chr, "left", "right") AS best FROM both0),
bo AS (SELECT chr, "left", "right", any_value(best) AS best, string_agg(g, ',' ORDER BY g) AS gs, string_agg(coalesce(a::VARCHAR, 'NA') || '/' || coalesce(b::VARCHAR, 'NA'), ',' ORDER BY g) AS ds FROM both1 WHERE n = best GROUP BY chr, "left", "right"),
h1 AS (SELECT *, bool_or(coalesce(d = 0, false)) OVER (PARTITION BY chr, "left", "right") AS hit FROM g1), h2 AS (SELECT *, bool_or(coalesce(d = 0, false)) OVER (PARTITION BY chr, "left", "right") AS hit FROM g2),
si AS (SELECT chr, "left", "right", g, 1 AS no, hit, coalesce(d::VARCHAR, 'NA') || '/NA' AS t FROM h1 WHERE NOT hit OR d = 0 UNION ALL SELECT chr, "left", "right", g, 2, hit, 'NA/' || coalesce(d::VARCHAR, 'NA') FROM h2 WHERE NOT hit OR d = 0),
fu AS (SELECT chr, "left", "right", string_agg(g, ',' ORDER BY g) AS gs, string_agg(t, ',' ORDER BY g) AS ds, max(CASE WHEN no = 1 AND hit THEN 1 ELSE 0 END) + max(CASE WHEN no = 2 AND hit THEN 1 ELSE 0 END) AS n FROM si GROUP BY ALL HAVING count(DISTINCT no) = 2)
SELECT CASE WHEN kn.tx IS NOT NULL THEN kn.gs ELSE coalesce(bo.gs, fu.gs, 'NA') END AS "GeneName", CASE WHEN kn.tx IS NOT NULL THEN kn.tx WHEN bo.gs IS NOT NULL THEN '' ELSE 'NA' END AS "TranscriptID",
    CASE WHEN kn.tx IS NOT NULL THEN 'KNOWN' WHEN bo.gs IS NOT NULL THEN 'NOVEL' WHEN fu.gs IS NOT NULL THEN 'NOVEL_FUSION' ELSE 'NA' END AS "Status",
    (CASE WHEN kn.tx IS NOT NULL THEN 2 ELSE coalesce(bo.best, fu.n, 0) END)::INT AS "nExons", CASE WHEN kn.tx IS NOT NULL THEN '0/0' ELSE coalesce(bo.ds, fu.ds, 'NA') END AS "Dist",
    jc.chr AS "Site1_chr", jc."left"::INT AS "Site1_location", jc."right"::INT AS "Site2_location", 'NA' AS "Site1_strand", coalesce(cf.n, 0) AS "F", coalesce(co.n, 0) AS "O"
FROM jc LEFT JOIN kn USING (chr, "left", "right") LEFT JOIN bo USING (chr, "left", "right") LEFT JOIN fu USING (chr, "left", "right")
LEFT JOIN (SELECT chr, "left", "right", count(*) AS n FROM j JOIN (SELECT fid, file FROM l) USING (fid) WHERE file = 'F' GROUP BY ALL) cf USING (chr, "left", "right")
LEFT JOIN (SELECT chr, "left", "right", count(*) AS n FROM j JOIN (SELECT fid, file FROM l) USING (fid) WHERE file = 'O' GROUP BY ALL) co USING (chr, "left", "right")""")
def junction_table(spark, sf_dir):
    """Genes, transcripts, status, known exon edges and distances of each junction, and its support in each library."""
    a = views.alignments(spark, sf_dir).withColumnRenamed("file", "library")
    per = C.junctions(C.single_fragments(a, carry=("library",)), ("library",)).groupBy("library", "chr", "left", "right").agg(F.count(F.lit(1)).alias("support"))
    sites = per.groupBy("chr", "left", "right").agg(F.sum("support").alias("support"))
    out = C.junction_table(C.classify_junctions(sites, views.features(spark, sf_dir)), per)
    return out.withColumnRenamed("Dist.to.nearest.splicing.site", "Dist").drop("Site2_chr", "Site2_strand")


@query(f"""WITH {SEQ}, s AS (SELECT chr, 10 + doc_id % 97 AS "left", 40 + doc_id % 389 AS "right", seq, length(seq) AS n FROM q),
d AS (SELECT chr, "left", "right", CASE WHEN "left" < n THEN seq["left" + 1:"left" + 2] ELSE '' END AS d, CASE WHEN "right" - 2 <= n THEN seq["right" - 2:"right" - 1] ELSE '' END AS a FROM s)
SELECT chr, "left", "right", CASE WHEN d = 'GT' AND a = 'AG' THEN '+' WHEN d = 'CT' AND a = 'AC' THEN '-' END AS strand FROM d""")
def junction_strands(spark, sf_dir):
    q = views.sequences(spark, sf_dir)
    sites = q.select("chr", (10 + F.col("doc_id") % 97).alias("left"), (40 + F.col("doc_id") % 389).alias("right"))
    return C.junction_strand(sites, views.chunks(q, 64, 2), 64)


@query(f"""WITH {SQL}, a AS (SELECT CASE WHEN feature_id % 3 = 0 THEN 'other' ELSE 'main' END AS grp, ['CDS', 'UTR', 'GENE'][(feature_id % 4 % 3 + 1)::INT] AS kind, 'c' || chr AS chr, gene_id, s, e, strand FROM f),
k AS (SELECT gene_id, CASE WHEN chr = 'cchr1' THEN 'chr1' ELSE chr END AS chr, strand, s, e FROM a WHERE grp = 'main' AND kind <> 'GENE'),
i AS (SELECT *, CASE WHEN s > max(e) OVER w + 1 OR max(e) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM k WINDOW w AS (PARTITION BY gene_id, chr, strand ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT gene_id, chr, strand, min(s)::INT AS start, max(e)::INT AS "end" FROM (SELECT *, sum(fresh) OVER (PARTITION BY gene_id, chr, strand ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM i) GROUP BY gene_id, chr, strand, n""")
def processed_exons(spark, sf_dir):
    f, k = views.features(spark, sf_dir), F.col("feature_id")
    kind = F.when(k % 4 % 3 == 0, "CDS").when(k % 4 % 3 == 1, "UTR").otherwise("GENE")
    a = f.select(F.when(k % 3 == 0, "other").otherwise("main").alias("group_label"), kind.alias("feature_type"), F.concat(F.lit("c"), "chr").alias("chr"), "gene_id", "start", "end", "strand")
    return I.process_exons(a, "main", {"cchr1": "chr1"})


@query(f"""WITH {SQL}{JUNCTIONS}, x AS (SELECT chr, e, lead(s) OVER (PARTITION BY chr, transcript_id, strand ORDER BY s, e) AS r FROM f), n AS (SELECT DISTINCT chr, e AS "left", r AS "right" FROM x WHERE r > e + 1)
SELECT chr, "left"::INT AS "left", "right"::INT AS "right", coalesce(support, 0) AS support, n.chr IS NOT NULL AS known FROM jc FULL JOIN n USING (chr, "left", "right")""")
def guided_junctions(spark, sf_dir):
    found = C.junction_counts(C.junctions(C.single_fragments(views.alignments(spark, sf_dir))))
    return E.guided_junctions(found, E.annotated_introns(views.features(spark, sf_dir).withColumn("gene_id", F.col("chr"))))
