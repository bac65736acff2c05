"""Queries on read tools, variants and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.operators import events as E
from readloom.operators import readtools as R
from readloom.operators import variants as V
from readloom.plans import views
from readloom.plans.queries import INDELS, SEQ, _piled, _with_indels
from readloom.plans.registry import query
from readloom.plans.views import SQL

SAMPLED = """ceil(floor(i / step) * step) = i OR ceil((floor(i / step) + 1) * step) = i"""


@query(f"""WITH r AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, CASE WHEN doc_id % 11 = 0 THEN 256 WHEN doc_id % 2 = 1 THEN 16 ELSE 0 END AS flag, upper(sha256(doc_id::VARCHAR)) AS q FROM documents),
k AS (SELECT *, greatest(1.0, ((SELECT count(*) FROM r WHERE flag <> 256) - 0.1) / 40) AS step FROM r WHERE flag <> 256), p AS (SELECT i AS ordinal, CASE WHEN flag = 16 THEN reverse(q) ELSE q END AS q FROM k WHERE {SAMPLED})
SELECT ordinal, array_to_string(list_transform(string_split(q, ''), lambda c: ascii(c) - 33), ',') AS scores FROM p""")
def quality_score_sample(spark, sf_dir):
    """A systematic sample of 40 records' quality scores."""
    from pyspark.sql import Window

    k = F.col("doc_id")
    flag = F.when(k % 11 == 0, 256).when(k % 2 == 1, 16).otherwise(0)
    # as many numbers as documents: the order that files have
    d = views.table(spark, sf_dir, "documents").select((F.row_number().over(Window.orderBy("doc_id")) - 1).cast("long").alias("ordinal"), flag.alias("flag"), F.upper(F.sha2(k.cast("string"), 256)).alias("qual"))
    return R.quality_scores(d, 40).select("ordinal", F.array_join(F.transform("scores", lambda s: s.cast("string")), ",").alias("scores"))


WINDOWS = f"""{SEQ}, w AS (SELECT chr, seq, unnest(range(0, length(seq) // 100)) * 100 + 1 AS s FROM q), x AS (SELECT chr, s, seq[s:s + 99] AS t FROM w),
e AS (SELECT chr AS gene_id, s, 100 AS length, 100 - length(replace(replace(t, 'G', ''), 'C', '')) AS gc, 100 - length(replace(replace(t, 'A', ''), 'T', '')) AS "at", 100 - length(replace(t, 'N', '')) AS n, s % 7 AS reads FROM x)"""


@query(f"""WITH {WINDOWS}, g AS (SELECT * FROM e WHERE n <= 90 AND n + gc + "at" >= 0.9 * length)
SELECT gene_id, sum(length)::BIGINT AS length, sum(gc)::BIGINT AS gc, sum("at")::BIGINT AS "at", sum(n)::BIGINT AS n, sum(reads)::BIGINT AS reads, round(sum(gc) / (sum(length) - sum(n)), 9) AS gc_percent FROM g GROUP BY gene_id""")
def gene_rollup(spark, sf_dir):
    """Exons' base content and reads summed to genes."""
    from readloom.operators import intervals as I

    q = views.sequences(spark, sf_dir)
    w = I.fixed_bins(q.select("chr", F.col("chr").alias("gene_id"), F.lit(1).cast("long").alias("start"), F.length("seq").cast("long").alias("end")), 100)
    exons = R.gc_content(w, views.chunks(q, R.GC_CHUNK), ["gene_id", "chr"], 0.9).withColumn("reads", F.col("start") % 7)
    return R.gene_rollup(exons).withColumn("gc_percent", F.round("gc_percent", 9))


@query(f"""WITH {SQL}, r AS (SELECT feature_id, gene_id, count(l.pos) AS reads FROM f LEFT JOIN l ON l.chr = f.chr AND l.pos BETWEEN f.s AND f.e GROUP BY ALL),
g AS (SELECT gene_id, sum(e - s + 1) AS length, sum(reads) AS reads FROM f JOIN r USING (feature_id, gene_id) GROUP BY gene_id)
SELECT gene_id, length::BIGINT AS length, reads::BIGINT AS reads, round(0.09 * length / 2000, 9) AS expected, reads > 0.09 * length / 2000 + 5 AS detected FROM g""")
def detected_genes(spark, sf_dir):
    """Detection over a flat background of 0.09 reads a bin: what is expected, and what far exceeds it."""
    from readloom.operators import intervals as I

    f = views.features(spark, sf_dir).select("feature_id", "gene_id", "chr", F.col("start").cast("long").alias("f_start"), F.col("end").cast("long").alias("f_end"))
    starts = views.reads(spark, sf_dir).select("chr", "pos")
    hits = I.stab(starts, f, ["chr"]).groupBy("feature_id").agg(F.count(F.lit(1)).alias("reads"))
    exons = f.join(hits, "feature_id", "left").na.fill({"reads": 0}).select("gene_id", (F.col("f_end") - F.col("f_start") + 1).alias("length"), "reads", F.lit(40).alias("gc"), F.lit(60).alias("at"), F.lit(0).alias("n"))
    genes = exons.groupBy("gene_id").agg(F.sum("length").alias("length"), F.sum("reads").alias("reads")).withColumn("gc_percent", F.lit(0.4))
    background = spark.range(1000).select((F.col("id") / 1000).alias("gc_percent"), F.lit(0.09).alias("count"))
    called = R.detection_call(genes, background)
    return called.select("gene_id", "length", "reads", F.round("expected", 9).alias("expected"), (F.col("reads") > F.col("expected") + 5).alias("detected"))


# Variants

PILED = """p AS (SELECT 'chr' || (p_partkey % 5) AS chr, p_partkey // 5 AS pos, p_size + 10 AS a, CASE WHEN p_partkey % 97 = 0 THEN 30 ELSE p_partkey % 2 END AS c, CASE WHEN p_partkey % 89 = 0 THEN 12 ELSE 0 END AS t FROM part),
b AS (SELECT chr, pos, a, c, t, a AS m, c + t AS x, sum(a) OVER w - a AS bm, sum(c + t) OVER w - c - t AS bx FROM p WINDOW w AS (PARTITION BY chr ORDER BY pos RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING))"""
#: Fisher's one-sided test of the table [[a, b], [c, d]] of the rows of u, by sums over all tables.
FISHER = """v AS (SELECT *, unnest(range(greatest(0, fa + fb + fa + fc - (fa + fb + fc + fd)), least(fa + fb, fa + fc) + 1)) AS k FROM u),
y AS (SELECT *, exp(lgamma(fa + fb + 1) + lgamma(fc + fd + 1) + lgamma(fa + fc + 1) + lgamma(fb + fd + 1) - lgamma(fa + fb + fc + fd + 1) - lgamma(k + 1) - lgamma(fa + fb - k + 1) - lgamma(fa + fc - k + 1) - lgamma(fd - fa + k + 1)) AS h FROM v),
s AS (SELECT * EXCLUDE (k, h), sum(h) FILTER (k >= fa) AS up, sum(h) FILTER (k <= fa) AS down FROM y GROUP BY ALL), z AS (SELECT *, CASE WHEN fa * fd < fb * fc THEN 1.1 ELSE least(1.0, up, down) END AS p FROM s)"""


@query(f"""WITH {PILED}, u AS (SELECT *, x::BIGINT AS fa, bx::BIGINT AS fb, m::BIGINT AS fc, bm::BIGINT AS fd, greatest(1e-323, least(0.005, pow(10.0, -(((bm + bx + a + c + t) / 11.0) / (50.0 / 12.0))))) AS cutoff FROM b WHERE x > 0 AND bm * 20 > 16 * (bm + bx)), {FISHER}
SELECT chr, pos, 'A' AS ref, CASE WHEN c >= 1 AND t >= 1 THEN 'C,T' WHEN c >= 1 THEN 'C' ELSE 'T' END AS alt, round(-log10(greatest(1e-40, p)), 4) AS qual, (a + c + t)::BIGINT AS depth, x::BIGINT AS mm,
    'DP=' || (a + c + t) || ';MMsum=' || x || ';MM=' || CASE WHEN c >= 1 AND t >= 1 THEN c || ',' || t WHEN c >= 1 THEN c::VARCHAR ELSE t::VARCHAR END || ';BGTOTAL=' || (bm + bx)::BIGINT || ';BGMM=' || bx::BIGINT AS info FROM z WHERE p < cutoff""")
def snp_calls(spark, sf_dir):
    return V.call_snps(_piled(spark, sf_dir)).withColumn("qual", F.round("qual", 4)).drop("p")


@query(f"""WITH {PILED}, k AS (SELECT chr, pos, a + 5 AS cm, c // 3 AS cx FROM p WHERE pos % 3 <> 0), u AS (SELECT chr, pos, coalesce(m, 0) AS m, coalesce(x, 0) AS x, coalesce(cm, 0) AS cm, coalesce(cx, 0) AS cx, coalesce(x, 0)::BIGINT AS fa, coalesce(cx, 0)::BIGINT AS fb, coalesce(m, 0)::BIGINT AS fc, coalesce(cm, 0)::BIGINT AS fd FROM b FULL JOIN k USING (chr, pos)), {FISHER}
SELECT chr, pos, m::BIGINT AS match, x::BIGINT AS mismatch, cm::BIGINT AS control_match, cx::BIGINT AS control_mismatch, round(p, 6) AS vs_p FROM z""")
def tumour_against_control(spark, sf_dir):
    piled = _piled(spark, sf_dir)
    control = piled.filter("pos % 3 <> 0").select("chr", "pos", "ref", (F.col("a") + 5).alias("a"), F.expr("c div 3").alias("c"), F.lit(0).cast("long").alias("g"), F.lit(0).cast("long").alias("t")).withColumn("depth", F.col("a") + F.col("c"))
    out = V.compare_with_control(piled, control)
    return out.select("chr", "pos", "match", "mismatch", "control_match", "control_mismatch", F.round("vs_p", 6).alias("vs_p"))


@query("""SELECT DISTINCT 'chr' || (user_id % 3) AS chr, user_id % 50 AS pos FROM events WHERE event_id % 7 <> 0""")
def known_sites(spark, sf_dir):
    return V.snp_bitmap(views.variants(spark, sf_dir))


@query("""WITH p AS (SELECT 'chr' || (p_partkey % 5) AS chr, p_partkey // 5 AS pos, p_size + 10 AS m, CASE WHEN p_partkey % 97 = 0 THEN 30 ELSE p_partkey % 2 END + CASE WHEN p_partkey % 89 = 0 THEN 12 ELSE 0 END AS x FROM part),
k AS (SELECT *, pos % 4 = 0 AS known FROM p), f AS (SELECT *, CASE WHEN known THEN 0 ELSE m END AS fm, CASE WHEN known THEN 0 ELSE x END AS fx FROM k)
SELECT chr, pos, (sum(fm) OVER w - fm)::BIGINT AS bg_match, (sum(fx) OVER w - fx)::BIGINT AS bg_mismatch FROM f WINDOW w AS (PARTITION BY chr ORDER BY pos RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING)""")
def snp_background_without_known_sites(spark, sf_dir):
    piled = _piled(spark, sf_dir)
    return V.background(piled, piled.filter("pos % 4 = 0").select("chr", "pos"), bin_width=64).select("chr", "pos", "bg_match", "bg_mismatch")


BASES = """t AS (SELECT item_id, translate(text, 'acgt', 'ACGT') AS s FROM benchmark), e AS (
    SELECT item_id, 1 AS no, item_id % 20 + 1 AS p0, s, 40 AS q FROM t UNION ALL SELECT item_id, 2, item_id % 20 + 6, s, CASE WHEN item_id % 2 = 0 THEN 41 ELSE 40 END FROM t
), b AS (SELECT item_id, no, p0 + i AS pos, substr(s, i + 1, 1) AS base, q FROM (SELECT *, unnest(range(3, length(s) - 3)) AS i FROM e))"""


def _mates(spark, sf_dir):
    d = views.table(spark, sf_dir, "benchmark")
    seq = F.translate("text", "acgt", "ACGT")
    ends = F.explode(F.array(F.struct(F.lit(1).alias("end"), F.lit(0).alias("more"), F.lit("I").alias("q")), F.struct(F.lit(2).alias("end"), F.lit(5).alias("more"), F.when(F.col("item_id") % 2 == 0, "J").otherwise("I").alias("q"))))
    a = d.select("item_id", seq.alias("seq"), ends.alias("e")).filter(F.length("seq") > 6)
    return a.select(F.col("item_id").alias("fid"), "e.end", F.lit("chr1").alias("chr"), (F.col("item_id") % 20 + 1 + F.col("e.more")).alias("pos"), F.lit(0).alias("flag"), F.concat(F.length("seq").cast("string"), F.lit("M")).alias("cigar"), "seq", F.repeat("e.q", F.length("seq")).alias("qual"))


@query(f"""WITH {BASES}, m AS (SELECT item_id, pos, arg_max(base, (q, -no)) AS base, max(q) AS q FROM b GROUP BY ALL)
SELECT pos, upper(base) AS base, q::INT AS q, count(*) AS n FROM m WHERE base IN ('A', 'C', 'G', 'T') GROUP BY ALL""")
def mate_bases(spark, sf_dir):
    """Where two mates overlap, the base of higher quality, else the first mate's."""
    got = V.mates_resolved(V.aligned_bases(_mates(spark, sf_dir)))
    return got.filter(F.col("base").isin(*"ACGT")).groupBy("pos", "base", "q").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SQL}{INDELS}, sec AS (
    SELECT chr, pos AS a, CASE WHEN len > 30 THEN pos + 9 ELSE pos + len - 1 END AS b FROM l
    UNION ALL SELECT chr, pos + 10 + CASE WHEN len % 2 = 0 THEN 0 ELSE 3 END, pos + CASE WHEN len % 2 = 0 THEN len - 3 ELSE len + 2 END FROM l WHERE len > 30
), t AS (SELECT ev.chr, ev.pos, kind, count(*) AS against FROM ev JOIN sec ON sec.chr = ev.chr AND sec.a <= ev.pos AND sec.b >= ev.pos + 1 GROUP BY ALL)
SELECT chr, pos, CASE WHEN kind = 'I' THEN 'C' ELSE 'CCCC' END AS ref, CASE WHEN kind = 'I' THEN 'CGT' ELSE 'C' END AS alt,
    floor(greatest(1.0, 250 + 10 * ln(pow(0.5, greatest(30 - support, 0)))))::INT AS qual, 'INDEL;DP=' || (support + coalesce(against, 0)) || ';SR=' || support AS info FROM ev LEFT JOIN t USING (chr, pos, kind)""")
def indel_variant_rows(spark, sf_dir):
    """Indels of reads with their alleles on a reference of C, as variant rows."""
    a = _with_indels(spark, sf_dir).withColumns({"seq": F.rpad(F.concat(F.repeat(F.lit("C"), F.lit(10)), F.lit("GT")), F.col("len"), "C"), "qual": F.repeat(F.lit("I"), F.col("len"))})
    most = a.agg(F.max("pos")).first()[0] or 0
    c = spark.range(0, 5 * (most // 4096 + 1)).select(F.concat(F.lit("chr"), F.col("id") % 5).alias("chr"), (F.expr("id div 5") * 4096 + 1).alias("start"), F.repeat(F.lit("C"), F.lit(4200)).alias("seq"))
    return V.indel_rows(V.indel_alleles(a, c, chunk=4096))


# Events


@query(f"""WITH {SQL}{INDELS}, i AS (SELECT *, CASE WHEN pos > lag(pos) OVER w + 1 + 5 OR lag(pos) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM ev WINDOW w AS (PARTITION BY chr ORDER BY pos)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY chr ORDER BY pos) AS k FROM i)
SELECT chr, count(*) AS n, sum(pos)::BIGINT AS places, sum(support)::BIGINT AS support FROM (SELECT chr, pos, support FROM g QUALIFY row_number() OVER (PARTITION BY chr, k ORDER BY support DESC, pos, kind, length) = 1) GROUP BY chr""")
def pruned_events(spark, sf_dir):
    """Of events close together, the best supported."""
    kept = E.prune_neighbours(E.indel_events(_with_indels(spark, sf_dir)), 5 + 1)
    return kept.groupBy("chr").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("places"), F.sum("support").alias("support"))


@query("""WITH p AS (SELECT ['a', 'b'][(o_orderkey % 2 + 1)::INT] AS kind, 'chr' || (o_orderkey % 3) AS chr1, 'chr' || (o_custkey % 3) AS chr2, o_orderkey * 37 % 100000 AS pos1, o_custkey * 91 % 100000 AS pos2 FROM orders),
i AS (SELECT *, CASE WHEN pos1 > lag(pos1) OVER w + 500 OR lag(pos1) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM p WINDOW w AS (PARTITION BY kind, chr1, chr2 ORDER BY pos1)),
a AS (SELECT * EXCLUDE (fresh), sum(fresh) OVER (PARTITION BY kind, chr1, chr2 ORDER BY pos1) AS one FROM i),
j AS (SELECT *, CASE WHEN pos2 > lag(pos2) OVER w + 500 OR lag(pos2) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM a WINDOW w AS (PARTITION BY kind, chr1, chr2, one ORDER BY pos2)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY kind, chr1, chr2, one ORDER BY pos2) AS two FROM j)
SELECT kind, chr1, chr2, min(pos1) AS pos1, max(pos1) AS end1, min(pos2) AS pos2, max(pos2) AS end2, count(*) AS support FROM b GROUP BY kind, chr1, chr2, one, two""")
def breakpoint_clusters(spark, sf_dir):
    o, k, c = views.table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    p = o.select(F.when(k % 2 == 0, "a").otherwise("b").alias("kind"), F.concat(F.lit("chr"), k % 3).alias("chr1"), F.concat(F.lit("chr"), c % 3).alias("chr2"), (k * 37 % 100_000).alias("pos1"), (c * 91 % 100_000).alias("pos2"))
    return E.breakpoint_clusters(p)


@query("""WITH r AS (SELECT c_custkey AS rid, translate(sha256(c_custkey::VARCHAR) || md5(c_custkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT')[1:75] AS s,
    translate(md5(c_custkey::VARCHAR) || sha256(c_custkey::VARCHAR), '0123456789abcdef', '#%5555IIIIIIIIII')[1:75] AS q FROM customer),
b AS (SELECT *, coalesce([i FOR i IN range(37, 75) IF q[i + 1] <= '%'][2], 75) AS b2, list_reverse([i FOR i IN range(38) IF q[i + 1] <= '%'])[2] AS c2 FROM r),
e AS (SELECT *, coalesce(list_max([i FOR i IN range(37, b2) IF q[i + 1] > '%']), 37) AS tail, CASE WHEN c2 IS NULL THEN 0 ELSE coalesce(list_min([i FOR i IN range(c2 + 1, 38) IF q[i + 1] > '%']), 37) END AS head FROM b)
SELECT rid, CASE WHEN 3 * (tail - head) < 75 THEN '' ELSE s[head + 1:tail] END AS seq, CASE WHEN 3 * (tail - head) < 75 THEN '' ELSE q[head + 1:tail] END AS qual,
    CASE WHEN 3 * (tail - head) < 75 THEN 0 ELSE head END::INT AS trimmed_5 FROM e""")
def trimmed_reads(spark, sf_dir):
    """Reads without the ends of low quality."""
    k = F.col("c_custkey").cast("string")
    text = lambda letters, *of: F.left(F.translate(F.concat(*of), "0123456789abcdef", letters), F.lit(75))
    r = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rid"), text("ACGTACGTACGTACGT", F.sha2(k, 256), F.md5(k)).alias("seq"), text("#%5555IIIIIIIIII", F.md5(k), F.sha2(k, 256)).alias("qual"))
    return R.trim_ends(r)
