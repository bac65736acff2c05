"""More single-cell queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.operators import singlecell as S
from readloom.plans import views
from readloom.plans.queries import BARCODE, RESOLVED, UMI, _barcodes
from readloom.plans.registry import query

STRIDE = 11_218_439
#: Cells with hundreds of times their UMIs, so that the fixed limits tell them apart.
CELLS = f"{UMI}{RESOLVED}, hc AS (SELECT sample, cell, gene, umis * 100 AS umis FROM uc), tt AS (SELECT sample, cell, sum(umis)::BIGINT AS total FROM hc GROUP BY ALL), ca AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY total DESC, cell) AS rank, total >= 4999.9 AS high FROM tt)"


def _counts(spark, sf_dir):
    counts = S.umi_counts(S.resolve_genes(S.umi_evidence(views.umis(spark, sf_dir))))
    return counts.withColumn("umis", F.col("umis") * 100)


@query(f"""WITH {UMI}{RESOLVED}, t AS (SELECT sample, cell, sum(umis)::BIGINT AS total FROM uc GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY total DESC, cell) AS rank, count(*) OVER (PARTITION BY sample) AS n FROM t),
d AS (SELECT *, (SELECT gcd({STRIDE}, any_value(n)) FROM rk) AS g FROM rk), e AS (SELECT *, (rank - 1) % g = (n // 2) % g AS drawn FROM d),
w AS (SELECT *, sum(CASE WHEN drawn THEN g ELSE 0 END) OVER (ORDER BY rank) AS upto FROM e), l AS (SELECT greatest(1, floor(max(total) / 10 + 0.5)) AS least_ FROM (SELECT total FROM w WHERE upto >= least(30, n) ORDER BY rank LIMIT 1)),
h AS (SELECT coalesce(sum(g), 0) AS n_high FROM w, l WHERE drawn AND total >= least_)
SELECT sample, cell, total, rank, rank <= n_high AS high FROM w, h""")
def cell_calls_bootstrap(spark, sf_dir):
    return S.call_cells(S.umi_counts(S.resolve_genes(S.umi_evidence(views.umis(spark, sf_dir)))))


@query(f"""WITH {CELLS}, m AS (SELECT sample, median(total) AS m FROM ca WHERE high GROUP BY sample)
SELECT sample, cell, total, rank FROM ca JOIN m USING (sample) WHERE NOT high AND total >= greatest(500, m * 0.01) AND rank < 45000 QUALIFY row_number() OVER (PARTITION BY sample ORDER BY rank) <= 20000""")
def rescue_candidates(spark, sf_dir):
    return S.rescue_candidates(S.call_cells(_counts(spark, sf_dir), cutoff=5000)).select("sample", "cell", "total", "rank")


@query(f"""WITH {CELLS} SELECT sample, gene, sum(umis)::BIGINT AS umis FROM hc JOIN ca USING (sample, cell) WHERE rank BETWEEN 50 AND 120 GROUP BY ALL""")
def ambient_profile(spark, sf_dir):
    counts = _counts(spark, sf_dir)
    return S.ambient_profile(counts, S.call_cells(counts, cutoff=5000), (50, 120))


@query(f"""WITH {CELLS} SELECT sample, cell, gene, umis FROM hc JOIN ca USING (sample, cell) WHERE high""")
def cell_matrix(spark, sf_dir):
    counts = _counts(spark, sf_dir)
    return S.cell_matrix(counts, S.call_cells(counts, cutoff=5000).filter("high")).select("sample", "cell", "gene", "umis")


@query(f"""WITH {CELLS} SELECT sample, count(*) AS total_cells, count(*) AS high_confidence, 0::BIGINT AS rescued, sum(total)::BIGINT AS total_umi, min(total) AS min_umi, median(total)::DOUBLE AS median_umi, max(total) AS max_umi, avg(total) AS mean_umi FROM ca WHERE high GROUP BY sample""")
def sample_stats(spark, sf_dir):
    return S.sample_stats(S.call_cells(_counts(spark, sf_dir), cutoff=5000))


SHEET = BARCODE.split(",\nkn AS")[0]


@query(f"""WITH {SHEET}, sh AS (SELECT n_nationkey AS ordinal, n_name AS sample, substr('ACGT', (n_nationkey % 4 + 1)::INT, 1) || substr('ACGT', (n_nationkey // 4 % 4 + 1)::INT, 1) || 'AC' || substr('ACGT', (n_nationkey // 16 % 4 + 1)::INT, 1) || 'A' AS s FROM nation),
r AS (SELECT k, bc, 'lane' || (k % 2) AS lane FROM b), m AS (SELECT k, arg_min(sample, ordinal) AS sample FROM r JOIN sh ON hamming(bc, s) <= 1 AND (ordinal % 3 <> 0 OR lane = 'lane1') GROUP BY k)
SELECT sample, count(*) AS reads FROM r LEFT JOIN m USING (k) GROUP BY sample""")
def demultiplexed_reads(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    base = lambda x, i: F.substring(F.lit("ACGT"), (F.floor(x / 4**i) % 4 + 1).cast("int"), F.lit(1))
    reads = views.table(spark, sf_dir, "customer").select(F.concat(*(base(k, i) for i in range(6))).alias("index1"), F.lit(None).cast("string").alias("index2"), F.concat(F.lit("lane"), k % 2).alias("lane"))
    sheet = views.table(spark, sf_dir, "nation").select(
        n.alias("ordinal"), F.col("n_name").alias("sample"), F.concat(base(n, 0), base(n, 1), F.lit("AC"), base(n, 2), F.lit("A")).alias("s_index1"), F.lit(None).cast("string").alias("s_index2"),
        F.when(n % 3 == 0, "lane1").alias("s_lane"),
    )
    return S.demultiplex(reads, sheet).groupBy("sample").agg(F.count(F.lit(1)).alias("reads"))


@query(f"""WITH {BARCODE}, s AS (SELECT count(*) FILTER (bc IN (SELECT barcode FROM kn)) / count(*) AS share FROM (SELECT bc FROM b ORDER BY k LIMIT 100000)) SELECT CASE WHEN share > 0.6 THEN 'sevenths' ELSE 'all' END AS name FROM s""")
def chosen_barcode_set(spark, sf_dir):
    """The first set that holds most of the reads' barcodes."""
    seen, known = _barcodes(spark, sf_dir)
    k = F.col("c_custkey")
    bc = F.concat(*(F.substring(F.lit("ACGT"), (F.floor(k / 4**i) % 4 + 1).cast("int"), F.lit(1)) for i in range(6)))
    reads = views.table(spark, sf_dir, "customer").select(bc.alias("raw"), k.alias("ordinal"))
    name = S.choose_barcode_set(reads, {"sevenths": known, "all": seen.withColumnRenamed("raw", "barcode")})
    return spark.createDataFrame([(name,)], "name string")
