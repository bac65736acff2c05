"""Single-cell quantification: demultiplexing, barcodes, UMIs, cell calling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.dna import hamming
from readloom.functions.stats import benjamini_hochberg, good_turing, log_factorial

#: Ranks of the barcodes that give the ambient profile, and limits of the rescue (fixed values).
AMBIENT_RANKS = (45_000, 90_000)
RESCUE_LEAST, RESCUE_MOST, RESCUE_FRACTION = 500, 20_000, 0.01
CELL_KEYS = ["sample", "cell"]
SHEET_COLUMNS = {
    "fastq": ["BarcodeUMIFile", "ReadFile", "SampleName"],
    "fastq-dir": ["FastqDirectory", "SampleName"],
    "bcl": ["InputDirectory", "Lane", "SampleName", "IndexSetName"],
    "bam": ["BAMFile", "SampleName"],
}


def check_sheet(columns: list[str], mode: str) -> None:
    if mode not in SHEET_COLUMNS:
        raise ValueError(f"input mode is one of {', '.join(SHEET_COLUMNS)}")
    if missing := [c for c in SHEET_COLUMNS[mode] if c not in columns]:
        raise ValueError(f"the sample sheet lacks {', '.join(missing)}")


def demultiplex(reads: DataFrame, sheet: DataFrame) -> DataFrame:
    """reads: index1, index2 (null if single), lane; sheet (tens of rows, made part of the plan): ordinal, sample, s_index1, s_index2, s_lane (null: any).
    Adds sample: the first entry within 1 difference (single index) or 2 (dual)."""
    entries = F.array(*[F.struct(*(F.lit(v).alias(k) for k, v in r.asDict().items())) for r in sheet.orderBy("ordinal").collect()])
    most = lambda e: F.when(e["s_index2"].isNull(), 1).otherwise(2)
    away = lambda e: hamming(F.col("index1"), e["s_index1"]) + F.when(e["s_index2"].isNull(), 0).otherwise(hamming(F.col("index2"), e["s_index2"]))
    fits = F.filter(entries, lambda e: (away(e) <= most(e)) & (e["s_lane"].isNull() | (e["s_lane"] == F.col("lane"))))
    return reads.withColumn("sample", F.get(fits, F.lit(0))["sample"])


def _half(barcode: Column, odd: int) -> Column:
    chars = F.split(barcode, "")
    return F.array_join(F.filter(chars, lambda c, i: i % 2 == odd), "")


def correct_barcodes(seen: DataFrame, known: DataFrame) -> DataFrame:
    """seen: raw (distinct), known: barcode, ordinal -> raw, barcode: equal, or the first known one with one difference.

    One difference leaves the even or the odd bases untouched: two equi-joins on half barcodes find all candidates; those by
    even bases come before those by odd, then list order."""
    exact = seen.join(known, seen["raw"] == known["barcode"]).select("raw", "barcode")
    rest = seen.join(exact, "raw", "left_anti")
    found = None
    for odd in (0, 1):
        a, b = rest.withColumn("half", _half(F.col("raw"), odd)), known.withColumn("half", _half(F.col("barcode"), odd))
        met = a.join(b, "half").filter(hamming(F.col("raw"), F.col("barcode")) == 1).select("raw", "barcode", F.lit(odd).alias("odd"), "ordinal")
        found = met if found is None else found.unionByName(met)
    near = found.groupBy("raw").agg(F.min_by("barcode", F.struct("odd", "ordinal")).alias("barcode"))
    return exact.unionByName(near)


def choose_barcode_set(reads: DataFrame, sets: dict[str, DataFrame], test_reads: int = 100_000, least: float = 0.6) -> str | None:
    """The first set that holds over ``least`` of the first reads' barcodes."""
    first = reads.orderBy("ordinal").limit(test_reads)
    n = first.count()
    for name, known in sets.items():
        if n and first.join(known, first["raw"] == known["barcode"], "left_semi").count() / n > least:
            return name
    return None


def umi_evidence(hits: DataFrame) -> DataFrame:
    """Reads per sample, cell, gene, umi."""
    return hits.groupBy("sample", "cell", "gene", "umi").agg(F.count(F.lit(1)).alias("reads"))


def _absorb(group: pd.DataFrame) -> pd.DataFrame:
    """Greedy: by reads, then UMI, each joins the first accepted UMI within one difference, or is accepted."""
    ordered = group.sort_values(["reads", "umi"], ascending=[False, True], kind="stable")
    accepted: dict[str, int] = {}
    order: dict[str, int] = {}
    near: dict[str, list[str]] = {}  # UMIs by a pattern with one place left open
    for umi, reads in zip(ordered["umi"], ordered["reads"]):
        patterns = [f"{umi[:i]}*{umi[i + 1 :]}" for i in range(len(umi))]
        found = [u for p in patterns for u in near.get(p, ())]
        if found:
            accepted[min(found, key=order.__getitem__)] += reads
        else:
            accepted[umi], order[umi] = reads, len(order)
            for p in patterns:
                near.setdefault(p, []).append(umi)
    return pd.DataFrame({"sample": group["sample"].iloc[0], "cell": group["cell"].iloc[0], "gene": group["gene"].iloc[0], "umi": list(accepted), "reads": list(accepted.values())})


def merge_umis(evidence: DataFrame) -> DataFrame:
    """UMIs of a cell and gene with one difference made one.  A group has at most 4**length rows, however many reads."""
    kind = dict(evidence.dtypes)
    schema = f"sample {kind['sample']}, cell {kind['cell']}, gene string, umi string, reads long"
    return evidence.groupBy("sample", "cell", "gene").applyInPandas(_absorb, schema)


def resolve_genes(evidence: DataFrame) -> DataFrame:
    """A UMI that several genes of a cell claim goes to that with strictly most reads, or to none."""
    w = Window.partitionBy("sample", "cell", "umi").orderBy(F.col("reads").desc())
    ranked = evidence.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("reads").over(w))
    return ranked.filter((F.col("r") == 1) & (F.col("next").isNull() | (F.col("reads") > F.col("next")))).drop("r", "next")


def umi_counts(resolved: DataFrame) -> DataFrame:
    """sample, cell, gene, umis."""
    return resolved.groupBy("sample", "cell", "gene").agg(F.count(F.lit(1)).alias("umis"))


def high_confidence_count(totals: np.ndarray, cells: np.ndarray | None = None, stride: int = 11_218_439) -> int:
    """How many cells are high-confidence ones: over pseudo-draws with a fixed stride, a tenth of the 30th highest total is the
    limit; the mean number above it.  totals, descending: one a cell, or each once with the number of its cells.

    Every draw visits the same ranks, as it begins where the first did: all, or where the number of cells n shares a factor g
    with the stride, each rank that equals n // 2 modulo g, g times.  So one draw gives the mean, from counts alone."""
    cells = np.ones(len(totals), np.int64) if cells is None else cells
    upto = np.cumsum(cells, dtype=np.int64)
    n = int(upto[-1]) if len(upto) else 0
    if not n:
        return 0
    g = math.gcd(stride, n)
    drawn = g * ((upto - n // 2 % g + g - 1) // g)  # of the totals down to each
    limit = np.floor(totals[np.searchsorted(drawn, min(30, n))] / 10 + 0.5)
    return int(drawn[np.count_nonzero(totals >= max(limit, 1)) - 1])


def ranked_cells(counts: DataFrame, cells: int = 4096) -> DataFrame:
    """sample, cell, total, rank (by total, then cell).  Ranks come from counts of totals by ranges of cells, so neither a sample nor the cells of
    one total, of which most have a single UMI, are sorted in one task.  A range is ``cells`` numbers, or the barcodes that share six letters."""
    ranges = F.left("cell", F.lit(6)) if dict(counts.dtypes)["cell"] == "string" else F.floor(F.col("cell") / cells)
    totals = counts.groupBy(*CELL_KEYS).agg(F.sum("umis").alias("total")).withColumn("__range", ranges)
    by_range = totals.groupBy("sample", "total", "__range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("sample").orderBy(F.col("total").desc(), "__range").rowsBetween(Window.unboundedPreceding, -1)
    above = by_range.select("sample", "total", "__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("above"))
    met = totals.join(above, ["sample", "total", "__range"])
    return met.withColumn("rank", F.col("above") + F.row_number().over(Window.partitionBy("sample", "total", "__range").orderBy("cell"))).drop("above", "__range")


def call_cells(counts: DataFrame, cutoff: float | None = None) -> DataFrame:
    """sample, cell, total, rank, high: with a cutoff, cells of cutoff - 0.1 UMIs or more; else the top N of each sample."""
    ranked = ranked_cells(counts)
    if cutoff is not None:
        return ranked.withColumn("high", F.col("total") >= cutoff - 0.1)
    def limit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("total", ascending=False)
        return pd.DataFrame({"sample": [g["sample"].iloc[0]], "n": [high_confidence_count(g["total"].to_numpy(), g["cells"].to_numpy())]})

    # a sample's group has a row a distinct total, however many cells
    limits = ranked.groupBy("sample", "total").agg(F.count(F.lit(1)).alias("cells")).groupBy("sample").applyInPandas(limit, f"sample {dict(counts.dtypes)['sample']}, n long")
    return ranked.join(F.broadcast(limits), "sample").withColumn("high", F.col("rank") <= F.col("n")).drop("n")


def rescue_candidates(called: DataFrame) -> DataFrame:
    """Cells that are not high-confidence but have UMIs enough to be tested."""
    middle = called.filter("high").groupBy("sample").agg(F.percentile("total", F.lit(0.5)).alias("m"))
    met = called.filter(~F.col("high")).join(F.broadcast(middle), "sample")
    enough = F.col("total") >= F.greatest(F.lit(RESCUE_LEAST), F.col("m") * RESCUE_FRACTION)
    kept = met.filter(enough & (F.col("rank") < AMBIENT_RANKS[0])).drop("m")
    return kept.withColumn("k", F.row_number().over(Window.partitionBy("sample").orderBy("rank"))).filter(F.col("k") <= RESCUE_MOST).drop("k")


def ambient_profile(counts: DataFrame, called: DataFrame, ranks: tuple[int, int] = AMBIENT_RANKS) -> DataFrame:
    """sample, gene, umis over the barcodes of these ranks."""
    low = called.filter(F.col("rank").between(*ranks)).select(*CELL_KEYS)
    return counts.join(low, CELL_KEYS).groupBy("sample", "gene").agg(F.sum("umis").alias("umis"))


def rescue(counts: DataFrame, candidates: DataFrame, ambient: DataFrame, simulations: int = 10_000, fdr: float = 0.01, seed: int = 42, block: int = 500) -> DataFrame:
    """sample, cell, p_value, fdr, rescued: candidates whose genes are unlikely draws from the ambient profile.

    The ambient profile (a row a gene) goes to the driver and is smoothed. Each candidate's own likelihood is worked out where its
    counts are. Draws are simulated by growing UMI totals, ``block`` simulations of a sample a task, and each serves all of the
    sample's candidates, of which a task sees only totals and likelihoods (RESCUE_MOST rows at most)."""
    profile = ambient.toPandas()
    shares = {s: dict(zip(g["gene"], good_turing(g["umis"].to_numpy()))) for s, g in profile.groupby("sample")}
    kinds = dict(counts.dtypes)

    def log_shares(sample) -> tuple[dict, np.ndarray]:
        share = shares.get(sample, {})
        p = np.maximum(np.array(list(share.values()) or [1.0]), 1e-12)
        return {g: i for i, g in enumerate(share)}, np.log(p / p.sum())

    def likelihood(group: pd.DataFrame) -> pd.DataFrame:
        genes, logp = log_shares(group["sample"].iloc[0])
        at = np.array([genes.get(g, -1) for g in group["gene"]])
        n = group["umis"].to_numpy()
        own = (n * np.where(at >= 0, logp[at], np.log(1e-12))).sum() - log_factorial(n).sum()
        return pd.DataFrame({"sample": [group["sample"].iloc[0]], "cell": [group["cell"].iloc[0]], "total": [int(n.sum())], "own": [own]})

    chosen = counts.join(candidates.select(*CELL_KEYS), CELL_KEYS)
    own = chosen.groupBy(*CELL_KEYS).applyInPandas(likelihood, f"sample {kinds['sample']}, cell {kinds['cell']}, total long, own double")

    def simulate(group: pd.DataFrame) -> pd.DataFrame:
        _, logp = log_shares(group["sample"].iloc[0])
        number = int(group["block"].iloc[0])
        runs = min(block, simulations - number * block)
        rng, upto = np.random.default_rng([seed, number]), np.cumsum(np.exp(logp))
        draws, size, seen, rows = np.zeros((runs, len(logp)), np.int32), 0, np.zeros(runs), np.arange(runs)
        ordered, below = group.sort_values("total", kind="stable"), []
        for total, mine in zip(ordered["total"], ordered["own"]):
            for _ in range(int(total) - size):  # one more UMI in each simulation
                pick = np.minimum(np.searchsorted(upto, rng.random(runs) * upto[-1], side="right"), len(logp) - 1)
                draws[rows, pick] += 1
                seen += logp[pick] - np.log(draws[rows, pick])
            size = int(total)
            below.append(int((seen < mine + 1e-9).sum()))
        return pd.DataFrame({"sample": ordered["sample"].to_numpy(), "cell": ordered["cell"].to_numpy(), "below": below})

    numbers = F.explode(F.sequence(F.lit(0), F.lit(-(-simulations // block) - 1)))
    drawn = own.withColumn("block", numbers).groupBy("sample", "block").applyInPandas(simulate, f"sample {kinds['sample']}, cell {kinds['cell']}, below long")
    tested = drawn.groupBy(*CELL_KEYS).agg(((F.sum("below") + 1) / (simulations + 1)).alias("p_value"))

    def adjust(group: pd.DataFrame) -> pd.DataFrame:
        q = benjamini_hochberg(group["p_value"].to_numpy())
        return group.assign(fdr=q, rescued=q <= fdr)[["sample", "cell", "p_value", "fdr", "rescued"]]

    return tested.groupBy("sample").applyInPandas(adjust, f"sample {kinds['sample']}, cell {kinds['cell']}, p_value double, fdr double, rescued boolean")


def cell_matrix(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """Counts of the cells that were called or rescued, in long form."""
    return counts.join(cells.select(*CELL_KEYS).distinct(), CELL_KEYS, "left_semi")


def sample_stats(called: DataFrame, rescued: DataFrame | None = None) -> DataFrame:
    """Cells and UMIs per sample."""
    cells = called.filter("high").select(*CELL_KEYS, "total", F.lit(1).alias("h"))
    if rescued is not None:
        cells = cells.unionByName(called.join(rescued.filter("rescued").select(*CELL_KEYS), CELL_KEYS).select(*CELL_KEYS, "total", F.lit(0).alias("h")))
    return cells.groupBy("sample").agg(
        F.count(F.lit(1)).alias("total_cells"), F.sum("h").alias("high_confidence"), F.sum(1 - F.col("h")).alias("rescued"), F.sum("total").alias("total_umi"), F.min("total").alias("min_umi"),
        F.percentile("total", F.lit(0.5)).alias("median_umi"), F.max("total").alias("max_umi"), F.avg("total").alias("mean_umi"),
    )
