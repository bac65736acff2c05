"""Simulated reads of transcripts with known truth."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.dna import reverse_complement
from readloom.session import drop, written

MOST_READS, MOST_LENGTH = 100_000_000, 250
#: Fragments of a transcript that are made together.
BLOCK = 64
#: Transcripts up to which their numbers of fragments, which the driver holds, are broadcast; the bases never are.
MOST_BROADCAST = 1 << 20


def length_weights(mean: float, sd: float, least: int, most: int) -> np.ndarray:
    """Shares of the fragment lengths least..most under a gamma law of shape (mean / sd)**2, in whole lengths."""
    x = np.arange(least, most + 1, dtype=float)
    shape = (mean / sd) ** 2
    logp = (shape - 1) * np.log(x) - x / (mean / shape)
    p = np.exp(logp - logp.max())
    return p / p.sum()


def _uniform(*of) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(1 << 40)) / float(1 << 40)


def simulate_reads(
    transcripts: DataFrame, reads: int, read_length: int = 75, paired: bool = False, mean: float = 180.0, sd: float = 40.0, least: int = 110, most: int = 400,
    quality: list[str] | None = None, truth_in_names: bool = False, seed: int = 42,
) -> DataFrame:
    """transcripts: transcript_id, seq, expression -> name, mate, seq, qual, transcript_id, start, fragment_length.

    The number of fragments of each transcript is drawn once on the driver (a row a transcript); fragments are made where
    they are read, from hashes of seed, transcript and number, so that a lost task makes the same ones again."""
    if not 0 <= reads <= MOST_READS:
        raise ValueError(f"reads lie between 0 and {MOST_READS}")
    if not 1 <= read_length <= MOST_LENGTH:
        raise ValueError(f"read lengths lie between 1 and {MOST_LENGTH}")
    t = transcripts.select("transcript_id", F.length("seq").alias("n"), F.coalesce("expression", F.lit(0.0)).alias("e"))
    t = written(t, "transcripts")  # read three times
    if t.filter("e < 0").limit(1).count():
        raise ValueError("expression is never negative")
    rows = t.orderBy("transcript_id").toPandas()
    drop(t)
    weight = np.maximum(rows["n"].to_numpy(float) - least + 1, 0) * rows["e"].to_numpy(float)
    drawn = np.random.default_rng(seed).multinomial(reads, weight / weight.sum()) if weight.sum() > 0 else np.zeros(len(rows), int)
    spark = transcripts.sparkSession
    kind = dict(transcripts.dtypes)["transcript_id"]
    some = pa.table({"transcript_id": pa.array(rows["transcript_id"][drawn > 0], from_pandas=True), "k": pa.array(drawn[drawn > 0], pa.int64())})
    counts = spark.createDataFrame(some).select(F.col("transcript_id").cast(kind).alias("transcript_id"), "k")
    cumulative = np.cumsum(length_weights(mean, sd, least, most))

    @F.pandas_udf("array<int>")
    def fragments(u: pd.Series, n: pd.Series) -> pd.Series:
        room = np.clip(n.to_numpy() - least, 0, len(cumulative) - 1)
        return pd.Series([(least + np.minimum(np.searchsorted(cumulative, np.asarray(x, float) * cumulative[r]), r)).astype(np.int32) for x, r in zip(u, room)])

    # a transcript's bases go with BLOCK of its fragments at a time
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("k") - 1) / BLOCK)))
    each = transcripts.join(counts.hint("broadcast" if some.num_rows <= MOST_BROADCAST else "merge"), "transcript_id").withColumn("block", block).repartition("transcript_id", "block")
    first = F.col("block") * BLOCK + 1
    u = lambda tag, i="i": _uniform(F.lit(seed), F.lit(tag), "transcript_id", i)
    lengths = F.transform(F.sequence(first, F.least("k", (F.col("block") + 1) * BLOCK)), lambda i: u("length", i))
    each = each.withColumn("lengths", fragments(lengths, F.length("seq")))
    each = each.select("transcript_id", "seq", "block", F.posexplode("lengths").alias("i", "fragment_length")).withColumn("i", F.col("i") + first)
    each = each.withColumn("start", F.lit(1) + F.floor(u("start") * (F.length("seq") - F.col("fragment_length")) + 0.5).cast("int"))
    # of a fragment no more bases are turned than are read
    forward = u("strand") < 0.5
    head = F.upper(F.expr(f"substring(seq, start, least({read_length}, fragment_length))"))
    last = reverse_complement(F.upper(F.expr(f"substring(seq, start + greatest(fragment_length - {read_length}, 0), least({read_length}, fragment_length))")))
    mates = [F.struct(F.lit(1).alias("mate"), F.when(forward, head).otherwise(last).alias("bases"))]
    if paired:
        mates.append(F.struct(F.lit(2).alias("mate"), F.when(forward, last).otherwise(head).alias("bases")))
    each = each.withColumn("m", F.explode(F.array(*mates)))
    given = quality or ["H" * read_length]
    pick = F.element_at(F.array(*map(F.lit, given)), (F.floor(_uniform(F.lit(seed), F.lit("quality"), "transcript_id", "i", "m.mate") * len(given)) + 1).cast("int"))
    wrong = quality is not None

    @F.pandas_udf("string")
    def sequenced(bases: pd.Series, qual: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for b, q, s in zip(bases, qual, h):
            rng = np.random.default_rng([seed, int(s) & 0x7FFFFFFFFFFFFFFF])
            x = np.frombuffer(b.encode(), np.uint8).copy()
            p = np.minimum(1, 10 ** (3.3 - np.frombuffer(q[: len(x)].encode(), np.uint8) / 10) * 4 / 3)
            p = np.r_[p, np.full(len(x) - len(p), p[-1] if len(p) else 0)]
            hit = rng.random(len(x)) < p
            x[hit] = np.frombuffer(b"ACGT", np.uint8)[rng.integers(0, 4, hit.sum())]
            out.append(x.tobytes().decode())
        return pd.Series(out)

    seq = sequenced(F.col("m.bases"), pick, F.xxhash64("transcript_id", "i", "m.mate")) if wrong else F.col("m.bases")
    name = F.concat(F.lit("R"), F.col("transcript_id").cast("string"), F.lit("_"), F.col("i").cast("string"))
    if truth_in_names:
        name = F.concat(name, F.lit(":"), F.col("start").cast("string"), F.lit(":"), F.col("fragment_length").cast("string"))
    return each.select(name.alias("name"), F.col("m.mate").alias("mate"), seq.alias("seq"), F.left(pick, F.length("m.bases")).alias("qual"), "transcript_id", "start", "fragment_length")
