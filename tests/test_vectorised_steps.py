"""Steps from contigs to votes that take many rows at a time: what they give, and in how many pieces."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readloom.operators import align as A
from readloom.operators import wanted as W
from readloom.plans import queries as Q


def test_slots_travel_in_large_pieces():
    """A row a segment and Arrow batch were 100 times as many rows, a slot or two in each."""
    kmers = np.random.default_rng(1).integers(0, 1 << 50, 100_000)
    batches = [pa.record_batch([pa.array(kmers[i : i + 1000])], ["kmer"]) for i in range(0, len(kmers), 1000)]
    rows = pa.Table.from_batches(W._by_segment(24, 2)(iter(batches))).sort_by("segment")
    assert rows.num_rows == 256
    bits = pa.Table.from_batches(W._bits(iter(rows.to_batches(max_chunksize=7))))
    assert bits.column("segment").to_pylist() == list(range(256))
    on = np.unpackbits(np.frombuffer(b"".join(bits.column("bits").to_pylist()), np.uint8), bitorder="little")
    assert set(np.flatnonzero(on)) == {int(s) for i in (0, 1) for s in W._slot(kmers, 24, i)}


def test_the_filter_is_not_made_one_partition_after_the_other(spark):
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("filter", "filter")
    try:
        W.Wanted(spark.range(50_000).select((F.col("id") * 7919).alias("kmer")).repartition(4))
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("filter") for s in tracker.getJobInfo(j).stageIds]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    single = [s.name for s in stages if s and s.numTasks == 1 and s.numCompletedTasks and "toLocalIterator" in s.name]
    assert len(single) <= 4  # of the written bits alone; a partition's shuffle and groups made two more stages each


@pytest.mark.parametrize(("step", "k"), [(1, 16), (3, 16), (1, 24)])
def test_places_of_many_chunks_together(step, k):
    rng = random.Random(step + k)
    contigs = {f"c{n}": "".join(rng.choices("ACGTN", [9, 9, 9, 9, 0.3], k=n)) for n in (0, 5, 15, 16, 24, 990, 1000, 1017, 1300, 2560)} | {f"d{i}": "".join(rng.choices("ACGT", k=2560)) for i in range(300)}
    contigs["t"] = "ACG" * 400
    rows = [(c, a + 1, s[a : a + 1300], max(len(s) - 1, 0) // 1000 * 1000 + 1) for c, s in contigs.items() for a in range(0, max(len(s), 1), 1000)]
    want, most = defaultdict(int), 5
    for c, start, seq, last in rows:
        seen = defaultdict(int)
        for i in range(len(seq) - k + 1 if start == last else min(len(seq) - k + 1, 1000)):
            w = seq[i : i + k]
            if "N" not in w and (start + i - 1) % step == 0:
                seen[w] += 1
                if seen[w] <= most + 1:
                    word = int(w.translate(str.maketrans("ACGT", "0123")), 10 if k == 16 else 4)
                    want[c, start + i, word] += 1
    batch = pa.record_batch([pa.array(list(x)) for x in zip(*rows)], ["chr", "start", "seq", "last"])
    out = list(A._places(step, 1000, most, None, k)(iter([batch])))
    got = defaultdict(int)
    for b in out:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            got[row] += 1
    assert got == want
    assert len(out) < 10  # a chunk was a piece of work, and a record batch, of its own


def test_votes_of_reads_cut_by_batches():
    rng = random.Random(3)
    hits = sorted(((r, rng.choice("+-"), rng.choice((0, 6, 12, 18)), rng.choice(("c1", "c2")), rng.choice((100, 103, 120)) + rng.randrange(12)) for r in range(40) for _ in range(rng.randrange(1, 30))), key=lambda h: h[0])
    want, groups = [], defaultdict(list)
    for rid, strand, offset, chrom, pos in hits:
        groups[rid, strand, chrom].append((pos - offset, offset))
    for key, some in groups.items():
        some.sort()
        runs = [[some[0]]]
        for a, b in zip(some, some[1:]):
            runs.append([b]) if b[0] - a[0] > 5 else runs[-1].append(b)
        for run in runs:
            at = [(o, d) for d, o in run]
            want.append((*key, min(at)[1], max(at)[1], len({o for o, _ in at}), min(at)[0], max(at)[0] + 16))
    columns = [pa.array(list(x), t) for x, t in zip(zip(*hits), (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64()))]
    table = pa.table(columns, ["rid", "strand", "offset", "chr", "pos"])
    for size in (1, 7, 10_000):
        got = [row for b in A._votes(5, 16)(iter(table.to_batches(max_chunksize=size))) for row in zip(*(c.to_pylist() for c in b.columns))]
        assert sorted(got) == sorted(want)


def test_contigs_are_the_hashes_of_their_names(spark, tmp_path):
    """They are made of the digests' bytes; the digits were translated one by one."""
    spark.createDataFrame([(i, "x") for i in (0, 7, 512_819)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    letters = F.translate(F.concat(*(F.sha2(F.concat("chr", F.lit(f":{i}")), 512) for i in range(20))), "0123456789abcdef", "ACGTACGTACGTACGT")
    made = Q._contigs(spark, str(tmp_path))
    rows = made.withColumn("want", letters).collect()
    assert len(rows) == 3 and all(r["seq"] == r["want"] and len(r["seq"]) == 2560 for r in rows)
    assert "translate" not in made._jdf.queryExecution().optimizedPlan().toString().lower()
