"""Importance resampling towards a target distribution, on a sparse count matrix.

Features are runs of 1 to ``runs`` consecutive words, hashed to ``buckets``.  One pass over the documents counts them into the rows of a
sparse matrix, documents by buckets, which is written as blocks of compressed sparse rows: the ids, each row's start, and the
bucket and count of each entry.  Texts are not read again.  The matrix's column sums are the corpus's distribution, those of the target texts'
matrix the target's; the logarithm of their smoothed ratio is a bucket's gain.  A sparse product of the matrix with the gains,
block by block, gives each document's weight, the mean gain of its features.  Gumbel noise of the id turns weights to scores, and the highest
scores are a sample drawn by importance, without replacement.

The draw: scores are whole numbers of a bounded range (gains lie within 1000 ln of the corpus's size, noise within -3200 and 23000), so
their histogram has a bounded number of bars, which is all that comes to the driver.  It gives the lowest score drawn; only rows that reach it are
sorted, by ranges of (score, id, row), and a range's place before it gives the ranks; no key, however common, lands in one task, as rows differ in their number.

Null text is empty text: no features, weight 0.  A null id is drawn as empty text and comes last in ties; repeated rows are drawn as rows.
Empty documents give no rows; empty targets have a flat distribution.  Other columns may have any names.  Very long texts are cut into
words ``SEGMENT`` bytes at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from readloom.llm.common import materialise, release, text_of

RUNS, BUCKETS = 2, 10_000
SEED = 7
LEAST_WORDS, PERCENT = 20, 25
#: Entries and rows of a block of the matrix; only a single document may have more entries, at most one a bucket.
BLOCK_ENTRIES, BLOCK_ROWS = 1 << 15, 1 << 12
SEGMENT = 1 << 20
#: Rows of a range of the drawn, about.
ROWS_A_RANGE = 1 << 18
#: Lower-cases A-Z and turns ASCII that is neither letter nor digit to spaces; other bytes belong to words.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))



def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    text, a = text.translate(_LETTERS), 0
    while a < len(text):
        b = text.find(b" ", a + SEGMENT)
        b = len(text) if b < 0 else b
        yield text[a:b].split()
        a = b


def hashed_runs(words: list[bytes], kept: int, runs: int) -> Iterator[list[int]]:
    """Checksums of the runs of words that end after the first ``kept`` words."""
    crc, spaced = list(map(crc32, words)), [b" " + w for w in words]
    yield crc[kept:]
    for k in range(1, runs):
        crc = list(map(crc32, spaced[k:], crc))  # the checksum of "a b" goes on from that of "a"
        yield crc[max(kept - k, 0) :]


def features_of(text: bytes, runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The buckets of a text's features, ascending, their counts, and how many words it has."""
    n, before, total, found = 0, [], None, np.zeros(0, np.uint32)
    for words in words_of(text):
        n += len(words)
        found = np.fromiter(chain.from_iterable(hashed_runs(before + words, len(before), runs)), np.uint32) % np.uint32(buckets)
        if len(text) > SEGMENT:
            total = np.bincount(found, minlength=buckets) + (0 if total is None else total)
            before = (before + words)[-(runs - 1) :] if runs > 1 else []
    if total is not None:
        found = np.flatnonzero(total)
        return found.astype(np.uint32), total[found], n
    return *np.unique(found, return_counts=True), n


def _rows(runs: int, buckets: int, kind: pa.DataType):
    """id, text -> blocks of compressed sparse rows."""

    def block(ids: list, words: list[int], found: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        starts = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
        data = (np.array(words, np.int64), starts, np.concatenate(found).astype(np.uint32), np.concatenate(counts).astype(np.uint32))
        return pa.record_batch([pa.array([ids], pa.list_(kind)), *(pa.array([x.tobytes()], pa.binary()) for x in data)], ["ids", "words", "starts", "buckets", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        entries = 0
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                found, counts, n = features_of(text.as_py().encode(), runs, buckets)
                if held[0] and (entries + len(found) > BLOCK_ENTRIES or len(held[0]) == BLOCK_ROWS):
                    yield block(*held)
                    held, entries = ([], [], [], []), 0
                for column, x in zip(held, (key.as_py(), n, found, counts)):
                    column.append(x)
                entries += len(found)
        if held[0]:
            yield block(*held)

    return run


def count_matrix(docs: DataFrame, id_col: str, text_col: str, runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """The sparse matrix of documents by buckets, written: blocks of ids, words, starts, buckets and counts."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    blocks = rows.mapInArrow(_rows(runs, buckets, to_arrow_type(kind)), f"ids array<{kind.simpleString()}>, words binary, starts binary, buckets binary, counts binary")
    return materialise(blocks, "count_matrix")


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs: summed by task, then by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at, counts in zip(batch.column(0), batch.column(1)):
                total += np.bincount(np.frombuffer(at.as_py(), np.uint32), np.frombuffer(counts.as_py(), np.uint32), minlength=buckets).astype(np.int64)
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["bucket", "n"])

    sums = matrix.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in sums.collect():  # a row a bucket
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of each bucket's smoothed share in the target over that in the corpus, rounded down."""
    size, s_all, t_all = float(len(corpus)), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """The matrix times the gains: id, n_words, n_features, weight, the mean gain of a row's features rounded down."""
    kind = matrix.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, starts, at, counts = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in ((1, np.int64), (2, np.int32), (3, np.uint32), (4, np.uint32)))
                summed = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[starts])
                n = summed(counts)
                weight = summed(counts * gain[at]) // np.maximum(n, 1)
                yield pa.record_batch([batch.column(0)[i].values, *(pa.array(x, pa.int64()) for x in (words, n, weight))], ["id", "n_words", "n_features", "weight"])

    return matrix.select("ids", "words", "starts", "buckets", "counts").mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def noise(id_col: str, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate drawn by the id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(scored: DataFrame, eligible: Column, percent: int = PERCENT) -> DataFrame:
    """Adds rank: 1, 2, 3... of the ``percent`` of eligible rows with the highest scores, ties to smaller ids; null for the rest.

    ``scored`` has id, score and row, a number of each row's own, and gives the same rows when read again.
    """
    spark = scored.sparkSession
    bars = sorted(((r["score"], r["n"]) for r in scored.filter(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    wanted, reached, lowest = sum(n for _, n in bars) * percent // 100, 0, None
    for lowest, n in bars if wanted else ():
        reached += n
        if reached >= wanted:
            break
    if lowest is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    taken = F.coalesce(eligible & (F.col("score") >= lowest), F.lit(False))
    keys = F.desc("score"), F.asc_nulls_last("id"), F.asc("row")
    top = scored.filter(taken).repartitionByRange(-(-reached // ROWS_A_RANGE), *keys).sortWithinPartitions(*keys)
    top = materialise(top.withColumn("__rl_place", F.monotonically_increasing_id()), "drawn")
    # the number counts rows within a partition in its lower 33 bits
    part, within = F.shiftright("__rl_place", 33), F.col("__rl_place").bitwiseAND(F.lit((1 << 33) - 1))
    before, starts = 0, []
    for p, n in sorted(tuple(r) for r in top.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((p, before))
        before += n
    top = top.withColumn("__rl_part", part).join(F.broadcast(spark.createDataFrame(starts, "__rl_part long, __rl_before long")), "__rl_part")
    rank = F.col("__rl_before") + within + 1
    top = top.select(*scored.columns, F.when(rank <= wanted, rank).alias("rank"))
    return top.unionByName(scored.filter(~taken).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
    runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """One row per row of docs: <id_col>, n_features, weight, score, rank.

    Documents of at least ``least_words`` words may be drawn, ``percent`` of them are.
    """
    matrix = count_matrix(docs, id_col, text_col, runs, buckets)
    goal = count_matrix(targets.select(F.lit(0).alias("id"), F.col(target_text_col).alias("text")), "id", "text", runs, buckets)
    gain = gains(column_sums(matrix, buckets), column_sums(goal, buckets))
    scored = weights(matrix, gain).withColumn("score", F.col("weight") + noise("id", seed)).withColumn("row", F.monotonically_increasing_id())
    scored = materialise(scored, "importance")
    release(matrix, goal)
    drawn = draw(scored, F.col("n_words") >= least_words, percent)
    return drawn.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
