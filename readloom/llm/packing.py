"""Best-fit-decreasing packing of token sequences, planned for the whole corpus at once.

Best fit depends on lengths only, and there are at most ``capacity`` different lengths.  So the counts of pieces by length, a
table of at most ``capacity`` rows however large the corpus, go to the driver, which packs the lengths from
long to short: a segment tree over remaining capacities gives the tightest open bin in logarithmic time, and
equal pieces and equal bins move as runs.  Each run gives a line of the plan: pieces number a to b of a length go, some to
a bin, to bins number c and on.  The plan's size depends on the capacity, not on the corpus.  Pieces are numbered within their length
by hash bucket, a length in as many buckets as it has pieces for, so that no task holds all pieces of one length, and find their line by
binary search.
Bins are those that packing document by document would give.

Null text is empty text and packs as its end token alone.  Repeated rows are packed as often as they occur.  Empty
tables give no rows.  A document of over ``capacity`` tokens is cut into pieces of just ``capacity`` but for its first.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import materialise, text_of
from readloom.llm.tokens import default_paths, tokenizer

CAPACITY = 1024
END_ID = 2
#: Pieces that are numbered together, and buckets of all lengths together, about.
PIECES_PER_BUCKET, BUCKETS = 500, 1_000_000


class OpenBins:
    """Segment tree over remaining capacities 1..capacity; each leaf holds runs (first bin, bins) of that capacity."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _update(self, room: int) -> None:
        i = self.size + room
        self.any[i] = bool(self.runs[room])
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def add(self, room: int, first: int, bins: int) -> None:
        if room and bins:
            self.runs[room].append((first, bins))
            self._update(room)

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity, length or more, that some bin has."""
        i = self.size + length
        if self.any[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        self._update(room)
        return run


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces a bin, first bin, offset in the bin), sorted; a line holds until the next."""
    bins, opened, lines = OpenBins(capacity), 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = bins.tightest(length)
            if room is None:
                room, first, free = capacity, opened, -(-left // (capacity // length))
                opened += free
            else:
                first, free = bins.take(room)
            each = room // length
            full = min(free, left // each)
            lines.append((length, rank, each, first, capacity - room))
            bins.add(room - each * length, first, full)
            rank, left = rank + full * each, left - full * each
            if full < free:
                if left:  # one more bin, in part
                    bins.add(room - left * length, first + full, 1)
                    left, full = 0, full + 1
                bins.add(room, first + full, free - full)
    return sorted(lines)


def _cut(paths: tuple[str, str], end_id: int, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokenizer(*paths).ids, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, piece, start, length, crc, parts = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = encode(text.as_py()) + end
                n = len(ids) // 4
                a, k = 0, 0
                while a < n:
                    b = a + ((n - 1) % capacity + 1 if a == 0 else capacity)
                    rows.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
                    if keep_ids:
                        parts.append(np.frombuffer(ids[4 * a : 4 * b], "<u4").astype(np.int32))
                    a, k = b, k + 1
            out = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.record_batch(out + [pa.array(parts, pa.list_(pa.int32()))] * keep_ids, ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    return run


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, paths: tuple[str, str] | None, keep_ids: bool) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(_cut(paths or default_paths(), end_id, capacity, keep_ids), schema)


def _place(lines: list[tuple[int, int, int, int, int]]):
    keys = [line[:2] for line in lines]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.array([bisect_right(keys, k) - 1 for k in zip(length.tolist(), rank.tolist())], np.int64)
            _, first, each, bin_, offset = (np.array([line[i] for line in lines], np.int64)[at] for i in range(5))
            nth = rank - first
            keep = [i for i, f in enumerate(batch.schema) if f.name != "rank"]
            yield pa.record_batch(
                [*(batch.column(i) for i in keep), pa.array(bin_ + nth // each), pa.array(offset + nth % each * length)],
                [*(batch.schema.names[i] for i in keep), "sequence_id", "offset"],
            )

    return run


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
    paths: tuple[str, str] | None = None, keep_ids: bool = True, pieces_per_bucket: int = PIECES_PER_BUCKET,
) -> DataFrame:
    """One row per piece: <id_col>, piece, start, length, ids_crc32, [ids,] sequence_id, offset."""
    cut = materialise(pieces(docs, id_col, text_col, capacity, end_id, paths, keep_ids), "pieces")
    n = cut.count()
    by_length = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = max(pieces_per_bucket, n // BUCKETS)
    buckets = F.element_at(F.array(*(F.lit(by_length.get(k, 0) // each + 1) for k in range(1, capacity + 1))), F.col("length").cast("int"))
    numbered = cut.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "start"), buckets))
    counts = materialise(numbered.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("count")), "counts")
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("length", "bucket", before.alias("before"))
    lines = plan(by_length, capacity)
    nth = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")) - 1
    ranked = numbered.withColumn("nth", nth).join(counts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("nth"))
    ranked = ranked.select(*cut.columns, "rank")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_place(lines), schema).withColumnRenamed("id", id_col)
