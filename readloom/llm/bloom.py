"""A Bloom filter of the hashes that occur more than once.

Each task counts, with saturation at two, how often its hashes fall on each of their slots.  Merged over tasks,
a slot is set when two insertions or more fell on it.  A hash that occurs twice has all its slots set, so there
are no false negatives.  The size is a power of two in [2**16, 2**max_log2].

Where there are more hashes than one filter of that size has room for, they are cut down first: each task's distinct hashes, with
counts saturated at two, are dealt out by hash to ranges of about RANGE, and each range's task builds and applies a
filter of its own, in its own memory.  The hashes that pass, repeated ones and a few in a thousand of the others, make up the
filter that is broadcast.  So however many rows there are, unique rows pass for possibly repeated at about that rate,
until the *repeated* distinct hashes alone overflow the broadcast filter (2**max_log2 / SLOTS_PER_HASH of them, 6.7e7 by
default); beyond it more unique rows are tested in vain, and results stay the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import materialise, release

PROBES = 4
SLOTS_PER_HASH = 16
SEGMENT = 1 << 16
#: At most 2**30 slots, 128 MB, are collected and broadcast.
MAX_LOG2 = 30
#: Slots that a task holds before it passes them on.
FLUSH = 1 << 22
#: Hashes of a range.
RANGE = 1 << 20


def log2_slots(n: int, max_log2: int = MAX_LOG2) -> int:
    return int(min(max_log2, max(16, np.ceil(np.log2(max(n, 1) * SLOTS_PER_HASH)))))


def slots_of(hashes: np.ndarray, log2: int) -> np.ndarray:
    """PROBES slots for each hash, a row for each probe."""
    h = hashes.view(np.uint64) if hashes.dtype == np.int64 else hashes.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    mask = np.uint64((1 << log2) - 1)
    return np.stack([(h + np.uint64(i) * step) & mask for i in range(PROBES)])


def _partials(log2: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            slots, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            segments = slots >> np.uint64(16)
            cuts = np.flatnonzero(np.r_[True, segments[1:] != segments[:-1]])
            low, again = (slots & np.uint64(SEGMENT - 1)).astype(np.uint16), counts > 1
            ends = np.r_[cuts[1:], len(slots)]
            return pa.record_batch(
                [
                    pa.array(segments[cuts].astype(np.int64), pa.int64()),
                    pa.array([low[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
                    pa.array([low[a:b][again[a:b]].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
                ],
                ["segment", "once", "twice"],
            )

        count = 0
        for batch in batches:
            if batch.num_rows:
                held.append(slots_of(batch.column(0).to_numpy(zero_copy_only=False), log2).ravel())
                count += len(held[-1])
            if count >= FLUSH:
                yield flush()
                count = 0
        if count:
            yield flush()

    return run


def _merge(least: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        count = np.zeros(SEGMENT, np.uint8)
        for once, twice in zip(group["once"], group["twice"]):
            i, j = np.frombuffer(once, np.uint16), np.frombuffer(twice, np.uint16)
            count[i] = np.minimum(count[i] + 1, 2)
            count[j] = 2
        return pd.DataFrame({"segment": [group["segment"].iloc[0]], "bits": [np.packbits(count >= least, bitorder="little").tobytes()]})

    return run


def _saturated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's distinct hashes, and whether it has them twice."""
    held, count = [], 0

    def flush() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.record_batch([pa.array(h), pa.array(n > 1)], ["h", "again"])

    for batch in batches:
        held.append(batch.column(0).to_numpy())
        count += batch.num_rows
        if count >= FLUSH:
            yield flush()
            count = 0
    if count:
        yield flush()


def _range_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of a range that its own filter takes for repeated."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if not parts:
        return
    log2 = log2_slots(sum(len(h) for h, _ in parts), 32)
    seen = np.zeros(1 << log2, np.uint8)
    for h, again in parts:
        for times in (h, h[again]):
            slots, n = np.unique(slots_of(times, log2), return_counts=True)
            seen[slots] = np.minimum(seen[slots] + np.minimum(n, 2), 2)
    bits = np.packbits(seen >= 2, bitorder="little")
    passed = np.unique(np.concatenate([h[hit(bits, h, log2)] for h, _ in parts]))
    yield pa.record_batch([pa.array(passed)], ["h"])


def possibly_repeated(hashes: DataFrame, n: int, size: int = RANGE) -> DataFrame:
    """h: distinct hashes that may occur twice, by a filter for each range of about size hashes."""
    each = hashes.mapInArrow(_saturated, "h long, again boolean").repartition(-(-max(n, 1) // size), "h")
    return each.mapInArrow(_range_filter, "h long")


class RepeatFilter:
    """Holds the bits on the driver; ``test(column)`` is true for each hash that may occur twice."""

    def __init__(self, spark: SparkSession, log2: int, bits: np.ndarray):
        self.log2 = log2
        self.bits = spark.sparkContext.broadcast(bits)

    @classmethod
    def build(cls, hashes: DataFrame, n: int, max_log2: int = MAX_LOG2, least: int = 2) -> RepeatFilter:
        """hashes: one long column without nulls; n: about how many rows it has.  With least 1, the filter has every hash."""
        narrowed = None
        if least == 2 and n * SLOTS_PER_HASH > 1 << max_log2:
            hashes = narrowed = materialise(possibly_repeated(hashes, n), "possibly_repeated")
            n, least = hashes.count(), 1
        log2 = log2_slots(n, max_log2)
        partials = hashes.mapInArrow(_partials(log2), "segment long, once binary, twice binary")
        merged = partials.groupBy("segment").applyInPandas(_merge(least), "segment long, bits binary")
        bits = np.zeros((1 << log2) // 8, np.uint8)
        for row in merged.toLocalIterator():
            at = row["segment"] * (SEGMENT // 8)
            bits[at : at + SEGMENT // 8] = np.frombuffer(row["bits"], np.uint8)
        if narrowed is not None:
            release(narrowed)
        return cls(hashes.sparkSession, log2, bits)

    def test(self, column: Column) -> Column:
        log2, shared = self.log2, self.bits

        @F.pandas_udf("boolean")
        def maybe_repeated(h: pd.Series) -> pd.Series:
            return pd.Series(hit(shared.value, h.to_numpy(), log2))

        return maybe_repeated(column)


def hit(bits: np.ndarray, hashes: np.ndarray, log2: int) -> np.ndarray:
    slots = slots_of(hashes, log2)
    return ((bits[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)
