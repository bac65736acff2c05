"""Which 16-mers reads ask for, so that an index of a long reference needs no others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from readloom.session import drop, written

#: At most 2**30 slots, 128 MB, are collected and broadcast; with more 16-mers more places pass in vain.
MOST_LOG2 = 30
#: Slots a 16-mer where there is room, and slots that travel together.
SLOTS, SEGMENT_LOG2 = 16, 16
#: 16-mers that a task holds before it passes them on.
HELD = 1 << 20
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _slot(kmers: np.ndarray, log2: int, probe: int) -> np.ndarray:
    return (kmers.astype(np.uint64) * np.uint64(_FACTORS[probe])) >> np.uint64(64 - log2)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The first column of batches, HELD rows at a time: a task's batches alone would hold a slot or two of each segment."""
    held, n = [], 0
    for batch in batches:
        held.append(batch.column(0).to_numpy())
        n += batch.num_rows
        if n >= HELD:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for kmers in _held(batches):
        yield pa.record_batch([pa.array(np.unique(kmers))], ["kmer"])


def _by_segment(log2: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kmers in _held(batches):
            slots = np.unique(np.concatenate([_slot(kmers, log2, i) for i in range(probes)]))
            segment = (slots >> np.uint64(SEGMENT_LOG2)).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            low = (slots & np.uint64((1 << SEGMENT_LOG2) - 1)).astype(np.uint16)
            ends = (np.r_[cuts, len(slots)] * 2).astype(np.int32)
            yield pa.record_batch([pa.array(segment[cuts]), pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(ends), pa.py_buffer(low)])], ["segment", "slots"])

    return run


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """segment, slots in order of segment -> segment, bits."""
    now, on = None, np.zeros(1 << SEGMENT_LOG2, bool)
    packed = lambda: np.packbits(on, bitorder="little").tobytes()
    for batch in batches:
        segments, bits = [], []
        for segment, slots in zip(batch.column(0).to_pylist(), batch.column(1)):
            if segment != now:
                if now is not None:
                    segments.append(now)
                    bits.append(packed())
                now, on[:] = segment, False
            on[np.frombuffer(slots.as_buffer(), np.uint16)] = True
        if segments:
            yield pa.record_batch([pa.array(segments, pa.int64()), pa.array(bits, pa.binary())], ["segment", "bits"])
    if now is not None:
        yield pa.record_batch([pa.array([now], pa.int64()), pa.array([packed()], pa.binary())], ["segment", "bits"])


class Wanted:
    """A Bloom filter of the seeds' 16-mers, broadcast: each of them passes, and a few of the others."""

    def __init__(self, found: DataFrame, most_log2: int = MOST_LOG2):
        """found: seeds, with kmer; evaluated once.  Seeds that know how many they are at most (``most`` and ``words`` of ``seeds_at``), and a table
        that was ``written``, are read where they are."""
        known, kmers = vars(found), None
        if "words" in known:
            n, some = known["most"](), known["words"]
        else:
            kmers = None if "written_at" in known else written(found.select("kmer").mapInArrow(_distinct, "kmer long"), "kmers")
            table = (found if kmers is None else kmers).select("kmer")
            n, some = table.count(), lambda then, schema: table.mapInArrow(then, schema)
        n = max(n, 1)
        self.log2 = min(most_log2, max(SEGMENT_LOG2, (n * SLOTS - 1).bit_length()))
        self.probes = 2 if 2 * n <= 1 << self.log2 else 1
        slots = some(_by_segment(self.log2, self.probes), "segment long, slots binary")
        # written, as an iterator on the driver would have one partition after the other made
        merged = written(slots.repartition("segment").sortWithinPartitions("segment").mapInArrow(_bits, "segment long, bits binary"), "bits")
        bits, size = np.zeros((1 << self.log2) // 8, np.uint8), (1 << SEGMENT_LOG2) // 8
        for row in merged.toLocalIterator():
            bits[row["segment"] * size : (row["segment"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
        for table in (kmers, merged):
            if table is not None:
                drop(table)
        self.shared = found.sparkSession.sparkContext.broadcast(bits)

    def __call__(self, kmers: np.ndarray) -> np.ndarray:
        bits, kept = self.shared.value, np.arange(len(kmers))
        for probe in range(self.probes):  # few are left for the second
            s = _slot(kmers[kept] if probe else kmers, self.log2, probe)
            kept = kept[(bits[(s >> np.uint64(3)).view(np.int64)] >> (s & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(kmers), bool)
        out[kept] = True
        return out


def narrowed(index: DataFrame, found: DataFrame) -> DataFrame:
    """The index, without places that no seed of ``found`` can meet, where it is not built yet (``build_index``); one that was written stays as it is."""
    build = vars(index).get("narrowed")
    return build(Wanted(found)) if build else index


def meeting(found: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seeds and index without what the other side can't meet.  Of an index that is not built yet the places that seeds ask for are written (``places``
    of the index), and seeds that ask for none of them, most of those of the wrong strand, are left out where they are made."""
    index = narrowed(index, found)
    places, ask = vars(index).get("places"), vars(found).get("narrowed")
    return (ask(Wanted(places)) if ask and places else found), index
