"""Substring dedup by super-k-mer partitioning.

A window is WINDOW consecutive words of a document.  Its minimiser is the least hash of its runs of MER words.
Consecutive windows that share a minimiser travel as one packed string, a super-k-mer, to the minimiser's bucket; equal
strings are merged on the way, and the bucket sorts all windows of its strings and so finds, by their very words,
in which smallest document each begins.  A window that begins in a smaller document than its own is removed, and every
word that such a window covers.

A bucket of over ``bucket`` different strings, a passage that many contexts surround, is not sorted in one task: its strings are
cut into windows, which meet by a 128-bit hash of their words, with partial minima, wherever they are dealt.

A first pass puts each document's minimisers in a filter of repeated ones; windows with a minimiser that no
other document has can't repeat, and stay at home.  Minimisers that a large part of all documents share rank last, so that only
windows that hold nothing else meet there.

Null text has no words.  Repeated rows have one id and don't remove each other.  Rows with a null id are neither changed
nor the cause of a change.  Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.bloom import MAX_LOG2, RepeatFilter, hit
from readloom.llm.common import join_by_key, materialise, release, text_of

WINDOW = 50
MER = 8
#: Windows of a packed string at most; longer runs are cut.
RUN = 256
#: Different strings of a bucket that is sorted in one task, and how many buckets may be told to be larger beforehand.
BUCKET, LARGE_BUCKETS = 1000, 20_000
#: A minimiser is common when over HOT_LEAST documents and a 1/HOT_PART part of all occurrences have it: fewer than HOT_PART are.
HOT_LEAST, HOT_PART = 10_000, 10_000
_TOP = np.uint64(1 << 63)


def mer_hashes(words: list[bytes], mer: int) -> np.ndarray:
    """63-bit hashes of all runs of mer words."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - mer + 1
    out = np.zeros(n, np.uint64)
    for j in range(mer):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (out ^ (out >> np.uint64(29))) >> np.uint64(1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def minimisers(words: list[bytes], window: int, mer: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per window its minimiser, and whether a common one would have been it; hot: sorted common minimisers."""
    h = mer_hashes(words, mer)
    plain = sliding_min(h, window - mer + 1)
    if not len(hot):
        return plain, np.zeros(len(plain), bool)
    common = np.isin(h, hot)
    if not common.any():
        return plain, np.zeros(len(plain), bool)
    return sliding_min(np.where(common, h | _TOP, h), window - mer + 1), np.isin(plain, hot)


def _mini_batches(window: int, mer: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for text in batch.column(0).cast(pa.binary()):
                words = text.as_py().split()
                if len(words) >= window:
                    out.append(np.unique(minimisers(words, window, mer, none)[0]))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(out).view(np.int64))], ["mini"])

    return run


def _super_kmers(window: int, mer: int, shared, log2: int):
    """id, text_hash, pos, mini, key, packed for each run of windows that may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot = shared.value
        for batch in batches:
            rows, pos, minis, packed, held = [], [], [], [], 0

            def flush():
                take = pa.array(rows, pa.int64())
                keys = [xxhash.xxh3_128_digest(p) for p in packed]
                return pa.record_batch(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(pos, pa.int32()), pa.array(minis, pa.int64()), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())],
                    ["id", "text_hash", "pos", "mini", "key", "packed"],
                )

            for i, text in enumerate(batch.column(2).cast(pa.binary())):
                words = text.as_py().split()
                if len(words) < window:
                    continue
                mini, forced = minimisers(words, window, mer, hot)
                cut = np.flatnonzero(np.r_[True, (mini[1:] != mini[:-1]) | (forced[1:] != forced[:-1])])
                stop = np.r_[cut[1:], len(mini)]
                goes = forced[cut] | hit(bits, mini[cut], log2)
                if not goes.any():
                    continue
                joined = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                for a, b in zip(cut[goes].tolist(), stop[goes].tolist()):
                    for c in range(a, b, RUN):
                        d = min(b, c + RUN)
                        rows.append(i)
                        pos.append(c)
                        minis.append(int(mini[a].view(np.int64)))
                        packed.append(joined[ends[c - 1] + 1 if c else 0 : ends[d - 1 + window - 1]])
                        held += len(packed[-1])
                if held > 1 << 24:
                    yield flush()
                    rows, pos, minis, packed, held = [], [], [], [], 0
            if rows:
                yield flush()

    return run


def _windows(packed: bytes, window: int) -> list[bytes]:
    ends = [i for i, c in enumerate(packed) if c == 32]
    starts, ends = [0, *(e + 1 for e in ends)], [*ends, len(packed)]
    return [packed[s:e] for s, e in zip(starts, ends[window - 1 :])]


def first_documents(strings: list[tuple[bytes, int | None]], window: int) -> list[list[int | None]]:
    """For each packed string the smallest id with which each of its windows comes."""
    if len(strings) == 1:
        packed, first = strings[0]
        return [[first] * (packed.count(b" ") + 2 - window)]
    out, entries = [], []
    for s, (packed, first) in enumerate(strings):
        found = _windows(packed, window)
        out.append([None] * len(found))
        entries += [(w, first is None, first, s, i) for i, w in enumerate(found)]
    entries.sort()
    last, least = None, None
    for w, empty, first, s, i in entries:
        if w != last:
            last, least = w, None if empty else first
        out[s][i] = least
    return out


def _count_windows(window: int, bucket: int):
    """mini, key, packed, first_id, last_id, w in order of mini -> key, firsts, w; of a bucket that turns out too large, the rows
    as they came, without firsts."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        head = next(batches, None)
        if head is None:
            return
        kind, rows, held = head.schema.field("first_id").type, [], 0
        kinds = (pa.binary(), pa.list_(kind), pa.int64(), pa.binary(), kind, kind)

        def flush() -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["key", "firsts", "w", "packed", "first_id", "last_id"])

        for _, group in groupby(rows_of(chain([head], batches)), key=lambda r: r[0]):
            some = list(islice(group, bucket + 1))
            if len(some) > bucket:
                for _, key, packed, first, last, w in chain(some, group):
                    rows.append((key, None, w, packed, first, last))
                    held += len(packed)
                    if held > 1 << 22:
                        yield flush()
                        rows, held = [], 0
                continue
            for (_, key, _, _, last, w), least in zip(some, first_documents([(r[2], r[3]) for r in some], window)):
                if last is not None and any(f is not None and f < last for f in least):
                    rows.append((key, least, w, None, None, None))
                    held += 16 * len(least)
            if held > 1 << 22:
                yield flush()
                rows, held = [], 0
        if rows:
            yield flush()

    return run


def _cut_windows(window: int):
    """key, packed, first_id, last_id, w -> a row a window: key, at, hash (16 bytes of its words), first_id, last_id, w."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                some = batch.slice(a, 1000)
                found = [[xxhash.xxh3_128_digest(x) for x in _windows(p, window)] for p in some.column(1).to_pylist()]
                take = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]), pa.int64())
                at = np.concatenate([np.arange(len(f), dtype=np.int32) for f in found])
                yield pa.record_batch([some.column(0).take(take), pa.array(at), pa.array([h for f in found for h in f], pa.binary()), *(some.column(i).take(take) for i in (2, 3, 4))], ["key", "at", "hash", "first_id", "last_id", "w"])

    return run


def _firsts_apart(strings: DataFrame, window: int, kind: str) -> DataFrame:
    """key, firsts, w of strings (key, packed, first_id, last_id, w), by a shuffle of their windows."""
    each = strings.mapInArrow(_cut_windows(window), f"key binary, at int, hash binary, first_id {kind}, last_id {kind}, w long")
    each = materialise(each, "windows_apart")
    least = each.groupBy("hash").agg(F.min("first_id").alias("least"), F.count(F.lit(1)).alias("times")).filter(F.col("times") > 1)
    met = join_by_key(each, least, "hash", "times", each.count(), F.xxhash64("key"))
    # a window of one string begins where that string does
    met = met.withColumn("least", F.coalesce("least", "first_id"))
    firsts = F.transform(F.sort_array(F.collect_list(F.struct("at", "least"))), lambda x: x["least"])
    out = met.groupBy("key").agg(firsts.alias("firsts"), F.max("last_id").alias("last_id"), F.max("w").alias("w"))
    return out.filter(F.exists("firsts", lambda f: f < F.col("last_id"))).select("key", "firsts", "w")


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text_hash, pos, firsts -> spans: first and last removed window of each run of them, in turn."""
    for batch in batches:
        ids, pos = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        keep, spans = [], []
        for i, firsts in enumerate(batch.column(3).to_pylist()):
            out, open_ = [], False
            for j, f in enumerate(firsts):
                if f is not None and ids[i] is not None and f < ids[i]:
                    if open_:
                        out[-1] = pos[i] + j
                    else:
                        out += [pos[i] + j, pos[i] + j]
                    open_ = True
                else:
                    open_ = False
            if out:
                keep.append(i)
                spans.append(out)
        take = pa.array(keep, pa.int64())
        yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), pa.array(spans, pa.list_(pa.int32()))], ["id", "text_hash", "spans"])


def _strip(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digest, left = [], [], [], []
            for text, spans in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist()):
                words = text.as_py().split()
                n, kept = len(words), words
                if spans:
                    keep = np.ones(n, bool)
                    for some in spans:
                        for a, b in zip(some[::2], some[1::2]):
                            keep[a : b + window] = False
                    kept = [words[i] for i in np.flatnonzero(keep).tolist()]
                joined = b" ".join(kept)
                n_words.append(n)
                n_removed.append(n - len(kept))
                digest.append(hashlib.sha256(joined).hexdigest())
                left.append(joined.decode()) if with_text else None
            out = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
            yield pa.record_batch(out + [pa.array(left, pa.string())] * with_text, ["id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, mer: int = MER, with_text: bool = True, hot_least: int = HOT_LEAST, max_log2: int = MAX_LOG2, bucket: int = BUCKET) -> DataFrame:
    """One row per row of docs: <id_col>, n_words, n_removed, kept_sha256 [, kept: the words left, joined by one space]."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("text_hash"), text_of(text_col).alias("text"))

    minis = materialise(rows.select("text").mapInArrow(_mini_batches(window, mer), "mini long"), "minimisers")
    n = minis.count()
    repeats = RepeatFilter.build(minis, n, max_log2)
    often = minis.filter(repeats.test(F.col("mini"))).groupBy("mini").count().filter(F.col("count") > max(hot_least, n // HOT_PART))
    hot = np.sort(np.array([r["mini"] for r in often.collect()], np.int64).view(np.uint64))
    release(minis)

    shared = spark.sparkContext.broadcast((repeats.bits.value, hot))
    schema = f"id {kind}, text_hash long, pos int, mini long, key binary, packed binary"
    found = materialise(rows.mapInArrow(_super_kmers(window, mer, shared, repeats.log2), schema), "super_kmers")
    n_found = found.count()
    # buckets so large that a task of their own would stand out are known from narrow sums; others may still turn out too large
    large = found.groupBy("mini", "key").agg(F.count(F.lit(1))).groupBy("mini").agg(F.count(F.lit(1)).alias("strings")).filter(F.col("strings") > max(bucket, n_found // LARGE_BUCKETS))
    merged = found.groupBy("mini", "key").agg(F.first("packed").alias("packed"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("w"))
    merged = materialise(merged.join(F.broadcast(large.select("mini", F.lit(True).alias("large"))), "mini", "left"), "strings")
    bucketed = merged.filter("large is null").select("mini", "key", "packed", "first_id", "last_id", "w").repartition("mini").sortWithinPartitions("mini")
    counted = materialise(bucketed.mapInArrow(_count_windows(window, bucket), f"key binary, firsts array<{kind}>, w long, packed binary, first_id {kind}, last_id {kind}"), "windows")
    apart = counted.filter("firsts is null").unionByName(merged.filter("large").select(F.col("key"), F.lit(None).cast(f"array<{kind}>").alias("firsts"), "w", "packed", "first_id", "last_id"))
    firsts = counted.filter("firsts is not null").select("key", "firsts", "w")
    firsts = materialise(firsts.unionByName(_firsts_apart(apart.select("key", "packed", "first_id", "last_id", "w"), window, kind)), "firsts")
    release(merged, counted)
    met = join_by_key(found.select("id", "text_hash", "pos", "key"), firsts, "key", "w", n_found, F.xxhash64("id", "pos"), "inner")
    spans = met.select("id", "text_hash", "pos", "firsts").mapInArrow(_covered, f"id {kind}, text_hash long, spans array<int>")
    spans = materialise(spans.groupBy("id", "text_hash").agg(F.collect_set("spans").alias("spans")), "spans")
    release(found, firsts)

    touched = RepeatFilter.build(spans.select(F.xxhash64("id", "text_hash").alias("h")), spans.count(), max_log2, least=1)
    maybe = touched.test(F.xxhash64("id", "text_hash"))
    marked = rows.withColumn("maybe", maybe)
    whole = marked.filter(~F.col("maybe")).select("id", "text", F.lit(None).cast("array<array<int>>").alias("spans"))
    cut = marked.filter("maybe").join(spans, ["id", "text_hash"], "left").select("id", "text", "spans")
    schema = f"id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return whole.unionByName(cut).mapInArrow(_strip(window, with_text), schema).withColumnRenamed("id", id_col)
