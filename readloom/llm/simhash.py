"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints that differ in at most 4 of 64 bits agree in one of five blocks of bits at least.  Each distinct
fingerprint goes to the five buckets of its blocks; a bucket's fingerprints, rotated so that the block leads, are sorted
by Gray rank and form a tree of fan-out 16.  An upper node factors out the bits that all fingerprints
below it share; a child keeps only what it shares beyond that.  A search goes down the tree level by level for many
fingerprints at once, adds up the differences with each node's pattern, and leaves a whole group as
soon as the sum passes 4.  A group that is already in one component with the searcher is left too, so a dense
group of copies costs about its size and not its square; each task passes on a spanning forest only.  Every
link between different fingerprints is found or implied by others: components are exact.

Buckets with over ``bucket_limit`` fingerprints are dealt out again by the five parts of the other bits.

Texts: null counts as empty; fewer than four words give one shingle, none the fingerprint zero, which is
linked like any other.  Null ids are members, but never a component's id unless all are null.
Repeated rows have equal fingerprints and one component.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import join_by_key, materialise, release, text_of
from readloom.llm.graph import connected_components

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: First bit and width of each of the DISTANCE + 1 blocks.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
FAN = 16
BUCKET_LIMIT = 1 << 20


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text's word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest, n, count = xxhash.xxh64_intdigest, len(starts), np.zeros(64, np.int64)
    for a in range(0, n, 1 << 15):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[a : a + (1 << 15)], ends[a : a + (1 << 15)])], np.uint64)
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * count > n, bitorder="little").tobytes(), "little")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
        out = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, batch.num_rows).view(np.int64)
        yield pa.record_batch([*(batch.column(i) for i, f in enumerate(batch.schema) if f.name != "text"), pa.array(out)], [*(f.name for f in batch.schema if f.name != "text"), "fp"])


def fingerprints(rows: DataFrame) -> DataFrame:
    """Replaces ``text`` of rows by ``fp`` (long)."""
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    return rows.mapInArrow(_fingerprint_batches, ", ".join([*kept, "fp long"]))


def _bits(column: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(column, first).bitwiseAND(F.lit((1 << width) - 1))


def _parts(block: int) -> list[list[tuple[int, int]]]:
    """The bits outside a block, in DISTANCE + 1 parts; each part is a list of (first, width)."""
    first, width = BLOCKS[block]
    rest = [b for b in range(64) if not first <= b < first + width]
    cut = [rest[len(rest) * i // (DISTANCE + 1) : len(rest) * (i + 1) // (DISTANCE + 1)] for i in range(DISTANCE + 1)]
    out = []
    for bits in cut:
        low, high = [b for b in bits if b < first], [b for b in bits if b >= first]
        out.append([(p[0], len(p)) for p in (low, high) if p])
    return out


def buckets(fps: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """fps: distinct fp.  Returns block, key, fp: any two within DISTANCE bits share a key.  There are at most 40960
    keys before large buckets are dealt out again."""
    fp = F.col("fp")
    first = fps.select(F.explode(F.array(*(F.struct(F.lit(i).alias("block"), _bits(fp, *b).alias("part")) for i, b in enumerate(BLOCKS)))).alias("k"), "fp")
    first = first.select("k.block", (F.col("k.block") * (1 << 40) + F.col("k.part") * (1 << 20)).alias("key"), "fp")
    large = first.groupBy("key").count().filter(F.col("count") > bucket_limit).select("key", F.lit(True).alias("large"))
    marked = first.join(F.broadcast(large), "key", "left")
    small = marked.filter("large is null").select("block", "key", "fp")

    def again(block: int) -> Column:
        keys = []
        for i, parts in enumerate(_parts(block)):
            value, at = F.lit(0).cast("long"), 0
            for a, w in parts:
                value, at = value + F.shiftleft(_bits(fp, a, w), at), at + w
            keys.append(F.col("key") + (i + 1) * (1 << 16) + value)
        return F.array(*keys)

    by_block = F.when(F.col("block") == 0, again(0))
    for i in range(1, len(BLOCKS)):
        by_block = by_block.when(F.col("block") == i, again(i))
    return small.unionByName(marked.filter("large").select("block", F.explode(by_block).alias("key"), "fp"))


def gray_rank(code: np.ndarray) -> np.ndarray:
    """The place of each 64-bit code in the reflected Gray sequence."""
    rank = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Forest:
    """Union-find over 0..n-1, for arrays of pairs; a root is its set's smallest member."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


def link_forest(block: np.ndarray, key: np.ndarray, fp: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (member, root) that connect just the fingerprints of equal key that links within distance connect."""
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    if len(fp) < 2:
        return none
    turn = np.array([(64 - first - width) % 64 for first, width in BLOCKS], np.uint64)[block]
    turned = np.where(turn == 0, fp, (fp << turn) | (fp >> ((np.uint64(64) - turn) & np.uint64(63))))
    order = np.lexsort((gray_rank(turned), key))
    key, fp = key[order], fp[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    alone = np.repeat(sizes == 1, sizes)
    key, fp = key[~alone], fp[~alone]
    if not len(fp):
        return none
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    stop = np.repeat(starts + sizes, sizes)
    values, uid = np.unique(fp, return_inverse=True)
    forest = Forest(len(values))

    # level 0: the fingerprints; a node of level k covers FAN**k of them
    n, every = len(fp), ~np.uint64(0)
    pattern, shared, lower, upper = [fp], [np.full(n, every)], fp, fp
    while len(lower) > 1:
        cut = np.arange(0, len(lower), FAN)
        lower, upper = np.bitwise_and.reduceat(lower, cut), np.bitwise_or.reduceat(upper, cut)
        pattern.append(lower)
        shared.append(~(lower ^ upper))
    own = [s & ~np.repeat(shared[k + 1], FAN)[: len(s)] for k, s in enumerate(shared[:-1])] + [shared[-1]]
    # the level at which a bucket is a few nodes wide
    level_of = np.repeat(np.minimum(len(pattern) - 1, np.ceil(np.log(np.maximum(sizes / FAN, 1)) / np.log(FAN)).astype(int)), sizes)

    def uniform() -> list[np.ndarray]:
        """The component of each node that has one, else -1."""
        low = high = forest.root[uid]
        out = [low]
        while len(low) > 1:
            cut = np.arange(0, len(low), FAN)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            out.append(np.where(low == high, low, -1))
        return out

    begin, step = 0, 64
    while begin < n:
        one = uniform()
        chunk = np.arange(begin, min(n, begin + step))
        begin, step = begin + step, min(step * 2, 8192)
        q = node = acc = np.zeros(0, np.int64)
        for level in range(int(level_of[chunk].max()), -1, -1):
            width = FAN**level
            if len(q):  # children of what is left
                q, node = np.repeat(q, FAN), (node[:, None] * FAN + np.arange(FAN)).ravel()
                acc = np.repeat(acc, FAN)
                fits = node < len(pattern[level])
                q, node, acc = q[fits], node[fits], acc[fits]
                acc = acc + np.bitwise_count((fp[q] ^ pattern[level][node]) & own[level][node])
            new = chunk[level_of[chunk] == level]
            if len(new):
                a, b = (new + 1) // width, (stop[new] - 1) // width
                count = np.maximum(b - a + 1, 0)
                nq = np.repeat(new, count)
                nn = np.repeat(a, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                q, node = np.r_[q, nq], np.r_[node, nn]
                acc = np.r_[acc, np.bitwise_count((fp[nq] ^ pattern[level][nn]) & shared[level][nn])]
            left = (acc <= distance) & ((node + 1) * width > q + 1) & (node * width < stop[q]) & (one[level][node] != one[0][q])
            q, node, acc = q[left], node[left], acc[left]
        if len(q):
            forest.union(uid[q], uid[node])
    member = np.flatnonzero(forest.root != np.arange(len(values)))
    return values[member], values[forest.root[member]]


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(3)] for b in batches if b.num_rows]
    if parts:
        block, key, fp = (np.concatenate([p[i] for p in parts]) for i in range(3))
        u, v = link_forest(block, key, fp.view(np.uint64))
        yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])


def links(fps: DataFrame, n: int, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges u, v between distinct fingerprints that connect what links connect."""
    tasks = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 5 * n // BUCKET_LIMIT + 1)
    return buckets(fps, bucket_limit).repartition(tasks, "key").mapInArrow(_link_batches, "u long, v long")


def _components(rows: DataFrame, bucket_limit: int) -> DataFrame:
    """rows: id, fp, any other columns, materialised.  Adds component_id and members (rows of the fingerprint)."""
    groups = materialise(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("members")), "fingerprints")
    labels = connected_components(links(groups.select("fp"), groups.count(), bucket_limit))
    rooted = groups.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialise(rooted, "roots")
    release(labels)
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("w"))
    of_fp = join_by_key(rooted, ids, "root", "w", groups.count(), F.col("fp")).select("fp", "component_id", "root", "members")
    return join_by_key(rows, of_fp, "fp", "members", rows.count(), F.xxhash64("id"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row per row of docs: <id_col>, fingerprint, component_id."""
    rows = materialise(fingerprints(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))), "simhash")
    return _components(rows, bucket_limit).select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """The rows of docs, one of each component: that with the smallest id (a null id only where there is no other)."""
    text_hash = F.xxhash64(text_of(text_col))
    rows = materialise(fingerprints(docs.select(F.col(id_col).alias("id"), text_hash.alias("text_hash"), text_of(text_col).alias("text"))), "simhash")
    found = _components(rows, bucket_limit)
    keep = found.groupBy("root").agg(F.min_by(F.struct("id", "text_hash"), F.struct(F.col("id").isNull(), "id", "text_hash")).alias("k"))
    keep = keep.select(F.col("k.id").alias("__rl_id"), F.col("k.text_hash").alias("__rl_hash"))
    marked = docs.withColumn("__rl_hash", text_hash).withColumn("__rl_id", F.col(id_col))
    same = marked["__rl_id"].eqNullSafe(keep["__rl_id"]) & (marked["__rl_hash"] == keep["__rl_hash"])
    return marked.join(keep, same, "left_semi").dropDuplicates(["__rl_id", "__rl_hash"]).select(*docs.columns)
