"""Exact nearest neighbours by a block matrix join on int8 product tiles.

Queries are dealt out to groups of about ``query_block`` and candidates to shards of about ``candidate_block`` vectors.  Each group meets
each shard in a cell of a grid, one task's work, whose size the two numbers bound; all cells are one job, and nothing
of it is broadcast or comes to the driver.  Each vector is quantised to int8 with its own scale, and the norm of what that
loses is kept.  A tile of integer products gives the distances of the quantised vectors; they differ from the true ones by
the two lost norms at most.  A query's tenth smallest upper bound so far, or tenth smallest true distance, is its limit;
only pairs whose lower bound is within it are computed again from the original vectors in double precision.  Heaps merge a
query's best within a cell, and a shuffle ranks the cells' best.  No pair is dropped on an estimate: results are exact.

Vectors that are null or zero or hold null or non-finite components take no part, neither as queries nor as
candidates; only vectors of equal length meet.  Ids are whole numbers or their text; another text raises under ANSI rules.  Rows with a null id take no part.  Of rows that share an id and differ in
their vectors, the smallest vector (component by component) asks, and the nearest answers.  Repeated rows count once; a candidate with
the query's own id is the query's own.  Ties go to the smaller id.  Fewer candidates than ``k`` give fewer rows; empty tables
none.  Other columns may have any names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 10
EVERY = 100
#: Queries and candidates of a tile, and of a cell of the grid.
QUERY_TILE, BLOCK = 512, 4096
QUERY_BLOCK, CANDIDATE_BLOCK = 16_384, 65_536
#: Vectors that travel as one row.
PIECE = 512
#: Products of int8 vectors up to this length are exact in single precision.
EXACT_FLOAT32 = 1024


def usable(column: Column) -> Column:
    """Whether a vector takes part."""
    odd = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(column) > 0) & ~odd & F.exists(column, lambda x: x != 0), F.lit(False))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, id, v -> part, width, ids, data: up to PIECE vectors of one part and length."""
    for batch in batches:
        part, ids, column = (batch.column(i) for i in range(3))
        part, ids, width, start = part.to_numpy(), ids.to_numpy(), column.value_lengths().to_numpy(), column.offsets.to_numpy()[:-1]
        values, out = column.values.to_numpy(), []
        for p, w in np.unique(np.stack([part, width]), axis=1).T.tolist() if len(part) else ():
            at = np.flatnonzero((part == p) & (width == w))
            for a in range(0, len(at), PIECE):
                some = at[a : a + PIECE]
                out.append((p, w, ids[some].tobytes(), np.ascontiguousarray(values[start[some][:, None] + np.arange(w)]).tobytes()))
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["part", "width", "ids", "data"])


def _unpacked(table: pa.Table, kind: type, wide: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors, up to wide of them, of one length."""
    rows = {}
    for w, ids, data in zip(*(table.column(c).to_pylist() for c in ("width", "ids", "data"))):
        rows.setdefault(w, []).append((np.frombuffer(ids, np.int64), np.frombuffer(data, kind).reshape(-1, w)))
    for some in rows.values():
        ids, vectors = (np.concatenate([r[i] for r in some]) for i in range(2))
        for a in range(0, len(ids), wide):
            yield ids[a : a + wide], vectors[a : a + wide].astype(np.float64)


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and an upper bound of the norm of what the codes lose."""
    scale = np.abs(vectors).max(axis=1) / 127
    scale = np.where(scale > 0, scale, np.finfo(float).tiny)
    codes = np.clip(np.rint(vectors / scale[:, None]), -127, 127).astype(np.int8)
    lost = vectors - codes * scale[:, None]
    return codes, scale, _norm(lost) * (1 + 1e-9)


def _norm(rows: np.ndarray) -> np.ndarray:
    """Euclidean norms, safe from overflow and underflow."""
    top = np.abs(rows).max(axis=1, initial=0)
    top = np.where((top > 0) & np.isfinite(top), top, 1)
    return np.sqrt(np.square(rows / top[:, None]).sum(axis=1)) * top


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows in double precision."""
    d = a - b
    with np.errstate(over="ignore"):
        plain = np.sqrt(np.square(d).sum(axis=1))
    odd = ~np.isfinite(plain) | (plain < 1e-140)
    if odd.any():
        plain[odd] = _norm(d[odd])
    return plain


class QueryBlock:
    """Up to QUERY_TILE queries of one length with their best candidates so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.codes, self.scale, self.lost = quantise(vectors)
        self.kind = np.float32 if vectors.shape[1] <= EXACT_FLOAT32 else np.float64
        self.tile = self.codes.astype(self.kind)
        self.size = _norm(self.codes * self.scale[:, None])
        self.limit = np.full(len(ids), np.inf)
        self.best: list[dict[int, float]] = [{} for _ in ids]  # the nearest of each id, up to k ids

    def meet(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, scale: np.ndarray, lost: np.ndarray) -> None:
        product = (self.tile @ codes.astype(self.kind).T).astype(np.float64) * self.scale[:, None] * scale[None, :]
        size = _norm(codes * scale[:, None])
        square = self.size[:, None] ** 2 + size[None, :] ** 2 - 2 * product
        slack = (self.size[:, None] + size[None, :]) * 1e-6  # rounding of the line above
        near = np.sqrt(np.maximum(square, 0))
        lower = near - (self.lost[:, None] + lost[None, :]) - slack
        own = self.ids[:, None] == ids[None, :]
        distinct = np.unique(ids)
        if len(distinct) > self.k:
            upper = np.where(own, np.inf, near + (self.lost[:, None] + lost[None, :]) + slack)
            if len(distinct) < len(ids):  # an id is one candidate, however many rows it has
                order = np.argsort(ids, kind="stable")
                upper = np.minimum.reduceat(upper[:, order], np.searchsorted(ids[order], distinct), axis=1)
            limit = np.minimum(self.limit, np.partition(upper, self.k - 1, axis=1)[:, self.k - 1])
        else:
            limit = self.limit
        q, c = np.nonzero(~(lower > limit[:, None]) & ~own)
        exact = np.empty(len(q))
        for a in range(0, len(q), 1 << 16):
            exact[a : a + (1 << 16)] = distance(self.vectors[q[a : a + (1 << 16)]], vectors[c[a : a + (1 << 16)]])
        left = exact <= self.limit[q]
        q, c, exact = q[left], ids[c[left]], exact[left]
        order = np.lexsort((c, exact, q))
        q, c, exact = q[order], c[order], exact[order]
        begin = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else []
        for a, b in zip(begin, [*begin[1:], len(q)]):
            found = {}
            for d, i in zip(exact[a:b].tolist(), c[a:b].tolist()):
                found.setdefault(i, d)  # nearest first
                if len(found) == self.k:
                    break
            best = self.best[q[a]] = _merge(self.best[q[a]], found, self.k)
            if len(best) == self.k:
                self.limit[q[a]] = max(best.values())


def _merge(held: dict[int, float], found: dict[int, float], k: int) -> dict[int, float]:
    """The k nearest ids of both, each with its least distance; ties to smaller ids."""
    for i, d in found.items():
        if i not in held or d < held[i]:
            held[i] = d
    return held if len(held) <= k else {i: d for d, i in heapq.nsmallest(k, ((d, i) for i, d in held.items()))}


def _cell(k: int, kind: type):
    def run(asked: pa.Table, met: pa.Table) -> pa.Table:
        blocks = [QueryBlock(ids, vectors, k) for ids, vectors in _unpacked(asked, kind, QUERY_TILE)]
        for ids, vectors in _unpacked(met, kind, BLOCK):
            coded = quantise(vectors)
            for block in blocks:
                if block.vectors.shape[1] == vectors.shape[1]:
                    block.meet(ids, vectors, *coded)
        found = [(q, i, d) for block in blocks for q, best in zip(block.ids.tolist(), block.best) for i, d in best.items()]
        q, i, d = zip(*found) if found else ((), (), ())
        return pa.table([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(d, pa.float64())], ["query_id", "vec_id", "score"])

    return run


def nearest(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", is_query: Column | None = None,
    k: int = K, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest.  is_query: a condition on vectors; ids divisible by 100."""
    spark = vectors.sparkSession
    is_query = F.col(id_col) % EVERY == 0 if is_query is None else is_query
    plain = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    v = F.col(vector_col) if plain else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), is_query.alias("q")).filter("id is not null").filter(usable(F.col("v")))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("asked")).first()
    if not size["asked"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    groups = -(-size["asked"] // query_block)
    shards = max(-(-size["n"] // candidate_block), min(-(-size["n"] // BLOCK), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    packed = "part long, width int, ids binary, data binary"
    part = lambda n, *of: F.pmod(F.xxhash64(*of), F.lit(n)).cast("long").alias("part")
    # keys of both sides are long, or equal ones would be dealt apart
    each_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = rows.filter("q").groupBy("id").agg(F.min("v").alias("v"))
    asked = asked.select(part(groups, "id"), "id", "v").repartition(groups, "part").mapInArrow(_pack, packed)
    asked = asked.select(F.col("part").alias("g"), each_of(shards).alias("s"), "width", "ids", "data")
    # a piece is a run of rows of one task, dealt to a shard whole
    met = rows.select(F.lit(0).cast("long").alias("part"), "id", "v").mapInArrow(_pack, packed)
    met = met.select(part(shards, "ids", "data").alias("s"), each_of(groups).alias("g"), "width", "ids", "data")
    cells = asked.groupBy("g", "s").cogroup(met.groupBy("g", "s")).applyInArrow(_cell(k, np.float32 if plain else np.float64), "query_id long, vec_id long, score double")
    each = cells.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
