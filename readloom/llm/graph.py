"""Connected components over an edge table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import join_by_key, materialise, release


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """edges: u, v (long), any direction, repeats allowed.  Returns node, root: the smallest node reachable.

    Each round hooks: every node takes the smallest root among its own and its neighbours', every root the
    smallest that its members found; then roots jump to their roots' roots.  A round needs sums by key with
    map-side partial results and joins that deal out hot keys, and writes its labels to the shared folder, so that
    lineage stays short and nothing comes to the driver but two counts.
    """
    both = materialise(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u != v").distinct(), "edges")
    labels = materialise(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")).withColumnRenamed("u", "node"), "labels")
    for _ in range(max_rounds):
        # pointer jump: the root of my root
        labels = _jump(labels)
        # contract: edges between roots; a node's edges, the centre of a star's too, meet its label wherever they are dealt
        n = both.count()
        degree = both.groupBy("u").agg(F.count(F.lit(1)).alias("w"))
        known = materialise(labels.join(degree, labels["node"] == degree["u"]).select("u", "root", "w"), "degrees")
        nodes = known.count()
        at = join_by_key(both, known.withColumnRenamed("root", "ru"), "u", "w", n, F.col("v"), "inner", nodes)
        at = join_by_key(at.select("v", "ru"), known.select(F.col("u").alias("v"), F.col("root").alias("rv"), "w"), "v", "w", n, F.col("ru"), "inner", nodes)
        contracted = materialise(at.filter("ru != rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct(), "edges")
        release(both, known)
        both = contracted
        if both.isEmpty():
            release(both)
            return labels
        # every root hooks to the smallest of its neighbours
        hooks = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("root"), F.least("u", "m").alias("to")).filter("root != to")
        hooks = materialise(hooks.join(labels.groupBy("root").agg(F.count(F.lit(1)).alias("w")), "root"), "hooks")
        met = join_by_key(labels, hooks, "root", "w", labels.count(), F.col("node"), "left", hooks.count())
        hooked = materialise(met.select("node", F.coalesce("to", "root").alias("root")), "labels")
        release(labels, hooks)
        labels = hooked
    raise RuntimeError(f"components have not settled in {max_rounds} rounds")


def _jump(labels: DataFrame) -> DataFrame:
    """Roots follow their roots until none moves."""
    while True:
        n = labels.count()
        sizes = labels.groupBy("root").agg(F.count(F.lit(1)).alias("w")).withColumnRenamed("root", "r")
        up = labels.filter("node != root").select(F.col("node").alias("r"), F.col("root").alias("up")).join(sizes, "r")
        by_root = labels.withColumnRenamed("root", "r")
        moved = join_by_key(by_root, up, "r", "w", n, F.col("node")).select("node", F.coalesce("up", "r").alias("root"), F.col("up").isNotNull().alias("moved"))
        moved = materialise(moved, "labels")
        release(labels)
        labels = moved.select("node", "root")
        labels.written_at = moved.written_at
        if moved.filter("moved").isEmpty():
            return labels
