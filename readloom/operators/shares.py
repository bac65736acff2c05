"""Equi-joins whose keys may hold a third of the rows: such keys are dealt out in shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.session import written

#: A key with over one in so many rows is dealt out, so there are fewer such keys than this.
SHARES = 1000


def in_shares(many: DataFrame, few: DataFrame, keys: Sequence[str], spread: Sequence[str], part: str = "__part") -> tuple[DataFrame, DataFrame]:
    """Both sides of a join by keys, each with one more column to join by.

    Keys are counted first.  The rows of a frequent one go, by a hash of ``spread``, to as many parts as it has thousandths of all
    rows, and the rows that ``few`` has for it are repeated in each: under 2,000 times altogether for one row a key.  Keys are not
    null; many is evaluated twice, the same both times.
    """
    counts = written(many.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), "counts")
    total = counts.agg(F.sum("__n")).first()[0] or 1
    frequent = counts.filter(F.col("__n") * SHARES > total).select(*keys, F.ceil(F.col("__n") * SHARES / total).cast("int").alias("__parts"))
    frequent = F.broadcast(frequent)  # fewer than SHARES rows
    dealt = many.join(frequent, list(keys), "left").withColumn(part, F.coalesce(F.pmod(F.xxhash64(*spread), F.col("__parts")).cast("int"), F.lit(0)))
    repeated = few.join(frequent, list(keys), "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)))
    return dealt.drop("__parts"), repeated.drop("__parts")
