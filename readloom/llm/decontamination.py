"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

An item's windows are its runs of ``window`` consecutive words; an item of fewer words is one window.  A window is a set of
shingles, runs of ``shingle`` words (fewer in a shorter window), and a document holds the window only if it holds all of them.  So
one shingle is prefix enough: the rarest.  A pass over all documents counts the benchmark's shingles in them, which orders them by rarity; windows
with a shingle that occurs nowhere go.  A second pass joins the documents' shingles with the windows' rarest ones only.  A shingle's
place in its window tells where in the document the window would begin; it must begin and end within the text (positional and
length bounds), and the words there, as many as the window has, must be the window's (exact verification).  Words under any
window that occurs are hit: intervals swept in order of their starts.

For the second pass a document is cut into pieces of ``STEP`` words and their neighbours, so that a shingle's row carries a few
hundred bytes to verify with, however long the text is.  Windows of equal words are one window, and the items it stands for one set, so that a
passage of many items meets each document once.  The benchmark's side is broadcast, at most ``MOST_WINDOWS`` windows of ``MOST_BYTES`` together,
which is counted first; a larger benchmark is met in so many parts, one after the other, over a written table of the documents' words.
What shuffles is a narrow row a document and a window found, by document row; lists of items are made once for each
combination that occurs.

Words are runs of letters and digits of ASCII, A-Z as a-z, and of all characters beyond ASCII.  A null text has no words: a document of
none is clean, an item of none has no window.  Repeated documents are rows of their own; items are told apart by their id, a null id being
named by the empty string, and a repeated id has the windows of all its texts.  Empty tables: no documents, no rows; no items, all clean.
Other columns may have any names; none is kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import join_by_key, materialise, release

WINDOW, SHINGLE = 10, 3
#: Of the benchmark's side of a join.
MOST_WINDOWS, MOST_BYTES = 200_000, 32 << 20
#: Words of a piece, without its neighbours.
STEP = 32
#: ASCII that is no part of a word, once letters are small.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, in a form that tells them apart as they are; none for null.

    Each UTF-8 byte is taken for a character, so that small letters can be had without touching any beyond ASCII: of bytes above 127 only
    those that begin a character change, and the bytes that go on with it, which don't, still tell what it was.
    """
    bytewise = F.lower(F.decode(F.coalesce(text, F.lit("")).cast("binary"), "ISO-8859-1"))
    return F.array_remove(F.split(bytewise, _BETWEEN, -1), "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def _tokens(hashes: str, sizes: list[int]) -> Column:
    """The shingles of each size that begin at each word: at m i + j that of the j-th of m sizes at word i."""
    run = lambda x, i, k: F.xxhash64(x, *(F.get(hashes, i + j) for j in range(1, k)))
    if len(sizes) == 1:
        return F.transform(hashes, lambda x, i: run(x, i, sizes[0]))
    return F.flatten(F.transform(hashes, lambda x, i: F.array(*(run(x, i, k) for k in sizes))))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """words (joined by a space), size, item_set of each distinct window; and item_set, items: the ids it stands for, as text, sorted."""
    words = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    words = words.withColumn("size", F.least(F.size("w"), F.lit(window)))
    each = words.select("item", "size", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda i: F.array_join(F.slice("w", i, F.col("size")), " "))).alias("words"))
    each = materialise(each.groupBy("words", "size").agg(F.array_sort(F.collect_set("item")).alias("items")), "windows")
    sets = materialise(each.select("items").distinct().withColumn("item_set", F.monotonically_increasing_id()), "item_sets")
    windows = materialise(each.join(sets, "items").select("words", "size", "item_set"), "windows_by_set")
    release(each)
    return windows, sets


def _shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """Each window's shingles: token and place, from 0."""
    size = F.least("size", F.lit(shingle))
    w = windows.withColumn("hashes", _hashes(F.split("words", " ")))
    per_size = [F.when(size == k, F.slice(_tokens("hashes", [k]), F.lit(1), F.col("size") - k + 1)) for k in range(1, shingle + 1)]
    return w.select(*windows.columns, F.posexplode(F.coalesce(*per_size)).alias("place", "token"))


def _in_parts(table: DataFrame) -> int:
    """How many parts the benchmark is met in."""
    bounds = table.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("words") + 64).alias("bytes")).first()
    return max(1, -(-bounds["n"] // MOST_WINDOWS), -(-(bounds["bytes"] or 0) // MOST_BYTES))


def _part(table: DataFrame, by: str, i: int, parts: int) -> DataFrame:
    return table if parts == 1 else table.filter(F.pmod(F.xxhash64(by), F.lit(parts)) == i)


def rarest_shingles(words: DataFrame, windows: DataFrame, sizes: list[int], shingle: int, parts: int) -> DataFrame:
    """Windows all of whose shingles occur in documents, with the token and place of the one that does least often."""
    each = _shingles(windows, shingle)
    seen = words.select(_hashes(F.col("w")).alias("hashes")).select(F.explode(_tokens("hashes", sizes)).alias("token"))
    known = [F.broadcast(_part(each.select("token").distinct(), "token", i, parts)) for i in range(parts)]
    counts = reduce(DataFrame.unionByName, (seen.join(k, "token").groupBy("token").agg(F.count(F.lit(1)).alias("often")) for k in known))
    least = each.join(counts, "token", "left").groupBy(*windows.columns).agg(F.min(F.struct("often", "place", "token")).alias("least"), F.count_if(F.col("often").isNull()).alias("missing"))
    return least.filter("missing = 0").select(*windows.columns, "least.token", "least.place")


def find_windows(words: DataFrame, prefixes: DataFrame, sizes: list[int], window: int, how: str) -> DataFrame:
    """row, id, n_words, start, size, item_set: one row a window found in a document; how left: and one or more without, for each document."""
    n, m, around = F.size("w"), len(sizes), window - 1
    docs = words.withColumn("hashes", _hashes(F.col("w"))).withColumn("tokens", _tokens("hashes", sizes))
    piece = lambda i: F.struct(
        i.alias("begin"),
        F.greatest(i - around, F.lit(0)).alias("from"),
        F.array_join(F.slice("w", F.greatest(i - around, F.lit(0)) + 1, STEP + 2 * around), " ").alias("text"),
        F.slice("tokens", i * m + 1, STEP * m).alias("tokens"),
    )
    pieces = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(STEP)), piece))
    at = docs.select("row", "id", n.alias("n_words"), F.explode_outer(pieces).alias("p"))
    at = at.select("row", "id", "n_words", "p.begin", "p.from", "p.text", F.posexplode_outer("p.tokens").alias("q", "token"))
    at = at.withColumn("at", F.col("begin") + F.floor(F.col("q") / m).cast("int")).drop("begin", "q")
    start = F.col("at") - F.col("place")
    inside = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    same = F.array_join(F.slice(F.split("text", " "), F.when(inside, start - F.col("from") + 1).otherwise(1), F.col("size")), " ") == F.col("words")
    side = F.broadcast(prefixes.withColumnRenamed("token", "known"))
    met = at.join(side, (F.col("token") == F.col("known")) & inside & same, how)
    if how == "left":
        met = met.filter(F.col("known").isNotNull() | F.coalesce(F.col("at") == 0, F.lit(True)))
    return met.select("row", "id", "n_words", start.alias("start"), "size", "item_set")


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, shingle: int = SHINGLE,
) -> DataFrame:
    """One row per row of docs: <id_col>, n_words, n_hit, n_items, items (the ids, as text, sorted), contaminated."""
    windows, sets = item_windows(items, item_id_col, item_text_col, window)
    sizes, parts = [r[0] for r in windows.select(F.least("size", F.lit(shingle)).alias("k")).distinct().orderBy("k").collect()] or [shingle], _in_parts(windows)
    words = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("w"))
    if parts > 1:
        words = materialise(words.withColumn("row", F.monotonically_increasing_id()), "words")
    prefixes = materialise(rarest_shingles(words, windows, sizes, shingle, parts), "prefixes")
    numbered = words if parts > 1 else words.withColumn("row", F.monotonically_increasing_id())
    found = (find_windows(numbered, _part(prefixes, "words", i, parts), sizes, window, "left" if i == 0 else "inner") for i in range(parts))
    found = materialise(reduce(DataFrame.unionByName, found), "windows_found")
    before = F.max(F.col("start") + F.col("size")).over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("start") + F.col("size")
    swept = found.withColumn("hit", F.greatest(end - F.greatest("start", F.coalesce(before, F.lit(0))), F.lit(0)))
    each = swept.groupBy("row").agg(
        F.first("id").alias("id"), F.max("n_words").cast("long").alias("n_words"), F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("n_hit"), F.array_sort(F.collect_set("item_set")).alias("sets")
    )
    each = materialise(each, "documents_found")
    release(found, windows, prefixes)
    clean = each.filter("n_hit = 0").select("id", "n_words", "n_hit", F.lit(0).cast("long").alias("n_items"), F.array().cast("array<string>").alias("items"))
    dirty = each.filter("n_hit > 0")
    combinations = dirty.groupBy("sets").agg(F.count(F.lit(1)).alias("often"))
    named = combinations.select("sets", "often", F.explode("sets").alias("item_set")).join(sets, "item_set")
    named = named.groupBy("sets").agg(F.first("often").alias("often"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    dirty = join_by_key(dirty, named, "sets", "often", dirty.count(), F.col("row"), "inner")
    dirty = dirty.select("id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items")
    return clean.unionByName(dirty).withColumn("contaminated", F.col("n_hit") > 0).withColumnRenamed("id", id_col)
