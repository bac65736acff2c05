"""Language-model scoring by subword lattices.

A token's lattice holds every way to write it in pieces of an existing vocabulary.  The vocabulary's own scores weigh them:
they are ranks, so a piece of rank r has the weight (r + shift) ** -power, and single bytes share what is left.  Power, shift and
the bytes' share are the likeliest given the expected counts that ``rounds`` of forward and backward recursion over all training
word types give.  This law is what is believed before, worth as many counts as there are pieces; together with the expected counts
it gives each piece's weight.  Training text also says how often a text ends.
A token's probability is the sum over all its segmentations, by forward recursion in log space, and a text's is the product over
its tokens, the end token included: ``score``.

``mixture_score`` has one more arc for each word that training has, with its count less an absolute discount, and leaves what
is discounted to the lattice.

Counts, expectations and lattices are made once a distinct word, in a table that grows with the corpus and stays
distributed; only sums by piece, one a vocabulary entry, pass the driver.  The commonest words, ``broadcast_words`` and
``broadcast_bytes`` at most, with their scores, are broadcast; a document's other words, summed by document, meet the table in a
shuffled join.

Null text has the end token alone.  Repeated rows are counted and scored each.  A null id counts as training text.  With
no training text, words get their pieces' probability at the first power and shift.  Empty tables give no rows.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import id_fold, materialise, release, text_of

FOLDS, HELD_OUT = 7, 2
ROUNDS = 1
#: Words that may be broadcast, and bytes of them.
BROADCAST_WORDS, BROADCAST_BYTES = 300_000, 16 << 20
#: Distinct words that a task counts before it passes them on.
FLUSH = 500_000
#: Power and shift of the law of ranks at first, what is tried, and the bytes' share at first and at least.
FIRST_LAW = (1.0, 2.7)
POWERS, SHIFTS = np.arange(0.3, 2.01, 0.05), np.geomspace(1, 10_000, 25)
BYTE_SHARE, LEAST_BYTE_SHARE = 0.01, 1e-6
END = ""  # no word is empty
SPACE = "▁"
LOG10 = math.log(10)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words_of(text: str) -> list[str]:
    """A-Z in lower case; words are runs of other characters than ASCII white space."""
    return [w.decode() for w in text.encode().lower().split()]


#: Words that are worked on together, and characters from which they go singly.
GROUP, LONG_WORD = 4096, 64
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_BASE) + ord(c)) & 0xFFFFFFFFFFFFFFFF
    return h


class Pieces:
    """A vocabulary's pieces with log weights.  Characters that are no piece are written in byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.names = [model.id_to_piece(i) for i in ids] + [bytes([b]) for b in range(256)]
        self.index = {p: i for i, p in enumerate(self.names)}
        self.longest = max(len(p) for p in self.names[:-256])
        score = np.array([model.get_score(i) for i in ids])
        self.rank = np.argsort(np.argsort(-score, kind="stable"), kind="stable")
        self.first = self.weights(*FIRST_LAW, BYTE_SHARE)
        # the text pieces by a hash of their characters, sorted
        keys = np.array([_hash(p) for p in self.names[:-256]], np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")

    def weights(self, power: float, shift: float, bytes_share: float) -> np.ndarray:
        """All pieces' probabilities under a law of ranks."""
        text = (self.rank + shift) ** -power
        return np.r_[text / text.sum() * (1 - bytes_share), np.full(256, bytes_share / 256)]

    def fitted(self, expected: np.ndarray) -> np.ndarray:
        """Each piece's probability after these expected counts, before which the law whose power, shift and bytes' share make them
        likeliest was worth a count a piece."""
        text = expected[:-256]
        total = max(expected.sum(), 1e-300)
        laws = [(-a * (text * np.log(self.rank + b)).sum() - text.sum() * np.log(((self.rank + b) ** -a).sum()), a, b) for a in POWERS.tolist() for b in SHIFTS.tolist()]
        _, power, shift = max(laws)
        before = self.weights(power, shift, min(0.5, max(LEAST_BYTE_SHARE, expected[-256:].sum() / total)))
        return (expected + len(before) * before) / (expected.sum() + len(before))

    def arcs(self, word: str, log_weight: list[float]) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """Per end position the arcs (start, log weight, pieces) that end there."""
        text, get, longest = SPACE + word, self.index.get, self.longest
        out: list[list[tuple[int, float, tuple[int, ...]]]] = []
        for j in range(1, len(text) + 1):
            here = []
            for i in range(max(0, j - longest), j):
                k = get(text[i:j])
                if k is not None:
                    here.append((i, log_weight[k], (k,)))
            if not here or here[-1][0] != j - 1:
                ids = tuple(self.index[bytes([b])] for b in text[j - 1].encode())
                here.append((j - 1, sum(log_weight[k] for k in ids), ids))
            out.append(here)
        return out

    def log_probability(self, word: str, log_weight: list[float]) -> float:
        """Natural log of the sum over all segmentations."""
        text, get, longest, index = SPACE + word, self.index.get, self.longest, self.index
        forward, exp, log = [0.0], math.exp, math.log
        for j in range(1, len(text) + 1):
            terms = [forward[i] + log_weight[k] for i in range(max(0, j - longest), j) if (k := get(text[i:j])) is not None]
            if get(text[j - 1]) is None:
                terms.append(forward[j - 1] + sum(log_weight[index[bytes([b])]] for b in text[j - 1].encode()))
            top = max(terms)
            forward.append(top if len(terms) == 1 else top + log(sum([exp(t - top) for t in terms])))
        return forward[-1]

    def expected(self, word: str, log_weight: list[float], into: np.ndarray, times: float = 1) -> None:
        """Adds the expected count of each piece in the segmentations of a word that comes so many times."""
        arcs = self.arcs(word, log_weight)
        n, exp, log = len(arcs), math.exp, math.log
        forward = [0.0]
        for here in arcs:
            terms = [forward[i] + w for i, w, _ in here]
            top = max(terms)
            forward.append(top if len(terms) == 1 else top + log(sum([exp(t - top) for t in terms])))
        backward = [-math.inf] * n + [0.0]
        for j in range(n, 0, -1):
            after = backward[j]
            if after == -math.inf:
                continue
            for i, w, ids in arcs[j - 1]:
                a, b = backward[i], after + w
                backward[i] = b if a == -math.inf else max(a, b) + math.log1p(exp(-abs(a - b)))
                p = exp(forward[i] + b - forward[n])
                for k in ids:
                    into[k] += p * times

    def batch(self, words: list[str], log_weight: list[float], into: np.ndarray | None = None, times: np.ndarray | None = None) -> np.ndarray:
        """``log_probability`` of many words, and, into an array, their ``expected`` counts, each word's so many times; words of one
        length go together.

        Long words go singly: their arcs would take much memory for few words."""
        out = np.empty(len(words))
        size = np.fromiter(map(len, words), np.int64, len(words))
        times = np.ones(len(words)) if times is None else times
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            for a in range(0, len(at), GROUP):
                some = at[a : a + GROUP]
                if n <= LONG_WORD:
                    out[some] = self._equal(["".join((SPACE, words[i])) for i in some], int(n) + 1, np.asarray(log_weight), into, times[some])
                    continue
                for i in some:
                    out[i] = self.log_probability(words[i], log_weight)
                    if into is not None:
                        self.expected(words[i], log_weight, into, times[i])
        return out

    def _equal(self, texts: list[str], n: int, weight: np.ndarray, into: np.ndarray | None, times: np.ndarray) -> np.ndarray:
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), n).T.astype(np.uint64)
        arcs: list[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(n + 1)]  # by end: start, rows, pieces, log weights
        bytes_of = {}
        for i in range(n):
            h = np.zeros(len(texts), np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = h * _BASE + codes[j - 1]
                place = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                rows = np.flatnonzero(self.keys[place] == h)
                if len(rows):
                    ids = self.order[place[rows]]
                    arcs[j].append((i, rows, ids, weight[ids]))
                if j == i + 1 and len(rows) < len(texts):  # characters that are no piece
                    rest = np.setdiff1d(np.arange(len(texts)), rows, assume_unique=True)
                    chars, which = np.unique(codes[i][rest], return_inverse=True)
                    for c in chars.tolist():
                        bytes_of.setdefault(-1 - c, [self.index[bytes([b])] for b in chr(c).encode()])
                    cost = np.array([weight[bytes_of[-1 - c]].sum() for c in chars.tolist()])
                    arcs[j].append((i, rest, -1 - chars.astype(np.int64)[which], cost[which]))
        forward = np.full((n + 1, len(texts)), -np.inf)
        forward[0] = 0
        for j in range(1, n + 1):
            for i, rows, _, w in arcs[j]:
                forward[j, rows] = np.logaddexp(forward[j, rows], forward[i, rows] + w)
        if into is not None:
            backward = np.full((n + 1, len(texts)), -np.inf)
            backward[n] = 0
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for j in range(n, 0, -1):
                for i, rows, ids, w in arcs[j]:
                    after = w + backward[j, rows]
                    backward[i, rows] = np.logaddexp(backward[i, rows], after)
                    p = np.exp(forward[i, rows] + after - forward[n, rows]) * times[rows]
                    text = ids >= 0
                    found.append((ids[text], p[text]))
                    for c, x in zip(ids[~text].tolist(), p[~text].tolist()):
                        np.add.at(into, bytes_of[c], x)
            if found:
                into += np.bincount(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), len(into))
        return forward[n]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One for each worker process."""
    return Pieces(path)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = (Counter(), Counter())  # held out, training

    def flush() -> pa.RecordBatch:
        words = list(counts[0] | counts[1])
        out = pa.record_batch([pa.array(words, pa.string()), pa.array([counts[1][w] for w in words], pa.int64()), pa.array([counts[0][w] + counts[1][w] for w in words], pa.int64())], ["word", "c", "c_all"])
        counts[0].clear()
        counts[1].clear()
        return out

    for batch in batches:
        for held, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            mine = counts[not held]
            mine.update(words_of(text.as_py()))
            mine[END] += 1
            if len(mine) > FLUSH:
                yield flush()
    if counts[0] or counts[1]:
        yield flush()


def _expect_batches(path: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights = pieces(path), shared.value
        total = np.zeros(len(model.names))
        for batch in batches:
            model.batch(batch.column(0).to_pylist(), weights, total, batch.column(1).to_numpy().astype(float))
        some = np.flatnonzero(total)
        if len(some):
            yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some])], ["piece", "n"])

    return run


def _lattice_batches(path: str, shared, n: int, v: int, ends: int, discount: float):
    """word, c, c_all -> and known (log10(c + 1)), logp and mixed (log10 of the token's probability by the lattice, and by the mixture)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights = pieces(path), shared.value
        end, free_end = (ends + 0.5) / (n + 1), 1 / (v + 1) if v else 0.5
        spare = math.log(discount * v / n) if n else 0.0
        for batch in batches:
            logp, mixed = [], []
            words = batch.column(0).to_pylist()
            for word, c, inside in zip(words, batch.column(1).to_pylist(), model.batch(words, weights).tolist()):
                logp.append((math.log(end) if word == END else math.log1p(-end) + inside) / LOG10)
                both = spare + (math.log(free_end) if word == END else math.log1p(-free_end) + inside)
                if c:
                    whole = math.log((c - discount) / n)
                    both = max(whole, both) + math.log1p(math.exp(-abs(whole - both)))
                mixed.append(both / LOG10)
            known = np.log10(batch.column(1).to_numpy() + 1.0)
            yield pa.record_batch([*batch.columns, pa.array(known), pa.array(logp, pa.float64()), pa.array(mixed, pa.float64())], ["word", "c", "c_all", "known", "logp", "mixed"])

    return run


_TABLES: dict[str, tuple] = {}


def _table(shared) -> tuple:
    """The broadcast words' places and figures, built once a worker."""
    if shared.id not in _TABLES:
        _TABLES.clear()
        words, *figures = shared.value
        _TABLES[shared.id] = {w: i for i, w in enumerate(words.split("\n"))} if words is not None else {}, *figures
    return _TABLES[shared.id]


class _Shared:
    """A broadcast and a name for it."""

    def __init__(self, spark, value, name: str):
        self.broadcast, self.id = spark.sparkContext.broadcast(value), name

    @property
    def value(self):
        return self.broadcast.value


def _score_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, known, logp, mixed = _table(shared)
        for batch in batches:
            n, n_known, base, score, mixture, rare, start = [], [], [], [], [], [], 0
            while start < batch.num_rows:
                text = batch.column(3)[start].as_py()
                words = words_of(text)
                words.append(END)
                at = list(map(place.get, words))
                if None in at:
                    rare.append(list(Counter(w for w, i in zip(words, at) if i is None).items()))
                    at = [i for i in at if i is not None]
                else:
                    rare.append([])
                at = np.array(at, np.int64)
                n.append(len(words))
                n_known.append(int((known[at] > 0).sum()))
                base.append(float(known[at].sum()))
                score.append(float(logp[at].sum()))
                mixture.append(float(mixed[at].sum()))
                start += 1
            kind = pa.list_(pa.struct([("word", pa.string()), ("times", pa.int64())]))
            rare = pa.array([[{"word": w, "times": t} for w, t in r] for r in rare], kind)
            yield pa.record_batch([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(mixture, pa.float64()), rare], ["row", "id", "held_out", "n_tokens", "n_known", "base", "score", "mixture", "rare"])

    return run


def lattice_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, rounds: int = ROUNDS, broadcast_words: int = BROADCAST_WORDS, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per row of docs: <id_col>, held_out, n_tokens, n_known, train_tokens, base_score, score, mixture_score."""
    spark, path = docs.sparkSession, path or default_path()
    kind = docs.schema[id_col].dataType.simpleString()
    held = F.coalesce(id_fold(id_col, FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    counted = docs.select(held, text_of(text_col).alias("text")).mapInArrow(_count_batches, "word string, c long, c_all long")
    vocabulary = materialise(counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all")), "vocabulary")
    power = F.floor(F.log2("c_all")).cast("int")
    stats = vocabulary.groupBy(power.alias("power")).agg(
        F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"), F.count(F.lit(1)).alias("words"), F.sum(F.octet_length("word")).alias("bytes"), F.sum(F.when(F.col("word") == END, F.col("c"))).alias("ends"),
    ).collect()
    n, v, n1, n2 = (sum(r[k] for r in stats) for k in ("n", "v", "n1", "n2"))
    ends = sum(r["ends"] or 0 for r in stats)
    discount = min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5

    model = Pieces(path)
    weight = model.first
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(r["words"] for r in stats) // 100_000 + 1)
    types = vocabulary.filter((F.col("c") > 0) & (F.col("word") != END)).select("word", "c").repartition(tasks)
    for _ in range(rounds if n else 0):
        shared = spark.sparkContext.broadcast(np.log(weight).tolist())
        sums = types.mapInArrow(_expect_batches(path, shared), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        expected = np.zeros(len(weight))
        expected[[r["piece"] for r in sums]] = [r["n"] for r in sums]
        weight = model.fitted(expected)
        shared.destroy()
    shared = spark.sparkContext.broadcast(np.log(weight).tolist())
    lattices = vocabulary.repartition(tasks).mapInArrow(_lattice_batches(path, shared, n, v, ends, discount), "word string, c long, c_all long, known double, logp double, mixed double")
    lattices = materialise(lattices, "lattices")
    release(vocabulary)

    least, words, size = 0, broadcast_words, broadcast_bytes  # the power of two of its count that a word needs to be broadcast
    for r in sorted(stats, key=lambda r: -r["power"]):
        words, size = words - r["words"], size - r["bytes"]
        if words < 0 or size < 0:
            least = r["power"] + 1
            break
    common = lattices.filter(power >= least).select("word", "known", "logp", "mixed").toArrow()
    names = common.column("word").to_pylist()
    table = _Shared(spark, ("\n".join(names) if names else None, *(common.column(c).to_numpy() for c in ("known", "logp", "mixed"))), uuid.uuid4().hex)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), held, text_of(text_col).alias("text"))
    schema = f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, mixture double, rare array<struct<word:string,times:long>>"
    part = materialise(rows.mapInArrow(_score_batches(table), schema), "scores")

    rare = part.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times").join(lattices.select("word", "known", "logp", "mixed"), "word")
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("known") > 0, F.col("times"))).alias("more_known"), F.sum(F.col("times") * F.col("known")).alias("more_base"), F.sum(F.col("times") * F.col("logp")).alias("more_score"),
        F.sum(F.col("times") * F.col("mixed")).alias("more_mixture"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return part.drop("rare").join(rare, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + zero("more_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base") - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"), (F.col("score") + zero("more_score")).alias("score"),
        (F.col("mixture") + zero("more_mixture")).alias("mixture_score"),
    )
