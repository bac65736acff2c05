"""Mapping reads: seeds, votes, extension, indels, junctions, report."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.dna import bases_of, reference_span, reverse_complement
from readloom.operators.events import breakpoint_clusters
from readloom.operators.local import MATCH, MISMATCH, align_locally, same_or_converted
from readloom.operators.shares import in_shares
from readloom.operators.wanted import Wanted, meeting
from readloom.session import drop, written

K = 16
#: Bases of a seed in three letters, which tells less a base: of random bases 24 such are as rare as 18 of four letters, and few of them are nearly all T or A.
CONVERTED_K = 24
#: What two places that make no proper pair must score more than two that do.
UNPAIRED = 17
#: Reads whose gaps are looked for together.
GAPPED_READS = 512


@dataclass(frozen=True)
class AlignOptions:
    seeds: int = 10
    threshold: int = 3  # votes that a read's best place needs
    mate_threshold: int = 1
    indel: int = 5
    max_mismatches: int = 3
    best: int = 1
    unique: bool = False
    min_fragment: int = 50
    max_fragment: int = 600
    orientation: str = "fr"  # strands of a proper pair's ends, from the fragment's start on: fr, rf or ff
    junctions: bool = False
    max_intron: int = 500_000
    max_occurrences: int = 100
    least_aligned: int = 24  # bases that are not clipped, and a third of the read
    trim_5: int = 0
    trim_3: int = 0
    converted: str = ""  # what bisulfite did to the reads as sequenced: CT (ends 1) or GA (ends 2); "": nothing


_CODE = np.full(256, 4, np.int64)
_CODE[np.frombuffer(b"ACGTacgt", np.uint8)] = [0, 1, 2, 3, 0, 1, 2, 3]
#: The code of a base's partner, and codes where C are T, and where G are A.
_PARTNER, _TURNED = np.array([3, 2, 1, 0, 4]), {"": np.arange(5), "CT": np.array([0, 3, 2, 3, 4]), "GA": np.array([0, 1, 0, 3, 4])}
#: Bases whose seeds are made together.
SEEDED = 1 << 21


def _words(code: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of k bases that begin at ``at`` in each row, as numbers, a decimal digit a base (longer ones: two bits), and whether all their bases are known."""
    words, known = np.zeros((len(code), len(at)), np.int64), np.ones((len(code), len(at)), bool)
    for j in range(k):
        base = code[:, at + j]
        words = words * (10 if k == K else 4) + base
        known &= base < 4
    return words, known


def _all_words(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``_words``, of each place of one row: words of 2, 4, 8 and 16 bases are put together from two of half their bases."""
    base, word, known, n = (10 if k == K else 4), code.astype(np.int64), code < 4, 1
    parts = {1: (word, known)}
    while 2 * n <= k:
        word, known = word[:-n] * base**n + word[n:], known[:-n] & known[n:]
        n *= 2
        parts[n] = word, known
    while n < k:
        more = next(m for m in sorted(parts, reverse=True) if n + m <= k)
        also, too = (x[n:] for x in parts[more])
        word, known = word[: len(also)] * base**more + also, known[: len(too)] & too
        n += more
    return word, known


#: Bases of chunks whose words are made together.
TOGETHER = 1 << 19


def _places(step: int, chunk: int, most: int, wanted: Wanted | None = None, k: int = K):
    """chr, start, seq, last -> chr, pos, kmer: all k-mers of a chunk that no later chunk has (and that are wanted), those of many chunks together.

    Of a k-mer with more than ``most`` places in the chunk alone, one more than that go on, enough to know it by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, last = (batch.column(c).to_numpy() for c in (1, 3))
            texts = batch.column(2).cast(pa.binary())
            size = pc.binary_length(texts).to_numpy()
            part = np.cumsum(size, dtype=np.int64) // TOGETHER
            for rows in np.split(np.arange(len(size)), np.flatnonzero(np.diff(part)) + 1):
                code = _CODE[np.frombuffer(b"".join(texts[int(rows[0]) : int(rows[-1]) + 1].to_pylist()), np.uint8)] if len(rows) else np.zeros(0, np.int64)
                if len(code) < k:
                    continue
                word, known = _all_words(code, k)
                here = size[rows].astype(np.int64)
                n = np.maximum(here - k + 1, 0)
                n = np.where(begin[rows] == last[rows], n, np.minimum(n, chunk))
                row = np.repeat(np.arange(len(rows)), n)
                offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(np.cumsum(here) - here, n) + offset
                kept = np.flatnonzero(known[at])
                if step > 1:
                    kept = kept[(begin[rows][row[kept]] + offset[kept] - 1) % step == 0]
                kmer = word[at[kept]]
                if wanted:
                    some = np.flatnonzero(wanted(kmer))
                    kept, kmer = kept[some], kmer[some]
                order = np.lexsort((kmer, row[kept]))
                kept, kmer = kept[order], kmer[order]
                new = np.r_[True, (kmer[1:] != kmer[:-1]) | (row[kept][1:] != row[kept][:-1])][: len(kept)]
                first = np.flatnonzero(new)
                fine = np.arange(len(kept)) - first[np.cumsum(new) - 1] <= most
                kept, kmer = kept[fine], kmer[fine]
                yield pa.record_batch([batch.column(0).take(pa.array(rows[row[kept]])), pa.array(begin[rows][row[kept]] + offset[kept]), pa.array(kmer)], ["chr", "pos", "kmer"])

    return run


#: The two alphabets of three letters that bisulfite leaves, and the letter of a read's other strand.
ALPHABETS = ("CT", "GA")


def _other(letters: str) -> str:
    return ALPHABETS[1 - ALPHABETS.index(letters)]


def build_converted_index(chunks: DataFrame, step: int = 1, max_occurrences: int = 100, chunk: int = 65_536) -> DataFrame:
    """letters, kmer, chr, pos: the index, of words of CONVERTED_K bases, of a reference whose C are all T (letters CT), and of one whose G are all A (GA).

    16 bases of three letters would be too few: those that are mostly T have over 100 places in 1e8 bases.  Consecutive chunks share CONVERTED_K - 1 bases or more.

    Max_occurrences holds in each.  The bases of a letter that was taken away come from ``chunks`` again when reads are extended."""

    def build(wanted: Wanted | None = None) -> DataFrame:
        one, two = (_index(chunks.withColumn("seq", F.translate(F.upper("seq"), *x)), step, max_occurrences, chunk, wanted, CONVERTED_K) for x in ALPHABETS)
        both = one.select(F.lit(ALPHABETS[0]).alias("letters"), "*").unionByName(two.select(F.lit(ALPHABETS[1]).alias("letters"), "*"))
        if wanted:
            both.places = one.places.unionByName(two.places)
        return both

    out = build()
    out.narrowed = build
    return out


def build_index(chunks: DataFrame, step: int = 1, max_occurrences: int = 100, chunk: int = 65_536) -> DataFrame:
    """kmer, chr, pos from chunks (chr, start, seq; consecutive chunks of a contig begin ``chunk`` bases apart and share K - 1 or more).  Where a column
    last says at which base the contig's last chunk begins, the chunks are read where they are.

    step 3 keeps every third base.  16-mers with another letter than ACGT or with more than max_occurrences places are left out.  The index
    is dealt out and sorted by 16-mer, as a join by it wants.  Reads that meet it before it is written have it built with their seeds' 16-mers alone."""
    out = _index(chunks, step, max_occurrences, chunk)
    out.narrowed = lambda wanted: _index(chunks, step, max_occurrences, chunk, wanted)
    return out


def _index(chunks: DataFrame, step: int, max_occurrences: int, chunk: int, wanted: Wanted | None = None, k: int = K) -> DataFrame:
    some, last = chunks.select("chr", F.col("start").cast("long").alias("start"), "seq"), F.col("last").cast("long").alias("last")
    if "last" in chunks.columns:  # so the bases don't shuffle
        some = chunks.select(*some.columns[:1], F.col("start").cast("long").alias("start"), "seq", last)
    else:
        some = some.join(chunks.groupBy("chr").agg(F.max("start").alias("last")).select("chr", last), "chr")
    places = some.mapInArrow(_places(step, chunk, max_occurrences, wanted, k), "chr string, pos long, kmer long")
    if wanted:
        places = written(places, "places")
    n = F.count(F.lit(1)).over(Window.partitionBy("kmer"))
    out = places.withColumn("n", n).filter(F.col("n") <= max_occurrences).select("kmer", "chr", "pos")
    if wanted:
        out.places = places
    return out


def check_reference(chunks: DataFrame) -> None:
    """Contigs have names, each once, and bases.  chunks: chr, start, seq; each contig's first begins at 1."""
    first = chunks.filter("start = 1")
    bad = first.groupBy("chr").agg(F.count(F.lit(1)).alias("n"), F.min(F.length("seq")).alias("m")).filter((F.col("n") > 1) | F.col("chr").isNull() | (F.col("chr") == "") | (F.col("m") == 0))
    if names := [r["chr"] for r in bad.limit(5).collect()]:
        raise ValueError(f"repeated or empty contigs: {names}")


def seeds(reads: DataFrame, o: AlignOptions = AlignOptions(), step: int = 1) -> DataFrame:
    """rid, strand, offset, kmer: evenly spaced 16-mers of both strands.  reads: rid, seq.

    Of converted reads words of CONVERTED_K bases, and also letters, the alphabet of each strand's 16-mers: a read whose C are T is so as it stands, and has A for G when turned."""
    n = CONVERTED_K if o.converted else K

    def offsets(length: int) -> list[int]:
        last = length - n
        gap = max(last / max(o.seeds - 1, 1), float(step))
        # a gapped index has one place in step: each seed tries so many neighbours
        return sorted({a + d for a in (int(i * gap) for i in range(o.seeds)) for d in range(step) if a + d <= last})

    return seeds_at(reads, offsets, o)


def seeds_at(reads: DataFrame, offsets: Callable[[int], Sequence[int]], o: AlignOptions = AlignOptions()) -> DataFrame:
    """Seeds that begin at ``offsets`` of a read's length, on both strands; ``narrowed`` of the result gives those alone that are wanted, ``words`` what is made of batches of
    their words alone, and ``most`` how many seeds there are, those with unknown bases too."""
    trimmed = F.expr(f"substring(upper(seq), {o.trim_5 + 1}, greatest(length(seq) - {o.trim_5 + o.trim_3}, 0))")
    n = CONVERTED_K if o.converted else K
    some = reads.select("rid", trimmed.alias("s")).filter(F.length("s") >= n)
    letters = {"+": o.converted, "-": _other(o.converted) if o.converted else ""}

    def of(texts: list[str], wanted: Wanted | None) -> list[tuple[np.ndarray, ...]]:
        """Row, whether turned, offset, word of texts' seeds."""
        texts, out = [s if s.isascii() else "".join(c if c.isascii() else "N" for c in s) for s in texts], []
        for length, rows in _by_length(texts):
            at, each = np.array(offsets(length), np.int64), max(1, SEEDED // length)
            for a in range(0, len(rows), each):
                here = rows[a : a + each]
                code = _CODE[_matrix([texts[i] for i in here], length)]
                for turned, (strand, c) in enumerate((("+", code), ("-", _PARTNER[code[:, ::-1]]))):
                    words, known = _words(_TURNED[letters[strand]][c], at, n)
                    if wanted:
                        known[known] = wanted(words[known])
                    row, place = np.nonzero(known)
                    out.append((here[row], np.full(len(row), turned), at[place], words[known]))
        return out

    def make(wanted: Wanted | None = None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = of(batch.column(1).to_pylist(), wanted)
                if not out:
                    continue
                row, turned, offset, word = map(np.concatenate, zip(*out))
                one = lambda *two: pa.array(two).take(pa.array(turned))
                columns = {"rid": batch.column(0).take(pa.array(row)), "strand": one("+", "-"), "offset": pa.array(offset, pa.int32()), "kmer": pa.array(word)}
                if o.converted:
                    columns["letters"] = one(*letters.values())
                yield pa.record_batch(list(columns.values()), list(columns))

        kind = dict(reads.dtypes)["rid"]
        return some.mapInArrow(run, f"rid {kind}, strand string, offset int, kmer long" + (", letters string" if o.converted else ""))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if found := of(batch.column(0).to_pylist(), None):
                yield pa.record_batch([pa.array(np.unique(np.concatenate([word for *_, word in found])))], ["kmer"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, of_it = np.unique(batch.column(0).to_numpy(), return_counts=True)
            yield pa.record_batch([pa.array([sum(2 * len(offsets(int(a))) * int(b) for a, b in zip(length, of_it))], pa.int64())], ["n"])

    out = make()
    out.narrowed = make
    out.words = lambda then, schema: some.select("s").mapInArrow(lambda batches: then(words(batches)), schema)
    out.most = lambda: some.select(F.length("s").alias("n")).mapInArrow(counted, "n long").agg(F.sum("n")).first()[0] or 0
    return out


def seed_hits(found: DataFrame, index: DataFrame, by: Sequence[str] = ("kmer",)) -> DataFrame:
    """rid, strand, offset, chr, pos: where the index has the seeds; written, and dealt out by read."""
    some, places = meeting(found, index)
    # Spark takes seeds for no larger than the reads they are exploded from, and would broadcast millions of them
    packed = some.select("rid", *by, (F.col("offset") * 2 + (F.col("strand") == "-").cast("int")).alias("at"))
    hits = written(packed.hint("merge").join(places, list(by)).select("rid", "at", "chr", "pos"), "hits")
    strand, out = F.when(F.col("at") % 2 == 1, "-").otherwise("+"), hits.repartition("rid")
    out = out.select("rid", strand.alias("strand"), F.expr("at div 2").cast("int").alias("offset"), "chr", "pos")
    out.written_at = hits.written_at
    return out


def vote(found: DataFrame, index: DataFrame, o: AlignOptions = AlignOptions()) -> DataFrame:
    """rid, strand, chr, diagonal (place of the read's base 0), far (the last diagonal), votes, from_, to_ (covered bases); written.

    Hits on one contig and strand whose diagonals lie within the indel tolerance vote together; a seed votes once."""
    met = seed_hits(found, index, ("kmer", "letters") if o.converted else ("kmer",))
    kind = dict(found.dtypes)["rid"]
    votes = written(met.sortWithinPartitions("rid").mapInArrow(_votes(o.indel, CONVERTED_K if o.converted else K), f"rid {kind}, strand string, chr string, diagonal long, far long, votes long, from_ int, to_ int"), "votes")
    drop(met)
    return votes


def _votes(indel: int, k: int):
    """Hits in order of rid -> votes.  A read's hits are taken together, many reads at a time."""

    def of(hits: pa.Table) -> pa.RecordBatch:
        code = lambda c: pc.fill_null(hits.column(c).combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        strand, chrom, offset = code("strand"), code("chr"), hits.column("offset").to_numpy()
        rid, diagonal = code("rid"), hits.column("pos").to_numpy().astype(np.int64) - offset
        order = np.lexsort((offset, diagonal, chrom, strand, rid))
        differs = lambda x: x[order][1:] != x[order][:-1]
        new = np.r_[True, differs(rid) | differs(strand) | differs(chrom) | (np.diff(diagonal[order]) > indel)]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        order = np.lexsort((diagonal, offset, group))  # by offset within a group
        group, offset, diagonal = group[order], offset[order], diagonal[order]
        new = np.r_[True, group[1:] != group[:-1]]
        begin = np.flatnonzero(new)
        end = np.r_[begin[1:], len(order)] - 1
        votes = np.add.reduceat(new | np.r_[True, offset[1:] != offset[:-1]], begin, dtype=np.int64)
        keep = hits.select(["rid", "strand", "chr"]).take(pa.array(order[begin])).combine_chunks()
        columns = [*(keep.column(c).combine_chunks() for c in range(3)), *map(pa.array, (diagonal[begin], diagonal[end], votes, offset[begin].astype(np.int32), (offset[end] + k).astype(np.int32)))]
        return pa.record_batch(columns, ["rid", "strand", "chr", "diagonal", "far", "votes", "from_", "to_"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([*(held.to_batches() if held else ()), batch])
            rid = pc.fill_null(held.column("rid").combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            others = np.flatnonzero(rid != rid[-1])  # the last read may go on in the next batch
            if len(others):
                yield of(held.slice(0, int(others[-1]) + 1))
                held = held.slice(int(others[-1]) + 1)
        if held:
            yield of(held)

    return run


def candidates(votes: DataFrame, o: AlignOptions = AlignOptions(), keep: int = 4) -> DataFrame:
    """The places with most votes of each read, at least the threshold; a junction's second half may have fewer."""
    w = Window.partitionBy("rid").orderBy(F.col("votes").desc(), "chr", "strand", "diagonal")
    top = votes.withColumn("top", F.max("votes").over(Window.partitionBy("rid"))).filter(F.col("top") >= (o.mate_threshold if o.junctions else o.threshold))
    return top.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= keep + o.best - 1).drop("top")


def _matrix(strings: list[str], width: int) -> np.ndarray:
    """A row of codes a string, cut or filled with 0 to width."""
    return np.frombuffer("".join(x[:width].ljust(width, "\0") for x in strings).encode(), np.uint8).reshape(len(strings), width)


def _by_length(strings: list[str]) -> list[tuple[int, np.ndarray]]:
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    return [(int(n), np.flatnonzero(size == n)) for n in np.unique(size)]


def _extend(o: AlignOptions):
    """Reads of one length are aligned with their windows of the reference together, ends that don't fit clipped."""
    band, same = max(o.indel, 1), same_or_converted if o.converted else np.equal

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reads, refs = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("s", "ref"))
            begin = batch.column(batch.schema.get_field_index("begin")).to_numpy()
            found = []  # row, place, CIGAR, mismatches, score
            for n, at in _by_length(reads):
                if n == 0:
                    continue
                code, window = _matrix([reads[i] for i in at], n), _matrix(["\0" * int(max(0, 1 - begin[i])) + refs[i] for i in at], n + 2 * band)
                for a in range(0, len(at), GAPPED_READS):
                    some = slice(a, a + GAPPED_READS)
                    for r, place, cigar, wrong, score in align_locally(code[some], window[some], band, o.indel, o.max_mismatches, min(n, max(o.least_aligned, n // 3)), same):
                        i = int(at[a + r])
                        found.append((i, int(begin[i]) + place, cigar, wrong, score))
            if found:
                row, place, cigar, wrong, score = zip(*found)
                take = pa.array(row, pa.int64())
                keep = [batch.column(batch.schema.get_field_index(c)).take(take) for c in ("rid", "strand", "chr", "votes")]
                columns = [*keep[:3], pa.array(place, pa.int64()), pa.array(cigar), pa.array(wrong, pa.int32()), keep[3], pa.array(score, pa.int32())]
                yield pa.record_batch(columns, ["rid", "strand", "chr", "pos", "cigar", "mismatches", "votes", "score"])

    return run


def _with_reference(places: DataFrame, chunks: DataFrame, start: str, length: str, name: str, chunk: int, spread: Sequence[str] = ()) -> DataFrame:
    """Adds name: the reference bases start..start + length - 1, from the chunk (chr, start, seq; overlapping) that holds start.

    Where a chunk may have a third of the places, ``spread`` names columns by which they are dealt out; places are evaluated twice then."""
    c = chunks.select(F.col("chr"), F.floor((F.col("start") - 1) / chunk).alias("__c"), F.col("start").alias("__s"), F.upper("seq").alias("__q"))
    places, keys = places.withColumn("__c", F.floor((F.greatest(F.col(start), F.lit(1)) - 1) / chunk)), ["chr", "__c"]
    if spread:
        places, c = in_shares(places, c, keys, spread)
        keys = [*keys, "__part"]
    # Spark takes chunks for no larger than the names they are made of, and would broadcast a whole reference through the driver
    met = places.join(c.hint("merge"), keys)
    return met.withColumn(name, F.expr(f"substring(__q, CAST(greatest({start}, 1) - __s + 1 AS INT), CAST({length} AS INT))")).drop("__c", "__s", "__q", "__part")


PLACED = "strand string, chr string, pos long, cigar string, mismatches int, votes long, score int"


def extend(found: DataFrame, reads: DataFrame, chunks: DataFrame, o: AlignOptions = AlignOptions(), chunk: int = 65_536) -> DataFrame:
    """rid, strand, chr, pos, cigar, mismatches, votes, score of candidates whose reads fit, ends that don't clipped.  chunks overlap by a read and its band."""
    trimmed = F.expr(f"substring(upper(seq), {o.trim_5 + 1}, greatest(length(seq) - {o.trim_5 + o.trim_3}, 0))")
    met = found.join(reads.select("rid", trimmed.alias("s")), "rid").withColumn("s", F.when(F.col("strand") == "-", reverse_complement(F.col("s"))).otherwise(F.col("s")))
    band = max(o.indel, 1)
    met = met.select("rid", "strand", "chr", "votes", "s", (F.col("diagonal") - band).cast("long").alias("begin"), (F.length("s") + 2 * band).alias("need"))
    places = written(met, "places")
    met = _with_reference(places, chunks, "begin", "need", "ref", chunk, ("rid", "strand", "begin")).select("rid", "strand", "chr", "votes", "s", "ref", "begin")
    if o.converted:  # marks the reference's letters that the read may have changed
        c = (F.col("strand") == "+") == F.lit(o.converted == "CT")
        met = met.withColumn("ref", F.when(c, F.translate("ref", "C", "c")).otherwise(F.translate("ref", "G", "g")))
    kind = dict(reads.dtypes)["rid"]
    placed = written(met.mapInArrow(_extend(o), f"rid {kind}, {PLACED}"), "placed")
    drop(places)
    return placed


def junction_candidates(votes: DataFrame, o: AlignOptions = AlignOptions()) -> DataFrame:
    """Pairs of places of a read on one contig and strand, an intron apart, that cover its left and right part."""
    a = votes.select("rid", "strand", "chr", F.col("diagonal").alias("d1"), F.col("votes").alias("v1"), F.col("from_").alias("f1"))
    b = votes.select("rid", "strand", "chr", F.col("diagonal").alias("d2"), F.col("votes").alias("v2"), F.col("from_").alias("f2"))
    met = a.join(b, ["rid", "strand", "chr"]).filter((F.col("d2") - F.col("d1") > 16) & (F.col("d2") - F.col("d1") <= o.max_intron) & (F.col("f1") < F.col("f2")))
    best = Window.partitionBy("rid").orderBy((F.col("v1") + F.col("v2")).desc(), F.col("d2") - F.col("d1"), "chr", "strand", "d1")
    return met.withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r")


def splice(pairs: DataFrame, reads: DataFrame, chunks: DataFrame, o: AlignOptions = AlignOptions(), chunk: int = 65_536) -> DataFrame:
    """Spliced alignments, cut where fewest bases differ, a cut at GT..AG or CT..AC before others with as many."""
    met = pairs.join(reads.select("rid", F.upper("seq").alias("s")), "rid").withColumn("s", F.when(F.col("strand") == "-", reverse_complement(F.col("s"))).otherwise(F.col("s")))
    places = written(met.withColumn("need", F.length("s") + 2).withColumn("before", F.col("d2") - 2), "pairs")
    met = _with_reference(places, chunks, "d1", "need", "left_ref", chunk, ("rid", "strand"))
    met = _with_reference(met, chunks, "before", "need", "right_ref", chunk, ("rid", "strand"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reads, lefts, rights = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("s", "left_ref", "right_ref"))
            d1, d2, v1, v2 = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("d1", "d2", "v1", "v2"))
            found = []  # row, CIGAR, mismatches
            for n, at in _by_length(reads):
                at = np.array([i for i in at if len(lefts[i]) >= n + 2 and len(rights[i]) >= n + 2], np.int64)
                if not len(at) or n < 2:
                    continue
                r, left, right = _matrix([reads[i] for i in at], n), _matrix([lefts[i] for i in at], n + 2), _matrix([rights[i] for i in at], n + 2)
                zero = np.zeros((len(at), 1), np.int64)
                before = np.c_[zero, np.cumsum(r != left[:, :n], axis=1)]
                after = np.c_[np.cumsum((r != right[:, 2:])[:, ::-1], axis=1)[:, ::-1], zero]
                wrong = (before + after)[:, 1:n]
                pair = lambda x: x[:, 1:n].astype(np.int32) * 256 + x[:, 2 : n + 1]  # noqa: E731  # the two bases from each cut on
                donor, acceptor = pair(left), pair(right)
                signal = np.full(wrong.shape, 3)
                for a, b, cost in (("GT", "AG", 0), ("CT", "AC", 0), ("GC", "AG", 1), ("AT", "AC", 1)):
                    signal[(donor == ord(a[0]) * 256 + ord(a[1])) & (acceptor == ord(b[0]) * 256 + ord(b[1]))] = cost
                cut = (wrong * 4 + signal).argmin(axis=1)
                rows = np.arange(len(at))
                good = (wrong[rows, cut] <= o.max_mismatches) & (signal[rows, cut] < 3)
                found += [(int(i), f"{b}M{d2[i] - d1[i]}N{n - b}M", int(w)) for i, b, w in zip(at[good], (cut[good] + 1).tolist(), wrong[rows, cut][good])]
            if found:
                row, cigar, wrong = zip(*found)
                take = np.array(row)
                keep = [batch.column(batch.schema.get_field_index(c)).take(pa.array(take)) for c in ("rid", "strand", "chr")]
                score = np.array([len(reads[i]) for i in row]) * MATCH + np.array(wrong) * (MISMATCH - MATCH)
                columns = [*keep, pa.array(d1[take], pa.int64()), pa.array(cigar), pa.array(wrong, pa.int32()), pa.array(v1[take] + v2[take], pa.int64()), pa.array(score, pa.int32())]
                yield pa.record_batch(columns, ["rid", "strand", "chr", "pos", "cigar", "mismatches", "votes", "score"])

    kind = dict(reads.dtypes)["rid"]
    spliced = written(met.mapInArrow(run, f"rid {kind}, {PLACED}"), "spliced")
    drop(places)
    return spliced


def report(placed: DataFrame, reads: DataFrame, o: AlignOptions = AlignOptions()) -> DataFrame:
    """Alignment records: the best places of each read (highest score, most votes) with NH and HI, unmapped reads with flag 4.  Where reads
    have a name, it stands for rid in the records.

    Quality is 40 over the number of places, less per mismatch, and 0 where the best is tied."""
    order = Window.partitionBy("rid").orderBy(F.col("score").desc(), F.col("votes").desc(), "chr", "pos", "strand")
    per = Window.partitionBy("rid")
    place = Window.partitionBy("rid", "chr", "pos", "strand").orderBy(F.col("score").desc(), F.col("votes").desc(), "cigar")
    best = placed.withColumn("r", F.row_number().over(place)).filter("r = 1").drop("r")
    best = best.withColumn("hi", F.row_number().over(order)).withColumn("places", F.count(F.lit(1)).over(per))
    top = F.struct(-F.col("score"), -F.col("votes"))
    best = best.withColumn("tied", F.count(F.lit(1)).over(Window.partitionBy("rid", "score", "votes"))).withColumn("top", F.min(top).over(per)).withColumn("is_top", top == F.col("top"))
    if o.unique:
        best = best.filter(~F.col("is_top") | (F.col("tied") == 1)).filter("is_top")
    best = best.filter(F.col("hi") <= o.best)
    nh = F.count(F.lit(1)).over(per)
    quality = F.when(F.col("is_top") & (F.col("tied") > 1), 0).otherwise(F.greatest(F.floor(40 / F.col("places")) - F.col("mismatches"), F.lit(1))).cast("int")
    got = best.select("rid", "strand", "chr", "pos", "cigar", F.col("mismatches").alias("nm"), quality.alias("mapq"), nh.cast("int").alias("nh"), F.col("hi").cast("int").alias("hi"), "score")
    met = reads.join(got, "rid", "left")
    name = F.col("name" if "name" in reads.columns else "rid").alias("rid")
    reverse, mapped = F.col("strand") == "-", F.col("chr").isNotNull()
    flag = F.when(~mapped, 4).otherwise(F.when(reverse, 16).otherwise(0) + F.when(F.col("hi") > 1, 256).otherwise(0))
    turned = lambda c, f: F.when(mapped & reverse, f).otherwise(F.col(c))
    return met.select(
        name, flag.alias("flag"), F.coalesce("chr", F.lit("*")).alias("chr"), F.coalesce("pos", F.lit(0)).cast("int").alias("pos"), F.coalesce("mapq", F.lit(0)).alias("mapq"), F.coalesce("cigar", F.lit("*")).alias("cigar"),
        turned("seq", reverse_complement(F.col("seq"))).alias("seq"), turned("qual", F.reverse("qual")).alias("qual"), "nm", F.coalesce("nh", F.lit(0)).alias("nh"), "hi", "score",
    )


def align(reads: DataFrame, index: DataFrame, chunks: DataFrame, o: AlignOptions = AlignOptions(), chunk: int = 65_536, step: int = 1) -> DataFrame:
    """Single ends.  reads: rid, seq, qual; chunks: chr, start, seq in steps of ``chunk`` bases that overlap by a read and its band; step: as the index was built.

    Converted reads go with the index of ``build_converted_index``, without junctions; a base that bisulfite may have turned is no mismatch, one
    that it can't have turned is."""
    if o.converted and (o.converted not in ALPHABETS or o.junctions):
        raise ValueError("converted reads are CT or GA, and have no junctions")
    # a number a read, as its name would go with each of its seeds
    reads = written(reads.select(F.monotonically_increasing_id().alias("rid"), F.col("rid").alias("name"), "seq", "qual"), "numbered")
    votes = vote(seeds(reads, o, step), index, o)
    placed = extend(candidates(votes.filter(F.col("votes") >= o.threshold), o), reads, chunks, o, chunk)
    if o.junctions:
        spliced = splice(junction_candidates(candidates(votes, o, 8).drop("r"), o), reads, chunks, o, chunk)
        placed = placed.unionByName(spliced)
    return report(placed, reads, o)


def pair_up(first: DataFrame, second: DataFrame, o: AlignOptions = AlignOptions()) -> DataFrame:
    """Alignments of two mates side by side, rid, r1, r2, with whether the pair is proper and its length.

    Mates may have several places each (``best``): of all combinations the one with the highest sum of scores goes first, a proper one UNPAIRED
    ahead, then one on one contig, then that with fewest mismatches, then the mates' own order."""
    a, b = (df.select("rid", F.struct(*[c for c in df.columns if c != "rid"]).alias(f"r{i}")) for i, df in ((1, first), (2, second)))
    met = a.join(b, "rid", "full")
    rev = lambda r: F.col(f"{r}.flag").bitwiseAND(F.lit(16)) != 0
    span = lambda r: reference_span(F.col(f"{r}.cigar"))
    mapped = (F.col("r1.chr") != "*") & (F.col("r2.chr") != "*")
    left, right = F.least("r1.pos", "r2.pos"), F.greatest(F.col("r1.pos") + span("r1"), F.col("r2.pos") + span("r2"))
    size = right - left
    turned = (~rev("r1") if o.orientation == "rf" else rev("r1"))
    ahead = F.when(turned, F.col("r2.pos") <= F.col("r1.pos")).otherwise(F.col("r1.pos") <= F.col("r2.pos"))
    strands = (rev("r1") == rev("r2")) == F.lit(o.orientation == "ff")
    proper = F.coalesce(mapped & (F.col("r1.chr") == F.col("r2.chr")) & strands & ahead & size.between(o.min_fragment, o.max_fragment), F.lit(False))
    same = F.coalesce(mapped & (F.col("r1.chr") == F.col("r2.chr")), F.lit(False))
    tlen = F.when(same, F.when(F.col("r1.pos") <= F.col("r2.pos"), size).otherwise(-size)).otherwise(0)
    if o.orientation not in ("fr", "rf", "ff"):
        raise ValueError("orientation is fr, rf or ff")
    met = met.withColumn("proper", proper).withColumn("tlen", tlen)
    none = F.lit(0)
    joint = F.coalesce("r1.score", none) + F.coalesce("r2.score", none) + F.when(F.col("proper"), UNPAIRED).otherwise(0)
    order = [joint.desc(), F.col("proper").desc(), same.desc(), F.coalesce("r1.nm", none) + F.coalesce("r2.nm", none), F.coalesce("r1.hi", none) + F.coalesce("r2.hi", none), "r1.chr", "r1.pos", "r2.pos"]
    return met.withColumn("r", F.row_number().over(Window.partitionBy("rid").orderBy(*order))).filter("r = 1").drop("r")


def _tags(up: Column, wrong: Column, cigar: Column, nh: Column, hi: Column) -> Column:
    """Tags of a record: NM, its edit distance (mismatches and bases in gaps), NH and HI; none if it isn't mapped."""
    distance = wrong + bases_of(cigar, "ID")
    return F.when(up, F.create_map(F.lit("NM"), distance.cast("string"), F.lit("NH"), nh.cast("string"), F.lit("HI"), hi.cast("string"))).otherwise(F.create_map().cast("map<string,string>"))


def with_read_group(records: DataFrame, group: str) -> DataFrame:
    """Records, mapped or not, with the tag RG."""
    others = F.map_filter("tags", lambda k, _: k != "RG")
    return records.withColumn("tags", F.map_concat(others, F.create_map(F.lit("RG"), F.lit(group))))


def single_records(mapped: DataFrame) -> DataFrame:
    """Single ends' records with the columns of ``mate_records``."""
    tags = _tags(F.col("chr") != "*", *map(F.col, ("nm", "cigar", "nh", "hi")))
    none = F.lit(0)
    return mapped.select(F.col("rid").alias("qname"), "flag", "chr", "pos", "mapq", "cigar", F.lit("*").alias("rnext"), none.alias("pnext"), none.alias("tlen"), "seq", "qual", tags.alias("tags"), "nh", "hi")


def mate_records(pairs: DataFrame) -> DataFrame:
    """Two alignment records of each pair, with mate fields: qname, flag, chr, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, tags, nh, hi."""
    def record(no: int) -> Column:
        me, mate = F.col(f"r{no}"), F.col(f"r{3 - no}")
        up = F.coalesce(me["chr"] != "*", F.lit(False))
        mate_up = F.coalesce(mate["chr"] != "*", F.lit(False))
        bit = lambda r, b: F.coalesce(r["flag"].bitwiseAND(F.lit(b)) != 0, F.lit(False))
        flag = F.lit(1 + (64 if no == 1 else 128)) + F.when(F.col("proper"), 2).otherwise(0) + F.when(up, F.when(bit(me, 16), 16).otherwise(0)).otherwise(4) + F.when(mate_up, F.when(bit(mate, 16), 32).otherwise(0)).otherwise(8)
        # an unmapped end stands at its mate's place
        chrom = F.when(up, me["chr"]).when(mate_up, mate["chr"]).otherwise("*")
        pos = F.when(up, me["pos"]).when(mate_up, mate["pos"]).otherwise(0)
        mate_chr = F.when(mate_up, mate["chr"]).when(up, me["chr"])
        mate_pos = F.when(mate_up, mate["pos"]).when(up, me["pos"]).otherwise(0)
        tags = _tags(up, *(me[c] for c in ("nm", "cigar", "nh", "hi")))
        return F.struct(
            flag.alias("flag"), chrom.alias("chr"), pos.alias("pos"), F.coalesce(me["mapq"], F.lit(0)).alias("mapq"), F.coalesce(me["cigar"], F.lit("*")).alias("cigar"),
            F.when(mate_chr.isNull(), "*").when(mate_chr == chrom, "=").otherwise(mate_chr).alias("rnext"), mate_pos.alias("pnext"), (F.col("tlen") if no == 1 else -F.col("tlen")).cast("int").alias("tlen"),
            me["seq"].alias("seq"), me["qual"].alias("qual"), tags.alias("tags"), F.coalesce(me["nh"], F.lit(0)).alias("nh"), me["hi"].alias("hi"),
        )

    return pairs.select(F.col("rid").alias("qname"), F.explode(F.array(record(1), record(2))).alias("x")).select("qname", "x.*").filter("seq is not null")


def breakpoint_class(pairs: DataFrame, most: int = 10_000, o: AlignOptions = AlignOptions()) -> DataFrame:
    """Adds kind to mate pairs that are not proper: deletion, inversion or translocation."""
    far = F.abs(F.col("r1.pos") - F.col("r2.pos"))
    same = F.col("r1.chr") == F.col("r2.chr")
    turned = (F.col("r1.flag").bitwiseAND(F.lit(16)) != 0) == (F.col("r2.flag").bitwiseAND(F.lit(16)) != 0)
    kind = F.when(~same | (far > most), "translocation").when(turned, "inversion").when(far > o.max_fragment, "deletion")
    return pairs.filter(~F.col("proper") & (F.col("r1.chr") != "*") & (F.col("r2.chr") != "*")).withColumn("kind", kind).filter("kind is not null")


def structural_variants(pairs: DataFrame, o: AlignOptions = AlignOptions(), within: int = 500, most: int = 10_000, support: int = 2) -> DataFrame:
    """kind, chr1, pos1, end1, chr2, pos2, end2, support: clusters of mate pairs (``pair_up``) that show a deletion, inversion or translocation."""
    first = F.least(F.struct("r1.chr", "r1.pos"), F.struct("r2.chr", "r2.pos"))
    second = F.greatest(F.struct("r1.chr", "r1.pos"), F.struct("r2.chr", "r2.pos"))
    odd = breakpoint_class(pairs, most, o).select("kind", first["chr"].alias("chr1"), first["pos"].alias("pos1"), second["chr"].alias("chr2"), second["pos"].alias("pos2"))
    return breakpoint_clusters(odd, within).filter(F.col("support") >= support)
