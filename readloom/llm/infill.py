"""Fill-in-the-middle by succinct rank and select.

A text is cut into tokens: a run of characters that are no white space, with the white space before it, or the white space
that ends the text.  Over the UTF-8 bytes of a batch of texts, a bitvector marks where tokens begin; it is packed, eight bytes
to a bit each, and a directory holds the popcount before every block of ``BLOCK`` bits.  Popcounts between the ends of a text give
its number of tokens n; two hashes of its id choose two ranks of 0 to n, and ``select`` of each gives the byte to cut at.  No text is
decoded or turned into a list of tokens; what a batch needs beside its texts is an eighth of a bit-mask, built ``WINDOW`` bytes at a time.

The forms: ``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` is <S>suffix<P>prefix<M>middle, ``plain`` is the text as it is.  ``restored``
undoes them from form and output alone, by columns; texts that hold a sentinel stay plain, so that it always can.

Null text is empty text, which has no tokens and stays plain.  A null id hashes as empty text.  Repeated rows give equal rows each; empty
tables none.  Other columns may have any names; none of them is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import text_of

SEED = 42
#: Percent of texts that are transformed, and of those the percent that get the suffix first.
RATE, SUFFIX_FIRST = 50, 80
SENTINELS = ("<P>", "<S>", "<M>")
#: Bits of a directory's block: whole bytes.
BLOCK = 512
#: Bytes of text whose boundaries are found at a time, a multiple of BLOCK.
WINDOW = 1 << 22

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class BitVector:
    """Packed bits with a popcount directory."""

    def __init__(self, packed: np.ndarray):
        """packed: bytes, the first bit in the lowest place; their number is a multiple of BLOCK / 8."""
        self.packed = packed
        ones = np.bitwise_count(packed.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    def _bits(self, blocks: np.ndarray) -> np.ndarray:
        return np.unpackbits(self.packed.reshape(-1, BLOCK // 8)[blocks], axis=1, bitorder="little")

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        out = self.before[places // BLOCK]
        inside = np.flatnonzero(places % BLOCK)
        for a in range(0, len(inside), 4096):
            some = places[inside[a : a + 4096]]
            sums = np.cumsum(self._bits(some // BLOCK), axis=1, dtype=np.int32)
            out[inside[a : a + 4096]] += sums[np.arange(len(some)), some % BLOCK - 1]
        return out

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """The place of the set bit that so many set bits come before; each must exist."""
        block = np.searchsorted(self.before, ranks, side="right") - 1
        out = block * BLOCK
        for a in range(0, len(ranks), 4096):
            some = slice(a, a + 4096)
            sums = np.cumsum(self._bits(block[some]), axis=1, dtype=np.int32)
            out[some] += np.argmax(sums > (ranks[some] - self.before[block[some]])[:, None], axis=1)
        return out


def boundaries(data: np.ndarray, offsets: np.ndarray) -> BitVector:
    """Marks the bytes where tokens begin; text i takes the bytes from offsets[i] to offsets[i + 1]."""
    size = len(data)
    packed = np.zeros(-(-(size + 1) // BLOCK) * (BLOCK // 8), np.uint8)
    first = np.unique(offsets[:-1][offsets[1:] > offsets[:-1]])
    for a in range(0, size, WINDOW):
        space = _SPACE[data[max(a - 1, 0) : a + WINDOW]]
        begins = np.zeros(min(WINDOW, size - a), bool)
        begins[int(a == 0) :] = space[1:] & ~space[:-1]
        begins[first[np.searchsorted(first, a) : np.searchsorted(first, a + WINDOW)] - a] = True
        bits = np.packbits(begins, bitorder="little")
        packed[a // 8 : a // 8 + len(bits)] = bits
    return BitVector(packed)


def cuts(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's number of tokens, and the bytes where prefix and middle end."""
    bits = boundaries(data, offsets)
    before = bits.rank(offsets)
    n = np.diff(before)
    one, two = h1 % (n + 1), h2 % (n + 1)
    ends = []
    for k in (np.minimum(one, two), np.maximum(one, two)):
        end = offsets[1:].copy()
        inside = np.flatnonzero(k < n)
        end[inside] = bits.select(before[inside] + k[inside])
        ends.append(end)
    return n, ends[0], ends[1]


def _string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, and its offsets into them."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _characters(data: np.ndarray) -> int:
    """Code points: bytes that don't continue one."""
    return sum(int(np.count_nonzero((data[a : a + WINDOW] & 0xC0) != 0x80)) for a in range(0, len(data), WINDOW))


def _transform(rate: int, suffix_first: int):
    marks = [s.encode() for s in SENTINELS]
    p, s, m = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, h3, h4 = (batch.column(i).to_numpy() for i in range(2, 6))
            data, offsets = _string_parts(batch.column(1))
            n, one, two = cuts(data, offsets, h1, h2)
            chosen, spm = h3 % 100 < rate, h4 % 100 < suffix_first
            forms, sizes, out = [], [], []
            for i, (a, b, c, d) in enumerate(zip(offsets[:-1].tolist(), one.tolist(), two.tolist(), offsets[1:].tolist())):
                text = data[a:d].tobytes()
                if not chosen[i] or not text or any(x in text for x in marks):
                    forms.append("plain")
                    sizes.append((None, None))
                    out.append(text)
                    continue
                prefix, middle, suffix = text[: b - a], text[b - a : c - a], text[c - a :]
                forms.append("spm" if spm[i] else "psm")
                sizes.append((_characters(data[a:b]), _characters(data[b:c])))
                out.append(b"".join((s, suffix, p, prefix, m, middle) if spm[i] else (p, prefix, s, suffix, m, middle)))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(forms, pa.string()), *(pa.array(x, pa.int64()) for x in zip(*sizes)), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.record_batch(columns, ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row per row of docs: <id_col>, n, form, prefix_chars, middle_chars, output.

    ``rate`` percent of texts are transformed, ``suffix_first`` percent of those to spm.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    keys = [F.conv(F.substring("__rl_digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), digest.alias("__rl_digest")).select("id", "text", *keys)
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(_transform(rate, suffix_first), f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restored(form: str = "form", output: str = "output") -> Column:
    """The text, rebuilt from the form and the output."""
    # the parts stand in the order of their sentinels; a transformed text holds no other sentinel
    part = F.split(F.col(output), "|".join(SENTINELS), -1)
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))
