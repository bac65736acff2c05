"""Resampling, decontamination and fill-in-the-middle against brute force and edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import decontamination, resampling
from readloom.llm.decontamination import decontaminate
from readloom.llm.infill import BitVector, boundaries, fill_in_middle, restored
from readloom.llm.resampling import features_of, resample

LONG = "Lorem ipsum dolor É sit " * 6_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
VOCABULARY = ["ba", "Ko", "ti", "É", "é", "ß", "STRASSE", "x1", "日本", "İ", "Σας", "no-one", "the", "of"]


def words_of(text):
    return WORD.findall((text or "").translate(SMALL))


def texts(seed, n, longest):
    rng = random.Random(seed)
    return [rng.choice([" ", "\n", ". "]).join(rng.choice(VOCABULARY) for _ in range(rng.randrange(longest))) for _ in range(n)]


def documents(spark, rows, kind="long"):
    """(doc_id, text), and columns with names that the operators use inside or return."""
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)
    return df.withColumns({c: F.lit(7) for c in ("id", "w", "row", "n", "form", "rank", "score", "n_words", "weight", "items", "output", "h1", "p", "sets", "tokens")})


def tables(seed):
    docs = texts(seed, 60, 80)
    rows = [*enumerate(docs), (60, None), (61, ""), (62, " \n\t"), (63, LONG), (64, LONG), (None, docs[5]), (None, None), (3, docs[3]), (3, docs[3]), (70, "<S> a"), (71, "the"), (72, "the of the"), (73, "a\x00b c")]
    return rows


def items_for(rows):
    """Items with passages of documents, short ones, hot ones, odd ones."""
    rng, out = random.Random(5), []
    for i in range(40):
        words = words_of(rng.choice(rows)[1])
        a = rng.randrange(max(len(words) - 5, 1))
        out.append((i, " ".join(words[a : a + rng.choice([1, 2, 9, 10, 11, 25])]).upper() if i % 3 else "not there " * rng.randrange(4)))
    hot = " ".join(words_of(rows[7][1])[:14])
    return [*out, (100, hot), (101, hot + " more"), (11, hot), (9, "the"), (None, hot), (None, "x1"), (200, None), (201, ""), (202, "--"), (203, "The, of: the")]


def decontaminated(rows, items, window=10):
    windows = {}
    for key, text in items:
        w = words_of(text)
        size = min(window, len(w))
        for a in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + size]), set()).add("" if key is None else str(key))
    out = []
    for key, text in rows:
        w, hit, named = words_of(text), set(), set()
        for size in {len(x) for x in windows}:
            for a in range(len(w) - size + 1):
                found = windows.get(tuple(w[a : a + size]))
                if found:
                    hit |= set(range(a, a + size))
                    named |= found
        out.append((key, len(w), len(hit), len(named), sorted(named), bool(hit)))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items", "contaminated"]


def got(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("shingle", [1, 3, 4])
def test_decontamination_equals_brute_force(spark, shingle):
    rows = tables(1)
    items = items_for(rows)
    table = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("item", "size", "words", "items", "w")})
    want = decontaminated(rows, items)
    assert sum(r[5] for r in want) > 20
    assert got(decontaminate(documents(spark, rows), table, shingle=shingle), COLUMNS) == want


def test_decontamination_without_short_items_and_in_parts(spark, monkeypatch):
    rows = tables(2)
    items = [(i, " ".join(words_of(rows[i][1])[:30])) for i in range(0, 60, 7)] + [(300, LONG[:400])]
    items = [x for x in items if len(words_of(x[1])) >= 10]
    table, want = spark.createDataFrame(items, "item_id long, text string"), decontaminated(rows, items)
    assert got(decontaminate(documents(spark, rows), table), COLUMNS) == want
    monkeypatch.setattr(decontamination, "MOST_WINDOWS", 40)
    assert got(decontaminate(documents(spark, rows), table), COLUMNS) == want


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "the of the")], "item_id string, text string")
    rows = [("a", "x The of THE y"), (None, None)]
    docs = documents(spark, rows, "string")
    assert got(decontaminate(docs, none), COLUMNS) == [("a", 5, 0, 0, [], False), (None, 0, 0, 0, [], False)]
    assert got(decontaminate(docs, some), COLUMNS) == [("a", 5, 3, 1, ["1"], True), (None, 0, 0, 0, [], False)]
    assert decontaminate(documents(spark, []), some).count() == 0


def test_small_letters_change_ascii_alone(spark):
    """Words are the same as those of the contract's pattern, for every character there is."""
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = [(i, " ".join(map(chr, points[a : a + 4096]))) for i, a in enumerate(range(0, len(points), 4096))]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", decontamination.words_of(F.col("text")).alias("w"))
    seen = {}
    for key, w in df.collect():
        want = words_of(rows[key][1])
        assert len(w) == len(want)
        for a, b in zip(w, want):
            assert seen.setdefault(a, b) == b
    assert len(seen) == len(set(seen.values()))


def resampled(rows, targets, buckets=10_000):
    def features(text):
        w = words_of(text)
        return Counter(zlib.crc32(x.encode()) % buckets for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]), len(w)

    each = [(key, *features(text)) for key, text in rows]
    s, t = Counter(), Counter()
    for _, c, _ in each:
        s.update(c)
    for text in targets:
        t.update(features(text)[0])
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in s}
    out = []
    for key, c, n in each:
        total = sum(c.values())
        weight = sum(k * gain[b] for b, k in c.items()) // total if total else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, n, total, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    eligible = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {}
    for i, r in enumerate(eligible[: 25 * len(eligible) // 100]):
        rank.setdefault(r, []).append(i + 1)
    return sorted(((r[0], *r[2:], rank[r].pop(0) if rank.get(r) else None) for r in out), key=repr)


def test_resampling_equals_brute_force(spark, monkeypatch):
    rows, targets = tables(3), [*texts(8, 10, 60), None, "", LONG[:5000]]
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    goal = spark.createDataFrame([(t,) for t in targets], "text string")
    want = resampled(rows, targets)
    assert sum(r[4] is not None for r in want) > 5
    assert got(resample(documents(spark, rows), goal), columns) == want
    # many blocks and ranges
    monkeypatch.setattr(resampling, "BLOCK_ROWS", 3)
    monkeypatch.setattr(resampling, "ROWS_A_RANGE", 2)
    assert got(resample(documents(spark, rows), goal), columns) == want
    # a hot id and score
    many = rows + [(3, rows[3][1])] * 80
    assert got(resample(documents(spark, many), goal), columns) == resampled(many, targets)


def test_resampling_of_nothing(spark):
    goal = spark.createDataFrame([], "text string")
    assert resample(documents(spark, []), goal).count() == 0
    rows = [("a", "x y"), ("b", None)]
    assert [(r[0], r[1], r[4]) for r in got(resample(documents(spark, rows, "string"), goal), ["doc_id", "n_features", "weight", "score", "rank"])] == [("a", 3, None), ("b", 0, None)]


@pytest.mark.parametrize("runs", [1, 2, 3])
def test_features_of_long_texts(monkeypatch, runs):
    text = " ".join(texts(9, 20, 70)).encode()
    whole = features_of(text, runs, 97)
    monkeypatch.setattr(resampling, "SEGMENT", 20)
    for a, b in zip(whole, features_of(text, runs, 97)):
        assert np.array_equal(a, b)


def test_rank_and_select():
    rng = np.random.default_rng(1)
    bits = rng.random(512 * 9) < 0.1
    bits[512:1536] = False
    vector = BitVector(np.packbits(bits, bitorder="little"))
    places = np.arange(len(bits))
    assert np.array_equal(vector.rank(places), np.concatenate([[0], np.cumsum(bits)])[:-1])
    assert np.array_equal(vector.select(np.arange(bits.sum())), np.flatnonzero(bits))


def test_boundaries_across_windows(monkeypatch):
    from readloom.llm import infill

    rows = [t.encode() for t in texts(4, 50, 60)] + [b"", b"  ", b" a ", b"a  "]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    data = np.frombuffer(b"".join(rows), np.uint8)
    whole = boundaries(data, offsets)
    monkeypatch.setattr(infill, "WINDOW", 512)
    assert np.array_equal(whole.packed, boundaries(data, offsets).packed)
    assert np.diff(whole.rank(offsets)).tolist() == [len(TOKEN.findall(r.decode())) for r in rows]


def filled(key, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return key, len(tokens), "plain", None, None, text, text
    spm = h4 % 100 < 80
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return key, len(tokens), "spm" if spm else "psm", len(prefix), len(middle), out, text


def test_fill_in_middle_equals_brute_force(spark):
    rng = random.Random(2)
    odd = ["<", "<P", ">", "S>", "é", "日本 ", " ", "\x85", " ", "\n", "😀", "a\x00", "\x1c"]
    rows = tables(6) + [(100 + i, "".join(rng.choice(odd) for _ in range(rng.randrange(30)))) for i in range(150)] + [(400 + i, "<P>" + t) for i, t in enumerate(texts(3, 5, 9))]
    df = fill_in_middle(documents(spark, rows)).withColumn("back", restored())
    out = got(df, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back"])
    assert out == sorted((filled(*r) for r in rows), key=repr)
    assert {r[2] for r in out} == {"plain", "spm", "psm"}
    assert fill_in_middle(documents(spark, [])).count() == 0
