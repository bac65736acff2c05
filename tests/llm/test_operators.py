"""The ten operators against brute force, exact round trips and edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from readloom.llm import neighbours, warc
from readloom.llm.exact_dedup import drop_exact_copies, exact_dedup
from readloom.llm.graph import connected_components
from readloom.llm.lattice import Pieces, default_path, lattice_scores
from readloom.llm.mixing import mix, mix_documents
from readloom.llm.packing import pack, plan
from readloom.llm.quality import quality_scores
from readloom.llm.simhash import drop_near_copies, fingerprint, simhash_components
from readloom.llm.substrings import substring_dedup
from readloom.llm.tokens import default_paths, tokenizer
from readloom.llm.toxicity import drop_toxic, toxicity_scores

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum " * 30_000


def documents(spark, rows):
    """(doc_id, text[, source]); other columns have names that the operators use inside or return."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS).repartition(3)
    return df.withColumns({c: F.lit(7) for c in ("keep_id", "id", "row", "h", "fp", "key", "size", "score", "maybe", "length", "held_out", "component_id", "n_words")})


def corpus(seed=1, n=160):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ba", "ko", "ti", "su", "Re") for b in ("la", "mi", "no", "x", "é")]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.3:
            text = rng.choice(rows)[1]
            if text and rng.random() < 0.5:
                words = text.split(" ")
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
                text = " ".join(words)
        else:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 90)))
        rows.append((i, text, rng.choice(["a", "b", "b", "b", None])))
    return rows + [(n, None, "c"), (n + 1, "", "c"), (n + 2, " \n\t ", None), (n + 3, LONG, "d"), (n + 4, LONG, "d"), (None, "only null", "a"), rows[3], rows[3]]


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


EMPTY = []


# 1


@pytest.mark.parametrize("log2", [30, 16])
def test_exact_dedup(spark, log2):
    rows = corpus()
    got = exact_dedup(documents(spark, rows), max_log2=log2).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    stay = Counter()
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"] and r["doc_id"] in groups[t])
        top = max((i for i in groups[text] if i is not None), default=None)
        assert (r["keep_id"], r["group_size"]) == (top, len(groups[text]))
        assert not r["kept"] or r["doc_id"] == top
        stay[text] += r["kept"]
    assert set(stay.values()) == {1}
    assert exact_dedup(documents(spark, EMPTY)).count() == 0


def test_exact_dedup_of_documents(spark):
    rows = corpus()
    df = documents(spark, rows)
    got = drop_exact_copies(df)
    assert got.columns == df.columns
    want = defaultdict(lambda: -1)
    for i, t, _ in rows:
        want[t or ""] = max(want[t or ""], -1 if i is None else i)
    assert sorted((r["text"] or "", -1 if r["doc_id"] is None else r["doc_id"]) for r in got.collect()) == sorted(want.items())
    assert drop_exact_copies(documents(spark, EMPTY)).count() == 0


def test_unique_rows_pass_a_filter_that_is_far_too_small_for_them(spark):
    from readloom.llm.bloom import RepeatFilter, possibly_repeated

    n, log2 = 120_000, 16  # room for 4096 hashes
    h = spark.range(n, numPartitions=7).select(F.xxhash64(F.when(F.col("id") % 4 == 0, F.col("id") % 400).otherwise(F.col("id"))).alias("h"), (F.col("id") % 4 != 0).alias("alone"))
    passed = h.withColumn("maybe", RepeatFilter.build(h.select("h"), n, log2).test(F.col("h"))).groupBy("alone").agg(F.count_if("maybe").alias("m"), F.count("*").alias("n"))
    share = {r["alone"]: r["m"] / r["n"] for r in passed.collect()}
    assert share[False] == 1 and share[True] < 0.01
    few = possibly_repeated(h.select("h"), n, 5000).count()
    assert 100 <= few < 100 + 0.01 * n


def test_one_group_of_a_third_of_all_rows(spark):
    rows = [(i, "same" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    got = exact_dedup(documents(spark, rows)).filter("group_size > 1").agg(F.count("*"), F.max("keep_id"), F.count_if("kept")).first()
    assert tuple(got) == (1000, 2997, 1)


# 2


def water(sizes):
    total, weight = 1.5 * sum(sizes.values()), {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    full, target = set(), {}
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in sizes if x not in full) for s in sizes if s not in full}
        over = {s for s in share if share[s] >= 2 * sizes[s]}
        if not over:
            return share | {s: 2.0 * sizes[s] for s in full}
        full |= over


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * (1 + i % 3) for _ in range(rng.randrange(0, 40))), rng.choice("abcdefg") if rng.random() < 0.7 else "hot") for i in range(3000)] + [(9001, None, None), (9002, "one two", None), (9003, "  ", "z"), (None, "a b", "a")]
    df = documents(spark, rows)
    got = mix(df).collect()
    words = lambda t: len((t or "").encode().split())
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    target = water(dict(sizes))
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    taken, source = Counter(), {(i, words(t)): s for i, t, s in rows}
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6 and r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 40 for s in sizes)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mix(df.repartition(7)).collect()), key=repr)
    mixed = mix_documents(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r["taken"] // r["size"] for r in got if r["size"])
    assert mix(documents(spark, EMPTY)).count() == 0 and mix_documents(documents(spark, EMPTY)).count() == 0
    assert [tuple(r) for r in mix(documents(spark, [(1, None, None)])).collect()] == [(1, 0, 0, 0.0, 0)]


# 3


def test_warc_round_trip(spark):
    html = ["<p>é " + "x" * 200, "<b>short</b>", "", None, "<i>" + "long page " * 200_000]
    rows = [(i, f"http://a.example/ü {i}%20?q=1" if i % 4 else None, html[i % 5]) for i in range(40)] + [(None, "http://n\r\n", html[0]), (2, "http://again", html[2]), (0, None, html[0])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("first", F.lit(1)).repartition(3)
    got = warc.read_warc(warc.write_warc(pages)).collect()
    assert sorted((r["page_id"], r["url"]) for r in got if r["page_id"] is not None and r["url"]) == sorted((i, u) for i, u, _ in rows if i is not None and u)
    first = {h: min(i for i, _, x in rows if x == h and i is not None) for h in html if h and len(h.encode()) >= 100}
    text = {hashlib.sha256((h or "").encode()).hexdigest(): h or "" for h in html}
    assert len(got) == len(rows)
    for r in got:
        h = text[r["payload_digest"]]
        assert r["payload_bytes"] == len(h.encode())
        target = first.get(h)
        if target is None or r["page_id"] == target:
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("response", None, h.encode())
        else:
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", target, None)
    assert warc.read_warc(warc.write_warc(pages.limit(0))).count() == 0


def test_archive_has_a_dictionary_and_single_frames(tmp_path):
    records = [warc.page_record(i, "http://x", b"<p>%d</p>" % i * 50, "d", 1, "response", None) for i in range(200)]
    path = tmp_path / "a.warc.zst"
    with open(path, "wb") as f:
        out = warc.ArchiveWriter(f, warc.train(records))
        for r in records:
            out.add(r)
    data = path.read_bytes()
    assert data[:4] == b"\x5d\x2a\x4d\x18" and len(data) == out.bytes < sum(map(len, records))
    with open(path, "rb") as f:
        assert [h["warc-type"] for h, _ in warc.read_archive(f)] == ["warcinfo"] + ["response"] * 200
    with pytest.raises(Exception), open(path, "rb") as f:
        f.seek(8)
        list(warc.read_archive(f))


# 4


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(fps):
    values = sorted(set(fps))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("limit", [1 << 20, 2])
def test_simhash(spark, limit):
    rows = corpus(3, 250)
    # short texts whose fingerprints differ by design can't be made; near copies of long ones are near enough
    base = [f"w{i}" for i in range(400)]
    rows += [(2000 + i, " ".join(base[:i] + ["Other"] + base[i + 1 :])) for i in range(0, 400, 7)]
    got = simhash_components(documents(spark, rows), bucket_limit=limit).collect()
    fps = [slow_fingerprint(r[1]) for r in rows]
    assert all(fingerprint((r[1] or "").encode()) == f for r, f in zip(rows, fps))
    root, least = components(fps), {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            least[root[f]] = min(least.get(root[f], r[0]), r[0])
    want = sorted(((r[0], f"{f:016x}", least.get(root[f])) for r, f in zip(rows, fps)), key=repr)
    assert rows_of(spark.createDataFrame(got), "doc_id", "fingerprint", "component_id") == want
    kept = drop_near_copies(documents(spark, rows), bucket_limit=limit)
    assert kept.columns == documents(spark, EMPTY).columns
    assert kept.count() == len(set(root.values()))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(least.values()))


def test_simhash_of_nothing(spark):
    assert simhash_components(documents(spark, EMPTY)).count() == 0 and drop_near_copies(documents(spark, EMPTY)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 4000), (5000, 5000)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(200)) and got[5000] == got[4000] == 4000


# 5 and 7


def labelled(spark, n=900):
    rng = random.Random(6)
    vocabulary = ["the", "river", "walks", "under", "a", "bright", "moon", "and", "sings", "softly", "today"]
    rows, labels, truth = [], [], {}
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 120))]
        bad, toxic = rng.random() < 0.25, rng.random() < 0.25
        if bad:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["grobnik", "grobnak", "Grobnel"]))
        rows.append((i, " ".join(words)))
        truth[i] = int(not bad), int(toxic)
        if i % 5:
            labels.append((i, int(not bad), int(toxic)))
    rows += [(9000, None), (9001, ""), (None, "the river walks"), (9002, LONG), rows[0]]
    labels += [labels[0], (9500, None, None), (None, 1, 1), (1, 0, 1), (1, 1, 0)]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth


@pytest.mark.parametrize(("score", "at", "threshold"), [(quality_scores, 0, 0.3), (toxicity_scores, 1, 0.5)])
def test_classifiers_on_held_out_rows(spark, score, at, threshold):
    rows, labels, truth = labelled(spark)
    got = score(documents(spark, rows), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= threshold)
    held = [(truth[r["doc_id"]][at], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 100 and sum(a == b for a, b in held) / len(held) > 0.95
    # held-out labels are never read
    lies = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    lies = lies.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = score(documents(spark, rows), lies).collect()
    assert {r["doc_id"]: round(r["score"], 9) for r in again} == {r["doc_id"]: round(r["score"], 9) for r in got}
    assert score(documents(spark, EMPTY), labels).count() == 0
    assert {r["score"] for r in score(documents(spark, rows[:5]), labels.limit(0)).collect()} == {0.5}


def test_toxic_documents_go(spark):
    rows, labels, truth = labelled(spark)
    df = documents(spark, rows)
    kept = drop_toxic(df, labels)
    assert kept.columns == df.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert sum(i in ids for i, t in truth.items() if t[1]) < 12 and sum(i not in ids for i, t in truth.items() if not t[1]) < 12
    assert drop_toxic(documents(spark, EMPTY), labels).count() == 0


# 6


def slow_substrings(rows, w):
    first, split = {}, [(i, (t or "").encode().split()) for i, t in rows]
    for i, x in split:
        for a in range(len(x) - w + 1) if i is not None else ():
            k = tuple(x[a : a + w])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, x in split:
        keep = [True] * len(x)
        for a in range(len(x) - w + 1) if i is not None else ():
            if first[tuple(x[a : a + w])] < i:
                keep[a : a + w] = [False] * w
        kept = b" ".join(v for v, z in zip(x, keep) if z)
        out.append((i, len(x), len(x) - sum(keep), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("hot", "bucket", "id_kind"), [(10_000, 1000, "long"), (5, 3, "long"), (10_000, 2, "long"), (10_000, 4, "string")])
def test_substrings(spark, hot, bucket, id_kind):
    rng = random.Random(1)
    passages = [[f"p{rng.randrange(40)}" for _ in range(rng.randrange(8, 60))] for _ in range(12)]
    rows = []
    for i in range(300):
        t = []
        for _ in range(rng.randrange(0, 8)):
            t += rng.choice(passages) if rng.random() < 0.6 else [f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 40))]
            t += ["x"] * 200 if rng.random() < 0.05 else []
        rows.append((i if rng.random() < 0.95 else None, rng.choice([" ", "\n", "  "]).join(t) if rng.random() < 0.95 else None))
    rows += rows[:20] + [(900, LONG), (901, LONG)]
    docs = documents(spark, rows)
    if id_kind == "string":
        docs, rows = docs.withColumn("doc_id", F.col("doc_id").cast("string")), [(None if i is None else str(i), t) for i, t in rows]
    got = substring_dedup(docs, window=12, mer=4, hot_least=hot, bucket=bucket)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256", "kept") == slow_substrings(rows, 12)


def test_substrings_by_default_and_of_nothing(spark):
    shared = " ".join(f"s{i}" for i in range(50))
    rows = [(1, "a " + shared), (2, shared + " b"), (3, shared.rsplit(" ", 1)[0])]
    assert rows_of(substring_dedup(documents(spark, rows)), "doc_id", "n_removed", "kept") == [(1, 0, "a " + shared), (2, 50, "b"), (3, 0, rows[2][1])]
    assert substring_dedup(documents(spark, EMPTY)).count() == 0


# 8


def test_packing_plan_is_best_fit_decreasing():
    rng = random.Random(8)
    for _ in range(40):
        capacity, counts = rng.choice([7, 16, 33]), Counter()
        for _ in range(rng.randrange(1, 60)):
            counts[rng.randrange(1, capacity + 1)] += rng.randrange(1, 4)
        bins = []
        for length in sorted(counts.elements(), reverse=True):
            fits = [b for b in bins if b >= length]
            if fits:
                bins.remove(min(fits))
            bins.append((min(fits) if fits else capacity) - length)
        lines, filled = plan(dict(counts), capacity), Counter()
        for at, (length, rank, each, first, _) in enumerate(lines):
            nxt = lines[at + 1][1] if at + 1 < len(lines) and lines[at + 1][0] == length else counts[length]
            for k in range(nxt - rank):
                filled[first + k // each] += length
        assert sorted(capacity - v for v in filled.values()) == sorted(bins)


@pytest.mark.parametrize("per_bucket", [500, 2])
def test_packing(spark, per_bucket):
    rows = [*corpus(4, 200), (7777, "日本語 and <|endoftext|>  two\n\nlines")]
    got = pack(documents(spark, rows), pieces_per_bucket=per_bucket).collect()
    full = tokenizer(*default_paths()).full
    want = Counter()
    for i, t, *_ in rows:
        ids = [*full.encode(t or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= math.ceil(sum(r["length"] for r in got) / 1024) * 1.05 + 1
    assert pack(documents(spark, EMPTY)).count() == 0


# 9


def test_lattice_sums_all_segmentations():
    p = Pieces(default_path())
    weight = np.log(p.first).tolist()

    def total(s):
        if not s:
            return 1.0
        out = sum(math.exp(weight[p.index[s[:k]]]) * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in p.index)
        if s[0] not in p.index:
            out += math.exp(sum(weight[p.index[bytes([b])]] for b in s[0].encode())) * total(s[1:])
        return out

    for word in ("the", "hello", "ñandú", "漢x☃"):
        assert abs(p.log_probability(word, weight) - math.log(total("▁" + word))) < 1e-9
        into = np.zeros(len(p.names))
        p.expected(word, weight, into)
        both = np.zeros(len(p.names))
        assert abs(p.batch([word, word], weight, both)[1] - p.log_probability(word, weight)) < 1e-9 and np.allclose(both, 2 * into, atol=1e-12)
        length = sum(into[i] * (len(p.names[i]) if isinstance(p.names[i], str) else 0) for i in range(len(into))) + into[-256:].sum()
        assert length >= len(word) + 1 - 1e-9


def test_lattices_by_batch_equal_single_ones():
    p, rng = Pieces(default_path()), random.Random(2)
    weight = np.log(p.first).tolist()
    words = ["".join(rng.choice("theandoé漢☃x😀") for _ in range(rng.randrange(1, 90))) for _ in range(300)] + ["a", "the", "the"]
    one, many = np.zeros(len(p.names)), np.zeros(len(p.names))
    for w in words:
        p.expected(w, weight, one)
    assert np.allclose(p.batch(words, weight, many), [p.log_probability(w, weight) for w in words], rtol=1e-12)
    assert np.allclose(one, many, atol=1e-9)


@pytest.mark.parametrize(("common", "size"), [(300_000, 1 << 20), (5, 1 << 20), (300_000, 12)])
def test_lattice_scores(spark, common, size):
    rows = [*corpus(5, 120), (700, "x" * 40_000 + " tail", "a"), (701, "字" * 3000, "a")]
    got = lattice_scores(documents(spark, rows), broadcast_words=common, broadcast_bytes=size).collect()
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t, _ in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 4)) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    # the score: power, shift and the bytes' share fitted once, then all segmentations of each token, one by one
    p = Pieces(default_path())
    weight, types = p.first, [(w.decode(), k) for w, k in c.items() if w]
    expected = np.zeros(len(p.names))
    for w, k in types:
        p.expected(w, np.log(weight).tolist(), expected, k)
    weight = p.fitted(expected)
    end, seen = (c[b""] + 0.5) / (n + 1), {}

    def slow(w):
        if len(w) > 50:  # the product would underflow
            return p.log_probability(w, np.log(weight).tolist()) / math.log(10) + math.log10(1 - end)
        if w not in seen:
            text, total = "▁" + w, [1.0]
            for j in range(1, len(text) + 1):
                arcs = [total[i] * weight[p.index[text[i:j]]] for i in range(j) if text[i:j] in p.index]
                if text[j - 1] not in p.index:
                    arcs.append(total[j - 1] * math.prod(weight[p.index[bytes([b])]] for b in text[j - 1].encode()))
                total.append(sum(arcs))
            seen[w] = math.log10(total[-1]) + math.log10(1 - end)
        return seen[w]

    texts = defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append(round(math.log10(end) + sum(slow(w.decode()) for w in tokens(t)[:-1]), 4))
    assert sorted((str(r["doc_id"]), round(r["score"], 4)) for r in got) == sorted((str(i), s) for i, x in texts.items() for s in x)
    assert all(-1e7 < r["mixture_score"] < 0 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[121] == by[122] == by[120]  # no words: the end token alone
    assert lattice_scores(documents(spark, EMPTY)).count() == 0


def test_lattice_prefers_the_language_it_learnt(spark):
    rng = random.Random(3)
    syllables = ["mar", "ten", "sol", "vi", "ka", "ron"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 5)))
    rows = [(i, " ".join(word() for _ in range(60))) for i in range(200)]
    odd = "".join(rng.sample("qzxjwpyghbdf", 12))
    rows += [(1000 + i, " ".join("".join(rng.sample(odd, 8)) for _ in range(60))) for i in range(7)]
    got = lattice_scores(documents(spark, rows)).filter("held_out").collect()
    per = lambda keep: [r["score"] / r["n_tokens"] for r in got if keep(r["doc_id"])]
    assert min(per(lambda i: i < 1000)) > max(per(lambda i: i >= 1000), default=-1e9)


def test_held_out_words_that_training_has_cost_little_more_than_its_counts_say(spark):
    """Under a law of ranks alone, held-out words cost twice what the base says and more."""
    rng = random.Random(4)
    # rare pieces of the vocabulary, common here
    words = [x[1:].lower() for x in Pieces(default_path()).names[20_000:20_400] if isinstance(x, str) and x.startswith("▁") and x[1:].isascii() and len(x) > 4]
    rows = [(i, " ".join(rng.choice(words) for _ in range(80))) for i in range(300)]
    got = lattice_scores(documents(spark, rows)).filter("held_out").collect()
    assert got and all(math.isfinite(r["score"]) and r["score"] > 1.6 * r["base_score"] for r in got)


# 10


def slow_neighbours(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v):
            good[i] = np.array(v, np.float32).astype(float)
    out = []
    for q in sorted(i for i in good if i % 100 == 0):
        near = sorted((float(np.sqrt(((good[q] - x) ** 2).sum())), i) for i, x in good.items() if i != q and len(x) == len(good[q]))
        out += [(q, r + 1, i) for r, (_, i) in enumerate(near[:k])]
    return out


@pytest.mark.parametrize(("queries", "candidates"), [(16_384, 65_536), (3, 200)])
def test_neighbours(spark, queries, candidates):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=24).round(1 if i % 2 else 3).tolist()) for i in range(1500)]
    hot = rows[100][1]
    rows = [(i, hot if i % 3 == 0 else v) for i, v in rows]
    rows += [(2000, None), (2100, [0.0] * 24), (2200, [float("nan")] + [1.0] * 23), (2300, [None] + [1.0] * 23), (2400, [1.0] * 5), (2401, [2.0] * 5), (2500, []), (None, hot), (2600, [1e-3] * 24), (2700, [1e30] * 24), rows[100], rows[101]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("q", F.lit(1)).repartition(5)
    got = neighbours.nearest(df, query_block=queries, candidate_block=candidates)
    assert rows_of(got, "query_id", "rank", "vec_id") == sorted(slow_neighbours(rows, 10), key=repr)
    v = dict(rows[:1500])
    for r in got.collect():
        if r["query_id"] < 1500 and r["vec_id"] < 1500:
            a, b = (np.array(v[r[c]], np.float32).astype(float) for c in ("query_id", "vec_id"))
            assert abs(r["score"] - np.sqrt(((a - b) ** 2).sum())) < 1e-12
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_neighbours_of_an_id_with_two_vectors(spark):
    rows = [(100, [5.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [9.0, 9.0]), (2, [1.0, 3.0]), (1, [1.0, 1.0])]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(4)
        assert rows_of(neighbours.nearest(df), "query_id", "rank", "vec_id", "score") == [(100, 1, 1, 1.0), (100, 2, 2, 3.0)]


@pytest.mark.parametrize("queries,candidates", [(16_384, 65_536), (2, 40)])
def test_neighbours_of_repeated_rows(spark, queries, candidates):
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    table = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<float>")
    columns = ("query_id", "rank", "vec_id", "score")
    want = rows_of(neighbours.nearest(table(rows)), *columns)
    assert len(want) == 30
    for many in (rows * 2, rows * 3, rows + [rows[7]] * 50 + [rows[100]] * 20):
        assert rows_of(neighbours.nearest(table(many), query_block=queries, candidate_block=candidates), *columns) == want
    # one id with fifty vectors, all nearer than the other ids
    near = rows + [(5, [x + 0.001 * k for x in rows[0][1]]) for k in range(1, 51)]
    got = neighbours.nearest(table(near), query_block=queries, candidate_block=candidates)
    assert rows_of(got, *columns[:3]) == sorted(slow_neighbours([(i, tuple(v)) for i, v in near], 10), key=repr)


def test_substrings_with_an_empty_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [("", text), ("b", text), (None, text), ("", "x " + text)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(2)
    assert sum(r["n_removed"] for r in substring_dedup(df).collect()) > 0
