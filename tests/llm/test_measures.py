from __future__ import annotations

import random
import statistics

import numpy as np
import zstandard

from readloom.llm import quality as Q
from readloom.llm import toxicity as T


def _size(data, dictionary):
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=Q.LEVEL)
    return len(zstandard.ZstdCompressor(level=Q.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data))


def _dictionaries():
    rng = random.Random(1)
    good = [" ".join(rng.choice(["river", "moon", "walks", "sings"]) for _ in range(200)).encode() for _ in range(200)]
    bad = [" ".join(rng.choice(["###", "&&&", "$$$", "zz"]) for _ in range(200)).encode() for _ in range(200)]
    return Q.train(good, 4096), Q.train(bad, 4096)


def test_measures_by_hand():
    both, texts = _dictionaries(), [b"", b"river", b"river moon walks ### " * 40, bytes(range(256)) * 5]
    got = Q.measures(texts, both)
    for text, row in zip(texts, got):
        want = []
        for chunk in Q.CHUNKS:
            parts = [text[a : a + chunk] for a in range(0, len(text), chunk)] or [b""]
            sizes = [(_size(p, both[0]), _size(p, both[1])) for p in parts]
            each = [(g - b) / max(g, b) for g, b in sizes]
            mean = sum(each) / len(each)
            g, b = sum(s[0] for s in sizes), sum(s[1] for s in sizes)
            want += [(g - b) / max(g, b), mean, (sum((x - mean) ** 2 for x in each) / len(each)) ** 0.5, sum(map(abs, each)) / len(each), statistics.median(each), sum(x > 0 for x in each) / len(each), sum(x == 0 for x in each) / len(each)]
        assert np.allclose(row, want + [x * x for x in want])


def test_measures_are_of_differences_not_of_length_or_ratio():
    both = _dictionaries()
    assert np.allclose(Q.measures([b"river moon walks sings! " * 64], both)[0, :1], Q.measures([b"river moon walks sings! " * 6400], both)[0, :1], atol=1e-3)
    assert np.allclose(Q.measures([b"river ### moon " * 9], (both[0], both[0]))[0, [0, 1, 2, 3, 4, 5]], 0)


def test_calibration_is_the_likeliest():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.5, -1, 0.2])))).astype(int)
    weight = np.where(y == 1, 0.7, 1.4)
    m = Q.Calibration(x, y, weight)
    z = np.c_[(x - x.mean(0)) / (x.std(0) + 1e-9), np.ones(400)]
    loss = lambda w: -(weight * np.log(np.where(y == 1, 1 / (1 + np.exp(-z @ w)), 1 / (1 + np.exp(z @ w))))).sum() + 0.5e-2 * (w @ w)
    best = loss(m.w)
    assert all(loss(m.w + d) >= best for d in rng.normal(size=(200, 4)) * 0.01)
    assert np.allclose(m(x), 1 / (1 + np.exp(-z @ m.w)))


def test_toxicity_by_hand():
    def slow(text):
        s, out = f" {' '.join(text.lower().split())} ", set()
        for n in T.ORDERS:
            for a in range(len(s) - n + 1):
                h = ord(s[a])
                for c in s[a + 1 : a + n]:
                    h = (h * 0x9E3779B1 + ord(c)) & 0xFFFFFFFF
                m = (h ^ h >> 15) * (0x85EBCA77 + 2 * n) & 0xFFFFFFFF
                out.add((m ^ m >> 13) >> (32 - T.LOG2))
        return sorted(out)

    texts = ["", "a", "Some  Text\n with words", "é漢☃ mixed " * 9]
    assert all(T.present(t).tolist() == slow(t) for t in texts)
    zero, one = np.array([5, 0, 9]), np.array([1, 4, 0])
    ratio, z = T.log_count_ratios(zero, one, 20, 10)
    assert np.allclose(ratio, [np.log(2 / 12) - np.log(6 / 22), np.log(5 / 12) - np.log(1 / 22), np.log(1 / 12) - np.log(10 / 22)])
    a, b = one / 10, zero / 20
    assert np.allclose(z, np.abs(a - b) / np.sqrt((a * (1 - a) + 0.1) / 10 + (b * (1 - b) + 0.05) / 20))
    features = np.array(slow(texts[2])[:5] + slow(texts[3])[:5])
    features = np.unique(features)
    weights = np.linspace(-1, 2, len(features))
    model = T.ToxicityModel(features, weights, -0.3)
    for t in texts:
        total = -0.3 + sum(w for f, w in zip(features.tolist(), weights.tolist()) if f in slow(t))
        assert abs(model.score(t) - 1 / (1 + np.exp(-total))) < 1e-6
