"""Statistics that the engine needs, on numpy arrays."""

from __future__ import annotations

import numpy as np

_LOG_FACTORIAL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 4097)))])


def log_factorial(n: np.ndarray) -> np.ndarray:
    """Exact sums for small n, Stirling's series beyond."""
    n = np.asarray(n, float)
    small = np.minimum(n, 4096).astype(int)
    m = np.maximum(n, 1) + 1
    series = (m - 0.5) * np.log(m) - m + 0.5 * np.log(2 * np.pi) + 1 / (12 * m) - 1 / (360 * m**3)
    return np.where(n <= 4096, _LOG_FACTORIAL[small], series)


def fisher_one_sided(a: int, b: int, c: int, d: int) -> float:
    """Tail probability of the table [[a, b], [c, d]]; 1.1 where a/c is below b/d; the lesser of the two tails."""
    a, b, c, d = (int(x) for x in (a, b, c, d))
    if a * d < b * c:
        return 1.1
    n, row, col = a + b + c + d, a + b, a + c
    lo, hi = max(0, row + col - n), min(row, col)
    k = np.arange(lo, hi + 1)
    f = log_factorial
    logp = f(row) + f(n - row) + f(col) + f(n - col) - f(n) - f(k) - f(row - k) - f(col - k) - f(n - row - col + k)
    p = np.exp(logp)
    return float(min(1.0, p[k >= a].sum(), p[k <= a].sum()))


def poisson_tail(n: np.ndarray, mean: np.ndarray, u: np.ndarray) -> np.ndarray:
    """P(X > n) + u P(X = n) for X ~ Poisson(mean), by summing the shorter side in log space."""
    out = np.empty(len(n))
    for i, (k, m, w) in enumerate(zip(n, mean, u)):
        if not m > 0:
            out[i] = w if k == 0 else 0.0
            continue
        k = int(k)
        at = np.exp(-m + k * np.log(m) - log_factorial(k))
        if k >= m:
            j = np.arange(k + 1, k + 2 + int(20 * np.sqrt(m + k + 1)) + 50)
            above = np.exp(-m + j * np.log(m) - log_factorial(j)).sum()
        else:
            j = np.arange(0, k + 1)
            above = 1 - np.exp(-m + j * np.log(m) - log_factorial(j)).sum()
        out[i] = min(1.0, max(0.0, above + w * at))
    return out


def lowess(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, span: float = 2 / 3, rounds: int = 3) -> np.ndarray:
    """Locally weighted linear fits with tricube weights and bisquare rounds; x sorted."""
    n = len(x)
    if n < 3:
        return np.asarray(y, float).copy()
    weight = np.ones(n) if weight is None else np.asarray(weight, float)
    k = min(n, max(2, int(np.ceil(span * n))))
    gap = np.abs(x[:, None] - x[None, :])
    reach = np.maximum(np.partition(gap, k - 1, axis=1)[:, k - 1], 1e-12)
    near = np.clip(1 - (gap / reach[:, None]) ** 3, 0, 1) ** 3 * weight
    robust, fit = np.ones(n), np.zeros(n)
    for _ in range(rounds + 1):
        w = near * robust
        s0, sx, sy = w.sum(1), w @ x, w @ y
        sxx, sxy = w @ (x * x), w @ (x * y)
        det = s0 * sxx - sx * sx
        flat = sy / np.maximum(s0, 1e-300)
        slope = np.where(det > 1e-12 * np.maximum(s0 * sxx, 1e-300), (s0 * sxy - sx * sy) / np.where(det == 0, 1, det), 0.0)
        fit = flat + slope * (x - sx / np.maximum(s0, 1e-300))
        off = y - fit
        scale = 6 * np.median(np.abs(off))
        if scale <= 0:
            break
        robust = np.clip(1 - (off / scale) ** 2, 0, 1) ** 2
    return fit


def benjamini_hochberg(p: np.ndarray) -> np.ndarray:
    order = np.argsort(p)[::-1]
    n = len(p)
    out = np.empty(n)
    out[order] = np.minimum(1, np.minimum.accumulate(p[order] * n / np.arange(n, 0, -1)))
    return out


def good_turing(counts: np.ndarray) -> np.ndarray:
    """Simple Good-Turing proportions of species with these counts (0 included); shares of the unseen mass for zeros."""
    counts = np.asarray(counts, np.int64)
    total, zeros = counts.sum(), int((counts == 0).sum())
    r, n = np.unique(counts[counts > 0], return_counts=True)
    if len(r) < 5 or total == 0:
        return counts / max(total, 1)
    p0 = n[0] / total if r[0] == 1 else 0.0
    before, after = np.r_[0, r[:-1]], np.r_[r[1:], 2 * r[-1] - (r[-2] if len(r) > 1 else 0)]
    z = n / (0.5 * (after - before))
    slope, cut = np.polyfit(np.log(r), np.log(z), 1)
    smooth = lambda k: np.exp(cut + slope * np.log(k))
    by_fit = (r + 1) * smooth(r + 1) / smooth(r)
    star, use_fit = by_fit.copy(), False
    at = dict(zip(r.tolist(), n.tolist()))
    for i, k in enumerate(r.tolist()):
        if use_fit or k + 1 not in at:
            use_fit = True
            continue
        turing = (k + 1) * at[k + 1] / at[k]
        sd = np.sqrt((k + 1) ** 2 * at[k + 1] / at[k] ** 2 * (1 + at[k + 1] / at[k]))
        if abs(by_fit[i] - turing) <= 1.65 * sd:
            use_fit = True
        else:
            star[i] = turing
    mass = (star * n).sum()
    share = dict(zip(r.tolist(), ((1 - p0) * star / mass).tolist()))
    return np.array([share[c] if c else p0 / zeros for c in counts.tolist()])
