"""Local alignment of whole batches of reads: the best stretch along a diagonal, gaps within a band, ends clipped.

Scores: a match MATCH, a mismatch MISMATCH, a gap OPEN and EXTEND a base, a clipped end CLIP.  So the last base may differ, two of
the last three may not, and a gap near an end needs a few matches behind it to pay.
"""

from __future__ import annotations

import numpy as np

MATCH, MISMATCH, OPEN, EXTEND, CLIP = 1, -4, -6, -1, -5
#: Where there is no reference base.
OUTSIDE = -1000


def same_or_converted(reads: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Whether bases match where a small c of the reference may read as T, a small g as A, as bisulfite turns them."""
    c = (refs == ord("c")) & ((reads == ord("C")) | (reads == ord("T")))
    g = (refs == ord("g")) & ((reads == ord("G")) | (reads == ord("A")))
    return (reads == refs) | c | g


def base_scores(reads: np.ndarray, refs: np.ndarray, same=np.equal) -> np.ndarray:
    """What each base adds; refs are 0 outside of the contig."""
    return np.where(refs == 0, OUTSIDE, np.where(same(reads, refs), MATCH, MISMATCH)).astype(np.int32)


def best_stretch(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row, begin, end and score of the stretch that scores most; either end that isn't the row's costs CLIP.

    The stretch from a to b scores the prefix sum at b less that at a, so the best a for each b is a running minimum.
    """
    m, n = scores.shape
    sums = np.concatenate([np.zeros((m, 1), np.int32), np.cumsum(scores, axis=1, dtype=np.int32)], axis=1)
    begin_cost = sums - CLIP
    begin_cost[:, 0] += CLIP
    least = np.minimum.accumulate(begin_cost[:, :-1], axis=1)
    total = sums[:, 1:] - least
    total[:, :-1] += CLIP
    rows = np.arange(m)
    end = n - 1 - total[:, ::-1].argmax(axis=1)
    score = total[rows, end]
    begin = (begin_cost[:, :-1] == least[rows, end][:, None]).argmax(axis=1)
    return begin, end + 1, score


def gapped(reads: np.ndarray, windows: np.ndarray, band: int, same=np.equal) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The best local alignment with gaps of each read: scores, places in the window of the first base, and operations in steps along
    the row, 0 match or mismatch, 1 insertion, 2 deletion, 3 clipped, -1 none.

    reads: codes, a row a read of n bases; windows: n + 2 * band codes a row.  Affine gaps; a step works on all reads and all
    2 * band + 1 diagonals at once.  Clips are free within the table; ``extended`` settles the ends.
    """
    m, n = reads.shape
    width, low = 2 * band + 1, -(10**6)
    M, X, Y = (np.full((m, width), low, np.int32) for _ in range(3))
    back = np.zeros((3, n + 1, m, width), np.int8)
    best, best_at, best_on = np.full(m, low), np.zeros(m, np.int64), np.zeros(m, np.int64)
    none = np.full((m, 1), low, np.int32)
    for i in range(1, n + 1):
        before, k = np.zeros((m, width), np.int32), np.full((m, width), 3, np.int8)  # begin here
        for state, other in ((0, M), (1, X), (2, Y)):
            k[other > before] = state
            before = np.maximum(before, other)
        opened, longer = np.c_[M[:, 1:], none] + (OPEN + EXTEND), np.c_[X[:, 1:], none] + EXTEND  # an insertion leaves a diagonal to the left
        X, back[1, i] = np.maximum(opened, longer), opened < longer
        M, back[0, i] = before + base_scores(reads[:, i - 1, None], windows[:, i - 1 : i - 1 + width], same), k
        Y = np.full((m, width), low, np.int32)
        for c in range(1, width):
            opened, longer = M[:, c - 1] + (OPEN + EXTEND), Y[:, c - 1] + EXTEND
            Y[:, c], back[2, i, :, c] = np.maximum(opened, longer), np.where(opened < longer, 2, 0)
        top = M.argmax(axis=1)
        value = M[np.arange(m), top]
        better = value >= best
        best, best_at, best_on = np.where(better, value, best), np.where(better, i, best_at), np.where(better, top, best_on)
    rows, left, diagonal, state = np.arange(m), best_at.copy(), best_on.copy(), np.zeros(m, np.int8)
    on, ops, place = best > 0, [], np.zeros(m, np.int64)
    begun = np.zeros(m, np.int64)
    while on.any():
        ops.append(np.where(on, state, -1))
        at = np.maximum(left, 1)
        came = back[state, at, rows, diagonal]
        ended = on & (state == 0) & (came == 3)
        place, begun = np.where(ended, at - 1 + diagonal, place), np.where(ended, at - 1, begun)
        left = left - (on & (state != 2))
        diagonal = np.where(on & (state == 1), diagonal + 1, np.where(on & (state == 2), diagonal - 1, diagonal))
        state = np.where(on & ~ended, came, state)
        on = on & ~ended
    path = np.array(ops, np.int8)[::-1].T if ops else np.zeros((m, 0), np.int8)
    clipped = lambda size: np.where(np.arange(size.max(initial=0))[None, :] < size[:, None], 3, -1).astype(np.int8)
    return best, place, np.concatenate([clipped(begun), path, clipped(n - best_at)], axis=1), begun


def extended(read: np.ndarray, window: np.ndarray, ops: np.ndarray, place: int, same=np.equal) -> tuple[np.ndarray, int, int]:
    """Gives each clipped end back where its bases, on the diagonal next to it, cost less than CLIP.  Operations, place, what it adds to the score."""
    gain, n = 0, len(read)
    for head in (True, False):
        along = ops if head else ops[::-1]
        k = int((along != 3).argmax())
        if not k:
            continue
        if head:
            lo = place - k
            ref = window[lo:place] if lo >= 0 else np.zeros(k, window.dtype)
            value = base_scores(read[:k], ref, same).sum()
        else:
            end = place + int(((ops == 0) | (ops == 2)).sum())
            ref = window[end : end + k]
            value = base_scores(read[n - k :], ref, same).sum() if len(ref) == k else OUTSIDE
        if value < CLIP:
            gain += CLIP
            continue
        ops = np.where(np.arange(len(ops)) < k, 0, ops) if head else np.where(np.arange(len(ops)) >= len(ops) - k, 0, ops)
        gain, place = gain + int(value), place - k if head else place
    return ops, place, gain


def cigar_of(ops: np.ndarray) -> str:
    """Operations as text."""
    cut = np.flatnonzero(np.r_[True, ops[1:] != ops[:-1]])
    return "".join(f"{k}{'MIDS'[c]}" for k, c in zip(np.diff(np.r_[cut, len(ops)]).tolist(), ops[cut].tolist()))


def align_locally(reads: np.ndarray, windows: np.ndarray, band: int, indel: int, most_wrong: int, least: int, same=np.equal) -> list[tuple[int, int, str, int, int]]:
    """row, place of the first aligned base in its window, CIGAR, mismatches and score of each read that fits.

    A read that lies on the window's middle diagonal as a whole isn't tried with gaps.  ``least`` aligned bases, at most ``most_wrong``
    mismatches and ``indel`` bases in gaps.  same: which bases of read and reference match.
    """
    m, n = reads.shape
    straight = windows[:, band : band + n]
    scores = base_scores(reads, straight, same)
    begin, end, score = best_stretch(scores)
    inside = (np.arange(n) >= begin[:, None]) & (np.arange(n) < end[:, None])
    wrong = ((scores != MATCH) & inside).sum(axis=1)
    whole = (begin == 0) & (end == n) & (wrong <= most_wrong)
    found = {}
    for r in np.flatnonzero((wrong <= most_wrong) & (end - begin >= least)).tolist():
        a, b = int(begin[r]), int(end[r])
        found[r] = (r, band + a, f"{a}S" * (a > 0) + f"{b - a}M" + f"{n - b}S" * (b < n), int(wrong[r]), int(score[r]))
    others = np.flatnonzero(~whole) if indel else np.zeros(0, np.int64)
    if len(others):
        _, place, ops, _ = gapped(reads[others], windows[others], band, same)
        for j, r in enumerate(others.tolist()):
            row = ops[j][ops[j] >= 0]
            gaps = (row == 1) | (row == 2)
            if not gaps.any() or gaps.sum() > indel:
                continue
            row, at, gain = extended(reads[r], windows[r], row, int(place[j]), same)
            on_read, on_ref = np.cumsum(row != 2) - (row != 2), at + np.cumsum((row == 0) | (row == 2)) - ((row == 0) | (row == 2))
            level = row == 0
            bad = int((~same(reads[r][on_read[level]], windows[r][on_ref[level]])).sum())
            aligned = int(level.sum())
            opened = int((gaps & ~np.r_[False, gaps[:-1]]).sum())
            ends = int((row[0] == 3)) + int(row[-1] == 3)
            value = MATCH * (aligned - bad) + MISMATCH * bad + OPEN * opened + EXTEND * int(gaps.sum()) + CLIP * ends
            if bad <= most_wrong and aligned >= least and (r not in found or value > found[r][4]):
                found[r] = (r, at, cigar_of(row), bad, value)
    return list(found.values())
