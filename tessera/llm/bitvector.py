"""Bit-parallel edit distance (Myers' column step on Python's long integers)."""

from __future__ import annotations

from collections.abc import Sequence


def match_masks(pattern: Sequence) -> dict:
    """symbol -> the positions of ``pattern`` that hold it, as bits."""
    masks: dict = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def best_occurrence(masks: dict, m: int, text: Sequence) -> tuple[int, int]:
    """(distance, end) of the place in ``text`` nearest to the pattern (m symbols): the
    smallest edit distance to any stretch of the text, and the first end that has it."""
    full, last = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, end = full, 0, m, m, 0
    get = masks.get
    for j, c in enumerate(text, 1):
        x = get(c, 0)
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp = vn | (full & ~(d0 | vp))
        hn = d0 & vp
        if hp & last:
            score += 1
        elif hn & last:
            score -= 1
            if score < best:
                best, end = score, j
        hp = hp << 1 & full
        hn = hn << 1 & full
        vp = hn | (full & ~(d0 | hp))
        vn = d0 & hp
    return best, end


def banded_distance(a: Sequence, b: Sequence, k: int) -> int:
    """Edit distance of the whole sequences where it is at most ``k``, else a number above ``k``.

    Only the 2k+1 diagonals around the main one are computed: bit t of column j is
    row j-k+t, so the band moves one row a column.
    """
    m, n = len(a), len(b)
    if abs(m - n) > k:
        return k + 1
    width = 2 * k + 1
    full, final = (1 << width) - 1, 1 << (m - n + k)
    masks = match_masks(a)
    get = masks.get
    vp, vn, score = full >> k << k, 0, max(m - n, 0)
    for j in range(1, n + 1):
        x = get(b[j - 1], 0)
        if x:
            s = j - k - 1
            x = (x >> s if s >= 0 else x << -s) & full
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp = vn | (full & ~(d0 | vp))
        hn = d0 & vp
        if not d0 & final:
            score += 1
            if score > k + abs(m - n):
                return k + 1
        d0 >>= 1
        vp = hn | (full & ~(d0 | hp))
        vn = d0 & hp
    return score
