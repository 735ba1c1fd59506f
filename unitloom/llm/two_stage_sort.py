"""Two-stage suffix sorting of many short texts, and common prefixes of neighbours."""

from __future__ import annotations

import numpy as np

#: Symbols packed in one sort key: 9 bits each.
_PACK = 7


def joined(rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts (bytes, one a row, `length` of them real) as one sequence of symbols: byte + 1, and 0 after each text. Also each text's start."""
    size = lengths + 1
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.int16)
    row = np.repeat(np.arange(len(rows)), lengths)
    col = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[start[row] + col] = rows[row, col].astype(np.int16) + 1
    return out, start


def smaller_than_successor(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that begins a symbol later; in a run of one symbol all are like the run's end."""
    n = len(t)
    step = np.sign(np.r_[t[1:].astype(np.int32), 1 << 20] - t)  # the end counts as a separator's own end
    where = np.where(step != 0, np.arange(n), n)
    nxt = np.minimum.accumulate(where[::-1])[::-1]
    return step[nxt] > 0


def _keys(t: np.ndarray) -> np.ndarray:
    """For each position its next _PACK symbols in one number; what follows a separator counts as nothing."""
    pad = np.r_[t, np.zeros(_PACK, t.dtype)].astype(np.uint64)
    n = len(t)
    key, open_ = np.zeros(n, np.uint64), np.ones(n, bool)
    for i in range(_PACK):
        s = pad[i : i + n]
        key = (key << np.uint64(9)) | np.where(open_, s, np.uint64(0))
        open_ &= s > 0
    return key


def direct_sort(t: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The chosen positions by their suffixes up to the separator; those alike up to there stay by position."""
    keys = _keys(t)
    n = len(t)
    order = chosen[np.argsort(keys[chosen], kind="stable")]
    k = keys[order]
    group = np.cumsum(np.r_[0, k[1:] != k[:-1]]) if len(order) else np.zeros(0, np.int64)
    ended = (k & np.uint64(511)) == 0  # a separator lies within the key
    depth = _PACK
    while True:
        same = np.r_[group[1:] == group[:-1], False] if len(group) else np.zeros(0, bool)
        tied = np.flatnonzero((same | np.r_[False, same[:-1]]) & ~ended) if len(group) else np.zeros(0, np.int64)
        if not len(tied):
            return order
        pos = order[tied]
        k = keys[np.minimum(pos + depth, n - 1)]
        by = np.lexsort((k, group[tied]))
        pos, k, g = pos[by], k[by], group[tied]
        order[tied] = pos
        ended[tied] = (k & np.uint64(511)) == 0
        # groups split where keys differ; numbers only have to be distinct and ascending
        fresh = np.zeros(len(group), np.int64)
        fresh[tied[1:]] = (k[1:] != k[:-1]) & (g[1:] == g[:-1])
        group = group + np.cumsum(fresh)
        depth += _PACK


def suffix_array(t: np.ndarray) -> np.ndarray:
    """All suffixes in order (separators before all bytes, among themselves by position).

    First stage: suffixes smaller than their successors are sorted directly and lie at the
    ends of their first symbols' buckets. Second stage: buckets are scanned in order, and each suffix met
    puts its predecessor, if that is larger than its successor, at the front of the predecessor's bucket.
    """
    n = len(t)
    small = smaller_than_successor(t)
    out = np.full(n, -1, np.int64)
    count = np.bincount(t, minlength=258)
    end = np.cumsum(count)
    front = end - count
    by = direct_sort(t, np.flatnonzero(small))
    sym = t[by]
    n_small = np.bincount(sym, minlength=258)
    place = (end - n_small)[sym] + np.arange(len(by)) - (np.cumsum(n_small) - n_small)[sym]
    out[place] = by
    put = front.copy()

    def induce(met: np.ndarray) -> None:
        before = met - 1
        before = before[before >= 0]
        before = before[~small[before]]
        if len(before):
            s = t[before]
            o = np.argsort(s, kind="stable")
            before, s = before[o], s[o]
            c = np.bincount(s, minlength=258)
            out[put[s] + np.arange(len(s)) - (np.cumsum(c) - c)[s]] = before
            put[:] += c

    for c in np.flatnonzero(count):
        done = front[c]
        while done < put[c]:  # those put into this very bucket come next
            upto = put[c]
            induce(out[done:upto])
            done = upto
        induce(out[end[c] - n_small[c] : end[c]])
    return out


def neighbours_prefix(t: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each suffix in order with the one before it, counted up to `most`; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    n = len(t)
    for d in range(most):
        a, b = order[live] + d, order[live - 1] + d
        ok = (a < n) & (b < n)
        ok[ok] = (t[a[ok]] == t[b[ok]]) & (t[a[ok]] > 0)
        live = live[ok]
        if not len(live):
            break
        out[live] = d + 1
    return out
