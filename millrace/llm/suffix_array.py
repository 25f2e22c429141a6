"""The suffix array of one shard by induced sorting, and its permuted common prefixes, in numpy.

Suffixes are classified as smaller or larger than their right neighbour; the leftmost smaller ones (LMS) are sorted
by their substrings with two induction passes, named, and sorted as suffixes of the string of names (by naming pairs
of names until all differ or `depth` bytes are covered); two more passes induce the array. A pass takes the buckets
of first bytes in order and moves each bucket's predecessors at once, so it is linear.
"""

from __future__ import annotations

import numpy as np


def _classify(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour; the end is smaller than any byte."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1
    at = np.where(step != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return step[at] > 0


def _spread(before: np.ndarray, bytes_before: np.ndarray, sa: np.ndarray, at: np.ndarray, down: bool) -> None:
    """Puts suffixes, in this order, at the next free places of their buckets."""
    order = np.argsort(bytes_before, kind="stable")
    b = bytes_before[order].astype(np.int64)
    many = np.bincount(b, minlength=257)
    rank = np.arange(len(b)) - (np.cumsum(many) - many)[b]
    sa[at[b] - rank if down else at[b] + rank] = before[order]
    at += -many if down else many


def _induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All suffixes' order from the order of the LMS ones (`seeds`)."""
    n = len(text)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    sa = np.full(n, -1, np.int32)
    seed_bytes = text[seeds]
    seed_sizes = np.bincount(seed_bytes, minlength=256)
    seed_starts = np.cumsum(seed_sizes) - seed_sizes
    at = np.append(starts, 0)
    # Larger ones, from small buckets to large. The last suffix comes first: what follows it, the end, is the smallest.
    sa[at[text[-1]]] = n - 1
    at[text[-1]] += 1
    held = np.flatnonzero(sizes)
    for c in held:
        low = starts[c]
        wave = sa[low : at[c]]
        while len(wave):
            wave = wave[wave > 0] - 1
            wave = wave[text[wave] == c]
            sa[at[c] : at[c] + len(wave)] = wave
            at[c] += len(wave)
        here = np.concatenate([sa[low : at[c]], seeds[seed_starts[c] : seed_starts[c] + seed_sizes[c]]])
        before = here[here > 0] - 1
        b = text[before]
        go = b > c
        _spread(before[go], b[go], sa, at, False)
    tops = at[:256].copy()
    # Smaller ones, from large buckets to small, each from its end.
    at = np.append(ends - 1, 0)
    for c in held[::-1]:
        high = ends[c]
        fresh, wave = at[c] + 1, sa[at[c] + 1 : high][::-1]
        while len(wave):
            wave = wave[wave > 0] - 1
            wave = wave[text[wave] == c]
            fresh = at[c] + 1 - len(wave)
            sa[fresh : at[c] + 1] = wave[::-1]
            at[c] -= len(wave)
        here = np.concatenate([sa[at[c] + 1 : high][::-1], sa[starts[c] : tops[c]][::-1]])
        before = here[here > 0] - 1
        b = text[before]
        go = b < c
        _spread(before[go], b[go], sa, at, True)
    return sa


def _packed(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number, the first byte highest; zeros past the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    n, out = len(text), np.zeros(len(text), np.uint64)
    for i in range(8):
        out |= padded[i : i + n] << np.uint64(56 - 8 * i)
    return out


def _common(packed: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at a and at b share from their start."""
    n = len(packed)
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    a, b = a.astype(np.int64), b.astype(np.int64)
    while len(live):
        bits = packed[a] ^ packed[b]
        same = bits == 0
        # Leading equal bytes of a word: from the float exponent of what differs.
        zeros = np.where(same, 8, (63 - np.minimum(63, np.frexp(np.maximum(bits, 1).astype(np.float64))[1] - 1)) // 8)
        # astype(float64) may round up to the next power of two, but only within the low 11 bits of a run of ones.
        fix = ~same & ((bits >> (np.uint64(56) - (8 * np.minimum(zeros, 7)).astype(np.uint64))) == 0)
        zeros = zeros + fix
        zeros = np.minimum(zeros, n - np.maximum(a, b))
        out[live] += zeros
        a, b = a + 8, b + 8
        go = same & (np.maximum(a, b) < n)
        live, a, b = live[go], a[go], b[go]
    return out


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first `depth` bytes at least; a suffix that ends is smaller."""
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    smaller = _classify(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + 1
    sizes = np.bincount(text, minlength=256)
    if len(lms) > 1:
        lms = lms[_lms_order(text, smaller, lms, sizes, depth)]
    return _induce(text, smaller, lms, sizes)


def _lms_order(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sizes: np.ndarray, depth: int) -> np.ndarray:
    """Which of the LMS suffixes comes first, second, and so on."""
    n, m = len(text), len(lms)
    place = np.full(n, -1, np.int32)
    place[lms] = np.arange(m)
    # By bucket is enough to start; two passes sort the substrings.
    sa = _induce(text, smaller, lms[np.argsort(text[lms], kind="stable")], sizes)
    order = place[sa]
    order = order[order >= 0]
    length = np.append(np.diff(lms), 0) + 1  # with the next LMS suffix's first byte
    length[-1] = n - lms[-1] + 1  # the last one holds the end and is like no other
    a, b = order[:-1], order[1:]
    alike = (length[a] == length[b]) & (a != m - 1) & (b != m - 1)
    at = np.flatnonzero(alike)
    alike[at] = _common(_packed(text), lms[a[at]], lms[b[at]]) >= length[a[at]]
    # A name is the number of suffixes that are surely smaller, so tied ones can be told apart without the others.
    name = np.empty(m, np.int64)
    name[order] = _heads(np.append(True, ~alike))
    tied = order[_tied(np.append(True, ~alike))]
    covered, width = int(length[:-1].min()) - 1, 1
    while len(tied) and covered * width < depth:
        after = tied + width
        key = name[tied] * (m + 1)
        inside = after < m
        key[inside] += name[after[inside]] + 1  # past the end counts as least
        by = np.argsort(key)
        tied, key = tied[by], key[by]
        new_group = np.append(True, key[1:] != key[:-1])
        old = name[tied]
        base = _heads(np.append(True, old[1:] != old[:-1]))
        name[tied] = old + _heads(new_group) - base
        tied = tied[_tied(new_group)]
        width *= 2
    return np.argsort(name, kind="stable")


def _heads(first: np.ndarray) -> np.ndarray:
    """For each place the last one, up to it, that is first in its group."""
    return np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))


def _tied(first: np.ndarray) -> np.ndarray:
    """Whether a group has more than this one place."""
    return ~(first & np.append(first[1:], True))


def common_with_previous(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Bytes that each suffix in sa shares with the one before it in sa (0 for the first); sa may hold a part of all.

    By place in the text, a pair that is its left neighbour's pair moved by one shares one byte less, so only the
    heads of such runs are compared.
    """
    if not len(sa):
        return np.zeros(0, np.int64)
    n = len(text)
    phi = np.full(n, -2, np.int64)
    phi[sa[1:]] = sa[:-1]
    place = np.flatnonzero(phi >= 0)
    j = phi[place]
    moved = np.zeros(len(place), bool)
    moved[1:] = (place[1:] == place[:-1] + 1) & (j[1:] == j[:-1] + 1) & (text[place[1:] - 1] == text[j[1:] - 1])
    head = np.flatnonzero(~moved)
    shared = np.zeros(len(place), np.int64)
    shared[head] = _common(_packed(text), place[head], j[head])
    of = head[np.cumsum(~moved) - 1] if len(place) else head
    shared = np.maximum(shared[of] - (np.arange(len(place)) - of), 0)
    out = np.zeros(n, np.int64)
    out[place] = shared
    return out[sa]
