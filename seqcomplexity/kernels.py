"""Sequence kernels without Spark: one string at a time, and bit-parallel over a batch of short strings."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

#: Strings of up to so many symbols, over up to so many different ones, are parsed bit-parallel.
BATCH_LENGTH, BATCH_ALPHABET = 256, 64


def lz76_starts(s: Sequence) -> list[int]:
    """Start of every phrase of the LZ76 parsing.

    A word stays open while it occurs from an earlier start (overlap allowed). The first occurrence never moves left as the
    word grows, so each search resumes at the last hit, and a hit is extended symbol by symbol without a search."""
    starts, n, i = [], len(s), 0
    find = s.find
    while i < n:
        starts.append(i)
        end, at = i + 1, 0
        while end <= n:
            at = find(s[i:end], at, end - 1)
            if at < 0:
                break
            end += 1
            while end <= n and s[at + end - 1 - i] == s[end - 1]:
                end += 1
        i = end
    return starts


def lz76_count(s: str) -> int:
    return len(lz76_starts(s))


def lz76_phrases(s: str) -> list[str]:
    starts = lz76_starts(s)
    return [s[a:b] for a, b in zip(starts, [*starts[1:], len(s)])]


def lz78_phrases(s: str) -> list[str]:
    """Phrases of the LZ78 parsing; a repeated word left open at the end counts too."""
    known, out, start = set(), [], 0
    for end in range(1, len(s) + 1):
        word = s[start:end]
        if word not in known:
            known.add(word)
            out.append(word)
            start = end
    if start < len(s):
        out.append(s[start:])
    return out


def lz78_count(s: str) -> int:
    """The number of LZ78 phrases, by a trie of (node, symbol) edges: constant work a symbol."""
    edges: dict[tuple[int, str], int] = {}
    node = count = 0
    for c in s:
        following = edges.get((node, c))
        if following is None:
            count += 1
            edges[node, c] = count
            node = 0
        else:
            node = following
    return count + (node != 0)


def block_entropy(s: str, k: int) -> float:
    """Shannon entropy in bits of the overlapping windows of length ``k``; 0 if there are none."""
    n = len(s) - k + 1
    if k <= 0 or n <= 0:
        return 0.0
    codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    ranks = np.unique(codes, return_inverse=True)[1]
    span, windows = int(ranks.max()) + 1, ranks
    for i in range(1, k):
        windows = np.unique(windows[:-1] * span + ranks[i:], return_inverse=True)[1]
    counts = np.bincount(windows)
    counts = counts[counts > 0]
    return float(math.log2(n) - (counts * np.log2(counts)).sum() / n) + 0.0


def _bits_lz76(codes: np.ndarray, lengths: np.ndarray, alphabet: int) -> np.ndarray:
    """LZ76 phrase counts of rows of ``codes``, by bit sets.

    For every row, ``seen[c]`` has bit p if symbol p, so far, is c, and ``ends`` the positions at which the open word has ended
    before. A symbol moves these ends by one and keeps those where it stands; when none is left, the word is a phrase."""
    rows, longest = codes.shape
    words = (longest + 63) // 64
    seen = np.zeros((words, alphabet * rows), np.uint64)
    ends = np.full((words, rows), np.uint64(0xFFFFFFFFFFFFFFFF))
    fresh, count = np.ones(rows, bool), np.zeros(rows, np.int64)
    spots = np.ascontiguousarray((codes * rows + np.arange(rows)[:, None]).T)
    one, top, shortest = np.uint64(1), np.uint64(63), int(lengths.min()) if rows else 0
    for j in range(longest):
        spot = spots[j]
        now = j // 64
        carry, hit = fresh.astype(np.uint64), None
        for w in range(now + 1):
            own = ends[w]
            moved = own << one
            moved |= carry
            if w < now:
                carry = own >> top
            moved &= seen[w][spot]
            ends[w] = moved
            hit = moved if hit is None else hit | moved
        seen[now][spot] |= one << np.uint64(j & 63)
        fresh = hit == 0
        if j >= shortest:
            live = j < lengths
            count += fresh & live
            last = lengths == j + 1
            count += last & ~fresh
        else:
            count += fresh
            if j + 1 == shortest:
                count += (lengths == shortest) & ~fresh
        for w in range(now + 1 + (j & 63 == 63 and now + 1 < words)):
            ends[w][fresh] = np.uint64(0xFFFFFFFFFFFFFFFF)
    return count


def lz76_counts(strings: list[str | None]) -> np.ndarray:
    """LZ76 phrase counts of a batch (0 for null), short strings bit-parallel by length."""
    out = np.zeros(len(strings), np.int64)
    lengths = np.array([len(s) if s is not None else 0 for s in strings], np.int64)
    for i in np.flatnonzero(lengths > BATCH_LENGTH).tolist():
        out[i] = lz76_count(strings[i])
    for low in range(0, BATCH_LENGTH, 64):
        rows = np.flatnonzero((lengths > low) & (lengths <= low + 64))
        for at in range(0, len(rows), 2048):
            part = rows[at:at + 2048]
            if len(part) < 16:
                out[part] = [lz76_count(strings[i]) for i in part.tolist()]
                continue
            size = lengths[part]
            flat = np.frombuffer("".join([strings[i] for i in part.tolist()]).encode("utf-32-le", "surrogatepass"), "<u4")
            symbols, codes = np.unique(flat, return_inverse=True)
            if len(symbols) > BATCH_ALPHABET:
                out[part] = [lz76_count(strings[i]) for i in part.tolist()]
                continue
            table = np.zeros((len(part), int(size.max())), np.int64)
            table[np.arange(table.shape[1]) < size[:, None]] = codes
            out[part] = _bits_lz76(table, size, len(symbols))
    return out


def lz76_counts_of_bits(index: np.ndarray, length: int) -> np.ndarray:
    """LZ76 phrase counts of the binary strings of ``length`` (up to 63) whose big-endian values are ``index``."""
    out = np.zeros(len(index), np.int64)
    for at in range(0, len(index), 2048):
        part = index[at:at + 2048].astype(np.int64)
        codes = (part[:, None] >> np.arange(length - 1, -1, -1)) & 1
        out[at:at + 2048] = _bits_lz76(codes, np.full(len(part), length), 2)
    return out
