"""Counting quotient filters as byte strings.

A fingerprint of `bits` bits is cut into a quotient and a remainder. The remainders of
a quotient form a run, sorted, in consecutive slots at or after the quotient's own; one
bit per quotient says whether it has a run, one bit per slot whether a run ends there.
A remainder that was counted more than once is followed by slots, marked by a third
bit, that hold its count less one in digits as wide as a remainder. Nothing is lost:
fingerprints and counts are read back in order, so filters of any size merge by their
sorted remainders.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np

_HEAD = struct.Struct("<BBQQ")  # quotient bits, remainder bits, slots, entries
_LOAD = 0.95


def summed(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints in order, with the sum of their counts."""
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]])) if len(prints) else order
    return prints[first], (np.add.reduceat(counts, first) if len(prints) else counts)


def build(prints: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """The filter of distinct sorted fingerprints (below 2^bits, bits at most 63) and counts."""
    n = len(prints)
    q = min(bits - 1, max(1, int(np.ceil(np.log2(max(n, 1) / _LOAD + 1)))))
    r = bits - q
    quotient, rest = prints >> r, prints & ((1 << r) - 1)
    extra = np.zeros(n, dtype=np.int64)
    left = counts - 1
    while left.any():
        extra += left > 0
        left = left >> r
    before = np.concatenate([[0], np.cumsum(1 + extra)])
    first = np.flatnonzero(np.concatenate([[True], quotient[1:] != quotient[:-1]])) if n else extra
    offset = before[first]
    start = offset + np.maximum.accumulate(quotient[first] - offset) if n else first
    length = np.diff(np.concatenate([offset, before[-1:]])) if n else first
    run = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [n]]))) if n else first
    place = start[run] + before[:-1] - offset[run] if n else first
    slots = int(start[-1] + length[-1]) if n else 0

    value = np.zeros(slots, dtype=np.int64)
    value[place] = rest
    occupied, ends, digits = (np.zeros(size, dtype=bool) for size in (1 << q, slots, slots))
    occupied[quotient[first]] = True
    ends[start + length - 1] = True
    left, k = counts - 1, 1
    while (more := np.flatnonzero(left > 0)).size:
        value[place[more] + k] = left[more] & ((1 << r) - 1)
        digits[place[more] + k] = True
        left, k = left >> r, k + 1
    width = (r + 7) // 8
    packed = value.astype("<i8").view(np.uint8).reshape(slots, 8)[:, :width]
    return b"".join([_HEAD.pack(q, r, slots, n), np.packbits(occupied).tobytes(),
                     np.packbits(ends).tobytes(), np.packbits(digits).tobytes(), packed.tobytes()])


def entries(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All fingerprints of a filter in order, with their counts."""
    q, r, slots, n = _HEAD.unpack_from(data)
    at = _HEAD.size

    def bitmap(size: int) -> np.ndarray:
        nonlocal at
        taken = (size + 7) // 8
        found = np.unpackbits(np.frombuffer(data, np.uint8, taken, at), count=size)
        at += taken
        return found.astype(bool)

    quotient = np.flatnonzero(bitmap(1 << q))
    ends, digits = np.flatnonzero(bitmap(slots)), bitmap(slots)
    width = (r + 7) // 8
    value = np.zeros((slots, 8), dtype=np.uint8)
    value[:, :width] = np.frombuffer(data, np.uint8, slots * width, at).reshape(slots, width)
    value = value.view("<i8").ravel()
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    start = np.maximum(quotient, np.concatenate([[0], ends[:-1] + 1]))
    length = ends - start + 1
    used = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
    run = np.repeat(np.arange(len(start)), length)
    more = digits[used]
    owner = np.cumsum(~more) - 1
    heads = np.flatnonzero(~more)
    counts = np.ones(n, dtype=np.int64)
    np.add.at(counts, owner[more],
              value[used[more]] << (r * (np.flatnonzero(more) - heads[owner[more]] - 1)))
    return (quotient[run[heads]] << r) | value[used[heads]], counts


def merge(filters: Iterable[bytes], bits: int) -> bytes:
    """One filter with the counts of all."""
    parts = [entries(f) for f in filters]
    prints = np.concatenate([p for p, _ in parts] or [np.zeros(0, dtype=np.int64)])
    counts = np.concatenate([c for _, c in parts] or [np.zeros(0, dtype=np.int64)])
    return build(*summed(prints, counts), bits)
