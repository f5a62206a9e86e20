"""Words and shingles of whole texts as 64-bit hashes, computed on Arrow buffers.

Works on the UTF-8 bytes of a column at once: A-Z fall to a-z, words are runs of
bytes outside the six ASCII blanks. Slices end between texts, or inside a very
long text between words, so memory is bounded by `SLICE_BYTES` and the longest word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
_U = np.uint64
_STEP = _U(0x100000001B3)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (xor-shift-multiply, bijective)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
BLANK = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_VALUE = np.where(BLANK, _U(0), mix((LOWER + 1).astype(np.uint64)))
_LANES = mix(np.arange(1, 65, dtype=np.uint64)) | _U(1)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins (one more offset than texts). Nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def _slices(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(at + SLICE_BYTES, end)
        if to < end:
            k = int(np.searchsorted(offsets, to, "right")) - 1
            if int(offsets[k]) > at:
                to = int(offsets[k])
            else:  # inside one long text: up to its next blank
                limit = int(offsets[k + 1])
                while to < limit:
                    blank = np.flatnonzero(BLANK[raw[to:min(to + 65536, limit)]])
                    if len(blank):
                        to += int(blank[0])
                        break
                    to = min(to + 65536, limit)
        yield at, to
        at = to


def word_spans(texts: pa.Array
               ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice: hash, index of the text, byte length and first byte of every word."""
    raw, offsets = text_buffers(texts)
    for lo, hi in _slices(raw, offsets):
        part = raw[lo:hi]
        blank = BLANK[part]
        first = np.empty(len(part), bool)
        first[0] = True
        first[1:] = blank[:-1]
        inner = offsets[(offsets > lo) & (offsets < hi)] - lo
        first[inner] = True
        starts = np.flatnonzero(first & ~blank)
        if not len(starts):
            continue
        value = _VALUE[part]
        size = np.diff(np.append(starts, len(part)))
        place = np.arange(starts[0], len(part)) - np.repeat(starts, size)
        powers = np.cumprod(np.concatenate(([_U(1)], np.full(int(size.max()), _STEP))))
        hashes = np.add.reduceat(value[starts[0]:] * powers[place], starts - starts[0])
        length = np.add.reduceat((~blank[starts[0]:]).astype(np.int64), starts - starts[0])
        doc = np.searchsorted(offsets, starts + lo, "right") - 1
        yield mix(hashes + length.astype(np.uint64) * _LANES[0]), doc, length, starts + lo


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every word of the column."""
    parts = list(word_spans(texts))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int, k: int = 5
             ) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text: (text index, hash), ordered by both.

    A text with 1 to k-1 words has its whole sequence as its only shingle.
    """
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    count = np.bincount(doc, minlength=n_docs)
    starts = np.concatenate(([0], np.cumsum(count)))
    n = len(hashes) - k + 1
    out_h, out_d = [], []
    if n > 0:
        value = hashes[:n] * _LANES[1]
        for j in range(1, k):
            value = value + hashes[j:n + j] * _LANES[j + 1]
        whole = doc[:n] == doc[k - 1:]
        out_h.append(mix(value[whole]))
        out_d.append(doc[:n][whole])
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        value = mix(count[short].astype(np.uint64))
        for j in range(k - 1):
            has = count[short] > j
            at = np.minimum(starts[short] + j, len(hashes) - 1)
            value = value + np.where(has, hashes[at] * _LANES[k + j + 2], _U(0))
        out_h.append(mix(value))
        out_d.append(short)
    h, d = np.concatenate(out_h), np.concatenate(out_d)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return d[fresh], h[fresh]
