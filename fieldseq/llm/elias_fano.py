"""Elias-Fano sequences and the n-gram trie made of them, in one memory-mapped file.

A monotone sequence is kept as packed low bits and unary coded high bits, and is searched
in this form: a select on the high bits gives the bucket of a number, a binary search on
the low bits its place there, for many numbers at once. The trie of a shard holds the contexts of one last word after another: the words seen after it, the
words seen before it, and for every such pair the words that followed, written as
positions in the first list (context-relative). Levels are monotone sequences with
monotone pointers; probabilities and back-off weights are 16-bit codes.
"""

from __future__ import annotations

import tempfile
from typing import NamedTuple

import numpy as np

STEPS = 2048  # codes per decade of probability
BLOCK = 64  # high bits per entry of the directory of ones
AT_ONCE = 1 << 14  # numbers searched together
_U = np.uint64
_EACH, _HIGHEST = _U(0x0101010101010101), _U(0x8080808080808080)  # the lowest and highest bit of every byte
#: Place of the k-th one (from the lowest bit) of each byte, 8 where it has fewer.
_PLACE = np.array([([j for j in range(8) if x >> j & 1] + [8] * 8)[:8] for x in range(256)], np.uint8)


def coded(p: np.ndarray) -> np.ndarray:
    """Probabilities (0, 1] as 16-bit codes of their negative decimal logarithm."""
    return np.minimum(np.rint(-np.log10(p) * STEPS), 65535).astype(np.uint16)


def log10_of(code: np.ndarray) -> np.ndarray:
    return code.astype(np.float64) / -STEPS


def _joined(values: np.ndarray, width: int) -> np.ndarray:
    """Numbers of `width` bits one after another in 64-bit words, and one more word."""
    out = np.zeros(len(values) * width // 64 + 2, _U)
    if not width or not len(values):
        return out
    at = np.arange(len(values)) * width
    word, shift = at >> 6, (at & 63).astype(_U)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
    over = np.flatnonzero((at & 63) + width > 64)  # at most one number crosses into a word
    out[word[over] + 1] |= values[over] >> (_U(64) - shift[over])
    return out


class Monotone:
    """An Elias-Fano coded sequence, read where it lies; nothing of it is decoded beforehand."""

    def __init__(self, shape: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.width, self.top = (int(x) for x in shape)
        self._low, self._high, self._ones = low, high.view(_U), ones.astype(np.int64)
        self._zeros = np.arange(len(ones)) * BLOCK - self._ones

    def __len__(self) -> int:
        return self.n

    def _select(self, k: np.ndarray, before: np.ndarray, flip: int) -> np.ndarray:
        """Position of the k-th one (flip 0) or zero (flip -1) among the high bits.

        Inside a block all eight bytes are counted and compared at once, as bytes of one number.
        """
        block = np.searchsorted(before, k, "right") - 1
        left = (k - before[block]).astype(_U)
        bits = self._high[block] ^ _U(flip & 0xFFFFFFFFFFFFFFFF)
        ones = bits - (bits >> _U(1) & _U(0x5555555555555555))
        ones = (ones & _U(0x3333333333333333)) + (ones >> _U(2) & _U(0x3333333333333333))
        upto = ((ones + (ones >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _EACH  # ones up to each byte
        byte = np.bitwise_count((left * _EACH | _HIGHEST) - upto & _HIGHEST).astype(_U)
        shift = byte << _U(3)
        left -= (upto << _U(8)) >> shift & _U(255)
        place = _PLACE[(bits >> shift & _U(255)).astype(np.int64), left.astype(np.int64)]
        return block * BLOCK + shift.astype(np.int64) + place

    def _bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place of the values with these high bits, and the place after the last one."""
        start, at = np.zeros(len(high), np.int64), np.zeros(len(high), np.int64)
        some = np.flatnonzero(high > 0)
        at[some] = self._select(high[some] - 1, self._zeros, -1) + 1
        start[some] = at[some] - high[some]
        # ones that follow, up to the end of the block; longer runs are selected
        word, shift = at >> 6, (at & 63).astype(_U)
        zeros = ~self._high[word] >> shift
        stop = start + np.bitwise_count((zeros & (~zeros + _U(1))) - _U(1))
        far = np.flatnonzero(zeros == 0)
        stop[far] = self._select(high[far], self._zeros, -1) - high[far]
        return start, stop

    def _low_bits(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), _U)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(_U)
        # shifted twice, since a shift by 64 has no defined value
        both = self._low[word] >> shift | (self._low[word + 1] << (_U(63) - shift)) << _U(1)
        return both & _U((1 << self.width) - 1)

    def at(self, places: np.ndarray) -> np.ndarray:
        """Values at these places."""
        out = np.empty(len(places), np.int64)
        for a in range(0, len(places), AT_ONCE):
            i = places[a:a + AT_ONCE]
            high = self._select(i, self._ones, 0) - i
            out[a:a + AT_ONCE] = high << self.width | self._low_bits(i).astype(np.int64)
        return out

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first value not below each number, and whether it equals it.

        Beyond the last value the place is the last one.
        """
        at, same = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        if not self.n:
            return at, same
        for a in range(0, len(wanted), AT_ONCE):
            at[a:a + AT_ONCE], same[a:a + AT_ONCE] = self._successor(wanted[a:a + AT_ONCE])
        return at, same

    def _successor(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high = wanted >> self.width
        beyond = high > self.top
        high = np.minimum(high, self.top)
        low = wanted.astype(_U) & _U((1 << self.width) - 1)
        at, end = self._bucket(high)
        same = np.zeros(len(wanted), bool)
        # in all buckets at once, those still to be searched
        open_ = np.flatnonzero((at < end) & ~beyond)
        start, stop, low = at[open_], end[open_], low[open_]
        while len(open_):
            middle = (start + stop) >> 1
            found = self._low_bits(middle)
            same[open_] |= found == low
            less = found < low
            start, stop = np.where(less, middle + 1, start), np.where(less, stop, middle)
            go = start < stop
            at[open_[~go]] = start[~go]
            open_, start, stop, low = open_[go], start[go], stop[go], low[go]
        at[beyond] = self.n
        return np.minimum(at, self.n - 1), same


class Levels:
    """Writes named arrays one after another to a temporary file and maps them back."""

    def __init__(self) -> None:
        self._file = tempfile.TemporaryFile()
        self._at: dict[str, tuple[int, int, np.dtype]] = {}
        self._map: np.memmap | None = None
        self.bytes = 0

    def put(self, name: str, values: np.ndarray) -> None:
        data = np.ascontiguousarray(values)
        self._file.write(data.tobytes() + bytes(-data.nbytes % 8))
        self._at[name] = (self.bytes, len(data), data.dtype)
        self.bytes += data.nbytes + -data.nbytes % 8

    def get(self, name: str) -> np.ndarray:
        start, n, kind = self._at[name]
        if not n:
            return np.zeros(0, kind)
        if self._map is None:
            self._file.flush()
            self._map = np.memmap(self._file, np.uint8, "r")
        return np.asarray(self._map[start:start + n * kind.itemsize]).view(kind)

    def put_monotone(self, name: str, values: np.ndarray) -> None:
        """Elias-Fano code of a non-decreasing sequence of non-negative numbers."""
        n = len(values)
        top = int(values[-1]) if n else 0
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        self.put(f"{name}.shape", np.array([n, low, top >> low], np.int64))
        v = values.astype(_U)
        self.put(f"{name}.low", _joined(v & _U((1 << low) - 1), low))
        bits = (top >> low) + n + 1
        high = np.zeros(-(-bits // BLOCK) * BLOCK, np.uint8)
        high[(v >> _U(low)).astype(np.int64) + np.arange(n)] = 1
        self.put(f"{name}.high", np.packbits(high, bitorder="little"))
        ones = np.add.reduceat(high, np.arange(0, len(high), BLOCK), dtype=np.int64)
        self.put(f"{name}.ones", np.concatenate(([0], np.cumsum(ones)))[:-1].astype(np.uint32))

    def monotone(self, name: str) -> Monotone:
        return Monotone(*(self.get(f"{name}.{part}") for part in ("shape", "low", "high", "ones")))

    def close(self) -> None:
        self._map = None
        self._file.close()


def find(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each wanted number in a sorted sequence, and whether it is there."""
    if not len(sorted_):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return at, sorted_[at] == wanted


def _runs(*columns: np.ndarray) -> np.ndarray:
    """First row of every run of equal rows."""
    first = np.zeros(len(columns[0]), bool)
    first[:1] = True
    for c in columns:
        first[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(first)


class Dealt(NamedTuple):
    """Contexts of which a shard has only a part, with their values over all parts.

    `pair_*` are the words after them, as often as they follow different words before;
    `first` is the context before the first word, `first_*` its sums and its words.
    """

    w2: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    pair_w2: np.ndarray
    pair_w3: np.ndarray
    pair_n: np.ndarray
    first: np.ndarray
    first_total: np.ndarray
    first_kinds: np.ndarray
    first_word: np.ndarray
    first_count: np.ndarray


def _taken(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values at these places; without any, zeros."""
    return values[at] if len(values) else np.zeros(len(at), values.dtype)


def _find_each(level: Monotone, wanted: np.ndarray, ordered: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """As `find`, with equal numbers (in order: runs of them) searched once."""
    if ordered:
        first = _runs(wanted)
        inverse = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(wanted))))
        kinds = wanted[first]
    else:
        kinds, inverse = np.unique(wanted, return_inverse=True)
    at, same = level.find(kinds)
    return at[inverse], same[inverse]


class Trie:
    """Interpolated Kneser-Ney trigram model of the contexts of one shard.

    Built from distinct (w1, w2, w3) with counts, sorted by w2, w1, w3; words are numbers
    below `width`. `low` has each word's unigram probability. Contexts in `dealt` take
    their bigram level from there.
    """

    def __init__(self, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, count: np.ndarray,
                 low: np.ndarray, width: int, discount: float, dealt: Dealt | None = None) -> None:
        self.width, self.levels = width, Levels()
        put, mono = self.levels.put, self.levels.put_monotone
        root_word = np.unique(w2 if dealt is None else np.concatenate((w2, dealt.w2)))
        self.empty = not len(root_word)
        if self.empty:
            return
        n_roots, root_of = len(root_word), np.searchsorted(root_word, w2)
        # words after the last word: as often as they follow different words before it
        after, kinds = np.unique(root_of * width + w3, return_counts=True)
        if dealt is not None:
            own = ~np.isin(root_word[after // width], dealt.w2)
            after = np.append(after[own], np.searchsorted(root_word, dealt.pair_w2) * width + dealt.pair_w3)
            kinds = np.append(kinds[own], dealt.pair_n)
            order = np.argsort(after)
            after, kinds = after[order], kinds[order]
        after_root = after // width
        total, n_after = self._sums(kinds, after_root, n_roots)
        if dealt is not None:
            at = np.searchsorted(root_word, dealt.w2)
            total[at], n_after[at] = dealt.total, dealt.kinds
        p2, back2 = self._smooth(kinds, after_root, total, n_after, low[after % width], discount)
        slot = np.searchsorted(after, root_of * width + w3)
        before = _runs(w2, w1)
        context = np.repeat(np.arange(len(before)), np.diff(np.append(before, len(w2))))
        total, n_after = self._sums(count, context, len(before))
        if dealt is not None and len(dealt.first):
            at = np.flatnonzero(w2[before] == dealt.first[0])
            total[at], n_after[at] = dealt.first_total[0], dealt.first_kinds[0]
        p3, back3 = self._smooth(count, context, total, n_after, p2[slot], discount)
        first_after = np.searchsorted(after_root, np.arange(n_roots + 1))
        sizes = np.diff(first_after)[root_of[before]]
        base = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        mono("roots", root_word)
        mono("after_ptr", first_after)
        mono("after", after)
        mono("before", root_of[before] * width + w1[before])
        mono("follow_base", base)
        mono("follow", slot - first_after[root_of] + base[context])
        put("p2", coded(p2))
        put("p3", coded(p3))
        put("back2", coded(back2))
        put("back3", coded(back3))

    @staticmethod
    def _sums(count: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(group, count, groups), np.bincount(group, minlength=groups)

    @staticmethod
    def _smooth(count: np.ndarray, group: np.ndarray, total: np.ndarray, kinds: np.ndarray,
                lower: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
        back = discount * kinds / total
        return (count - discount) / total[group] + back[group] * lower, back

    def log10(self, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, low: np.ndarray) -> np.ndarray:
        """log10 P(w3 | w1 w2); `low` has log10 of the words' unigram probabilities."""
        if self.empty:
            return low[w3]
        get, mono = self.levels.get, self.levels.monotone
        root, has_root = _find_each(mono("roots"), w2)
        slot, has_after = _find_each(mono("after"), root * self.width + w3, ordered=False)
        has_after &= has_root
        place, has_before = _find_each(mono("before"), root * self.width + w1)
        has_before &= has_root
        # the third word as its place among those after the second, looked up in this context only
        both = np.flatnonzero(has_before & has_after)
        relative = slot[both] - mono("after_ptr").at(root[both])
        at, has_follow = np.zeros(len(w3), np.int64), np.zeros(len(w3), bool)
        at[both], has_follow[both] = mono("follow").find(relative + mono("follow_base").at(place[both]))
        p2 = np.where(has_after, log10_of(_taken(get("p2"), slot)), log10_of(get("back2")[root]) + low[w3])
        p2 = np.where(has_root, p2, low[w3])
        p3 = np.where(has_before, log10_of(_taken(get("back3"), place)) + p2, p2)
        return np.where(has_follow, log10_of(_taken(get("p3"), at)), p3)

    def close(self) -> None:
        self.levels.close()
