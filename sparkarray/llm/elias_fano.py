"""Elias-Fano sequences and the n-gram trie made of them, for whole arrays of queries.

A sequence keeps its values' low bits side by side, without gaps, and the high
parts as unary gaps in a bit vector; a directory counts the ones before each
word.  Select reads one value, successor search finds the first value at or
above a given one: two selects give the few values with the same high part, and
their low bits decide.

A trie is one flat buffer, so it can be mapped from a file and used as it lies.
"""

from __future__ import annotations

import os
import uuid

import numpy as np

_U = np.uint64


def _select_in_word(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Where the r-th one of each word stands (from 0)."""
    x, r, place = x.copy(), r.astype(np.int64), np.zeros(len(x), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count(x & _U((1 << width) - 1)).astype(np.int64)
        on = r >= below
        r -= np.where(on, below, 0)
        x = np.where(on, x >> _U(width), x)
        place += on * width
    return place


class EliasFano:
    """A non-decreasing sequence of 64-bit values."""

    PARTS = 4

    def __init__(self, meta: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.width, self.top = (int(x) for x in meta)
        self.low, self.high, self.ones = low, high, ones
        self._zeros: np.ndarray | None = None

    @classmethod
    def build(cls, values: np.ndarray) -> list[np.ndarray]:
        """The parts of a sequence, from sorted values."""
        n = len(values)
        values = values.astype(_U)
        largest = int(values[-1]) if n else 0
        width = min(63, max(0, ((largest + 1) // max(1, n)).bit_length() - 1))
        low = np.zeros(n * width // 64 + 2, _U)
        if width and n:
            at = np.arange(n) * width
            word, shift = at >> 6, (at & 63).astype(_U)
            some = values & _U((1 << width) - 1)
            np.bitwise_or.at(low, word, some << shift)
            over = np.flatnonzero(shift + _U(width) > 64)
            np.bitwise_or.at(low, word[over] + 1, some[over] >> (_U(64) - shift[over]))
        marks = (values >> _U(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(((int(marks[-1]) + 2 if n else 1) + 63) // 64 * 64, np.uint8)
        bits[marks] = 1
        high = np.packbits(bits, bitorder="little").view("<u8").astype(_U)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)]).astype(np.uint32)
        return [np.array([n, width, largest >> width], np.int64), low, high, ones]

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), _U)
        bit = at * self.width
        word, shift = bit >> 6, (bit & 63).astype(_U)
        # A shift by 64 has no defined result; in two steps the part beyond is empty.
        found = (self.low[word] >> shift) | (self.low[word + 1] << _U(1) << (_U(63) - shift))
        return found & _U((1 << self.width) - 1)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at these places (select)."""
        word = np.searchsorted(self.ones, at, side="right") - 1
        one = word * 64 + _select_in_word(self.high[word], at - self.ones[word])
        return (one - at).astype(_U) << _U(self.width) | self._low(at)

    def _before_zero(self, k: np.ndarray) -> np.ndarray:
        """How many values stand before the k-th zero: those whose high part is k at most."""
        if self._zeros is None:
            self._zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        word = np.searchsorted(self._zeros, k, side="right") - 1
        return word * 64 + _select_in_word(~self.high[word], k - self._zeros[word]) - k

    def find(self, x: np.ndarray, first: np.ndarray | int = 0, last: np.ndarray | int | None = None) -> np.ndarray:
        """Where x stands within the places first..last-1, or -1: the successor of x, if it is x itself."""
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        part = (x >> _U(self.width)).astype(np.int64) if self.width else x.astype(np.int64)
        known = (part <= self.top) & (part >= 0)
        part = np.where(known, part, 0)
        low = np.where(part > 0, self._before_zero(np.maximum(part - 1, 0)), 0)
        high = self._before_zero(part)
        low = np.maximum(low, first)
        high = np.where(known, np.minimum(high, self.n if last is None else last), low)
        end, want = high.copy(), x & _U((1 << self.width) - 1)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            less = self._low(middle) < want[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
            open_ = open_[low[open_] < high[open_]]
        there = low < end
        there[there] = self._low(low[there]) == want[there]
        return np.where(there, low, -1)


def joined(parts: list[np.ndarray]) -> bytes:
    """Arrays as one buffer: how many, their kinds and lengths, then each at a multiple of eight bytes."""
    head = np.array([len(parts), *(x for p in parts for x in (ord(p.dtype.kind) << 8 | p.dtype.itemsize, p.nbytes))], np.int64)
    return b"".join([head.tobytes(), *(x for p in parts for x in (p.tobytes(), bytes(-p.nbytes % 8)))])


def parted(buffer: np.ndarray) -> list[np.ndarray]:
    """The arrays of such a buffer, in place."""
    n = int(buffer[:8].view(np.int64)[0])
    head, at, out = buffer[8 : 8 + 16 * n].view(np.int64), 8 + 16 * n, []
    for kind, size in head.reshape(-1, 2).tolist():
        out.append(buffer[at : at + size].view(f"{chr(kind >> 8)}{kind & 255}"))
        at += size + -size % 8
    return out


class Trie:
    """Two levels.  First: contexts (hashes), the running sum of their counts, pointers to their successors.  Second:
    successors (context rank, then word hash) and their quantised smoothed probabilities.

    A probability is n / (c + t): n of the c occurrences of the context go to the
    word, and t different words follow it.  What is left, t / (c + t), goes to the
    word model (Witten and Bell's smoothing).  Its code k stands for 2^-((k-1) step).
    """

    def __init__(self, buffer: np.ndarray) -> None:
        parts, size = parted(buffer), EliasFano.PARTS
        self.contexts, self.sums, self.pointers, self.successors = (EliasFano(*parts[k * size : (k + 1) * size]) for k in range(4))
        self.codes, self.step = parts[4 * size], float(parts[4 * size + 1][0])

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, count: np.ndarray) -> bytes:
        """From sorted distinct (context, word) and their counts."""
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1])[: len(context)])
        starts = np.append(first, len(context))
        sums = np.concatenate([[0], np.cumsum(np.add.reduceat(count, first) if len(first) else np.empty(0, np.int64))])
        rank = np.repeat(np.arange(len(first), dtype=_U), np.diff(starts))
        mass = np.repeat(np.diff(sums) + np.diff(starts), np.diff(starts))
        bits = -np.log2(count / mass)
        step = max(float(bits.max(initial=0.0)) / 254.0, 1e-6)
        parts: list[np.ndarray] = []
        for values in (context[first], sums, starts, rank << _U(32) | word.astype(_U)):
            parts += EliasFano.build(values)
        return joined([*parts, (1 + np.round(bits / step)).astype(np.uint8), np.array([step])])

    def look(self, context: np.ndarray, lens: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each context its count and number of successors; of each word behind it (``lens`` a context) its code, or 0."""
        rank = self.contexts.find(context)
        known = np.flatnonzero(rank >= 0)
        some = rank[known]
        first, last, count = np.zeros(len(context), np.int64), np.zeros(len(context), np.int64), np.zeros(len(context), np.int64)
        first[known], last[known] = self.pointers.get(some), self.pointers.get(some + 1)
        count[known] = (self.sums.get(some + 1) - self.sums.get(some)).astype(np.int64)
        owner = np.repeat(np.arange(len(context)), lens)
        codes = np.zeros(len(word), np.uint8)
        asked = np.flatnonzero(rank[owner] >= 0)
        owner = owner[asked]
        at = self.successors.find(rank[owner].astype(_U) << _U(32) | word[asked].astype(_U), first[owner], last[owner])
        hit = at >= 0
        codes[asked[hit]] = self.codes[at[hit]]
        return count, last - first, codes


def write_shared(uri: str, data: bytes) -> None:
    """One file of the shared folder, complete or not there; a task that runs twice writes the same again."""
    path = _path(uri)
    if path is None:
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(uri)
        with system.open_output_stream(name) as out:
            out.write(data)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    new = f"{path}.{uuid.uuid4().hex}"
    with open(new, "wb") as out:
        out.write(data)
    os.replace(new, path)


def map_shared(uri: str) -> np.ndarray:
    """A file of the shared folder: mapped where the folder is mounted, else read whole."""
    path = _path(uri)
    if path is not None:
        return np.memmap(path, np.uint8, "r")
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(uri)
    with system.open_input_file(name) as file:
        return np.frombuffer(file.read(), np.uint8)


def _path(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri.removeprefix("file:").lstrip("/")
    return None if "://" in uri else uri
