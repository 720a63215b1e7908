"""Words and hashes of whole Arrow batches with NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def give_back() -> None:
    """Returns freed memory to the system, so that an idle worker stays small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def hash_strings(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of non-empty strings: a sum of bytes times a multiplier per position, scrambled."""
    strings = strings.cast(pa.large_string())
    if not len(strings):
        return np.empty(0, np.uint64)
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    starts, lens = offsets[:-1] - offsets[0], np.diff(offsets)
    by_place = mix64(np.arange(1, int(lens.max()) + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)
    place = np.arange(len(data)) - np.repeat(starts, lens)
    return mix64(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * by_place[place], starts) ^ (lens.astype(np.uint64) * GOLDEN))


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words (between ASCII white space) of all texts, and each text's start among them."""
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat, offsets = parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
    full = pc.greater(pc.binary_length(flat), 0)
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), upto[offsets]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and each text's start among them."""
    words, offsets = split_words(texts)
    coded = words.dictionary_encode()
    return hash_strings(coded.dictionary)[coded.indices.to_numpy()], offsets


def shingles(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every run of ``size`` words; a shorter text is one run."""
    words, offsets = word_hashes(texts)
    counts = np.diff(offsets)
    runs = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    owner = np.repeat(np.arange(len(counts)), runs)
    at = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(offsets[:-1], runs)
    end = offsets[1:][owner]
    found = np.zeros(len(at), np.uint64)
    for k in range(size):
        here = at + k
        value = words[np.minimum(here, len(words) - 1)] if len(words) else np.empty(0, np.uint64)
        found = np.where(here < end, mix64(found * np.uint64(3) + value + np.uint64(k)), found)
    return found, owner


def slices(batch: pa.RecordBatch, column: int, rows: int = 1024, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows and about ``size`` bytes of text (one row at least)."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(upto[at - 1]) if at else 0
        end = min(max(int(np.searchsorted(upto, before + size, "right")), at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def distinct(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, value) pairs in order, and how often each occurs."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return values[first], owner[first], np.diff(np.append(first, len(values)))
