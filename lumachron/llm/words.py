"""Words of whole texts as flat numpy arrays, a bounded slice of an Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes handled at once; a longer single text is handled alone.
SLICE_BYTES = 4 << 20

_BYTES = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, all other bytes (so all of UTF-8 beyond ASCII) as they are.
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
#: Separators of white-space words, [\x20\x09-\x0D].
BLANKS = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
#: Separators of letter and digit words after lower-casing, [\x00-\x2F\x3A-\x60\x7B-\x7F].
SIGNS = (_BYTES <= 0x2F) | ((_BYTES >= 0x3A) & (_BYTES <= 0x60)) | ((_BYTES >= 0x7B) & (_BYTES <= 0x7F))


def flat_text(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and n + 1 offsets; null is empty."""
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose text has about `most` bytes."""
    if not batch.num_rows:
        return
    _, at = flat_text(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def binary_array(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A binary (or string) array over bytes end to end."""
    small = offsets[-1] < 2**31
    kind = kind or (pa.binary() if small else pa.large_binary())
    at = offsets.astype(np.int64 if kind in (pa.large_binary(), pa.large_string()) else np.int32)
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


@dataclass
class Words:
    """Words of n texts, end to end; text i has words[at[i]:at[i + 1]]."""

    words: pa.Array
    at: np.ndarray

    @cached_property
    def coded(self) -> pa.DictionaryArray:
        return self.words.dictionary_encode()

    @property
    def codes(self) -> np.ndarray:
        """Of each word, its place in `distinct`."""
        return np.asarray(self.coded.indices).astype(np.int64)

    @property
    def distinct(self) -> pa.Array:
        return self.coded.dictionary

    def places(self, vocabulary: pa.Array) -> np.ndarray:
        """Of each word, its place in the vocabulary, or -1."""
        return np.asarray(pc.index_in(self.words, value_set=vocabulary.cast(self.words.type)).fill_null(-1)).astype(np.int64)

    def texts(self) -> np.ndarray:
        """Of each word, its text."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        one = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in self.distinct.to_pylist()), np.uint64, len(self.distinct))
        return one[self.codes] if len(one) else np.zeros(0, np.uint64)


def split_words(texts: pa.Array, separators: np.ndarray, fold: np.ndarray | None = LOWER, cuts: np.ndarray | None = None) -> Words:
    """Words are the longest runs of bytes that are no separators; a word never crosses two texts, nor two bytes that
    `cuts` (256 x 256) marks."""
    raw, at = flat_text(texts)
    if fold is not None:
        raw = fold[raw]
    gap = separators[raw]
    first, last = np.ones(len(raw) + 1, bool), np.ones(len(raw) + 1, bool)
    first[1:], last[: len(raw)] = np.append(gap, True)[:-1][: len(raw)], np.append(gap[1:], True)[: len(raw)]
    first[at], last[at[1:] - 1] = True, True
    if cuts is not None and len(raw) > 1:
        between = cuts[raw[:-1], raw[1:]]
        first[1 : len(raw)] |= between
        last[: len(raw) - 1] |= between
    starts = np.flatnonzero(~gap & first[: len(raw)])
    ends = np.flatnonzero(~gap & last[: len(raw)]) + 1
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    return Words(binary_array(raw[~gap], offsets), np.searchsorted(starts, at))


def gather_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all ranges [start, start + length), one range after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finisher that spreads each bit of a 64-bit value over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """A 64-bit hash of each `size` consecutive words, whatever text they are in; position i is the window from word i."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total += hashes[j : j + n] * np.uint64((_ODD[j % 6] + 2 * (j // 6) * 0x51_7CC1B7) & (2**64 - 1) | 1)
    return mixed(total)


def sequence_hash(hashes: np.ndarray, salt: int = 0) -> int:
    """A 64-bit hash of a whole sequence of words."""
    return xxhash.xxh3_64_intdigest(np.ascontiguousarray(hashes).tobytes(), seed=salt)
