"""Words of a batch of texts as codes into the batch's own dictionary, without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import mix


class Words:
    """codes: of all words of all texts in a row; at: where each text begins and ends among them; distinct: the words."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        flat, at = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # white space at either end gives empty ones
        self.at = np.concatenate([[0], np.cumsum(real)])[at]
        coded = flat.filter(pa.array(real)).dictionary_encode()
        self.distinct, self.codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def raw(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the distinct words in a row, and where each begins and the last ends."""
        offsets = np.frombuffer(self.distinct.buffers()[1], np.int32)[self.distinct.offset : self.distinct.offset + len(self.distinct) + 1]
        data = self.distinct.buffers()[2]
        return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data and len(self.distinct) else np.empty(0, np.uint8), offsets - (offsets[0] if len(offsets) else 0)


def _multipliers(n: int, seed: int) -> np.ndarray:
    """Odd 64-bit numbers, the same for each place whatever n."""
    return mix((np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def word_hashes(words: Words, seeds: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of the distinct words, for each seed one that is independent of the others: sums of bytes times a number for each place, mixed."""
    raw, offsets = words.raw()
    if not len(words.distinct):
        return [np.empty(0, np.uint64) for _ in seeds]
    size = np.diff(offsets).astype(np.int64)
    place = np.arange(len(raw)) - np.repeat(offsets[:-1], size)
    byte = raw.astype(np.uint64) + np.uint64(1)
    return [mix(np.add.reduceat(byte * _multipliers(int(size.max()), seed)[place], offsets[:-1])) for seed in seeds]


def segment_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]], also where that is empty."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[at[1:]] - total[at[:-1]]


def passages(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts texts into passages of size words: the text of each, and its borders. A text without words has one, empty."""
    n = np.maximum(1, -(-np.diff(at) // size))
    owner = np.repeat(np.arange(len(n)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return owner, np.concatenate([at[:-1][owner] + inside * size, at[-1:]])
