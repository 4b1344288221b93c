"""Arrow helpers: the words of a batch of texts, with each distinct word once."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def texts_of(column: pa.Array) -> pa.Array:
    """A string column without nulls (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "")


def slices(texts: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about most_bytes each; a longer text is a range of its own."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most_bytes:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def split_words(texts: pa.Array, split: Callable[[pa.Array], pa.Array] = pc.ascii_split_whitespace) -> tuple[pa.Array, np.ndarray]:
    """All words between ASCII (or, by `split`, other) white space, and each text's first word (n + 1 offsets)."""
    lists = split(texts)
    flat = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    some = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not some.all():
        owner = np.repeat(np.arange(len(counts)), counts)[some]
        flat = flat.filter(pa.array(some))
        counts = np.bincount(owner, minlength=len(counts))
    return flat, np.concatenate(([0], np.cumsum(counts)))


def distinct(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Index of each word among the distinct words, and these."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def sums_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the rows of values in each text's range [first[i], first[i + 1])."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(first) > 0)
    if full.size:
        out[full] = np.add.reduceat(values, first[full], axis=0, dtype=np.float64)
    return out


def joined_words(words: pa.Array) -> bytes:
    """All words with a space between."""
    one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(one.cast(pa.list_(pa.binary())), b" ")[0].as_buffer().to_pybytes() if len(words) else b""


def _settle() -> None:
    """Give freed memory back; workers that idle between stages otherwise hold their largest batch."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that frees memory after every batch."""

    @wraps(run)
    def freeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                _settle()

        yield from run(each())
        _settle()

    return freeing
