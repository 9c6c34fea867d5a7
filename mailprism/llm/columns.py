"""Words of text columns as codes, so that Python meets each distinct word of a batch once."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def coded_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, code of each word, bounds of the texts in the codes).

    Words are what stands between ASCII white space; the empty word before or after it may occur. Null counts as empty.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    bounds = np.asarray(lists.offsets, dtype=np.int64)
    coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    return coded.dictionary.to_pylist(), np.asarray(coded.indices, dtype=np.int64), bounds - bounds[0]


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word with A-Z as a-z, bounds of the texts in them). Null counts as empty."""
    seen, codes, bounds = coded_words(texts)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode().lower()) for w in seen), np.uint64, len(seen))
    if "" in seen:
        words = codes != seen.index("")
        before = np.concatenate([[0], np.cumsum(words)])
        codes, bounds = codes[words], before[bounds]
    return hashes[codes], bounds


def few_mb(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of about `most` bytes of text; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, size in enumerate(sizes):
        held += int(size)
        if held > most or i == len(sizes) - 1:
            yield batch.slice(first, i + 1 - first)
            first, held = i + 1, 0


_HELD: dict[Hashable, object] = {}


def release() -> None:
    """Gives back what worker_cache keeps in this worker: for operators that need no cache of their own."""
    if _HELD:
        _HELD.clear()
        _trim()


def _trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def worker_cache(key: Hashable, make: Callable[[], object]):
    """What `make` makes, kept in this worker until another key is asked for: one operator's cache at a time.

    Workers live on between operators; what the last one kept is given back to the system first.
    """
    if key not in _HELD:
        _HELD.clear()
        _trim()
        _HELD[key] = make()
    return _HELD[key]
