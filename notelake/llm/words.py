"""Words of many texts at once: each different word of a chunk is seen by Python once."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK = 16 << 20


def chunks(batches: Iterator[pa.RecordBatch], text: int, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batches in slices of some ``size`` bytes of column ``text``, so that memory does not follow the batch size."""
    for b in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(b.column(text)), 0)).astype(np.int64)
        ends, lo = np.cumsum(sizes), 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def split_words(texts: pa.Array, at: str = " ") -> tuple[pa.DictionaryArray, np.ndarray]:
    """(the pieces of texts without nulls, cut at ``at``, end to end; first place of each text and the end)."""
    pieces = pc.split_pattern(texts, at)
    bounds = np.concatenate(([0], np.cumsum(np.asarray(pieces.value_lengths()), dtype=np.int64)))
    return pieces.flatten().dictionary_encode(), bounds


def gather(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds): the runs of ``flat`` (of the given sizes, end to end) that ``codes`` names, end to end, and where each begins."""
    starts = np.cumsum(sizes) - sizes
    n = sizes[codes]
    bounds = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
    at = np.arange(bounds[-1]) + np.repeat(starts[codes] - bounds[:-1], n)
    return flat[at], bounds
