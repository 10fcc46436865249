"""Words of many texts at once, each distinct word once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def slices(texts: Sequence[str | bytes], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes or characters: what a task works on at once.

    A text is never cut; one longer than that is a range of its own.
    """
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= most):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def split_words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the word at each place, and where each text's places begin and end.

    A word comes with the ASCII white space before it, so that a text's words joined are
    the text; white space at its end is a word of its own. Lone surrogates become "?".
    """
    raw = [t.encode("utf-8", "replace") for t in texts]
    bounds = np.append(0, np.cumsum([len(r) for r in raw], dtype=np.int64))
    data = np.frombuffer(b"".join(raw), np.uint8)
    space = _SPACE[data]
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[bounds[bounds < len(data)]] = True
    starts = first.nonzero()[0]
    offsets = np.append(starts, len(data)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))
    words = words.dictionary_encode()
    return words.dictionary.to_pylist(), words.indices.to_numpy(), np.searchsorted(starts, bounds)


def ragged(starts: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Positions of the members of each of these rows, row after row."""
    n = lengths[rows]
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[rows] - (ends - n), n)
