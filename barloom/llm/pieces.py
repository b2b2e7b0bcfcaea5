"""Texts cut into pieces that repeat, each looked up once per batch, and ids put together from the pieces' ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct ones of pieces (their UTF-8 bytes end to end, and where each begins, one more at the end), and each piece's number among them."""
    words = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
    return words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()


def spread(each: list[bytes], numbers: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and where each text's begin (one more at the end).

    each: ids of the distinct pieces as 32-bit integers; numbers: which piece comes where; at: where each text's pieces begin (one more at the end).
    """
    pool = np.frombuffer(b"".join(each), "<u4")
    sizes = np.fromiter(map(len, each), np.int64, len(each)) >> 2
    n = sizes[numbers]
    stops = np.concatenate([[0], np.cumsum(n)])
    return pool[np.repeat((np.cumsum(sizes) - sizes)[numbers] - stops[:-1], n) + np.arange(stops[-1])], stops[at]


def lengths(each: list[bytes], numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where each text's ids begin (one more at the end), as spread() has it, without putting them together."""
    sizes = np.fromiter(map(len, each), np.int64, len(each)) >> 2
    return np.concatenate([[0], np.cumsum(sizes[numbers])])[at]
