"""64-bit hashes of the words of whole texts, vectorised over Arrow buffers.

Words are the runs of bytes outside space and \\t..\\r, with A-Z lower-cased.
Every byte has a random 64-bit number; a word's hash is the polynomial of its
numbers (prefix sums give all words of a batch at once) mixed with its length.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa

from gavel.llm import common
from gavel.llm.common import by_value, slices, worker_memory

by_value(sys.modules[__name__])
by_value(common)

BASE = 0x9E3779B97F4A7C15 | 2  # odd, and 3 modulo 4
#: Bytes of text that are hashed at once.
PIECE = 1 << 19


def blend(x):
    """Finaliser over 64-bit numbers: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _tables(n: int):
    """Numbers of the bytes (A-Z as a-z; as they are), powers of BASE and of its
    inverse up to n."""
    memory = worker_memory()
    if len(memory.get("powers", ())) < n + 1:
        size = max(n + 1, PIECE + (1 << 16))
        memory["bytes"] = np.random.default_rng(20240301).integers(0, 1 << 64, 256, dtype=np.uint64)
        memory["numbers"] = memory["bytes"].copy()
        memory["numbers"][65:91] = memory["bytes"][97:123]
        for name, x in (("powers", BASE), ("inverse", pow(BASE, -1, 1 << 64))):
            p = np.full(size, x, dtype=np.uint64)
            p[0] = 1
            memory[name] = np.cumprod(p, dtype=np.uint64)
    return memory["numbers"], memory["bytes"], memory["powers"], memory["inverse"]


def _bytes_of(texts: pa.Array):
    """Bytes of a string array, and the offsets of its texts in them."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    off = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    b = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return b, off - off[0]


def _sums(numbers, powers, b):
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    value = np.take(numbers, b, mode="clip")
    value *= powers[: len(b)]
    np.cumsum(value, out=total[1:])
    return total


def _named(total, inverse, first, last):
    return blend((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def string_hashes(texts: pa.Array) -> np.ndarray:
    """64-bit hash of every string of an array without nulls."""
    b, off = _bytes_of(texts)
    _lower, numbers, powers, inverse = _tables(len(b))
    return _named(_sums(numbers, powers, b), inverse, off[:-1], off[1:])


def hash_words(texts: pa.Array, lines: bool = False):
    """(hashes, offsets by text, line of each word within its text or None) of a
    string array; a null text has no words."""
    b, off = _bytes_of(texts)
    numbers, _exact, powers, inverse = _tables(len(b))
    solid = (b != 32) & ((b < 9) | (b > 13))
    edge = np.zeros(len(b) + 1, dtype=bool)  # a text begins here
    edge[off] = True
    before = np.concatenate([[False], solid[:-1]]) & ~edge[:-1] if len(b) else solid
    after = np.concatenate([solid[1:], [False]]) & ~edge[1:] if len(b) else solid
    first, last = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    h = _named(_sums(numbers, powers, b), inverse, first, last)
    at = np.searchsorted(first, off)
    if not lines:
        return h, at, None
    breaks = np.flatnonzero(b == 10)
    line = np.searchsorted(breaks, first)
    return h, at, line - np.repeat(np.searchsorted(breaks, off[:-1]), np.diff(at))


def text_runs(batch, column: str):
    """(first row, texts) of bounded runs of a batch's rows."""
    lo = 0
    for part in slices(batch, column, PIECE):
        yield lo, part.column(part.schema.get_field_index(column))
        lo += part.num_rows
