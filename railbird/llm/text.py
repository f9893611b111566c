"""What the text operators share: words as 64-bit hashes, worked out on whole arrays of bytes, and row-wise Arrow steps.

Texts are handled as UTF-8 bytes. Every separator is an ASCII byte, so no character is ever cut. A long text is worked
through in slices that end between two words, so memory follows the longest word and not the longest text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE = 1 << 20
U = np.uint64
_FACTOR = 0x9E3779B97F4A7C15 | 1


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = np.asarray(values, dtype=U).copy()
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def numbers(seed: int, count: int) -> np.ndarray:
    """``count`` fixed pseudo-random 64-bit values for ``seed``."""
    with np.errstate(over="ignore"):
        return mixed(np.arange(1, count + 1, dtype=U) * U(_FACTOR) + U(seed * 0x632BE59BD9B4E019 % 2**64))


def _weights(gaps: Iterable[int], seed: int) -> np.ndarray:
    """A value for each byte, A-Z as a-z; 0 for the bytes between words."""
    table = numbers(seed, 256) | U(1)
    table[65:91] = table[97:123]
    table[list(gaps)] = 0
    return table


# words of anything but white space, and words of letters and digits (with all beyond ASCII)
SPACED = _weights([0x20, *range(0x09, 0x0E)], 1)
ALNUM = _weights([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)], 1)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor modulo 2**64, and of its inverse."""
    size = max(SLICE * 2, 1 << int(count - 1).bit_length())
    if size not in _powers:
        up, down = (np.full(size, f, dtype=U) for f in (_FACTOR, pow(_FACTOR, -1, 2**64)))
        up[0] = down[0] = 1
        _powers.clear()
        _powers[size] = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
    return _powers[size]


def slices(data: bytes, table: np.ndarray, size: int = SLICE) -> Iterator[np.ndarray]:
    """The bytes of ``data`` in pieces of about ``size``, each cut where no word is."""
    codes = np.frombuffer(data, dtype=np.uint8)
    start = 0
    while start < len(codes):
        end = start + size
        while end < len(codes):
            gaps = np.flatnonzero(table[codes[end : end + 4096]] == 0)
            if len(gaps):
                end += int(gaps[0])
                break
            end += 4096
        yield codes[start:end]
        start = min(end, len(codes))


def word_hashes(data: bytes, table: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each word of ``data`` in order, A-Z taken as a-z."""
    found = []
    for codes in slices(data, table):
        values = table[codes]
        inside = values != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        starts = np.flatnonzero(first)
        if len(starts):
            up, down = powers(len(codes))
            found.append(np.add.reduceat(values * up[: len(codes)], starts) * down[starts])
    if not found:
        return np.empty(0, dtype=U)
    return mixed(found[0] if len(found) == 1 else np.concatenate(found))


def runs_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` consecutive values; for fewer values, one for all of them."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    factors = numbers(2, width) | U(1)
    total = np.zeros(n - width + 1, dtype=U)
    for i in range(width):
        total += hashes[i : n - width + 1 + i] * factors[i]
    return mixed(total + U(width))


def texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each value; a null is an empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for value in column.cast(kind):
        yield value.as_py() or b""


def annotate(df: DataFrame, added: str, work: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """``df`` with the columns of the schema ``added``, worked out batch by batch.

    A column of ``df`` whose name is among the added ones is replaced.
    """
    fields = T.StructType.fromDDL(added)
    # the working columns stay visible to `work` even where an added column replaces them
    kept = [c for c in df.columns if c not in fields.names]
    schema = T.StructType([*[f for f in df.schema.fields if f.name in kept], *fields.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = work(batch)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *new], names=[*kept, *fields.names])

    return df.mapInArrow(run, schema)
