"""Periodic runs of words, found by block convolution.

A run is a stretch of words with smallest period q that no neighbouring word extends, at least ``SHORTEST`` words and three
periods long. At the scale B (8, 16, 32, ...) the words are cut into blocks of B. A run of a period from B to 2B (at the first
scale, from 1) holds a block whose copy one period later it holds too. So for each block the sum of squared differences to
every stretch of B words that begins up to 2B words after it is worked out, all at once, by a number-theoretic transform
modulo the prime P: where it is zero the block occurs again. A zero is never missed, as codes and sums are whole numbers; a
sum that is zero only modulo P is told by comparing the words. Each distance found seeds a stretch that is extended both ways.

Many documents are worked through as one sequence with a code of its own between them, which no run can contain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from railbird.llm.text import U, mixed, texts

SHORTEST = 24  # words
TIMES = 3  # periods
FIRST = 8  # words of a block at the smallest scale: 2 * FIRST - 1 words fit into the shortest run less its longest small period
GROUP_BYTES = 1 << 21  # of text worked through at once, unless one text is longer
TABLE = 1 << 20  # numbers of one table of convolutions

# a prime with roots of unity for all powers of two up to 2**30, below 2**32 so that products fit 64 bits
P = 3 * 2**30 + 1
ROOT = 5


@dataclass(frozen=True)
class Run:
    start: int
    length: int
    period: int

    @property
    def stop(self) -> int:
        return self.start + self.length


def _powers_of(root: int, count: int) -> np.ndarray:
    out = np.ones(1, dtype=U)
    step = root
    while len(out) < count:
        out = np.concatenate([out, out * U(step) % U(P)])
        step = step * step % P
    return out[:count]


def transform(rows: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The number-theoretic transform modulo P of each row; the length of rows is a power of two.

    Decimation in time on halves that are reordered as it goes, so no bit reversal is needed. The inverse is not divided by
    the length.
    """
    n = rows.shape[1]
    root = pow(ROOT, (P - 1) // n, P)
    if inverse:
        root = pow(root, -1, P)
    x, count = rows.reshape(len(rows), n, 1), n
    while count > 1:
        half = count // 2
        even, odd = x[:, :half, :], x[:, half:, :]
        twiddle = _powers_of(pow(root, n // count, P), half)[None, :, None]
        total = even + odd
        total -= U(P) * (total >= U(P))
        rest = (even + U(P) - odd) % U(P) * twiddle % U(P)
        x = np.concatenate([total, rest], axis=2)
        count = half
    return x.reshape(len(rows), n)


def mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For each row, the sums of squared differences, modulo P, of its block to each stretch of its window.

    Blocks have B numbers, windows up to 3 * B; the result has a column for each place at which a stretch may begin.
    """
    size, width = blocks.shape[1], windows.shape[1]
    n = 4 * size
    a, b = (np.zeros((len(blocks), n), dtype=U) for _ in range(2))
    a[:, :size] = blocks[:, ::-1]
    b[:, :width] = windows
    product = transform(transform(a) * transform(b) % U(P), inverse=True)
    cross = product[:, size - 1 : width] * U(pow(n, -1, P)) % U(P)
    own = (blocks * blocks % U(P)).sum(axis=1) % U(P)
    sums = np.zeros((len(windows), width + 1), dtype=U)
    np.cumsum(windows * windows % U(P), axis=1, out=sums[:, 1:])  # of fewer than 2**32 numbers below 2**32
    squares = (sums[:, size:] - sums[:, : width - size + 1]) % U(P)
    return (own[:, None] + squares + U(2) * (U(P) - cross)) % U(P)


def _next(codes: np.ndarray) -> np.ndarray:
    """How far the next equal code is; beyond all lengths if there is none."""
    order = np.argsort(codes, kind="stable")
    ahead = np.full(len(codes), len(codes) + 1, dtype=np.int64)
    same = codes[order[1:]] == codes[order[:-1]]
    ahead[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return ahead


def _equal(codes: np.ndarray, at: int, distance: int, step: int) -> int:
    """How many codes from ``at`` on, forwards or backwards, equal those ``distance`` further on."""
    count, size = 0, 32
    while True:
        if step > 0:
            begin = at + count
            end = min(begin + size, len(codes) - distance)
            if begin >= end:
                return count
            differ = np.flatnonzero(codes[begin:end] != codes[begin + distance : end + distance])
            found = int(differ[0]) if len(differ) else end - begin
        else:
            end = at + 1 - count
            begin = max(0, end - size)
            if begin >= end:
                return count
            differ = np.flatnonzero(codes[begin:end] != codes[begin + distance : end + distance])
            found = end - 1 - begin - int(differ[-1]) if len(differ) else end - begin
        count += found
        if found < end - begin:
            return count
        size = min(2 * size, 1 << 16)


class _Known:
    """The runs found so far, by where they begin and end."""

    def __init__(self):
        self.runs: dict[tuple[int, int], int] = {}

    def add(self, start: int, stop: int, period: int) -> None:
        # of the multiples of a period, which all give the same stretch, the smallest is the period
        self.runs[start, stop] = min(period, self.runs.get((start, stop), period))

    def covers(self, starts: np.ndarray, stops: np.ndarray, longest: int) -> np.ndarray:
        """Which of the stretches lie within one run of a period of at most ``longest``."""
        out = np.zeros(len(starts), dtype=bool)
        for (start, stop), period in self.runs.items():
            if period <= longest:
                # stretches are in order
                a, b = np.searchsorted(starts, start), np.searchsorted(stops, stop, "right")
                out[a:b] = True
        return out


def find_runs(codes: np.ndarray) -> list[Run]:
    """All runs of a sequence of codes (whole numbers from 0), by start, then period."""
    n = len(codes)
    known = _Known()
    if n < SHORTEST:
        return []
    ahead = _next(codes)
    numbers = mixed(codes.astype(U)) % U(P)  # spread, so that few sums are zero by chance
    size = FIRST
    while True:
        low = 1 if size == FIRST else size
        if TIMES * low > n or size > n:
            break
        begins = np.arange(0, n - size + 1, size)
        # a block with a word that does not come again within the window cannot occur there
        begins = begins[np.maximum.reduceat(ahead[: begins[-1] + size], begins) < 2 * size]
        # inside a run of a shorter period a block occurs again at its multiples only, which seed the same run
        begins = begins[~known.covers(begins, np.minimum(begins + 3 * size, n), size - 1)]
        per_table = max(1, TABLE // (4 * size))
        seeds: list[tuple[int, int]] = []
        for first in range(0, len(begins), per_table):
            some = begins[first : first + per_table]
            places = some[:, None] + np.arange(low, 3 * size)[None, :]
            windows = np.where(places < n, numbers[np.minimum(places, n - 1)], U(0))
            blocks = numbers[some[:, None] + np.arange(size)[None, :]]
            row, shift = np.nonzero(mismatches(blocks, windows) == 0)
            distance = shift[shift < 2 * size - low] + low
            at = some[row[shift < 2 * size - low]]
            fits = at + distance + size <= n
            seeds.extend(zip(distance[fits].tolist(), at[fits].tolist(), strict=True))
        _extend(codes, sorted(seeds), size, known)
        size *= 2
    return sorted((Run(a, b - a, q) for (a, b), q in known.runs.items()), key=lambda r: (r.start, r.period))


def _extend(codes: np.ndarray, seeds: list[tuple[int, int]], size: int, known: _Known) -> None:
    """Extend the seeds, pairs of a distance and a block, in order; runs are added to those known."""
    for distance, group in groupby(seeds, key=lambda seed: seed[0]):
        begins = np.array([at for _, at in group], dtype=np.int64)
        within = np.zeros(len(begins), dtype=bool)
        for (start, stop), period in known.runs.items():
            if distance % period == 0:
                within |= (begins >= start) & (begins + size + distance <= stop)
        reached = -1
        for at in begins[~within].tolist():
            if at + size <= reached:
                continue
            right = at + _equal(codes, at, distance, 1)
            if right - at < size:
                continue  # the sum was zero by chance
            left = at - _equal(codes, at - 1, distance, -1)
            reached = right
            if right + distance - left >= max(SHORTEST, TIMES * distance):
                known.add(left, right + distance, distance)


def runs_of_documents(documents: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each document, a list of words."""
    numbers: dict[bytes, int] = {}
    lengths = np.array([len(words) for words in documents], dtype=np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    codes = np.empty(int(lengths.sum()) + len(documents), dtype=np.int64)
    for start, words in zip(starts.tolist(), documents, strict=True):
        codes[start : start + len(words)] = [numbers.setdefault(w, len(numbers)) for w in words]
    between = starts + lengths
    codes[between] = len(numbers) + np.arange(len(documents))
    out: list[list[Run]] = [[] for _ in documents]
    for run in find_runs(codes):
        document = int(np.searchsorted(starts, run.start, "right")) - 1
        out[document].append(Run(run.start - int(starts[document]), run.length, run.period))
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words), dtype=bool)
    for run in runs:
        gone[run.start + run.period : run.stop] = True
    return [words[i] for i in np.flatnonzero(~gone).tolist()]


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest length by period; of equal ones that which begins first, then that of the smallest period."""
    return min(runs, key=lambda r: (-Fraction(r.length, r.period), r.start, r.period), default=None)


def words_of(data: bytes) -> list[bytes]:
    """The words of a text: what lies between spaces, tabs, line feeds, form feeds, vertical tabs and carriage returns."""
    return data.split()


RUNS = "array<struct<start: long, length: long, period: long>>"


def periodic_runs(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    change: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """A row for each document with its id, ``runs`` (by start, then period; word numbers from 0) and ``collapsed``.

    ``collapsed`` holds the words that no run repeats, joined by one space. Words are what white space (ASCII) separates, as
    they are; ``change`` may replace a document's words, given its id. A null or empty text has no words and no runs, and
    collapses to an empty text. No documents give no rows; repeated rows count each; ties between runs are all kept; other
    columns are left out, so none can clash. Texts are worked through whole, in groups of about ``GROUP_BYTES``; nothing is
    shuffled.
    """
    kind = docs.schema[doc_id]
    schema = T.StructType(
        [
            kind,
            T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))),
            T.StructField("collapsed", T.StringType()),
        ]
    )
    arrow = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def group(ids: pa.Array, data: list[bytes]) -> pa.RecordBatch:
        documents = [words_of(x) for x in data]
        if change is not None:
            documents = [change(i, words) for i, words in zip(ids.to_pylist(), documents, strict=True)]
        found = runs_of_documents(documents)
        rows = [[{"start": r.start, "length": r.length, "period": r.period} for r in runs] for runs in found]
        kept = [b" ".join(collapsed(words, runs)).decode() for words, runs in zip(documents, found, strict=True)]
        return pa.RecordBatch.from_arrays([ids, pa.array(rows, arrow), pa.array(kept, pa.string())], names=schema.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, size = 0, [], 0
            for data in texts(batch.column(text)):
                if held and size + len(data) > GROUP_BYTES:
                    yield group(batch.column(doc_id).slice(first, len(held)), held)
                    first, held, size = first + len(held), [], 0
                held.append(data)
                size += len(data)
            if held:
                yield group(batch.column(doc_id).slice(first, len(held)), held)

    return docs.select(doc_id, text).mapInArrow(work, schema)
