"""Benchmark passages in documents, found by Wu-Manber search over words.

A window is a run of ``width`` words of a benchmark item (a whole shorter item is one). For windows of one length m, a
table holds for each block of two words how far the search may shift: m - j, if the block ends at word j of some window
at the latest, and m - 1 if it is in none. Where the shift is 0, the windows that end in that block are in a bucket, and
each is compared with the document's words directly. Windows of other lengths have tables of their own.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbird.llm.text import ALNUM, annotate, numbers, texts, word_hashes

# windows are taken to the tasks in slices of at most so many bytes of benchmark text
SLICE_BYTES = 32 << 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_FACTORS = numbers(3, 2) | np.uint64(1)


def words(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def _blocks(hashes: np.ndarray) -> list[int]:
    """A value for each pair of neighbouring words."""
    return (hashes[:-1] * _FACTORS[0] + hashes[1:] * _FACTORS[1]).tolist()


class Windows:
    """The search tables for windows of one length."""

    def __init__(self, length: int):
        self.length = length
        self.block = min(2, length)
        self.items: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, list[tuple[bytes, ...]]] = defaultdict(list)

    def add(self, window: tuple[bytes, ...], blocks: list[int], item: str) -> None:
        if window not in self.items:
            for j, block in enumerate(blocks):
                left = self.length - self.block - j
                self.shift[block] = min(left, self.shift.get(block, left))
            self.bucket[blocks[-1]].append(window)
        self.items[window].add(item)

    def find(self, blocks: list[int], words_of: Words) -> list[tuple[int, tuple[bytes, ...]]]:
        """The first words of all occurrences, with the window found."""
        found, shift, far = [], self.shift.get, self.length - self.block + 1
        back = self.length - self.block
        i, n = back, len(blocks)
        while i < n:
            step = shift(blocks[i], far)
            if step:
                i += step
                continue
            here = tuple(words_of()[i - back : i - back + self.length])
            found += [(i - back, window) for window in self.bucket[blocks[i]] if window == here]
            i += 1
        return found


class Words:
    """The words of a text, split only when first asked for."""

    def __init__(self, text: bytes):
        self.text = text
        self.words: list[bytes] | None = None

    def __call__(self) -> list[bytes]:
        if self.words is None:
            self.words = words(self.text)
        return self.words


def tables(items: list[tuple[str, bytes]], width: int) -> list[Windows]:
    by_length: dict[int, Windows] = {}
    for item, text in items:
        own, hashes = words(text), word_hashes(text, ALNUM)
        length = min(width, len(own))
        if not length:
            continue
        search = by_length.setdefault(length, Windows(length))
        blocks = _blocks(hashes) if search.block == 2 else hashes.tolist()
        per_window = length - search.block + 1
        for i in range(len(own) - length + 1):
            search.add(tuple(own[i : i + length]), blocks[i : i + per_window], item)
    return list(by_length.values())


def occurrences(text: bytes, searches: list[Windows]) -> tuple[int, list[tuple[int, int]], set[str]]:
    """The number of words, the disjoint spans of words that are inside occurrences, and the items that occur."""
    hashes = word_hashes(text, ALNUM)
    own, items, spans = Words(text), set(), []
    pairs = _blocks(hashes) if len(hashes) > 1 else []
    for search in searches:
        for start, window in search.find(pairs if search.block == 2 else hashes.tolist(), own):
            spans.append((start, start + search.length))
            items |= search.items[window]
    joined: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if joined and start <= joined[-1][1]:
            joined[-1] = joined[-1][0], max(end, joined[-1][1])
        else:
            joined.append((start, end))
    return len(hashes), joined, items


FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, stop: long>>"


def _search(docs: DataFrame, text: str, items: list[tuple[str, bytes]], width: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)
    kept: dict[str, list[Windows]] = {}

    def work(batch: pa.RecordBatch) -> list:
        if "searches" not in kept:
            kept["searches"] = tables(sent.value, width)
        rows = [occurrences(x, kept["searches"]) for x in texts(batch.column(text))]
        return [
            pa.array([n for n, _, _ in rows], pa.int64()),
            pa.array([sum(b - a for a, b in spans) for _, spans, _ in rows], pa.int64()),
            pa.array([sorted(found) for _, _, found in rows], pa.list_(pa.string())),
            pa.array(
                [[{"start": a, "stop": b} for a, b in spans] for _, spans, _ in rows],
                pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])),
            ),
        ]

    return annotate(docs, FOUND, work)


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    width: int = 13,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Add to each document its words, those inside an occurrence of a window, the items found (ids as sorted strings),
    and the spans of words found.

    Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z as a-z. A null or empty text has none.
    Repeated documents and items are each searched; items with one id count as one, an item without an id is ``null``,
    and one without words is never found. Columns of ``docs`` named like the added ones are replaced. Documents are not
    shuffled: the benchmark is brought to them, whole if it is at most ``slice_bytes``. A larger one is searched slice
    by slice, and what the slices found is joined by document.
    """
    items = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("text")
    ).where(F.octet_length("text") > 0)
    size = items.agg(F.sum(F.octet_length("text") + 64)).head()[0] or 0
    slices = -(-size // slice_bytes)

    def part(k: int) -> list[tuple[str, bytes]]:
        some = items if slices <= 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == k)
        return [(r["item"], r["text"].encode()) for r in some.distinct().toLocalIterator()]

    if slices <= 1:
        return _search(docs, text, part(0), width)
    # what is found depends on the text alone, so equal texts are put together by a digest
    kept = [c for c in docs.columns if c not in ("n_words", "n_hit", "items", "spans")]
    keyed = docs.select(*kept).withColumn("_key", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    narrow = keyed.select("_key", F.col(text).alias("_text"))
    first = [F.first(c).alias(c) for c in ("n_words", "items", "spans")]
    found = [_search(narrow, "_text", part(k), width).groupBy("_key").agg(*first) for k in range(slices)]
    whole = reduce(DataFrame.unionByName, found).groupBy("_key").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("_all"),
    )
    return keyed.join(_joined(whole), "_key").select(*kept, "n_words", "n_hit", "items", "spans")


def _joined(df: DataFrame) -> DataFrame:
    """Put the sorted spans of ``_all`` together where they touch, and count the words in them."""
    span = "struct<start: bigint, stop: bigint>"
    spans = f"""aggregate(_all, cast(array() as array<{span}>), (done, x) ->
        if(size(done) > 0 and x.start <= element_at(done, -1).stop,
           concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start,
                  'stop', greatest(x.stop, element_at(done, -1).stop)))),
           concat(done, array(x))))"""
    return (
        df.withColumn("spans", F.expr(spans))
        .withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, x) -> n + x.stop - x.start)"))
        .drop("_all")
    )


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit"):
    """Whether at least a twentieth of the words are inside occurrences."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))


