"""The language of a text, from Bloom filters that return a bit mask of languages for each character trigram.

The filter is bit-sliced: a row for each hash position, a bit for each language. The rows of a trigram's positions ANDed
together are the languages that contain it. A language scores the trigrams of a text that it contains, less those that
its part of the filter would let pass by chance.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbird.llm.text import SLICE, U, annotate, mixed, numbers, texts
from railbird.operators.groups import durable

ROWS = 1 << 20
HASHES = 4
MIN_SHARE = 0.005  # of a language's documents must contain a trigram of it
MIN_RATIO = 0.1  # of the share in the language where it is most common
FLUSH = 1 << 22
UNDETERMINED = "und"
_FACTORS = numbers(7, 3) | U(1)


@functools.cache
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 where it is no letter."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def trigrams(text: bytes) -> Iterator[np.ndarray]:
    """Hashes of the runs of three characters around each letter, piece by piece; a run of non-letters counts as one gap."""
    string = text.decode("utf-8", "replace")
    for start in range(0, len(string), SLICE):
        # a character more on either side, so that pieces meet without a break
        piece = string[max(0, start - 1) : start + SLICE + 1]
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        chars = np.concatenate([[0], letters()[codes], [0]]).astype(U)
        if start:
            chars = chars[1:]
        if start + SLICE < len(string):
            chars = chars[:-1]
        middle = np.flatnonzero(chars[1:-1])
        if len(middle):
            yield mixed(
                chars[middle] * _FACTORS[0] + chars[middle + 1] * _FACTORS[1] + chars[middle + 2] * _FACTORS[2]
            )


def document_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """Per language (``lang``) and trigram (``gram``), the documents that contain it (``n``); gram null counts all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[np.ndarray]] = {}
        held, seen = 0, {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, parts in kept.items():
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n, pa.int64())],
                    names=["lang", "gram", "n"],
                )
            kept.clear()

        for batch in batches:
            for name, data in zip(batch.column(lang).to_pylist(), texts(batch.column(text)), strict=True):
                pieces = [np.unique(piece) for piece in trigrams(data)]
                if not pieces:
                    continue
                grams = pieces[0] if len(pieces) == 1 else np.unique(np.concatenate(pieces))
                kept.setdefault(name, []).append(grams)
                seen[name] = seen.get(name, 0) + 1
                held += len(grams)
                if held > FLUSH:
                    yield from flush()
                    held = 0
        yield from flush()
        if seen:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(seen), pa.string()),
                    pa.array([None] * len(seen), pa.int64()),
                    pa.array(list(seen.values()), pa.int64()),
                ],
                names=["lang", "gram", "n"],
            )

    counted = docs.select(text, lang).mapInArrow(count, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def positions(grams: np.ndarray) -> list[np.ndarray]:
    """The rows of the filter for each trigram, by double hashing."""
    first, step = grams & U(0xFFFFFFFF), (grams >> U(32)) | U(1)
    return [((first + U(k) * step) % U(ROWS)).astype(np.int64) for k in range(HASHES)]


@dataclass
class Filters:
    languages: list[str]
    rows: np.ndarray  # bytes of masks: ROWS x enough bytes for a bit a language
    chance: np.ndarray  # that a trigram not in a language passes its filter

    def score(self, text: bytes) -> tuple[str, float]:
        """The language with most trigrams above chance, and its part of the best two; ``und`` without letters."""
        total, hits = 0, np.zeros(self.rows.shape[1] * 8)
        for grams in trigrams(text):
            masks = functools.reduce(np.bitwise_and, [self.rows[p] for p in positions(grams)])
            total += len(grams)
            hits += np.unpackbits(masks, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        if not total or not self.languages:
            return UNDETERMINED, 0.0
        hits = hits[: len(self.languages)]
        above = np.maximum(0.0, (hits - total * self.chance) / (1 - self.chance))
        best = int(np.argmax(above))
        rest = np.delete(above, best)
        second = float(rest.max()) if len(rest) else 0.0
        return self.languages[best], float(above[best] / (above[best] + second)) if above[best] > 0 else 0.0


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Filters:
    """Filters from all texts with a language. Their size is fixed by the number of languages; the driver gets only them.

    A language's trigrams are those in ``MIN_SHARE`` of its documents, where that is at least ``MIN_RATIO`` of their share
    in any other language; so there are at most (trigrams of a document) / ``MIN_SHARE`` a language, at any input size.
    """
    known = docs.where(F.col(lang).isNotNull())
    counts = durable(document_counts(known, text, lang))
    sizes = counts.where(F.col("gram").isNull()).select("lang", F.col("n").alias("docs"))
    languages = [r["lang"] for r in sizes.orderBy(F.desc("docs"), "lang").collect()]
    width = max(1, -(-len(languages) // 8))
    rows = np.zeros((ROWS, width), dtype=np.uint8)
    if languages:
        place = F.create_map(*[x for i, name in enumerate(languages) for x in (F.lit(name), F.lit(i))])
        shares = counts.where(F.col("gram").isNotNull()).join(F.broadcast(sizes), "lang")
        shares = shares.withColumn("share", F.col("n") / F.col("docs")).where(F.col("share") >= MIN_SHARE)
        most = shares.groupBy("gram").agg(
            F.max("share").alias("most"), F.collect_list(F.struct("share", place[F.col("lang")].alias("at"))).alias("all")
        )
        members = most.select("gram", "most", F.inline("all")).where(F.col("share") >= F.col("most") * MIN_RATIO)

        def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                grams = batch.column("gram").to_numpy().view(U)
                at = batch.column("at").to_numpy()
                for found in positions(grams):
                    yield pa.RecordBatch.from_pydict(
                        {"row": found, "byte": at // 8, "mask": (1 << (at % 8)).astype(np.int32)}
                    )

        filled = members.select("gram", "at").mapInArrow(rows_of, "row long, byte int, mask int")
        for r in filled.groupBy("row", "byte").agg(F.bit_or("mask").alias("mask")).toLocalIterator():
            rows[r["row"], r["byte"]] = r["mask"]
    fill = np.unpackbits(rows, axis=1, bitorder="little").mean(axis=0)[: len(languages)]
    return Filters(languages, rows, fill**HASHES)


def identify(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1) to each document.

    ``und`` with score 0 stands for a text that is null, empty or without a letter. Equal texts get equal answers; ties go
    to the language with more training documents. Columns of these names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def work(batch: pa.RecordBatch) -> list:
        found = [sent.value.score(x) for x in texts(batch.column(text))]
        return [pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())]

    return annotate(docs, "lang_pred string, score double", work)
