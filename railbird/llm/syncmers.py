"""Fingerprints of documents from closed syncmers.

A closed syncmer is a run of K characters whose smallest inner run of S characters (by hash) is its first or its last.
Whether a run is one depends on nothing around it, so an edit moves no anchor that it does not touch, and two texts share
the anchors of every passage they share. ``anchors`` gives them with their places, for positional matching;
``fingerprint`` folds them into a sketch of fixed length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbird.llm.text import SLICE, U, annotate, mixed, numbers, powers, texts

K, S = 12, 6
BINS = 256  # of the sketch, a power of two
EMPTY = 0xFFFF
_FACTORS = numbers(11, 2) | U(1)


def _runs(sums: np.ndarray, width: int, down: np.ndarray) -> np.ndarray:
    """A hash of each run of ``width`` characters, from the running sums of weighted characters."""
    n = len(sums) - width
    return mixed((sums[width:] - sums[:n]) * down[:n])


def syncmers(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and hashes of the closed syncmers among code points, piece by piece. A shorter text is one anchor itself."""
    total = len(codes)
    if 0 < total < K:
        up, _ = powers(total)
        yield np.zeros(1, dtype=np.int64), mixed(np.array([((codes + U(1)) * up[:total]).sum() + U(total)]))
        return
    for start in range(0, max(0, total - K + 1), SLICE):
        piece = codes[start : start + SLICE + K - 1]
        up, down = powers(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, dtype=U)
        np.cumsum(mixed(piece + _FACTORS[0]) * up[: len(piece)], out=sums[1:])
        inner = _runs(sums, S, down)
        ends = K - S  # from the first inner run of a K-run to its last
        smallest, width = inner, 1
        while width < ends + 1:
            step = min(width, ends + 1 - width)
            smallest = np.minimum(smallest[:-step], smallest[step:])
            width += step
        place = np.flatnonzero((inner[: len(smallest)] == smallest) | (inner[ends:] == smallest))
        yield place + start, mixed((sums[place + K] - sums[place]) * down[place])


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(U)


def sketch(text: str) -> np.ndarray:
    """The anchors dealt to bins by hash, and the smallest of each bin as 16 bits; in the last place their number."""
    bins = np.full(BINS, ~U(0), dtype=U)
    count = 0
    for _, hashes in syncmers(codes_of(text)):
        found = np.unique(hashes)
        count += len(found)
        # sorted by hash, the first of each bin is its smallest; bins are the upper bits
        at = (found >> U(56)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        bins[at[first]] = np.minimum(bins[at[first]], found[first])
    out = np.full(BINS + 2, EMPTY, dtype=np.uint16)
    used = bins != ~U(0)
    out[:BINS][used] = ((bins[used] >> U(32)) & U(0xFFFF)) % U(EMPTY)
    out[BINS], out[BINS + 1] = count >> 16 & 0xFFFF, count & 0xFFFF
    return out


def fingerprint(text: str) -> str:
    return sketch(text).astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The part of their anchors that two sketches share, from 0 to 1: twice the common ones by the sum of both.

    Two empty texts are alike, an empty and another text are not.
    """
    used = (a[:BINS] != EMPTY) | (b[:BINS] != EMPTY)
    n = int(used.sum())
    if not n:
        return 1.0
    same = int((a[:BINS][used] == b[:BINS][used]).sum())
    return 2.0 * same / (n + same)


def anchors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each anchor of each document: its id, ``place`` (in code points) and ``anchor`` (a hash)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(texts(batch.column(text))):
                for place, hashes in syncmers(codes_of(data.decode())):
                    ids = batch.column(doc_id).slice(i, 1).take(pa.array(np.zeros(len(place), dtype=np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(place), pa.array(hashes.view(np.int64))], names=[doc_id, "place", "anchor"]
                    )

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(doc_id, text).mapInArrow(work, f"{doc_id} {kind}, place long, anchor long")


def matches(left: DataFrame, right: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Passages that documents of two anchor tables share: pairs of ids, the ``shift`` between the places, and the anchors
    (``n``) that agree on it, with the places (``first``, ``last``) of the outermost in the left document."""
    a, b = (x.select(F.col(doc_id).alias(side), F.col("place").alias(f"{side}_at"), "anchor") for x, side in ((left, "a"), (right, "b")))
    return (
        a.join(b, "anchor")
        .groupBy("a", "b", (F.col("b_at") - F.col("a_at")).alias("shift"))
        .agg(F.count("*").alias("n"), F.min("a_at").alias("first"), F.max("a_at").alias("last"))
    )


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of each text; a null has that of an empty text. A column named like ``out`` is replaced."""
    return annotate(
        docs, f"{out} string", lambda batch: [pa.array([fingerprint(x.decode()) for x in texts(batch.column(text))], pa.string())]
    )


def in_order(docs: DataFrame, doc_id: str, text: str, slices: int | None = None) -> DataFrame:
    """Rows ``_range, _guest, _id, _text`` such that a task reads a range in the order of ids, and then what follows it.

    Ids are cut into ranges by quantiles. The first row of a range is also sent to the range before it, as a guest; the
    first of all to the last range. Only ids are gathered for this, one for each range. Rows of one id are ordered by a
    hash of their texts; a null id comes first.
    """
    slices = slices or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(text, F.lit("")).alias("_text")).withColumns(
        {"_key": F.coalesce(F.col("_id").cast("long"), F.lit(-(2**63))), "_tie": F.xxhash64("_text")}
    )
    quantiles = [i / slices for i in range(1, slices)] or [0.5]
    cuts = rows.agg(F.percentile_approx("_key", quantiles, 20 * slices).alias("cuts")).head()["cuts"]
    bounds = np.unique(np.array(cuts or [], dtype=np.int64))

    def ranges(keys: pa.Array) -> np.ndarray:
        return np.searchsorted(bounds, keys.to_numpy(zero_copy_only=False), "left").astype(np.int32)

    keyed = annotate(rows.select("_key", "_tie"), "_range int", lambda batch: [pa.array(ranges(batch.column("_key")))])
    firsts = keyed.groupBy("_range").agg(F.min(F.struct("_key", "_tie")).alias("first")).orderBy("_range").collect()
    before = {firsts[i]["_range"]: firsts[i - 1]["_range"] for i in range(len(firsts))}
    first = {r["_range"]: tuple(r["first"]) for r in firsts}

    def places(batch: pa.RecordBatch) -> list:
        own, ties = ranges(batch.column("_key")).tolist(), batch.column("_tie").to_pylist()
        to = [
            [(r, False), (before[r], True)] if first.get(r) == (key, tie) else [(r, False)]
            for r, key, tie in zip(own, batch.column("_key").to_pylist(), ties, strict=True)
        ]
        kind = pa.list_(pa.struct([("_range", pa.int32()), ("_guest", pa.bool_())]))
        return [pa.array([[{"_range": r, "_guest": g} for r, g in x] for x in to], kind)]

    dealt = annotate(rows, "_to array<struct<_range: int, _guest: boolean>>", places).select("*", F.inline("_to"))
    ordered = dealt.repartition("_range").sortWithinPartitions("_range", "_guest", "_key", "_tie")
    return ordered.select("_range", "_guest", "_id", "_text")


EDITED = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """``text`` with the last half of its characters replaced by as many (or all) of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint each document and its edited text (see ``edited``), and compare both with it and with the next one.

    Returns the id and the columns of ``EDITED``. Nulls are empty texts; equal texts get equal fingerprints. Rows of one id
    follow each other by a hash of their texts, a null id comes first, and a single row is followed by itself; no rows give
    none. Other columns are left out. Texts are shuffled once, by range of ids.
    """
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row that waits for the one after it: range, guest, id, text, sketch
        for batch in batches:
            ids, rows = [], []
            columns = [batch.column(c).to_pylist() for c in ("_range", "_guest", "_id")]
            for place, guest, own, data in zip(*columns, texts(batch.column("_text")), strict=True):
                row = (place, guest, own, data.decode())
                mine = last[4] if last and last[3] == row[3] else sketch(row[3])
                if last and last[0] == place and not last[1]:
                    ids.append(last[2])
                    rows.append(compared(last[3], row[3], last[4], mine))
                last = (*row, mine)
            columns = list(zip(*rows, strict=True)) or [()] * 6
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column("_id").type), *arrays], names=[doc_id, *names])

    kind = dict(docs.dtypes)[doc_id]
    return in_order(docs, doc_id, text).mapInArrow(work, f"{doc_id} {kind}, {EDITED}")


def compared(text: str, after: str, mine: np.ndarray, other: np.ndarray) -> tuple:
    changed = edited(text, after)
    theirs = sketch(changed)
    prints = [x.astype(">u2").tobytes().hex() for x in (mine, theirs)]
    return len(text), hashlib.sha256(changed.encode()).hexdigest(), *prints, likeness(mine, theirs), likeness(mine, other)
