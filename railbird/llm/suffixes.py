"""Removal of passages that occur more than once, by a distributed merge sort of suffixes.

A byte goes if a string of ``width`` bytes that covers it also begins anywhere else. Two equal strings of that length have
their anchors at the same places: an anchor is the beginning of the half-width string whose hash is the smallest (the first of
equal ones) of those within some string of ``width`` bytes. So only the suffixes that begin at anchors are sorted, about one
in a quarter of ``width``.

* Every piece of the corpus (some documents) tells the hashes of its anchors' half-width strings; only anchors whose hash is
  found twice in the corpus go on. Equal strings have equal hashes, so none is lost.
* A piece sorts its suffixes, ``width`` bytes from each anchor and the half width before it, backwards. Equal ones are one
  entry. The run is front-coded: of each entry only what it does not share with the one before it is sent. Runs are cut by the
  hashes, so suffixes that share their half-width string meet.
* Runs are merged by a loser tree that carries, for each run, how much its next entry shares with the last one put out. Two
  entries are compared only where both share the same number of bytes with it, and only from there on.
* In merged order, neighbours tell how far any two suffixes agree after their anchor; the order of what lies before the
  anchors tells how far they agree there. For each place of a string of ``width`` bytes around an anchor, those that agree far
  enough on both sides are equal. The first and the last such string of an anchor bound what it removes.

Documents are kept apart by the byte 0xFF, which UTF-8 does not have.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from railbird.llm.katz import cuts, packed, packed_keys, released, squeezed, unpacked, unpacked_keys
from railbird.llm.text import U, mixed, numbers, powers, texts
from railbird.operators.groups import shared_dir

PIECE_BYTES = 2 << 20  # of text, unless one text is longer
PART_BYTES = 4 << 20  # of text whose suffixes meet in a task, on average
SLICE = 1 << 18  # bytes whose hashes are worked out at a time
ROWS = 1 << 11  # contexts gathered at a time
WIDTH = 200
APART = 0xFF
_CODES = numbers(41, 256) | U(1)


# pieces of the corpus


def pack(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A row for each piece: its number, the ids and lengths of its documents, and their texts as one, compressed.

    Written once to the shared folder, as numbers of pieces depend on how a scan is split.
    """
    spark = docs.sparkSession
    kind, arrow = docs.schema[doc_id].dataType.simpleString(), to_arrow_type(docs.schema[doc_id].dataType)

    def row(piece: int, ids: list[pa.Array], data: list[bytes]) -> pa.RecordBatch:
        each = pa.concat_arrays(ids) if ids else pa.array([], arrow)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([piece], pa.int64()),
                pa.ListArray.from_arrays([0, len(each)], each),
                pa.array([[len(x) for x in data]], pa.list_(pa.int64())),
                pa.array([squeezed(b"".join(data))], pa.binary()),
            ],
            names=["piece", "ids", "lengths", "texts"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, ids, data, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for i, own in enumerate(texts(batch.column(1))):
                if data and size + len(own) > PIECE_BYTES:
                    yield row(piece, ids, data)
                    piece, ids, data, size = piece + 1, [], [], 0
                ids.append(batch.column(0).slice(i, 1))
                data.append(own)
                size += len(own)
        if data:
            yield row(piece, ids, data)

    folder = f"{shared_dir(spark)}/pieces/{uuid.uuid4().hex}"
    schema = f"piece long, ids array<{kind}>, lengths array<long>, texts binary"
    docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).mapInArrow(work, schema).write.parquet(folder)
    return spark.read.schema(schema).parquet(folder)


@dataclass
class Piece:
    data: np.ndarray
    begins: np.ndarray  # of documents
    ends: np.ndarray

    @classmethod
    def of(cls, texts_: bytes, lengths: list[int]) -> Piece:
        ends = np.cumsum(np.array(lengths, dtype=np.int64))
        return cls(np.frombuffer(released(texts_), dtype=np.uint8), ends - np.array(lengths, dtype=np.int64), ends)


def anchors(piece: Piece, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors: of each string of ``width`` bytes within a document, its smallest half-width string."""
    half, n = width // 2, len(piece.data)
    reach = width - half + 1  # half-width strings in one of width
    edge = np.zeros(n + 1, dtype=np.int8)
    long = piece.ends - piece.begins >= width
    edge[piece.begins[long]] = 1
    edge[piece.ends[long] - width + 1] -= 1
    inside = np.cumsum(edge, dtype=np.int8).astype(bool)
    low = U((1 << int(SLICE + width).bit_length()) - 1)
    places, hashes = [], []
    for start in range(0, n - width + 1, SLICE):
        codes = piece.data[start : start + SLICE + width - 1]
        up, down = powers(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, dtype=U)
        np.cumsum(_CODES[codes] * up[: len(codes)], out=sums[1:])
        count = len(codes) - half + 1
        each = mixed((sums[half:] - sums[:count]) * down[:count])
        # the place in the lower bits makes the first of equal hashes the smallest
        smallest, span = (each & ~low) | np.arange(count, dtype=U), 1
        while span < reach:
            step = min(span, reach - span)
            smallest = np.minimum(smallest[:-step], smallest[step:])
            span += step
        found = (smallest[inside[start : start + len(smallest)]] & low).astype(np.int64)
        found = found[np.flatnonzero(np.diff(found, prepend=-1))]
        places.append(found + start)
        hashes.append(mixed(each[found]))  # the smallest hashes are no even share of all; these are
    if not places:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=U)
    # slices overlap by a string less one byte, so they share anchors; places are in order otherwise
    both, first = np.unique(np.concatenate(places), return_index=True)
    return both, np.concatenate(hashes)[first]


# which hashes are found twice


def asked(pieces: DataFrame, parts: int, width: int) -> DataFrame:
    """For each piece and partition the distinct hashes of its anchors, and which of them it has twice or more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                _, hashes = anchors(Piece.of(r["texts"], r["lengths"]), width)
                keys, counts = np.unique(hashes, return_counts=True)
                runs = cuts(keys, parts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p for p, _ in runs], pa.int32()),
                        pa.array([r["piece"]] * len(runs), pa.int64()),
                        pa.array([packed_keys(keys[run]) for _, run in runs], pa.binary()),
                        pa.array([np.packbits(counts[run] > 1).tobytes() for _, run in runs], pa.binary()),
                    ],
                    names=["part", "piece", "keys", "twice"],
                )

    return pieces.select("piece", "lengths", "texts").mapInArrow(work, "part int, piece long, keys binary, twice binary")


def told(rows: DataFrame) -> DataFrame:
    """For each row of ``asked``, which of its hashes are found twice in the corpus."""

    def work(table: pa.Table) -> pa.Table:
        each = [unpacked_keys(x) for x in table.column("keys").to_pylist()]
        twice = [
            np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=len(k)).astype(bool)
            for x, k in zip(table.column("twice").to_pylist(), each, strict=True)
        ]
        keys = np.concatenate(each)
        _, at, counts = np.unique(keys, return_inverse=True, return_counts=True)
        weight = np.bincount(at, np.concatenate(twice), minlength=len(counts)) + counts
        ends = np.cumsum([len(k) for k in each])
        repeated = np.split(weight[at] > 1, ends[:-1])
        return pa.table(
            {
                "part": table.column("part"),
                "piece": table.column("piece"),
                "n": pa.array([len(k) for k in each], pa.int32()),
                "repeated": pa.array([np.packbits(x).tobytes() for x in repeated], pa.binary()),
            }
        )

    return rows.groupBy("part").applyInArrow(work, "part int, piece long, n int, repeated binary")


# sorted runs


def contexts(piece: Piece, places: np.ndarray, width: int) -> Iterator[list[bytes]]:
    """For each place ``width`` bytes from it on and half as many before it, backwards; bytes of no document are ``APART``."""
    half = width // 2
    steps = np.concatenate([np.arange(width), -1 - np.arange(half)])
    for first in range(0, len(places), ROWS):
        some = places[first : first + ROWS]
        doc = np.searchsorted(piece.ends, some, "right")
        at = some[:, None] + steps[None, :]
        inside = (at >= piece.begins[doc][:, None]) & (at < piece.ends[doc][:, None])
        rows = np.where(inside, piece.data[np.where(inside, at, 0)], np.uint8(APART))
        yield rows.astype(np.uint8).view(f"V{len(steps)}").ravel().tolist()


def shared(rows: np.ndarray) -> np.ndarray:
    """How many bytes each of different rows shares with the one before it; the first shares none."""
    out = np.zeros(len(rows), dtype=np.int64)
    out[1:] = np.argmax(rows[1:] != rows[:-1], axis=1)
    return out


RUN = "part int, piece long, shared binary, rest binary, counts binary, places binary"
RUN_SCHEMA = pa.schema([("part", pa.int32()), ("piece", pa.int64())] + [(c, pa.binary()) for c in ("shared", "rest", "counts", "places")])


def sorted_runs(piece: Piece, number: int, repeated: np.ndarray, parts: int, width: int) -> list[dict]:
    """The front-coded runs of a piece, one for each partition; ``repeated`` marks its distinct hashes in order."""
    places, hashes = anchors(piece, width)
    keys, at = np.unique(hashes, return_inverse=True)
    kept = repeated[at]
    places, hashes = places[kept], hashes[kept]
    entries: dict[int, dict[bytes, list[int]]] = {}
    of = (((hashes >> U(32)) * U(parts)) >> U(32)).tolist()
    done = 0
    for rows in contexts(piece, places, width):
        for context, place, part in zip(rows, places[done : done + len(rows)].tolist(), of[done : done + len(rows)], strict=True):
            entries.setdefault(part, {}).setdefault(context, []).append(place)
        done += len(rows)
    out = []
    size = width + width // 2
    for part, own in entries.items():
        order = sorted(own)
        rows = np.frombuffer(b"".join(order), dtype=np.uint8).reshape(-1, size)
        same = shared(rows)
        out.append(
            {
                "part": part,
                "piece": number,
                "shared": packed(same.astype(np.uint16)),
                "rest": squeezed(rows[np.arange(size)[None, :] >= same[:, None]].tobytes()),
                "counts": packed(np.array([len(own[x]) for x in order], dtype=np.int64)),
                "places": packed(np.concatenate([own[x] for x in order]).astype(np.int64)),
            }
        )
    return out


# merging


def entries_of(run: dict, size: int) -> Iterator[tuple[bytes, int]]:
    """The entries of a front-coded run, each with how many bytes it shares with the one before it."""
    rest, at, last = released(run["rest"]), 0, b""
    for same in unpacked(run["shared"], np.uint16).tolist():
        last = last[:same] + rest[at : at + size - same]
        at += size - same
        yield last, same


class LoserTree:
    """Merges sorted runs of entries of one size, given with what each shares with the one before it in its run.

    ``same[i]`` is how many bytes the next entry of run i shares with the last entry put out. Of two entries, the one that
    shares more is the smaller, and what they share with each other is the less of both; nothing is compared. Where both share
    as much, they are compared from there on, and the loser keeps what it shares with the winner, which is put out before it.
    """

    def __init__(self, runs: list[Iterator[tuple[bytes, int]]], size: int):
        self.runs, self.size = runs, size
        count = 1
        while count < len(runs):
            count *= 2
        self.now: list[bytes | None] = [None] * count
        self.same = [0] * count
        for i in range(len(runs)):
            self._advance(i)
            self.same[i] = 0
        self.losers = [0] * count
        self.winner = self._fill(1, count)

    def _advance(self, i: int) -> None:
        self.now[i], self.same[i] = next(self.runs[i], (None, 0))

    def _fill(self, node: int, count: int) -> int:
        if node >= count:
            return node - count
        winner, self.losers[node] = self._play(self._fill(2 * node, count), self._fill(2 * node + 1, count))
        return winner

    def _play(self, a: int, b: int) -> tuple[int, int]:
        x, y = self.now[a], self.now[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        known, other = self.same[a], self.same[b]
        if known > other:
            return a, b
        if known < other:
            return b, a
        if x == y:
            self.same[b] = self.size
            return a, b
        differ = int.from_bytes(x[known:]) ^ int.from_bytes(y[known:])
        agree = self.size - (differ.bit_length() + 7) // 8
        if x[agree] < y[agree]:
            self.same[b] = agree
            return a, b
        self.same[a] = agree
        return b, a

    def __iter__(self) -> Iterator[tuple[bytes, int, int]]:
        """Entries in order, each with its run and what it shares with the one before it."""
        count = len(self.now)
        while (entry := self.now[winner := self.winner]) is not None:
            yield entry, winner, self.same[winner]
            self._advance(winner)
            node = (winner + count) // 2
            while node:
                winner, self.losers[node] = self._play(winner, self.losers[node])
                node //= 2
            self.winner = winner


def _lengths(rows: np.ndarray) -> np.ndarray:
    """How many bytes of each row come before its first ``APART``."""
    apart = rows == APART
    return np.where(apart.any(axis=1), np.argmax(apart, axis=1), rows.shape[1])


def _neighbours(agree: np.ndarray) -> np.ndarray:
    """The most that each entry shares with any other, from what each shares with the one before it."""
    return np.maximum(agree, np.append(agree[1:], -1))


@dataclass
class Merged:
    """Different contexts in order, with how many places have each."""

    rows: np.ndarray
    agree: np.ndarray  # bytes shared with the one before
    counts: np.ndarray
    width: int
    before: np.ndarray = field(init=False)  # what an anchor removes before itself; -1 if nothing at all
    after: np.ndarray = field(init=False)  # and after its half-width string

    def __post_init__(self) -> None:
        half, width = self.width // 2, self.width
        room = width - half
        left, right = _lengths(self.rows[:, width:]), _lengths(self.rows[:, :width]) - half
        whole = self.counts > 1
        self.before, self.after = np.where(whole, left, -1), np.where(whole, right, -1)
        # what neighbours share after their half-width strings; -1 where those differ
        own = np.minimum(np.minimum(self.agree, width) - half, np.minimum(right, np.append(-1, right[:-1])))
        own = np.maximum(own, -1)
        if len(own):
            own[0] = -1
        group = np.cumsum(own < 0)
        # groups of several contexts, of which some are found only once
        several = np.bincount(group) > 1
        open_ = np.bincount(group, ~whole) > 0
        some = np.flatnonzero((several & open_)[group])
        if not len(some):
            return
        own, group, left_rows = own[some], group[some], np.ascontiguousarray(self.rows[some, width:])
        keys = left_rows.view(f"V{left_rows.shape[1]}").ravel().tolist()
        of = group.tolist()
        order = np.array(sorted(range(len(some)), key=lambda i: (of[i], keys[i])), dtype=np.int64)
        lengths = left[some][order]
        back = left_rows[order]
        equal = np.zeros(len(order), dtype=np.int64)
        same = back[1:] == back[:-1]
        equal[1:] = np.where(same.all(axis=1), back.shape[1], np.argmin(same, axis=1))
        equal = np.minimum(equal, np.minimum(lengths, np.append(-1, lengths[:-1])))
        equal[np.append(True, np.diff(group[order]) != 0)] = -1
        most_after, most_before = _neighbours(own), np.empty(len(order), dtype=np.int64)
        most_before[order] = _neighbours(equal)
        first, last = np.full(len(some), -1), np.full(len(some), -1)
        back_class = np.empty(len(order), dtype=np.int64)
        for step in range(room + 1):  # a string that begins so many bytes before the anchor
            part = np.flatnonzero((most_before >= step) & (most_after >= room - step))
            if len(part) < 2:
                continue
            back_class[order] = np.cumsum(equal < step)
            pairs = back_class[part] * (len(some) + 1) + np.cumsum(own < room - step)[part]
            _, at, counts = np.unique(pairs, return_inverse=True, return_counts=True)
            found = part[counts[at] > 1]
            last[found] = step
            first[found[first[found] < 0]] = step
        found = first >= 0
        self.before[some[found]] = np.maximum(self.before[some[found]], last[found])
        self.after[some[found]] = np.maximum(self.after[some[found]], room - first[found])


def merge(runs: list[dict], width: int) -> list[dict]:
    """The bytes that the anchors of one partition remove: for each piece, where stretches begin and end."""
    size = width + width // 2
    entries, agree, owners = [], [], []
    for entry, run, same in LoserTree([entries_of(r, size) for r in runs], size):
        if not entries or same < size:
            entries.append(entry)
            agree.append(same)
        owners.append((len(entries) - 1, run))
    if not entries:
        return []
    counts = [unpacked(r["counts"], np.int64) for r in runs]
    which, run_of = np.array(owners, dtype=np.int64).T
    # a run's entries come out in its own order
    by_run = np.argsort(run_of, kind="stable")
    which = which[by_run]
    times = np.concatenate(counts)
    total = np.bincount(which, times, minlength=len(entries)).astype(np.int64)
    found = Merged(np.frombuffer(b"".join(entries), dtype=np.uint8).reshape(-1, size), np.array(agree), total, width)
    out, at = [], 0
    for run, own in zip(runs, counts, strict=True):
        each = np.repeat(which[at : at + len(own)], own)
        at += len(own)
        gone = found.before[each] >= 0
        if gone.any():
            places, each = unpacked(run["places"], np.int64)[gone], each[gone]
            begins, ends = places - found.before[each], places + width // 2 + found.after[each]
            out.append({"piece": run["piece"], "begins": packed(begins), "ends": packed(ends)})
    return out


# all together


def removed_from(piece: Piece, rows: list[dict]) -> list[list[tuple[int, int]]]:
    """The maximal stretches of each document that the rows of ``merge`` remove."""
    out: list[list[tuple[int, int]]] = [[] for _ in piece.begins]
    if not rows:
        return out
    begins, ends = (np.concatenate([unpacked(r[c], np.int64) for r in rows]) for c in ("begins", "ends"))
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    doc = np.searchsorted(piece.ends, begins, "right")
    first = np.flatnonzero(np.append(True, (begins[1:] > ends[:-1]) | (doc[1:] != doc[:-1])))
    last = np.append(first[1:], len(begins)) - 1
    for d, a, b in zip(doc[first].tolist(), begins[first].tolist(), ends[last].tolist(), strict=True):
        out[d].append((a, b))
    return out


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """A row for each document: its id, ``n_bytes``, ``spans`` (maximal removed stretches of bytes) and ``kept`` (the rest).

    A byte is removed if a string of ``width`` bytes (an even number) within a document covers it and also begins anywhere
    else, in this document or another; strings are judged on the input. A null text is an empty one; texts shorter than
    ``width`` are kept. No documents give no rows; repeated rows are texts of their own, so each loses what they share; other
    columns are left out. ``kept`` is binary, as a cut may lie within a character.

    Pieces of about ``PIECE_BYTES`` are worked through as wholes. What meets in a task are an even share of the anchors' hashes
    and, of each, one entry for every piece that has the same context, however often it has it.
    """
    pieces = pack(docs, doc_id, text)
    size = pieces.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b))).head()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    kind, arrow = docs.schema[doc_id].dataType.simpleString(), to_arrow_type(docs.schema[doc_id].dataType)

    def runs(own: pa.Table, given: pa.Table) -> pa.Table:
        marks = sorted(given.to_pylist(), key=lambda r: r["part"])
        repeated = [np.unpackbits(np.frombuffer(r["repeated"], dtype=np.uint8), count=r["n"]).astype(bool) for r in marks]
        r = own.to_pylist()[0]
        rows = sorted_runs(Piece.of(r["texts"], r["lengths"]), r["piece"], np.concatenate(repeated), parts, width) if repeated else []
        return pa.Table.from_pylist(rows, schema=RUN_SCHEMA)

    def merged(table: pa.Table) -> pa.Table:
        schema = pa.schema([("piece", pa.int64()), ("begins", pa.binary()), ("ends", pa.binary())])
        return pa.Table.from_pylist(merge(table.to_pylist(), width), schema=schema)

    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def cut(own: pa.Table, given: pa.Table) -> pa.Table:
        r = own.select(["lengths", "texts"]).to_pylist()[0]
        piece = Piece.of(r["texts"], r["lengths"])
        kept, stretches = [], []
        for begin, end, gone in zip(piece.begins.tolist(), piece.ends.tolist(), removed_from(piece, given.to_pylist()), strict=True):
            stretches.append([{"start": a - begin, "stop": b - begin} for a, b in gone])
            edges = [begin, *[x for span in gone for x in span], end]
            kept.append(b"".join(piece.data[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True)))
        ids = own.column("ids").combine_chunks().flatten()
        return pa.table(
            {doc_id: ids.cast(arrow), "n_bytes": pa.array(r["lengths"], pa.int64()), "spans": pa.array(stretches, spans), "kept": pa.array(kept, pa.binary())}
        )

    whole = pieces.groupBy("piece")
    marks = told(asked(pieces, parts, width))
    front_coded = whole.cogroup(marks.groupBy("piece")).applyInArrow(runs, RUN)
    removed = front_coded.groupBy("part").applyInArrow(merged, "piece long, begins binary, ends binary")
    schema = f"`{doc_id}` {kind}, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary"
    return whole.cogroup(removed.groupBy("piece")).applyInArrow(cut, schema)
