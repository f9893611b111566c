"""Scores of texts by a bigram model with Katz back-off, learned from a part of the corpus.

Counts are discounted by Good-Turing where they are small. What a context thereby has left is dealt to the words not seen
after it in proportion to their unigram probabilities, by a back-off weight that makes the whole exactly 1. A unigram has
its discounted share, and all unknown words together, as one, have what that leaves.

Counts are tables partitioned by the hash of the n-gram. Documents come in chunks of consecutive rows. Each chunk asks the
tables for the distinct words and pairs that occur in it, in sorted order, so a word or pair as common as may be is asked
for once a chunk; the answers are counts in the same order. Back-off weights need sums over all that follows a context,
wherever it occurs: of each pair one chunk, its owner, adds its part, and the sums are asked for by context.

Words are known by 64-bit hashes. Requests and answers are packed arrays, a row for each chunk and partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railbird.llm.text import SPACED, U, mixed, numbers, texts, word_hashes
from railbird.operators.groups import durable

CHUNK_ROWS = 4096
PART_BYTES = 16 << 20  # of text, for each partition of the tables
K = 5  # counts above are not discounted
START, END = (U(x) for x in numbers(31, 2))
_FACTORS = numbers(32, 2) | U(1)
WORD, PAIR = 0, 1


def read_chunks(spark: SparkSession, path: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """A Parquet table with the column ``chunk``: runs of ``rows`` consecutive rows of a file, as far as a task reads it.

    Another read may cut the file, and so name the chunks, in another way.
    """
    place = (F.col("_metadata.row_index") / rows).cast("long")
    chunk = F.xxhash64("_metadata.file_path", "_metadata.file_block_start", place)
    return spark.read.parquet(path).select("*", chunk.alias("chunk"))


@dataclass
class Tokens:
    """The tokens of some documents one after the other: words and an end each."""

    words: np.ndarray
    pairs: np.ndarray  # of each token with the one before it, or the start
    starts: np.ndarray  # where each document begins
    lengths: np.ndarray


def tokens(documents: list[bytes]) -> Tokens:
    each = [word_hashes(x, SPACED) for x in documents]
    lengths = np.array([len(x) + 1 for x in each], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    words = np.empty(int(lengths.sum()), dtype=U)
    for start, own in zip(starts.tolist(), each, strict=True):
        words[start : start + len(own)] = own
        words[start + len(own)] = END
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[starts] = START
    return Tokens(words, mixed(before * _FACTORS[0] + words * _FACTORS[1]), starts, lengths)


def cuts(keys: np.ndarray, parts: int) -> list[tuple[int, slice]]:
    """The partitions that sorted keys lie in, each with its run of keys."""
    if not len(keys):
        return []
    of = ((keys >> U(32)) * U(parts)) >> U(32)
    begins = np.flatnonzero(np.diff(of, prepend=U(parts)))
    ends = [*begins[1:].tolist(), len(keys)]
    return [(int(of[a]), slice(a, b)) for a, b in zip(begins.tolist(), ends, strict=True)]


def squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def released(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def packed(values: np.ndarray) -> bytes:
    """Byte by byte of all values, so that like bytes lie together, compressed."""
    return squeezed(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes())


def unpacked(data: bytes, kind: type = U) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(released(data), dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences, whose upper bytes are zero."""
    return packed(np.diff(keys, prepend=U(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=U)


def small(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as bytes, with those from 255 on in a list of their own."""
    return squeezed(np.minimum(counts, 255).astype(np.uint8).tobytes()), counts[counts >= 255].astype(np.int64).tobytes()


def grown(low: bytes, high: bytes) -> np.ndarray:
    counts = np.frombuffer(released(low), dtype=np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(high, dtype=np.int64)
    return counts


def by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """The rows of each chunk; those of one chunk come one after the other."""
    now, held = None, []
    for batch in batches:
        chunks = batch.column("chunk").to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(np.diff(chunks, prepend=~chunks[:1]))
        for begin, end in zip(begins, [*begins[1:], len(chunks)], strict=True):
            if chunks[begin] != now:
                if held:
                    yield now, held
                now, held = chunks[begin].item(), []
            held.append(batch.slice(begin, end - begin))
    if held:
        yield now, held


def together(docs: DataFrame, kind: str) -> DataFrame:
    """A row for each chunk of ``chunk, _doc, _out, _text``: its ids, marks and texts, these compressed as one."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in by_chunk(batches):
            table = pa.Table.from_batches(rows)
            documents = [x for c in table.column("_text").chunks for x in texts(c)]
            ids, out = (pa.ListArray.from_arrays([0, len(table)], table.column(c).combine_chunks()) for c in ("_doc", "_out"))
            sizes = packed(np.array([len(x) for x in documents], dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), ids, out, pa.array([sizes], pa.binary()), pa.array([squeezed(b"".join(documents))], pa.binary())],
                names=["chunk", "ids", "out", "sizes", "texts"],
            )

    return docs.mapInArrow(pack, f"chunk long, ids array<{kind}>, out array<boolean>, sizes binary, texts binary")


def apart(row: dict) -> list[bytes]:
    """The texts of a chunk's row."""
    sizes, data = unpacked(row["sizes"], np.int64), released(row["texts"])
    ends = np.cumsum(sizes)
    return [data[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


REQUEST = "part int, chunk long, kind int, keys binary, low binary, high binary"


def requests(chunks: DataFrame, parts: int) -> DataFrame:
    """For each chunk of ``together``, the distinct words and pairs in it, with their counts in its training documents."""

    def ask(chunk: int, documents: list[bytes], out: list[bool]) -> Iterator[dict]:
        found = tokens(documents)
        train = np.repeat(~np.array(out, dtype=bool), found.lengths)
        begun = int((~np.array(out, dtype=bool)).sum())
        for kind, keys in ((WORD, found.words), (PAIR, found.pairs)):
            if kind == WORD:  # the start is counted as a context, once a document
                keys = np.concatenate([keys, np.full(len(documents), START)])
                train = np.concatenate([train, np.arange(len(documents)) < begun])
            order = np.sort(keys)
            distinct = order[np.flatnonzero(np.diff(order, prepend=~order[:1]))]
            learned = np.sort(keys[train[: len(keys)]])
            counts = np.searchsorted(learned, distinct, "right") - np.searchsorted(learned, distinct, "left")
            for part, run in cuts(distinct, parts):
                low, high = small(counts[run])
                yield {"part": part, "chunk": chunk, "kind": kind, "keys": packed_keys(distinct[run]), "low": low, "high": high}

    schema = pa.schema(
        [("part", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32())] + [(c, pa.binary()) for c in ("keys", "low", "high")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                yield pa.RecordBatch.from_pylist(list(ask(r["chunk"], apart(r), r["out"])), schema=schema)

    return chunks.select("chunk", "out", "sizes", "texts").mapInArrow(run, REQUEST)


ANSWER = "part int, chunk long, kind int, low binary, high binary, owned binary, seen long, distinct long, " + ", ".join(
    f"n{r} long" for r in range(1, K + 2)
)


def answers(asked: DataFrame) -> DataFrame:
    """The count of each key over all chunks, to each chunk that asked, and which keys it owns.

    A row without a chunk has the totals of a partition: all counts, the keys counted, and those counted 1, 2, ... times.
    """

    def tally(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        out: list[dict] = []
        kinds = table.column("kind").to_numpy()
        for kind in (WORD, PAIR):
            rows = table.filter(pa.array(kinds == kind)).to_pylist()
            if not rows:
                continue
            part = rows[0]["part"]
            each = [unpacked_keys(r["keys"]) for r in rows]
            keys = np.concatenate(each)
            own = np.concatenate([grown(r["low"], r["high"]) for r in rows])
            order = np.argsort(keys, kind="stable")
            ranked = keys[order]
            firsts = np.flatnonzero(np.diff(ranked, prepend=~ranked[:1]))
            totals = np.add.reduceat(own[order], firsts)
            counts, owned = np.empty_like(own), np.zeros(len(own), dtype=bool)
            counts[order] = np.repeat(totals, np.diff(np.append(firsts, len(keys))))
            owned[order[firsts]] = True
            at = 0
            for r, some in zip(rows, each, strict=True):
                run = slice(at, at + len(some))
                at += len(some)
                low, high = small(counts[run])
                out.append({"part": part, "chunk": r["chunk"], "kind": kind, "low": low, "high": high, "owned": np.packbits(owned[run]).tobytes()})
            totals = totals[ranked[firsts] != START] if kind == WORD else totals
            line = {"part": part, "kind": kind, "seen": int(totals.sum()), "distinct": int((totals > 0).sum())}
            out.append(line | {f"n{r}": int((totals == r).sum()) for r in range(1, K + 2)})
        return pa.Table.from_pylist(out, schema=schema)

    schema = pa.schema(
        [("part", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32())]
        + [(c, pa.binary()) for c in ("low", "high", "owned")]
        + [(c, pa.int64()) for c in ("seen", "distinct", *[f"n{r}" for r in range(1, K + 2)])]
    )
    return asked.groupBy("part").applyInArrow(tally, ANSWER)


def discounts(n: list[int]) -> np.ndarray:
    """By count from 0 to ``K``, the part of it that is kept. ``n`` has the n-grams seen once, twice, ... ``K`` + 1 times.

    Katz's form of Good-Turing; where few or odd counts give no proper discounts, a constant is subtracted instead.
    """
    kept = np.zeros(K + 1)
    if all(n[:K]):
        tail = (K + 1) * n[K] / n[0]
        if tail != 1:
            for r in range(1, K + 1):
                kept[r] = ((r + 1) * n[r] / (r * n[r - 1]) - tail) / (1 - tail)
        if all(0 < x < 1 for x in kept[1:]):
            return kept
    taken = min(0.9, max(0.1, n[0] / (n[0] + 2 * n[1]))) if n[0] else 0.5
    kept[1:] = 1 - taken / np.arange(1, K + 1)
    return kept


@dataclass
class Model:
    """What does not depend on the n-gram."""

    tokens: int  # in training
    distinct: int
    words: np.ndarray  # discounts
    pairs: np.ndarray

    def discounted(self, counts: np.ndarray, kind: int) -> np.ndarray:
        kept = self.words if kind == WORD else self.pairs
        return np.where(counts > K, 1.0, kept[np.minimum(counts, K)]) * counts

    def unigram(self, counts: np.ndarray, left: float) -> np.ndarray:
        """Each context, the empty one too, counts one more than it was seen, so that it always has something left."""
        return np.where(counts > 0, self.discounted(counts, WORD) / (self.tokens + 1), left)


def totals(answered: DataFrame) -> tuple[Model, float]:
    """The model's constants, and the probability of an unknown word."""
    names = ["seen", "distinct", *[f"n{r}" for r in range(1, K + 2)]]
    rows = answered.where(F.col("chunk").isNull()).groupBy("kind").agg(*[F.sum(c).alias(c) for c in names]).collect()
    by_kind = {r["kind"]: r.asDict() for r in rows}
    none = dict.fromkeys(names, 0)
    word, pair = by_kind.get(WORD, none), by_kind.get(PAIR, none)
    kept = [discounts([x[f"n{r}"] for r in range(1, K + 2)]) for x in (word, pair)]
    model = Model(word["seen"], word["distinct"], *kept)
    taken = sum(word[f"n{r}"] * r * (1 - model.words[r]) for r in range(1, K + 1))
    return model, (taken + 1) / (model.tokens + 1)


SCORED = (
    "kind string, part int, chunk long, place int, doc {id}, held_out boolean, n_tokens long, n_known long, base double, score double, "
    "keys binary, seen binary, expected binary, places binary, times binary"
)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out: str = "held_out") -> DataFrame:
    """For each document: its id, ``held_out``, ``n_tokens``, ``n_known`` (tokens seen in training), ``train_tokens``,
    ``base_score`` (an add-one unigram model) and ``score``, both as the log10 of the text's probability.

    ``docs`` has a column ``chunk`` such that the rows of a chunk lie together in one partition (see ``read_chunks``).
    Rows not ``held_out`` are learned from. A null text is an empty one, whose one token is its end. With nothing to learn
    from, all words are unknown, with probability 1 together. No documents give no rows; repeated rows count each.
    """
    size = docs.agg(F.sum(F.octet_length(text))).head()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select("chunk", F.col(doc_id).alias("_doc"), F.col(held_out).alias("_out"), F.col(text).alias("_text"))
    # one fixed copy, as a second read of the documents may name the chunks otherwise
    chunks = durable(together(rows, kind))
    answered = durable(answers(requests(chunks, parts)))
    model, left = totals(answered)
    told = answered.where(F.col("chunk").isNotNull()).select("part", "chunk", "kind", "low", "high", "owned")

    def scored(own: pa.Table, given: pa.Table) -> pa.Table:
        return _scored(own, given, model, left, parts)

    partial = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(scored, SCORED.format(id=kind))
    out = partial.groupBy("part").applyInArrow(_weighted, f"chunk long, place int, doc {kind}, held_out boolean, n_tokens long, n_known long, base double, score double")
    # the part that needed no back-off weights, and what each partition of the weights adds
    return (
        out.groupBy("chunk", "place")
        .agg(
            F.max("doc").alias(doc_id),
            F.max("held_out").alias("held_out"),
            F.sum("n_tokens").alias("n_tokens"),
            F.sum("n_known").alias("n_known"),
            F.lit(model.tokens).cast("long").alias("train_tokens"),
            F.sum("base").alias("base_score"),
            F.sum("score").alias("score"),
        )
        .drop("chunk", "place")
    )


def _told(given: list[dict], kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The counts of a chunk's keys of a kind, in the order of the keys, and which it owns."""
    rows = sorted((r for r in given if r["kind"] == kind), key=lambda r: r["part"])
    counts = [grown(r["low"], r["high"]) for r in rows]
    owned = [np.unpackbits(np.frombuffer(r["owned"], dtype=np.uint8), count=len(c)) for r, c in zip(rows, counts, strict=True)]
    return np.concatenate(counts), np.concatenate(owned).astype(bool)


def _scored(own: pa.Table, given: pa.Table, model: Model, left: float, parts: int) -> pa.Table:
    documents = [x for row in own.select(["sizes", "texts"]).to_pylist() for x in apart(row)]
    chunk = own.column("chunk")[0].as_py()
    ids, marks = (pa.chunked_array([c.flatten() for c in own.column(name).chunks]).combine_chunks() for name in ("ids", "out"))
    told = given.to_pylist()
    found = tokens(documents)
    out = np.array(marks.to_pylist(), dtype=bool)
    # the start is among the words a chunk asks for
    words, at = np.unique(np.append(found.words, START), return_inverse=True)
    word_counts, _ = _told(told, WORD)
    at_word, at_start = at[:-1], int(at[-1])
    at_before = np.empty_like(at_word)
    at_before[1:] = at_word[:-1]
    at_before[found.starts] = at_start
    pairs, first, at_pair = np.unique(found.pairs, return_index=True, return_inverse=True)
    pair_counts, owned = _told(told, PAIR)

    # by distinct word and pair, then by token
    chance = model.unigram(word_counts, left)
    log_chance = np.log10(chance)
    pair_context = at_before[first]
    context = word_counts[pair_context]
    direct = model.discounted(pair_counts, PAIR) / (context + 1)
    known = pair_counts > 0
    pair_score = np.where(known, np.log10(np.where(known, direct, 1.0)), log_chance[at_word[first]])
    backed = ~known & (context > 0)

    total = model.tokens + model.distinct + 1
    base = np.log10((word_counts + 1) / total)
    line = {
        "place": np.arange(len(documents), dtype=np.int32),
        "n_tokens": found.lengths,
        "n_known": np.add.reduceat((word_counts > 0)[at_word].astype(np.int64), found.starts),
        "base": np.add.reduceat(base[at_word], found.starts),
        "score": np.add.reduceat(pair_score[at_pair], found.starts),
    }
    n = len(documents)
    kind = pa.array(["doc"] * n, pa.string())
    part = pa.array(np.full(n, int(np.uint64(chunk & 0xFFFFFFFF)) % parts, dtype=np.int32))
    doc = pa.table(
        {
            "kind": kind,
            "part": part,
            "chunk": pa.array([chunk] * n, pa.int64()),
            "place": line["place"],
            "doc": ids,
            "held_out": pa.array(out),
            **{c: line[c] for c in ("n_tokens", "n_known", "base", "score")},
            **{c: pa.nulls(n, pa.binary()) for c in ("keys", "seen", "expected", "places", "times")},
        }
    )
    rows = []
    # of the pairs it owns: what their contexts have dealt out, and what unigrams would have
    mine = owned & known
    ctx = pair_context[mine]
    contexts = np.unique(ctx)
    seen = np.bincount(ctx, direct[mine], minlength=len(words))[contexts]
    expected = np.bincount(ctx, chance[at_word[first[mine]]], minlength=len(words))[contexts]
    for p, run in cuts(words[contexts], parts):
        rows.append(
            {"kind": "sums", "part": p, "keys": packed_keys(words[contexts][run]), "seen": packed(seen[run]), "expected": packed(expected[run])}
        )
    # the contexts whose weights its documents need, by document and how often
    need = np.flatnonzero(backed[at_pair])
    if len(need):
        documents_of = np.searchsorted(found.starts, need, "right") - 1
        both, times = np.unique(at_before[need] * n + documents_of, return_counts=True)
        contexts, places = both // n, (both % n).astype(np.int32)
        for p, run in cuts(words[contexts], parts):
            keys, lengths = np.unique(words[contexts[run]], return_counts=True)
            rows.append(
                {
                    "kind": "ask",
                    "part": p,
                    "chunk": chunk,
                    "keys": packed_keys(keys),
                    "seen": packed(lengths.astype(np.int32)),
                    "places": packed(places[run]),
                    "times": packed(times[run].astype(np.int32)),
                }
            )
    return pa.concat_tables([doc, pa.Table.from_pylist(rows, schema=doc.schema)])


def _weighted(table: pa.Table) -> pa.Table:
    """The back-off weights of a partition's contexts, added up for the documents that need them; other rows as they are."""
    kinds = np.array(table.column("kind").to_pylist(), dtype=object)
    names = ["chunk", "place", "doc", "held_out", "n_tokens", "n_known", "base", "score"]
    done = [table.filter(pa.array(kinds == "doc")).select(names)]
    sums = table.filter(pa.array(kinds == "sums")).select(["keys", "seen", "expected"]).to_pylist()
    asked = table.filter(pa.array(kinds == "ask")).select(["chunk", "keys", "seen", "places", "times"])
    if sums and len(asked):
        keys = np.concatenate([unpacked_keys(r["keys"]) for r in sums])
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        firsts = np.flatnonzero(np.diff(ranked, prepend=~ranked[:1]))
        seen, expected = (
            np.add.reduceat(np.concatenate([unpacked(r[c], np.float64) for r in sums])[order], firsts) for c in ("seen", "expected")
        )
        contexts = ranked[firsts]
        weights = np.log10((1 - seen) / (1 - expected))
        schema = done[0].schema
        for i in range(len(asked)):
            r = asked.slice(i, 1).to_pylist()[0]
            each = np.repeat(weights[np.searchsorted(contexts, unpacked_keys(r["keys"]))], unpacked(r["seen"], np.int32))
            places = unpacked(r["places"], np.int32)
            distinct, at = np.unique(places, return_inverse=True)
            added = np.bincount(at, each * unpacked(r["times"], np.int32))
            n = len(distinct)
            new = {"chunk": pa.array([r["chunk"]] * n, pa.int64()), "place": pa.array(distinct), "score": pa.array(added)}
            done.append(pa.table([new.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema))
    return pa.concat_tables(done)
