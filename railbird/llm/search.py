"""Ranked lexical search over an index whose postings are stratified by document length.

A document's score for a term depends on how often it has the term (tf) and on its length normaliser m. So the index keeps the
documents of a segment (a bounded piece of the corpus) by m, and a term's postings within each stratum by tf. Of a stratum, the
largest tf of each term bounds the score of every document in it. A search visits strata in the order of their bounds, works
out an impact once for each (term, m, tf), adds it to all documents listed there, and stops where the next bound cannot enter
the best k. What is best so far is kept from one segment to the next by a task, so later segments are visited less.

Scores are whole numbers; only a term's weight is worked out in doubles.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from railbird.llm.text import texts
from railbird.operators.groups import durable, shared_dir

SEGMENT_BYTES = 8 << 20  # of text, unless one text is longer
SEGMENT_DOCS = 1 << 16
QUERY_BYTES = 32 << 20  # of terms of the queries that are sent to tasks at a time
FIRST_VISIT = 4  # strata; each visit takes twice as many as the one before

# letters, digits and all beyond ASCII make terms; A-Z are taken as a-z
_INSIDE = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_LOWER = bytes(b if b in _INSIDE else 0x20 for b in range(256)).translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))


def terms_of(data: bytes) -> list[bytes]:
    return data.translate(_LOWER).split()


def count_terms(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """The documents with at least one term, and all their terms."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = total = 0
        for batch in batches:
            for data in texts(batch.column(0)):
                n = len(terms_of(data))
                held, total = held + (n > 0), total + n
        yield pa.RecordBatch.from_pydict({"held": [held], "total": [total]})

    row = docs.select(text).mapInArrow(work, "held long, total long").agg(F.sum("held"), F.sum("total")).head()
    return row[0] or 0, row[1] or 0


INDEX = "segment long, term binary, m array<long>, tf array<int>, stops array<int>, docs array<int>, ids array<long>"
KINDS = [pa.int64(), pa.binary(), *[pa.list_(k) for k in (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())]]
NAMES = ["segment", "term", "m", "tf", "stops", "docs", "ids"]


@dataclass
class Index:
    """Postings in the shared folder: ``folder`` has a row for each segment and term, and one for each segment, without a term,
    with the ids of its documents by number.

    A term's ``docs`` are the numbers of its documents in the segment, by stratum and by tf within it; ``m``, ``tf`` and
    ``stops`` tell for each such stretch what it has in common and where it ends.
    """

    spark: SparkSession
    folder: str
    documents: int  # with at least one term
    terms: int  # of them all

    def rows(self) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(self.folder)

    def postings(self) -> DataFrame:
        return self.rows().where(F.col("term").isNotNull())

    def segments(self) -> DataFrame:
        return self.rows().where(F.col("term").isNull())

    def delete(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def normaliser(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """A document's m, from its number of terms; 100 for one of average length."""
    return np.array([100 - 50 + (50 * x * documents) // terms for x in n.tolist()], dtype=np.int64)


def impact(tf: int, m: int) -> int:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _segment(segment: int, ids: list, data: list[bytes], documents: int, terms: int) -> pa.RecordBatch:
    """The index of some documents; those without terms have no postings."""
    numbers: dict[bytes, int] = {}
    lengths = np.empty(len(data), dtype=np.int64)
    codes = []
    for i, text in enumerate(data):
        own = [numbers.setdefault(t, len(numbers)) for t in terms_of(text)]
        lengths[i] = len(own)
        codes.append(np.array(own, dtype=np.int64))
    m = normaliser(lengths, documents, terms) if terms else lengths
    owner = np.repeat(np.arange(len(data), dtype=np.int64), lengths)
    pairs, tf = np.unique(np.concatenate(codes) * len(data) + owner, return_counts=True)
    code, doc = pairs // len(data), pairs % len(data)
    # terms in the order of their bytes, so that a search for some reads few row groups
    names = sorted(numbers)
    place = np.empty(len(names), dtype=np.int64)
    place[[numbers[t] for t in names]] = np.arange(len(names))
    code = place[code]
    order = np.lexsort((doc, tf, m[doc], code))
    code, m_of, tf, doc = code[order], m[doc][order], tf[order], doc[order]
    new_term = np.diff(code, prepend=-1) != 0
    stretch = np.flatnonzero(new_term | (np.diff(m_of, prepend=-1) != 0) | (np.diff(tf, prepend=-1) != 0))
    begins = np.flatnonzero(new_term)  # of the terms among documents
    edges = np.append(np.searchsorted(stretch, begins), len(stretch)).astype(np.int32)  # and among stretches
    stops = np.append(stretch[1:], len(doc)) - np.repeat(begins, np.diff(edges))

    def lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))

    count = len(begins)
    body = [
        pa.array(np.full(count, segment), pa.int64()),
        pa.array(names, pa.binary()),
        lists(edges, m_of[stretch], pa.int64()),
        lists(edges, tf[stretch], pa.int32()),
        lists(edges, stops, pa.int32()),
        lists(np.append(begins, len(doc)), doc, pa.int32()),
        pa.nulls(count, pa.list_(pa.int64())),
    ]
    head = [pa.array([segment], pa.int64()), *[pa.nulls(1, k) for k in KINDS[1:-1]], pa.array([ids], KINDS[-1])]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(head, body, strict=True)], names=NAMES)


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Index every term of every document, whole texts. Ids are whole numbers.

    Each task indexes its own documents, segment by segment, and writes them to the shared folder; nothing is shuffled, so a
    term or a length that most documents have makes no task larger. A null or empty text has no terms and is in no posting.
    Repeated rows, and rows that share an id, count each; a null id is kept. No documents give an index without postings.
    Other columns are left out.
    """
    spark = docs.sparkSession
    documents, terms = count_terms(docs, text)
    folder = f"{shared_dir(spark)}/search/{uuid.uuid4().hex}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        ids: list = []
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                if held and (size + len(data) > SEGMENT_BYTES or len(held) >= SEGMENT_DOCS):
                    yield _segment(segment, ids, held, documents, terms)
                    segment, ids, held, size = segment + 1, [], [], 0
                ids.append(i)
                held.append(data)
                size += len(data)
        if held:
            yield _segment(segment, ids, held, documents, terms)

    indexed = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).mapInArrow(work, INDEX)
    indexed.write.parquet(folder)
    return Index(spark, folder, documents, terms)


def _slices(queries: DataFrame, query_id: str, text: str) -> Iterator[list[tuple]]:
    """The queries as ids and terms (once each), in lists of bounded size."""
    held, size = [], 0
    for row in queries.select(query_id, text).toLocalIterator():
        data = (row[1] or "").encode()
        held.append((row[0], sorted(set(terms_of(data)))))
        size += len(data)
        if size >= QUERY_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


class _Best:
    """The best k of a query: whole scores, equal ones by id, nulls first."""

    def __init__(self, k: int):
        self.k = k
        self.scores = np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype=np.int64)
        self.null = np.empty(0, dtype=bool)

    @property
    def least(self) -> int:
        """What a document has to reach to enter, if its id is small enough."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        scores, ids, null = np.append(self.scores, scores), np.append(self.ids, ids), np.append(self.null, null)
        order = np.lexsort((ids, ~null, -scores))[: self.k]
        self.scores, self.ids, self.null = scores[order], ids[order], null[order]


class _Segment:
    """The postings of a segment for the terms that are asked for."""

    def __init__(self, rows: list[pa.RecordBatch], numbers: dict[bytes, int]):
        table = pa.Table.from_batches(rows)
        heads = table.column("term").is_null()
        ids = table.filter(heads).column("ids").combine_chunks().flatten()
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        body = table.filter(pc.invert(heads))

        def flat(column: str) -> np.ndarray:
            return pc.list_flatten(body.column(column)).to_numpy().astype(np.int64)

        terms = np.array([numbers[t] for t in body.column("term").to_pylist()], dtype=np.int64)
        stretches, docs = (pc.list_value_length(body.column(c)).to_numpy().astype(np.int64) for c in ("m", "docs"))
        self.m, self.tf, self.docs = flat("m"), flat("tf"), flat("docs")
        self.terms = np.repeat(terms, stretches)
        self.ends = flat("stops") + np.repeat(np.cumsum(docs) - docs, stretches)
        self.begins = np.append(0, self.ends[:-1]) if len(self.ends) else self.ends
        # once for each (term, m, tf)
        self.impacts = np.array([impact(tf, m) for tf, m in zip(self.tf.tolist(), self.m.tolist(), strict=True)], dtype=np.int64)
        self.order = np.argsort(self.terms, kind="stable")
        self.sorted_terms = self.terms[self.order]
        self.scores = np.zeros(len(self.ids), dtype=np.int64)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: _Best) -> None:
        """``terms`` are sorted, with a weight each."""
        begins = np.searchsorted(self.sorted_terms, terms)
        counts = np.searchsorted(self.sorted_terms, terms, "right") - begins
        if not counts.sum():
            return
        rows = self.order[np.repeat(begins - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))]
        gains = np.repeat(weights, counts) * self.impacts[rows]
        # the strata that have any of the terms, and for each term the most it gives there
        strata, at = np.unique(self.m[rows], return_inverse=True)
        which = at * len(terms) + np.repeat(np.arange(len(terms)), counts)
        most = np.zeros(len(strata) * len(terms), dtype=np.int64)
        np.maximum.at(most, which, gains)
        bounds = most.reshape(len(strata), len(terms)).sum(axis=1)
        visits = np.argsort(-bounds, kind="stable")
        place = np.empty(len(strata), dtype=np.int64)
        place[visits] = np.arange(len(visits))
        by_visit = np.argsort(place[at], kind="stable")
        rows, gains, turn = rows[by_visit], gains[by_visit], place[at][by_visit]
        done, size = 0, FIRST_VISIT
        while done < len(visits) and bounds[visits[done]] >= best.least:
            last = min(done + size, len(visits))
            # of the strata of this visit, those that can still matter
            last = done + int(np.searchsorted(-bounds[visits[done:last]], -best.least, "right"))
            some = slice(np.searchsorted(turn, done), np.searchsorted(turn, last - 1, "right"))
            self._score(rows[some], gains[some], best)
            done, size = last, 2 * size

    def _score(self, rows: np.ndarray, gains: np.ndarray, best: _Best) -> None:
        lengths = self.ends[rows] - self.begins[rows]
        docs = self.docs[np.repeat(self.begins[rows] - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))]
        np.add.at(self.scores, docs, np.repeat(gains, lengths))
        reached = self.scores >= best.least
        found = np.flatnonzero(reached)
        if len(found) > best.k:  # only the best k, and none of those that tie with the last is left out before ids decide
            last = np.partition(self.scores[found], -best.k)[-best.k]
            found = found[self.scores[found] >= last]
        best.add(self.scores[found], self.ids[found], self.null[found])
        self.scores[docs] = 0


def _by_segment(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    now, held = None, []
    for batch in batches:
        segments = batch.column("segment").to_numpy()
        begins = np.flatnonzero(np.diff(segments, prepend=~segments[:1]))
        for begin, end in zip(begins, [*begins[1:], len(segments)], strict=True):
            if held and segments[begin] != now:
                yield held
                held = []
            now = segments[begin]
            held.append(batch.slice(begin, end - begin))
    if held:
        yield held


def search(index: Index, queries: DataFrame, k: int, query_id: str = "item_id", text: str = "text") -> DataFrame:
    """The ``k`` documents of the highest scores above 0 for each query: ``query``, ``rank`` (from 1), ``doc_id``, ``score``.

    Equal scores are ranked by ascending id. Queries are whole texts whose terms count once each, and are sent to the tasks in
    slices of bounded size; a query that is null or has no term of any document gives no rows; rows that repeat a query's
    id and text give each its own ranking. Each task ranks the segments it reads, and sends at most ``k`` rows a query on.
    """
    spark = queries.sparkSession
    kind, arrow = dict(queries.dtypes)[query_id], to_arrow_type(queries.schema[query_id].dataType)
    schema = f"slice int, query {kind}, number int, doc_id long, score long"
    found = []
    for number, items in enumerate(_slices(queries, query_id, text)):
        wanted = sorted({t for _, terms in items for t in terms})
        asked = spark.createDataFrame(pa.table({"term": pa.array(wanted, pa.binary())}))
        # no larger than QUERY_BYTES and one query
        postings = index.postings().join(F.broadcast(asked), "term", "left_semi")
        # one row a term of the queries, so as many as were sent
        held = postings.groupBy("term").agg(F.sum(F.size("docs")).alias("df")).collect()
        weights = {bytes(r["term"]): math.floor(1000 * math.log((2 * index.documents + 2) / (2 * r["df"] + 1))) for r in held}
        sent = spark.sparkContext.broadcast((items, weights))

        def work(batches: Iterator[pa.RecordBatch], sent=sent, number=number) -> Iterator[pa.RecordBatch]:
            items, weights = sent.value
            numbers = {t: i for i, t in enumerate(sorted(weights))}
            by_number = np.array([weights[t] for t in sorted(weights)], dtype=np.int64)
            terms = [np.array(sorted(numbers[t] for t in own if t in numbers), dtype=np.int64) for _, own in items]
            best = [_Best(k) for _ in items]
            for rows in _by_segment(batches):
                segment = _Segment(rows, numbers)
                for own, so_far in zip(terms, best, strict=True):
                    segment.search(own, by_number[own], so_far)
            for i, ((query, _), b) in enumerate(zip(items, best, strict=True)):
                n = len(b.ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * n, pa.int32()),
                        pa.array([query] * n, arrow),
                        pa.array([i] * n, pa.int32()),
                        pa.array(b.ids, mask=b.null),
                        pa.array(b.scores),
                    ],
                    names=["slice", "query", "number", "doc_id", "score"],
                )

        read = postings.select(*NAMES).union(index.segments().select(*NAMES))
        dealt = read.repartition("segment").sortWithinPartitions("segment")
        found.append(dealt.mapInArrow(work, schema))
    if not found:
        return spark.createDataFrame([], f"query {kind}, rank int, doc_id long, score long")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("slice", "number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query", "rank", "doc_id", "score")


def search_once(docs: DataFrame, queries: DataFrame, k: int, query_id: str = "item_id", text: str = "text") -> DataFrame:
    """Index ``docs``, rank them for ``queries``, and remove the index. The ranking is kept as a checkpoint."""
    index = build(docs)
    found = durable(search(index, queries, k, query_id, text))
    index.delete()
    return found
