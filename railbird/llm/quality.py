"""Quality scores from statistics of a document: kernel ridge regression on random Fourier features, calibrated.

The features are cosines of random projections, whose inner products approximate a Gaussian kernel. The normal equations
are summed by partition, so training reads all labelled rows and the driver solves one system of fixed size. Scores are
made probabilities by isotonic regression on a histogram of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbird.llm.text import SPACED, annotate, runs_of, slices, texts, word_hashes

N_STATS = 24
N_FEATURES = 256
WIDTH = 4.0  # of the kernel, in standard deviations
RIDGE = 1e-4  # a row
BINS = 2048
LOW, HIGH = -0.5, 1.5  # raw scores outside are taken as at the end
_LINES = np.ones(256, dtype=np.uint64)
_LINES[0x0A] = 0

_CLASSES = {
    "lower": range(97, 123),
    "upper": range(65, 91),
    "digit": range(48, 58),
    "white": [9, 10, 11, 12, 13, 32],
    "line": [10],
    "stop": b".!?",
    "comma": b",;:",
    "cry": b"!",
    "bar": b"|",
    "sign": b"#$%&*",
    "bracket": b"()[]{}<>",
    "quote": b"'\"",
    "join": b"-_/\\@=+~^`",
    "high": range(128, 256),
}
_MASKS = np.array([[float(b in set(group)) for b in range(256)] for group in _CLASSES.values()])


def statistics(text: bytes) -> np.ndarray:
    """``N_STATS`` numbers about a text; all are finite, for an empty text too."""
    counts = np.zeros(256)
    for codes in slices(text, SPACED):
        counts += np.bincount(codes, minlength=256)
    n = max(1.0, counts.sum())
    group = dict(zip(_CLASSES, _MASKS @ counts, strict=True))
    hashes = word_hashes(text, SPACED)
    words = len(hashes)
    lines = [line for line in text.split(b"\n") if line]
    portions = counts[counts > 0] / n
    letters = group["lower"] + group["upper"]

    def distinct(values: np.ndarray) -> float:
        return len(np.unique(values)) / len(values) if len(values) else 1.0

    stats = [
        np.log1p(n),
        np.log1p(words),
        (n - group["white"]) / max(1, words),
        group["upper"] / max(1.0, letters),
        letters / n,
        *[group[k] / n for k in ("digit", "white", "bar", "sign", "bracket", "quote", "join", "high")],
        group["stop"] / max(1, words),
        group["comma"] / max(1, words),
        group["cry"] / max(1, words),
        group["line"] / max(1, words),
        words / max(1, len(lines)),
        len(set(lines)) / max(1, len(lines)),
        distinct(hashes),
        distinct(runs_of(hashes, 2)),
        distinct(runs_of(hashes, 4)),
        float(-(portions * np.log2(portions)).sum()),
        np.log1p(group["sign"] + group["bar"] + group["join"]),
    ]
    return np.array(stats, dtype=np.float64)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the features and a constant
    grid: np.ndarray  # raw scores and the probabilities there
    chance: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        draw = np.random.default_rng(5)
        directions = draw.normal(size=(N_STATS, N_FEATURES)) / WIDTH
        phases = draw.uniform(0, 2 * np.pi, N_FEATURES)
        near = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.cos(near @ directions + phases) * np.sqrt(2 / N_FEATURES)
        return np.hstack([waves, np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.features(stats) @ self.weights, LOW, HIGH)

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.grid, self.chance), 0.0, 1.0)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), N_STATS)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``stats``, the statistics of each text.

    A null is an empty text, of which all statistics are finite; repeated rows get the same ones, no rows give none, and a
    column named ``stats`` is replaced.
    """

    def work(batch: pa.RecordBatch) -> list:
        return [pa.array([statistics(x) for x in texts(batch.column(text))], pa.list_(pa.float64()))]

    return annotate(docs, "stats array<double>", work)


def _summed(train: DataFrame, model: Model) -> np.ndarray:
    """The matrix of the normal equations with their right side as last column, summed over all of ``train``."""
    side = N_FEATURES + 1

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros((side, side + 1))
        for batch in batches:
            x = model.features(matrix(batch.column("stats")))
            whole[:, :side] += x.T @ x
            whole[:, side] += x.T @ batch.column("label").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_pydict({"sums": [whole.tobytes()]})

    def together(table: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(x.as_py()) for x in table.column("sums"))
        return pa.table({"sums": pa.array([whole.tobytes()], pa.binary())})

    sums = train.mapInArrow(total, "sums binary")
    many = train.rdd.getNumPartitions()
    while many > 64:  # in steps, so that no task or driver holds the sums of very many partitions
        many = -(-many // 32)
        sums = sums.groupBy(F.pmod(F.monotonically_increasing_id(), F.lit(many)).alias("k")).applyInArrow(together, "sums binary")
    whole = np.zeros((side, side + 1))
    for row in sums.toLocalIterator():
        whole += np.frombuffer(row["sums"]).reshape(side, side + 1)
    return whole


def isotonic(weights: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The non-decreasing means nearest to ``values`` by weighted squares: neighbours that fall are pooled."""
    pools: list[list[float]] = []
    for weight, value in zip(weights, values, strict=True):
        pools.append([weight, value, 1])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            w, v, k = pools.pop()
            last = pools[-1]
            last[1] = (last[0] * last[1] + w * v) / (last[0] + w)
            last[0] += w
            last[2] += k
    return np.concatenate([np.full(int(k), v) for _, v, k in pools]) if pools else np.empty(0)


def fit(train: DataFrame) -> Model:
    """A model from rows of ``stats`` and ``label`` (0 or 1).

    Without rows, every score is a half. Repeated rows weigh as often as they are there; neither column may be null
    (``training_rows`` leaves out null labels); other columns are not read.
    """
    value = [F.element_at("stats", i + 1) for i in range(N_STATS)]
    moments = train.agg(
        F.count("*").alias("n"),
        F.array(*[F.avg(v) for v in value]).alias("mean"),
        F.array(*[F.stddev_pop(v) for v in value]).alias("scale"),
    ).head()
    grid = np.linspace(LOW, HIGH, BINS + 1)
    middles = (grid[:-1] + grid[1:]) / 2
    if not moments["n"]:
        zero = np.zeros(N_STATS)
        return Model(zero, zero + 1, np.zeros(N_FEATURES + 1), middles, np.full(BINS, 0.5))
    scale = np.array(moments["scale"])
    model = Model(np.array(moments["mean"]), np.where(scale > 1e-9, scale, 1.0), np.empty(0), middles, np.empty(0))
    sums = _summed(train, model)
    side = N_FEATURES + 1
    penalty = np.eye(side) * RIDGE * moments["n"]
    penalty[-1, -1] = 0
    model.weights = np.linalg.solve(sums[:, :side] + penalty + np.eye(side) * 1e-9, sums[:, side])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, good = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            place = np.clip(np.searchsorted(grid, model.raw(matrix(batch.column("stats"))), "right") - 1, 0, BINS - 1)
            count += np.bincount(place, minlength=BINS)
            good += np.bincount(place, batch.column("label").to_numpy(zero_copy_only=False), minlength=BINS)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"bin": used.astype(np.int32), "n": count[used], "good": good[used]})

    bins = train.mapInArrow(binned, "bin int, n double, good double")
    rows = bins.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).orderBy("bin").collect()
    n = np.array([r["n"] for r in rows])
    model.grid = middles[[r["bin"] for r in rows]]
    model.chance = isotonic(n, np.array([r["good"] for r in rows]) / n)
    return model


def score(with_stats: DataFrame, model: Model, threshold: float) -> DataFrame:
    """Replace ``stats`` by ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on, else 0)."""
    return predicted(_scored(with_stats, model, lambda batch: matrix(batch.column("stats"))).drop("stats"), threshold)


def score_texts(docs: DataFrame, model: Model, threshold: float, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on, else 0) to documents, from their whole texts.

    Null and empty texts have the score of an empty text, equal texts equal scores. No rows give none; columns named
    ``score`` or ``predicted`` are replaced, all others stay.
    """

    def stats(batch: pa.RecordBatch) -> np.ndarray:
        return np.array([statistics(x) for x in texts(batch.column(text))]).reshape(-1, N_STATS)

    return predicted(_scored(docs, model, stats), threshold)


def _scored(df: DataFrame, model: Model, stats) -> DataFrame:
    return annotate(df, "score double", lambda batch: [pa.array(model.scores(stats(batch)), pa.float64())])


def predicted(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def remainder(doc_id: str, parts: int):
    """The part of the rows that a document is in, by a checksum of its id; a null id is an empty one."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def training_rows(with_stats: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id") -> DataFrame:
    """``stats`` and ``label`` of the labelled documents; a document with several labels counts once for each."""
    marks = labels.where(F.col(label).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("label"))
    rows = with_stats.select(F.col(doc_id).alias("_doc"), "stats")
    return rows.join(marks, F.col("_doc") == F.col("_id")).select("stats", "label")
