"""A corpus from raw documents to shards.

STAGES in order: each takes (spark, docs, sf_dir), works on all that the stage before kept, and its result is written and
read again as the next one's ``docs``. All but the last return the columns they were given.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railbird.llm import mixture, neardup, quality, shards, wumanber
from railbird.llm.queries import DOMAIN, EPOCHS, QUALITY_THRESHOLD, SEED, SHARDS, SHARE, TOKENS, WEIGHTS, table
from railbird.operators.groups import durable, shared_dir


def set_apart(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The columns ``used`` with the others as one struct, and how to get the documents back.

    So no column that an operator adds can clash with one that it does not know.
    """
    columns = docs.columns
    rest = [c for c in columns if c not in used]
    apart = docs.select(*used, F.struct(F.lit(0).alias("_none"), *rest).alias("_rest"))

    def back(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c) if c in used else F.col("_rest")[c].alias(c) for c in columns])

    return apart, back


def numbered(docs: DataFrame) -> DataFrame:
    """A copy of the documents in the shared folder with ``_row``, a number for each row.

    Numbers of a scan depend on how it splits the files, so all that is joined by them has to read the one copy.
    """
    folder = f"{shared_dir(docs.sparkSession)}/numbered/{uuid.uuid4().hex}"
    docs.withColumn("_row", F.monotonically_increasing_id()).write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier does not reject, learned from the labels of three quarters of them.

    Null and empty texts are judged as an empty text; a null id counts as an empty one when rows are dealt to training.
    Without labels every score is a half, below the threshold, so nothing stays. Repeated rows share their fate.
    """
    learned = docs.where(quality.remainder("doc_id", 4) != 2).select("doc_id", "text")
    stats = quality.with_statistics(learned).select("doc_id", "stats")
    model = quality.fit(durable(quality.training_rows(stats, table(spark, sf_dir, "labels"), "quality")))
    apart, back = set_apart(docs, "text")
    return back(quality.score_texts(apart, model, QUALITY_THRESHOLD).where("predicted = 1"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links of 80 percent or more of five-word shingles: that of the smallest id.

    Rows without words are linked with nothing and stay; of repeated rows one stays, also of those without an id.
    """
    marked = numbered(docs)
    found = neardup.near_duplicates(marked.select(F.struct("doc_id", "_row").alias("_id"), "text"), doc_id="_id")
    gone = durable(found.where(~F.col("kept")).select(F.col("_id._row").alias("_row")))
    return marked.join(gone, "_row", "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which less than a twentieth is benchmark text; null and empty texts stay, as all do without items."""
    apart, back = set_apart(docs, "text")
    found = wumanber.find_passages(apart, table(spark, sf_dir, "benchmark"))
    return back(found.where(~wumanber.contaminated()))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken as often as the weights of their domain, language and source ask for.

    Null languages and sources are leaves ``(none)``; documents without tokens cost nothing. Repeated rows are dealt one by one.
    """
    apart, back = set_apart(docs, "doc_id", "text", "lang", "source")
    levels = apart.withColumn("domain", F.expr(DOMAIN))
    taken = mixture.mix(levels, ("domain", "lang", "source"), TOKENS, WEIGHTS, SHARE, EPOCHS, SEED)
    return back(taken.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``shard`` and ``slot``: contiguous shards, by id, of nearly equal bytes.

    A null text has no bytes but the eight of its row; null ids come first; repeated rows have a slot each; no rows give none.
    Columns named ``shard`` or ``slot`` are replaced.
    """
    marked = numbered(docs.drop("shard", "slot"))
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 8
    sized = marked.select("doc_id", "_row", size.cast("long").alias("_size"))
    placed = shards.byte_shards(sized, SHARDS, ["doc_id", "_row"], "_size")
    return marked.join(placed.select("_row", "shard", "slot"), "_row").drop("_row")


STAGES = [
    ("quality", good_quality),
    ("near duplicates", without_near_duplicates),
    ("benchmark", without_benchmark),
    ("mixture", mixed),
    ("shards", sharded),
]

# the classifier and MinHash cannot be said in SQL
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = f"{shared_dir(spark)}/corpus/{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
