"""Landing files: JSON as the feeds delivered it, read with fixed schemas."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railbird.operators.prices import usable_prices
from railbird.operators.tables import keep_last
from railbird.sources import schemas
from railbird.sources.schemas import PRICE_HISTORY, RATING_ITEM, RUNNERS, SECTIONAL_KEYS, conform, empty, struct_type

DATE_IN_NAME = r"_(\d{4}-\d{2}-\d{2})"
MEETING_IN_NAME = r"_\d{4}-\d{2}-\d{2}_([^/._]+)\."


def _renamed(dtype: T.DataType, names: Mapping[str, str]) -> T.DataType:
    """The type with each field under the name the feed uses for it."""
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(names.get(f.name, f.name), _renamed(f.dataType, names)) for f in dtype])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_renamed(dtype.elementType, names))
    return dtype


def read_feed(spark: SparkSession, path: str, ddl: str, names: Mapping[str, str] | None = None) -> DataFrame:
    """A JSON feed: each file is a document or a list of documents.

    ``names`` maps our field names to the feed's where those differ. A cast by position gives the columns and nested fields
    our names again. ``landed`` orders the documents of a feed by the time their file came and their place in it; a whole file
    is parsed as one text, so places do not depend on how a scan is split. What is no JSON gives no rows.
    """
    ours = struct_type(ddl)
    theirs = _renamed(ours, names or {})
    files = spark.read.text(path, wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_modification_time").alias("_time")
    )
    parsed = F.from_json("value", T.ArrayType(theirs))
    raw = files.select("_file", "_time", F.posexplode(parsed).alias("_place", "_doc"))
    return raw.select(
        *[F.col("_doc")[t.name].cast(o.dataType).alias(o.name) for t, o in zip(theirs, ours, strict=True)],
        "_file",
        F.struct(F.col("_time").alias("time"), F.col("_file").alias("file"), F.col("_place").alias("place")).alias("landed"),
    )


def parse_feed(df: DataFrame, text: str, ddl: str) -> DataFrame:
    """A text column of JSON records as columns; other columns stay.

    The record is exploded from an array of its own: else Spark would push a filter on what is in it below the parsing, where the
    text is made and parsed once more.
    """
    parsed = df.select(*[c for c in df.columns if c != text], F.explode(F.array(F.from_json(F.col(text), struct_type(ddl)))).alias("_parsed"))
    return parsed.select(*[c for c in df.columns if c != text], "_parsed.*")


def payloads(df: DataFrame, text: str = "value") -> DataFrame:
    """Unwrap response envelopes: (payload JSON, failed).

    An object with ``payLoad`` yields it unless ``error`` or ``errors`` is set; anything else is
    the payload itself. Malformed documents fail too. Failed rows keep their text for inspection.
    """
    doc = F.try_parse_json(F.col(text))
    key_names = F.json_object_keys(F.col(text))
    wrapped = F.coalesce(F.array_contains(key_names, "payLoad"), F.lit(False))

    def is_set(name: str) -> Column:
        # an empty text, list or object, zero and false count as not set
        raw = F.get_json_object(F.col(text), f"$.{name}")
        return F.coalesce(~F.lower(raw).isin("", "null", "0", "0.0", "false", "[]", "{}"), F.lit(False))

    failed = doc.isNull() | (wrapped & (is_set("error") | is_set("errors")))
    payload = F.when(failed, F.lit(None)).when(wrapped, F.get_json_object(F.col(text), "$.payLoad")).otherwise(F.col(text))
    return df.withColumns({"payload": payload, "failed": F.coalesce(failed, F.lit(True))})


def file_date(path: Column) -> Column:
    return F.regexp_extract(path, DATE_IN_NAME, 1).try_cast("date")


def file_meeting(path: Column) -> Column:
    return F.regexp_extract(path, MEETING_IN_NAME, 1)


def read_meetings(spark: SparkSession, path: str) -> DataFrame:
    """Meeting lists, one file per day; the day is in the file's name."""
    return read_feed(spark, path, schemas.MEETINGS).withColumn("date", file_date(F.col("_file"))).drop("_file", "landed")


def read_fields(spark: SparkSession, path: str, names: Mapping[str, str] | None = None) -> DataFrame:
    """Fields of meetings; where a file's name has a day, the fields are of that day."""
    return read_feed(spark, path, schemas.FIELDS, names).withColumn("date", file_date(F.col("_file"))).drop("_file", "landed")


def split_shapes(df: DataFrame, text: str, item_ddl: str, feed_ddl: str | None = None) -> DataFrame:
    """Rating-like documents of either shape to items.

    A list holds the items; an object holds ``races[].runners[]``, whose race goes into
    ``ext_race_id`` and ``ext_race_number``. Entries that are no objects are skipped. ``feed_ddl``
    is the item under the feed's own field names, where those differ from ours.
    """
    ours = struct_type(item_ddl)
    item = ours.simpleString() if feed_ddl is None else struct_type(feed_ddl).simpleString()
    others = [F.col(c) for c in df.columns if c != text]
    body = F.ltrim(F.col(text))

    def entries(documents: Column) -> Column:
        # each entry stays text at first, so that one stray entry does not spoil its list
        return F.from_json(documents, "array<string>")

    shape = "struct<races:array<struct<raceId:string,number:int,runners:string>>>"
    race = "struct<id:string,number:int,item:string>"

    def listed(texts: Column, race_id: Column, number: Column) -> Column:
        entry = lambda x: F.struct(race_id.alias("id"), number.alias("number"), x.alias("item"))
        return F.coalesce(F.transform(entries(texts), entry), F.array().cast(f"array<{race}>"))

    none = F.lit(None).cast("string"), F.lit(None).cast("int")
    races = F.from_json(F.col(text), shape)["races"]
    items = F.when(body.startswith("["), listed(F.col(text), *none)).when(
        body.startswith("{"), F.flatten(F.transform(races, lambda r: listed(r["runners"], r["raceId"], r["number"])))
    )
    # places count through all races of a document, so no two items share one
    rows = df.select(*others, F.posexplode(items).alias("row_pos", "_e")).select(
        *others,
        "row_pos",
        F.col("_e.item").alias("_item"),
        F.col("_e.id").alias("ext_race_id"),
        F.col("_e.number").alias("ext_race_number"),
    )
    items = rows.where(F.ltrim("_item").startswith("{"))
    parsed = items.withColumn("_i", F.from_json("_item", item).cast(ours))
    return parsed.select(*others, "_i.*", "ext_race_id", "ext_race_number", "row_pos")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as text with their names; each is one response for one meeting."""
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("_file"))


def read_ratings(spark: SparkSession, path: str, names: Mapping[str, str] | None = None) -> DataFrame:
    """Meeting ratings, one file per day and meeting, in either shape."""
    docs = read_documents(spark, path)
    docs = docs.withColumns({"ext_date": file_date(F.col("_file")), "ext_meeting_id": file_meeting(F.col("_file"))}).drop("_file")
    theirs = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _renamed(struct_type(RATING_ITEM), names or {}))
    return split_shapes(docs, "value", RATING_ITEM, theirs)


def sectional_rows(documents: DataFrame, text: str, ddl: str) -> DataFrame:
    """Sectional documents of either shape to items; ``ddl`` names the values besides the runner's key.

    The key has gone by several names, two of which differ in case only; the first one set is taken.
    """
    keys = [f"_key{i}" for i in range(len(SECTIONAL_KEYS))]
    ours = ", ".join([*[f"{k} STRING" for k in keys], ddl])
    theirs = ", ".join([*[f"{k} STRING" for k in SECTIONAL_KEYS], ddl])
    items = split_shapes(documents, text, ours, theirs)
    return items.select(F.coalesce(*keys).alias("runner_id"), *[c for c in items.columns if c not in keys])


def read_sectionals(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Sectional times, one file per day and meeting."""
    docs = read_documents(spark, path)
    docs = docs.withColumns({"ext_date": file_date(F.col("_file")), "ext_meeting_id": file_meeting(F.col("_file"))})
    return sectional_rows(docs.drop("_file"), "value", ddl)


def _parquet_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _csv_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("header", True).option("escape", '"').csv(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def file_place() -> Column:
    """Where a row lies in an export: its file, the piece of the file a task read, and the row in that.

    It orders rows as the files of a folder do by name, without naming a file. Rows of one piece are read in order by one
    task, so their numbers grow, however many pieces the task reads.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("piece"),
        F.monotonically_increasing_id().alias("row"),
    )


def load_runners(spark: SparkSession, path: str, csv: bool = False) -> DataFrame:
    """The runner table: every known column present, one row per run (the last), empty if absent.

    A CSV export has no batch numbers; its own order decides (``file_place``). All its rows are of batch 0, and a row's
    position is that among the rows of its race in the export.
    """
    raw = _csv_or_none(spark, path) if csv else _parquet_or_none(spark, path)
    if raw is None:
        return empty(spark, RUNNERS + ", ingest_seq BIGINT, row_pos INT")
    given = set(raw.columns)
    raw = raw.withColumn("_place", file_place())
    if "ingest_seq" not in given:
        raw = raw.withColumn("ingest_seq", F.lit(0))
    if "row_pos" not in given:
        raw = raw.withColumn("row_pos", F.lit(None))
    fitted = conform(raw, RUNNERS).withColumns(
        {"ingest_seq": F.col("ingest_seq").cast("bigint"), "row_pos": F.col("row_pos").cast("int")}
    )
    last = keep_last(fitted, ["run_id"], ["ingest_seq", "row_pos", "_place"])
    if "row_pos" not in given:
        in_race = Window.partitionBy("race_id").orderBy("_place")
        last = last.withColumn("row_pos", F.row_number().over(in_race) - 1)
    return last.drop("_place")


def load_ratings(spark: SparkSession, path: str, csv: bool = False) -> DataFrame:
    """The second provider's ratings, or an empty table, which joins as all NULL.

    Where an export has no batch numbers, ``ingest_seq`` is a row's ``file_place``, which orders rows as a number would.
    """
    raw = _csv_or_none(spark, path) if csv else _parquet_or_none(spark, path)
    if raw is None:
        return empty(spark, schemas.RATINGS + ", ingest_seq BIGINT, row_pos INT")
    if "ingest_seq" not in raw.columns:
        raw = raw.withColumn("ingest_seq", file_place())
    if "row_pos" not in raw.columns:
        raw = raw.withColumn("row_pos", F.lit(0))
    return conform(raw, schemas.RATINGS)


def load_prices(spark: SparkSession, path: str, csv: bool = False) -> DataFrame:
    """The price history, without unusable prices and times."""
    raw = _csv_or_none(spark, path) if csv else _parquet_or_none(spark, path)
    if raw is None:
        return empty(spark, PRICE_HISTORY)
    if dict(raw.dtypes)["snapshot_time"] == "string":
        raw = raw.withColumn("snapshot_time", F.try_to_timestamp("snapshot_time"))
    return usable_prices(conform(raw, PRICE_HISTORY))
