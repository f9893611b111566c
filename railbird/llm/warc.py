"""Web archives: written as WARC files by Spark's text writer, and read back in splits of any size.

A reader of one split cannot tell a record from the same bytes inside a payload. So each task only lists candidates:
places where the magic stands with a header after it, and the place where that header says the next record begins. From
the beginning of each file, candidates are followed to their successors; those not reached are parts of payloads. Chains
within a split are found by its task, and the chains of a file are joined by pointer jumping.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from railbird.operators.groups import durable, shared_dir

MAGIC = "WARC/1."
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a binary column in upper-case base 32: five bits a character, so 10 hex digits are 8 characters."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def without_magic(url: Column) -> Column:
    """A URL with the dot of each magic in it percent-encoded, since readers split on the magic; what looks encoded is so once more."""
    again = F.regexp_replace(url, "WARC/1%((?:25)*)2E", "WARC/1%25$12E")
    return F.regexp_replace(again, "WARC/1\\.", "WARC/1%2E")


def with_magic(url: Column) -> Column:
    """What ``without_magic`` was given."""
    dotted = F.regexp_replace(url, "WARC/1%2E", "WARC/1.")
    return F.regexp_replace(dotted, "WARC/1%25((?:25)*)2E", "WARC/1%$12E")


def planned(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The records that repeat a payload: ``page_id`` and ``refers_to``, the largest id with that payload.

    Only digests and ids are shuffled; payloads of fewer than ``min_bytes`` bytes are never repeats.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    ids = pages.where(F.octet_length(payload) >= min_bytes).select(
        "page_id", base32_sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes")
    )
    most = ids.groupBy("digest", "bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    again = most.where(F.col("n") > 1).drop("n")
    found = ids.join(again, ["digest", "bytes"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return found.where(F.col("refers_to").isNotNull()).select("page_id", "refers_to").distinct()


def record(page_id: Column, url: Column, html: Column, refers_to: Column) -> Column:
    """The text of a record, up to the blank lines after it."""
    payload = F.coalesce(html, F.lit(""))
    size = F.octet_length(payload).cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END))
    again = refers_to.isNotNull()
    block = F.when(again, http).otherwise(F.concat(http, payload))
    refers = F.concat(F.lit("WARC-Refers-To: <urn:x-page:"), refers_to.cast("string"), F.lit(f">\r\nWARC-Profile: {PROFILE}\r\n"))
    return F.concat(
        F.lit(f"{MAGIC}0\r\nWARC-Type: "),
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:x-page:"),
        F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "),
        # a header line cannot hold control characters or blanks
        without_magic(F.regexp_replace(F.coalesce(url, F.lit("")), "[\\x00-\\x20\\x7f]", "")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        base32_sha1(payload.cast("binary")),
        F.lit("\r\n"),
        F.when(again, refers).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
        block,
    )


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> None:
    """Write a record for each row of ``page_id, url, html`` to archives in ``folder``, one file a partition.

    A page whose payload an id above its own also has is a revisit of the largest such id, without the payload. A null
    html is an empty payload; rows without an id are responses, as are repeated rows of the largest id. Pages are not
    shuffled where the list of revisits is small.
    """
    repeats = f"{folder}-revisits"
    planned(pages, min_bytes).write.parquet(repeats)  # a file, so that Spark knows its size and may broadcast it
    again = pages.sparkSession.read.parquet(repeats)
    joined = pages.select("page_id", "url", "html").join(again, "page_id", "left")
    line = record(F.col("page_id"), F.col("url"), F.col("html"), F.col("refers_to"))
    joined.select(line.alias("value")).write.option("lineSep", END).text(folder)


def header(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*(.*?)[ \t]*$", 1)
    return F.when(found != "", found)


def parsed(df: DataFrame) -> DataFrame:
    """Add what the piece of text after a magic says, taken as a record: see the columns."""
    head = F.substring_index("value", END, 1)
    pieces = df.withColumn("_head", head).withColumn("_bytes", F.octet_length("value"))
    pieces = pieces.withColumns(
        {
            "_body": F.octet_length("_head") + 4,
            "block_bytes": header(F.col("_head"), "Content-Length").try_cast("bigint"),
            "record_type": F.lower(header(F.col("_head"), "WARC-Type")),
            "page_id": F.regexp_extract(header(F.col("_head"), "WARC-Record-ID"), "^<urn:x-page:(-?[0-9]+)>$", 1).try_cast("bigint"),
            "refers_to": F.regexp_extract(header(F.col("_head"), "WARC-Refers-To"), "^<urn:x-page:(-?[0-9]+)>$", 1).try_cast("bigint"),
            "stated": F.regexp_replace(header(F.col("_head"), "WARC-Payload-Digest"), "^sha1:", ""),
            "url": with_magic(header(F.col("_head"), "WARC-Target-URI")),
        }
    )
    pieces = pieces.withColumn("candidate", F.col("_head").rlike("^[0-9]\r\n") & (F.col("_bytes") >= F.col("_body")) & F.col("block_bytes").isNotNull())
    # the HTTP header is ASCII up to its blank line, the rest is bytes
    http = F.substring_index(F.expr("substring(value, length(_head) + 5)"), END, 1)
    payload = F.expr("substring(cast(value as binary), cast(_body + _http + 5 as int), cast(block_bytes - _http - 4 as int))")
    return (
        pieces.withColumn("_http_head", http)
        .withColumn("_http", F.octet_length("_http_head"))
        .withColumn("whole", F.col("candidate") & (F.col("_bytes") == F.col("_body") + F.col("block_bytes") + 4))
        .withColumn("stated_bytes", header(F.col("_http_head"), "Content-Length").try_cast("bigint"))
        .withColumn("payload", F.when(F.col("whole") & (F.col("record_type") == "response"), payload))
    )


FIELDS = ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "stated_digest")


def fields(df: DataFrame) -> list[Column]:
    read = F.col("payload").isNotNull()
    return [
        F.col("page_id"),
        F.col("url"),
        F.col("record_type"),
        F.col("refers_to"),
        F.when(read, F.octet_length("payload").cast("long")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(read, base32_sha1(F.col("payload"))).otherwise(F.col("stated")).alias("payload_digest"),
        F.col("stated").alias("stated_digest"),
    ]


def pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The text between magics, with its file and that file's length, its split, and a number that grows within the split.

    Splits and numbers are those of one read: another may cut the files elsewhere. ``piece`` is the SHA-256 of the text.
    """
    read = spark.read.option("lineSep", MAGIC).text(folder)
    return read.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("_metadata.file_size").alias("length"),
        F.unhex(F.sha2(F.col("value").cast("binary"), 256)).alias("piece"),
    ).withColumn("n", F.monotonically_increasing_id())


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of the archives: ``start`` (the offset of the magic before) and, for candidates, ``successor``.

    Splits are read whole and in order, so the bytes of the pieces before one, of its own split and of those before in
    the file, are its offset. Payloads are digested where the piece is just a record, and not kept.
    """
    rows = parsed(pieces(spark, folder))
    known = durable(
        rows.select(
            "file", "length", "split", "n", "piece", "candidate", "whole", "_body", "block_bytes", *fields(rows), (F.col("_bytes") + len(MAGIC)).alias("size")
        )
    )
    splits = known.groupBy("file", "split").agg(F.sum("size").alias("_split_bytes"))
    upto = F.sum("_split_bytes").over(Window.partitionBy("file").orderBy("split"))
    starts = splits.select("file", "split", (upto - F.col("_split_bytes")).alias("_split_start"))
    before = F.sum("size").over(Window.partitionBy("file", "split").orderBy("n")) - F.col("size")
    placed = known.withColumn("_before", before).join(starts, ["file", "split"])
    start = F.col("_split_start") + F.col("_before") - len(MAGIC)
    successor = F.col("start") + len(MAGIC) + F.col("_body") + F.col("block_bytes") + len(END)
    return placed.withColumn("start", start).withColumn("successor", F.when(F.col("candidate"), successor)).drop(
        "_before", "_split_start", "_body", "block_bytes"
    )


def reached(found: DataFrame) -> DataFrame:
    """The candidates that the chain from the beginning of their file reaches."""
    own = Window.partitionBy("file", "split").orderBy("start")
    some = found.where("candidate").drop("length", "piece", "n")
    breaks = F.coalesce((F.lag("successor").over(own) != F.col("start")).cast("int"), F.lit(1))
    chained = some.withColumn("_breaks", breaks).withColumn("_chain", F.sum("_breaks").over(own))
    chains = Window.partitionBy("file", "split", "_chain")
    chained = durable(chained.withColumn("chain", F.min("start").over(chains)).drop("_breaks", "_chain"))
    tails = chained.groupBy("file", "chain").agg(F.max_by("successor", "start").alias("start"))
    steps = durable(
        tails.join(chained.select("file", "start", F.col("chain").alias("to")), ["file", "start"]).select(
            "file", "chain", "to", F.col("start").alias("entry")
        )
    )
    good = chained.where("start = 0").select("file", "chain")
    jumps, count = steps.select("file", "chain", "to"), -1
    while not jumps.isEmpty():
        more = good.join(jumps, ["file", "chain"]).select("file", F.col("to").alias("chain"))
        good = durable(good.union(more).distinct())
        now = good.count()
        if now == count:
            break
        count = now
        onward = jumps.select("file", F.col("chain").alias("to"), F.col("to").alias("_far"))
        jumps = durable(jumps.join(onward, ["file", "to"]).select("file", "chain", F.col("_far").alias("to")))
    entries = good.join(steps, ["file", "chain"]).select("file", F.col("to").alias("chain"), "entry")
    entries = entries.union(chained.where("start = 0").select("file", "chain", F.lit(0).cast("long")))
    return chained.join(entries, ["file", "chain"]).where(F.col("start") >= F.col("entry")).drop("chain", "entry")


def check_whole(found: DataFrame, records: DataFrame) -> None:
    """Raise ``ValueError`` unless the last record of each file ends where the file does."""
    ends = records.groupBy("file").agg(F.max("successor").alias("end"))
    lengths = found.groupBy("file").agg(F.max("length").alias("length"))
    short = lengths.join(ends, "file", "left").where(~F.col("end").eqNullSafe(F.col("length"))).limit(3).collect()
    if short:
        raise ValueError("; ".join(f"{r['file']}: records end at {r['end'] or 0} of {r['length']} bytes" for r in short))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the archives in ``folder``: see ``FIELDS``. Payloads are digested, not returned.

    Records whose payload holds the magic are put together from their pieces by a second read. A file that is not records
    from its beginning to its end is a ``ValueError``.
    """
    found = candidates(spark, folder)
    records = durable(reached(found))
    check_whole(found, records)
    whole = records.where("whole").select(*FIELDS)
    broken = records.where(~F.col("whole"))
    if broken.isEmpty():
        return whole
    marked = found.join(broken.select("file", F.col("start"), F.lit(True).alias("_broken")), ["file", "start"], "left")
    starts = records.select("file", "start", F.lit(True).alias("_record"))
    marked = marked.select("file", "piece", "start", "_broken").join(starts, ["file", "start"], "left")
    last = Window.partitionBy("file").orderBy("start")
    owned = marked.withColumns(
        {
            "owner": F.last(F.when(F.col("_record"), F.col("start")), True).over(last),
            "of": F.last(F.when(F.col("_record"), F.coalesce("_broken", F.lit(False))), True).over(last),
        }
    )
    wanted = f"{shared_dir(spark)}/pieces/{uuid.uuid4().hex}"
    owned.where("of").select("file", "piece", "start", "owner").write.parquet(wanted)
    places = spark.read.parquet(wanted)
    # pieces are asked for by what they are, as the second read may have other splits
    values = pieces(spark, folder).select("piece", "value").join(places.select("piece").distinct(), "piece", "left_semi")
    parts = places.join(values.dropDuplicates(["piece"]), "piece")
    together = parts.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("_all"))
    joined = parsed(together.select(F.array_join(F.col("_all.value"), MAGIC).alias("value")))
    return whole.unionByName(joined.select(*fields(joined)))


def archive(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}"
    write(pages, folder)
    return read(spark, folder)
