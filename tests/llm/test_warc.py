"""Archives: round trips with magic inside payloads, copies, nulls, and splits of any size."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from railbird.llm import warc
from railbird.operators.groups import shared_dir

INNER = (
    "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:999>\r\nContent-Length: 25\r\n\r\n"
    "HTTP/1.1 200 OK\r\n\r\nabcdef\r\n\r\n"
)
PAGES = [
    (1, "http://a/1", "plain é text", "x"),
    (2, "http://a/2", f"before {INNER}after", "x"),
    (3, "http://a/3", INNER, None),
    (4, "http://a/4", INNER + INNER + "WARC/1.", "x"),
    (5, None, None, "x"),
    (6, "http://a/\r\n6", "", "x"),
    (7, "http://a/7", "plain é text", "x"),
    (8, "http://a/8", "WARC/1.0\r\nContent-Length: 5\r\n\r\n", "x"),
    (9, "http://a/9", "plain é text", "x"),
    (10, "http://a/10", "\r\n\r\n" + "WARC/1.1\r\n" * 40, "x"),
    (None, "http://a/11", "no id", "x"),
    (12, "http://a/12", "x" * 5000 + INNER, "x"),
    (12, "http://a/12", "x" * 5000 + INNER, "x"),
]


def expected(pages):
    digest = {p: base64.b32encode(hashlib.sha1((p or "").encode()).digest()).decode() for _, _, p, _ in pages}
    most = {}
    for i, _, p, _ in pages:
        if i is not None:
            most[p or ""] = max(i, most.get(p or "", i))
    out = []
    for i, _, p, _ in pages:
        again = i is not None and most[p or ""] != i
        out.append((i, len((p or "").encode()), digest[p], "revisit" if again else "response", most[p or ""] if again else None))
    return sorted(out, key=repr)


def frame(spark, pages, parts):
    return spark.createDataFrame(pages, "page_id long, url string, html string, value string").repartition(parts)


@pytest.mark.parametrize("split", [37, 500, 1 << 20])
def test_round_trip(spark, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        read = warc.archive(frame(spark, PAGES, 2))
        rows = read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(map(tuple, rows), key=repr) == expected(PAGES)


def test_empty_table(spark):
    assert warc.archive(frame(spark, PAGES, 1).where("page_id < 0")).count() == 0


def test_small_payloads_are_not_repeats(spark):
    pages = frame(spark, [(1, "u", "ab", ""), (2, "u", "ab", ""), (3, "u", "abcdef", ""), (4, "u", "abcdef", "")], 1)
    found = {r["page_id"]: r["refers_to"] for r in warc.planned(pages, 4).collect()}
    assert found == {3: 4}


def test_records_are_standard(spark):
    folder = f"{shared_dir(spark)}/warc-standard"
    warc.write(frame(spark, PAGES[:1], 1), folder)
    (record,) = [r["content"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).collect()]
    head, block = bytes(record).split(b"\r\n\r\n", 1)
    length = int(dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])[b"Content-Length"])
    assert head.startswith(b"WARC/1.0\r\n") and block[length:] == b"\r\n\r\n"
    assert block[:length].endswith("plain é text".encode())


def test_false_candidates_are_found_and_dropped(spark):
    folder = f"{shared_dir(spark)}/warc-false"
    warc.write(frame(spark, PAGES, 1), folder)
    found = warc.candidates(spark, folder)
    assert found.where("candidate").count() > len(PAGES)
    assert warc.reached(found).count() == len(PAGES)
    assert found.where("candidate").agg(F.max("successor")).head()[0] >= found.agg(F.max("start")).head()[0]


MAGIC_URLS = [
    (1, "http://a/1", "first", "x"),
    (2, "http://host/WARC/1.1/spec", "magic in the address", "x"),
    (3, "http://host/WARC/1%2E1/WARC/1%252E/WARC/1.WA RC/1.0", INNER, "x"),
    (4, "http://a/4", "last", "x"),
]


def test_magic_in_addresses(spark):
    rows = warc.archive(frame(spark, MAGIC_URLS, 1)).select("page_id", "url").collect()
    assert sorted(map(tuple, rows)) == [(i, url.replace(" ", "")) for i, url, _, _ in MAGIC_URLS]


@pytest.mark.parametrize(
    ("harm", "end"),
    [(lambda x: x[:-3], "of"), (lambda x: x + "more", "of"), (lambda x: x.replace("Content-Length", "Content-Size"), "end at 0 of")],
)
def test_a_file_that_is_not_read_to_its_end_is_an_error(spark, harm, end):
    folder = f"{shared_dir(spark)}/warc-harmed-{len(harm('Content-Length' * 4))}"
    warc.write(frame(spark, PAGES[:2], 1), f"{folder}-whole")
    text = "".join(r["value"] for r in spark.read.option("wholetext", True).text(f"{folder}-whole").collect())
    spark.createDataFrame([(harm(text),)], "value string").coalesce(1).write.option("lineSep", "\n").text(folder)
    with pytest.raises(ValueError, match=end):
        warc.read(spark, folder)
