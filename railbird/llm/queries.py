"""The operators over whole tables, and the same as SQL where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railbird.llm import extract, katz, langid, mixture, neardup, periodic, quality, search, shards, suffixes, syncmers, warc, wumanber
from railbird.operators.groups import durable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SHARDS = 24

# CRC-32 (the reflected polynomial of zip files) byte by byte, from a table of 256 values
CRC_SQL = """RECURSIVE steps AS (
  SELECT range AS i, 0 AS k, range AS c FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS crc FROM steps WHERE k = 8)"""


def crc_sql(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    fold = "lambda c, b: xor(c >> 8, crc[CAST((xor(c, b) & 255) + 1 AS INT)])"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), {fold}), 4294967295)"


SHARD_SQL = f"""sized AS (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 8 AS size FROM docs),
placed AS (SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total
  FROM sized),
cut AS (SELECT *, CAST(((2 * before + size) * {SHARDS}) // (2 * total) AS INT) AS shard FROM placed)"""


@query(
    "op3_byte_shards",
    f"""WITH {CRC_SQL}, docs AS (SELECT * FROM documents), {SHARD_SQL}
  SELECT doc_id, CAST(size AS BIGINT) AS size, {crc_sql("text")} AS text_crc32, 'bytes' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
  FROM cut, crc_table""",
)
def op3_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 contiguous shards, in the order of their ids, of nearly equal bytes."""
    text = F.coalesce("text", F.lit(""))
    sized = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return shards.byte_shards(sized, SHARDS, ["doc_id"], "size").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


ALNUM_SQL = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
PASSAGES_SQL = f"""items AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {ALNUM_SQL.format(text="text")} AS words FROM benchmark),
windows AS (SELECT DISTINCT item, n, array_to_string(words[i + 1:i + n], ' ') AS win FROM
  (SELECT *, unnest(range(len(words) - n + 1)) AS i FROM (SELECT *, least(len(words), 13) AS n FROM items WHERE len(words) > 0))),
split AS (SELECT doc_id, coalesce({ALNUM_SQL.format(text="text")}, []) AS words FROM docs),
runs AS (SELECT doc_id, n, i, array_to_string(words[i + 1:i + n], ' ') AS win FROM (SELECT *, unnest(range(len(words) - n + 1)) AS i
  FROM split, (SELECT DISTINCT n FROM windows) WHERE len(words) >= n)),
found AS (SELECT DISTINCT doc_id, i, n, item FROM runs JOIN windows USING (n, win)),
hits AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS w FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM found)
  GROUP BY doc_id),
passages AS (SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
  FROM split LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id))"""


@query("op7_benchmark_passages", f"WITH docs AS (SELECT * FROM documents), {PASSAGES_SQL} SELECT * FROM passages")
def op7_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items found in each document, and whether they make up a twentieth of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return wumanber.find_passages(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        wumanber.contaminated().alias("contaminated"),
    )


LEVELS = ("domain", "lang", "source")
# the tables have no domains: sources are dealt to four by the number at their end (its last two digits tell), which the SQL also
# says, and those without a number by the CRC-32 of their name; the SQL fails on these and on numbers beyond int
DOMAIN = (
    "concat('d', coalesce(try_cast(right(regexp_extract(source, '([0-9]+)$', 1), 2) as int), crc32(cast(source as binary))) % 4)"
)
TOKENS = r"size(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 0))"
DOMAIN_WEIGHTS = {"d0": 0.4, "d1": 0.3, "d2": 0.2, "d3": 0.1}
LANG_WEIGHTS = {"en": 0.4, "fr": 0.25, "de": 0.2, "es": 0.15}
WEIGHTS = DOMAIN_WEIGHTS | {f"{d}/{x}": w for d in DOMAIN_WEIGHTS for x, w in LANG_WEIGHTS.items()}
SHARE, EPOCHS, SEED = 0.75, 2, 17


def _weight_sql(column: str, weights: dict[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {w}e0" for k, w in weights.items()) + " ELSE 1e0 END"


def _deal_sql(name: str, children: str, budget: str, parent: str) -> str:
    """Water-filling of each parent's budget over its children, as the level at which all is dealt."""
    by = f"PARTITION BY {parent} " if parent else ""
    return f"""{name}_l AS (SELECT *, ({budget} - (sum(room) OVER ({by}ORDER BY room / weight, weight, path ROWS UNBOUNDED PRECEDING) - room))
  / sum(weight) OVER ({by}ORDER BY room / weight, weight, path ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM {children}),
{name} AS (SELECT * EXCLUDE (l), least(room, coalesce(weight * max(CASE WHEN room > l * weight THEN l END) OVER ({by}), room)) AS given
  FROM {name}_l)"""


MIX_SQL = f"""sized AS (SELECT doc_id, 'd' || (CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4) AS domain, lang, source,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM docs),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, {EPOCHS} * CAST(sum(n_tokens) AS DOUBLE) AS room, 1e0 AS weight,
  concat_ws('/', domain, lang, source) AS path FROM sized GROUP BY ALL),
langs AS (SELECT domain, lang, sum(room) AS room, {_weight_sql("lang", LANG_WEIGHTS)} AS weight, domain || '/' || lang AS path
  FROM leaves GROUP BY domain, lang),
domains AS (SELECT domain, sum(room) AS room, {_weight_sql("domain", DOMAIN_WEIGHTS)} AS weight, domain AS path,
  (SELECT {SHARE} * sum(tokens) FROM leaves) AS budget FROM langs GROUP BY domain),
{_deal_sql("domains_given", "domains", "budget", "")},
langs_in AS (SELECT langs.*, given AS budget FROM langs JOIN (SELECT domain, given FROM domains_given) USING (domain)),
{_deal_sql("langs_given", "langs_in", "budget", "domain")},
leaves_in AS (SELECT leaves.*, given AS budget FROM leaves JOIN (SELECT domain, lang, given FROM langs_given) USING (domain, lang)),
{_deal_sql("leaves_given", "leaves_in", "budget", "domain, lang")},
budgets AS (SELECT domain, lang, source, tokens, leaf_budget, leaf_budget // tokens AS reads FROM
  (SELECT *, CAST(floor(given + 1e-6) AS BIGINT) AS leaf_budget FROM leaves_given)),
ordered AS (SELECT sized.*, tokens, leaf_budget, reads, sum(n_tokens) OVER (PARTITION BY domain, lang, source
  ORDER BY md5('{SEED}/' || reads || '/' || doc_id) ROWS UNBOUNDED PRECEDING) AS upto FROM sized JOIN budgets USING (domain, lang, source)),
mixed AS (SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens, leaf_budget,
  CAST(reads + CASE WHEN upto <= leaf_budget - reads * tokens AND leaf_budget > reads * tokens THEN 1 ELSE 0 END AS INT) AS copies FROM ordered)"""


@query("op8_source_mixture", f"WITH docs AS (SELECT * FROM documents), {MIX_SQL} SELECT * FROM mixed")
def op8_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken to fill three quarters of the tokens by domain, language and source.

    The domain is that of ``DOMAIN``: any source has one, whether it ends in a number or not; a null source is ``(none)``.
    """
    docs = table(spark, sf_dir, "documents").withColumn("domain", F.expr(DOMAIN))
    mixed = mixture.mix(docs, LEVELS, TOKENS, WEIGHTS, SHARE, EPOCHS, SEED)
    return mixed.select("doc_id", *LEVELS, "n_tokens", "leaf_budget", "copies")


QUALITY_THRESHOLD = 0.7


@query("op5_quality_scores")
def op5_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of each document, learned from the labels of three quarters of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = quality.remainder("doc_id", 4) == 2
    stats = durable(quality.with_statistics(docs).select("doc_id", held_out.alias("held_out"), "stats"))
    train = quality.training_rows(stats.where(~F.col("held_out")), table(spark, sf_dir, "labels"), "quality")
    scored = quality.score(stats, quality.fit(durable(train)), QUALITY_THRESHOLD)
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op10_languages")
def op10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learned from four fifths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = quality.remainder("doc_id", 5) == 0
    filters = langid.fit(docs.where(~held_out))
    return langid.identify(docs, filters).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op2_syncmer_fingerprints")
def op2_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints of each document and of its edited text, and how near they and the next document's are."""
    return syncmers.compare_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def base32_sql(digest: str) -> str:
    parts = " || ".join(f"to_base(CAST('0x' || substr({digest}, {1 + 10 * i}, 10) AS BIGINT), 32, 8)" for i in range(4))
    return f"translate({parts}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"


@query(
    "op4_warc_round_trip",
    f"""WITH payloads AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
last AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS latest FROM payloads)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {base32_sql("hex")} AS payload_digest,
  CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = latest THEN NULL ELSE latest END AS refers_to FROM last""",
)
def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back by following the records from the beginning of each file."""
    read = warc.archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_main_texts")
def op9_main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page."""
    return extract.main_texts(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


@query("op1_near_duplicates")
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each document by links of 85 percent or more of three-word shingles."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), neardup.Near(3, 85))


@query("op6_katz_scores")
def op6_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability of each document by a bigram model learned from six sevenths of them."""
    docs = katz.read_chunks(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text", "chunk")
    docs = docs.withColumn("held_out", quality.remainder("doc_id", 7) == 2)
    return katz.score(docs).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def with_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the documents, which their ids name, with a period from a place on that the id names too."""
    n, h = len(words), 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


# of two runs, the one of the greater length by period comes first, then the one that begins first, then that of the smaller period
STRONGEST = """get(array_sort(runs, (a, b) -> CASE
  WHEN a.length * b.period <> b.length * a.period THEN CAST(sign(b.length * a.period - a.length * b.period) AS INT)
  WHEN a.start <> b.start THEN CAST(sign(a.start - b.start) AS INT) ELSE CAST(sign(a.period - b.period) AS INT) END), 0)"""

# equal stretches of eight words seed the periods of a document; islands of equal words a period apart are its runs
RUNS_SQL = rf"""WITH {CRC_SQL}, split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS words,
  {crc_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents, crc_table),
planned AS (SELECT *, len(words) AS n, (h // 10) % greatest(len(words), 1) AS a, 3 + (h // 10) % 8 AS parts FROM split),
docs AS (SELECT row_number() OVER () AS r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n),
  lambda i: words[CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // parts) ELSE i END + 1]) ELSE words END AS words FROM planned),
eights AS (SELECT r, i, hash(words[i + 1:i + 8]) AS eight FROM (SELECT r, words, unnest(range(n - 7)) AS i FROM docs WHERE n >= 24)),
periods AS (SELECT DISTINCT a.r, b.i - a.i AS q FROM eights a JOIN eights b ON a.r = b.r AND a.eight = b.eight AND a.i < b.i
  JOIN docs ON docs.r = a.r WHERE a.i % 8 = 0 AND 3 * (b.i - a.i) <= docs.n),
same AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM
  (SELECT r, q, unnest(list_filter(range(n - q), lambda i: words[i + 1] = words[i + q + 1])) AS i FROM periods JOIN docs USING (r))),
runs AS (SELECT r, start, length, min(q) AS period FROM (SELECT r, q, min(i) AS start, count(*) + q AS length FROM same GROUP BY r, q, island)
  WHERE length >= greatest(24, 3 * q) GROUP BY r, start, length),
listed AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY r),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / period DESC, start, period) AS place FROM runs)
  WHERE place = 1),
gone AS (SELECT r, list(DISTINCT i) AS gone FROM (SELECT r, unnest(range(start + period, start + length)) AS i FROM runs) GROUP BY r),
kept AS (SELECT docs.r, CASE WHEN gone IS NULL THEN words ELSE list_select(words, [i + 1 FOR i IN list_filter(range(n),
  lambda i: NOT list_contains(gone, i))]) END AS words FROM docs LEFT JOIN gone USING (r))
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, start, length, CAST(period AS BIGINT) AS period,
  (1000 * length) // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(array_to_string(kept.words, ' ')) AS collapsed_sha256
  FROM docs JOIN kept USING (r) LEFT JOIN listed USING (r) LEFT JOIN best USING (r)"""


@query("op12_periodic_runs", RUNS_SQL)
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of words of each document, a tenth of which get a period of their own first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic.periodic_runs(docs, change=with_period).withColumn("best", F.expr(STRONGEST))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
RANKED = 50


@query(
    "op13_ranked_search",
    f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {TERMS_SQL} AS terms FROM documents),
held AS (SELECT count(*) AS docs_n, sum(len(terms)) AS terms_n FROM docs WHERE len(terms) > 0),
postings AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(terms) AS t FROM docs) GROUP BY r, t),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, held GROUP BY t),
lengths AS (SELECT r, doc_id, 100 - 50 + (50 * len(terms) * docs_n) // terms_n AS m FROM docs, held),
items AS (SELECT DISTINCT item_id, unnest({TERMS_SQL}) AS t FROM benchmark),
scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM items JOIN weights USING (t) JOIN postings USING (t) JOIN lengths USING (r) GROUP BY item_id, r, doc_id)
SELECT * FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
  FROM scored WHERE score > 0) WHERE rank <= {RANKED}""",
)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty documents that rank highest for each benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = search.search_once(docs, table(spark, sf_dir, "benchmark"), RANKED)
    return found.select(F.col("query").alias("item_id"), "rank", "doc_id", "score")


# texts as hexadecimal digits, two a byte
REPEATS_SQL = """WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h,
  octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (SELECT r, unnest(range(n - 199)) AS i, unnest(list_transform(range(n - 199), lambda i: hash(substr(h, 2 * i + 1, 400)))) AS w
  FROM docs WHERE n >= 200),
twice AS (SELECT r, i FROM windows JOIN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1) USING (w)),
islands AS (SELECT r, i, sum(CASE WHEN i > before + 200 OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS island
  FROM (SELECT *, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM twice)),
spans AS (SELECT r, min(i) AS start, max(i) + 200 AS stop FROM islands GROUP BY r, island),
pieces AS (SELECT r, start, stop, substr(h, 2 * last + 1, 2 * (start - last)) AS piece FROM docs JOIN
  (SELECT *, coalesce(lag(stop) OVER (PARTITION BY r ORDER BY start), 0) AS last FROM spans) USING (r)),
cut AS (SELECT r, count(*) AS n_spans, sum(stop - start) AS n_removed, string_agg(piece, '' ORDER BY start) AS kept, max(stop) AS stop
  FROM pieces GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE kept || substr(h, 2 * stop + 1) END)) AS kept_sha256
  FROM docs LEFT JOIN cut USING (r)"""


@query("op11_repeated_passages", REPEATS_SQL)
def op11_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the strings of 200 bytes that occur more than once."""
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lengths = F.transform("spans", lambda s: s["stop"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate(lengths, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
