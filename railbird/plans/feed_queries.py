"""Queries over nested feeds. Each row of a table becomes one feed document, and is read back as such."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railbird.operators import flatten
from railbird.plans import star
from railbird.plans.catalog import query, rounded
from railbird.sources import landing, schemas


def documents(spark: SparkSession, sf_dir: str, table: str, body: str, *keep: str) -> DataFrame:
    """One JSON document per row of a table.

    Rows are dealt to all tasks, as a row of a few bytes in its file becomes a document of kilobytes, that takes long to parse.
    """
    rows = star.table(spark, sf_dir, table).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.select(*[F.expr(k) for k in keep], F.expr(f"to_json({body})").alias("value"))


def landed_twice(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """The same documents as they came first and as they came again."""
    return earlier.withColumn("landed", F.lit(1)).unionByName(later.withColumn("landed", F.lit(2)))


def struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


# Two meetings a day; the first has two races, the second one.
_RACES = {
    1: {"meeting": 1, "number": "1", "prize": "o_totalprice", "start": "startTime", "dropped": "o_custkey % 11 = 0"},
    2: {"meeting": 1, "number": "2", "prize": "CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_totalprice / 100 END", "start": "jumpTime", "dropped": "false"},
    3: {"meeting": 2, "number": "1", "prize": "o_totalprice / 50", "start": "raceTime", "dropped": "o_custkey % 13 = 0"},
}
_MEETINGS = {
    1: {"venue": "o_orderstatus", "isTrialMeeting": "o_custkey % 7 = 0", "isJumpout": "CAST(NULL AS BOOLEAN)"},
    2: {"venue": "CAST(NULL AS STRING)", "isTrialMeeting": "false", "isJumpout": "o_custkey % 5 = 0"},
}


def _calendar_body() -> str:
    meeting = schemas.struct_type(schemas.CALENDAR)["meetings"].dataType.elementType
    types = {f.name: f.dataType.simpleString() for f in meeting["races"].dataType.elementType}

    def race(k: int) -> str:
        r = _RACES[k]
        given = {
            "raceId": f"o_orderkey * 10 + {k}",
            "number": r["number"],
            "name": "concat('Race ', o_custkey)",
            "distance": "CAST(1000 + o_custkey % 5 * 400 AS INT)",
            "prizeMoney": r["prize"],
            "startTime": "concat(CAST(o_orderdate AS DATE), 'T05:00:00Z')" if r["start"] == "startTime" else "''",
            "raceTime": "'14:10'" if r["start"] == "raceTime" else "CAST(NULL AS STRING)",
            "jumpTime": "'15:45'",
            "isAbandoned" if k != 3 else "isBarrierTrial": r["dropped"],
        }
        return struct({name: f"CAST({given.get(name, 'NULL')} AS {kind})" for name, kind in types.items()})

    meetings = []
    for m, fields in _MEETINGS.items():
        # fields differ between races, as they do in a feed: what is null is not in the document
        races = [race(k) for k, r in _RACES.items() if r["meeting"] == m]
        meetings.append(struct({**fields, "state": "'VIC'", "going": "o_orderpriority", "races": f"array({', '.join(races)})"}))
    return struct({"date": "CAST(CAST(o_orderdate AS DATE) AS STRING)", "meetings": f"array({', '.join(meetings)})"})


def _calendar_sql(select: str) -> str:
    parts = []
    for k, r in _RACES.items():
        m = _MEETINGS[r["meeting"]]
        start = {"startTime": "concat(CAST(o_orderdate AS DATE), 'T05:00:00Z')", "raceTime": "'14:10'", "jumpTime": "'15:45'"}[r["start"]]
        parts.append(
            f"SELECT CAST(o_orderdate AS DATE) AS date, coalesce({m['venue']}, '') AS venue, 'VIC' AS state, {r['number']} AS race, "
            f"CAST(o_orderkey * 10 + {k} AS STRING) AS race_id, concat('Race ', o_custkey) AS race_name, "
            f"CAST(1000 + o_custkey % 5 * 400 AS INT) AS distance, CAST({r['prize']} AS DOUBLE) AS prize_money, o_orderpriority AS going, "
            f"{start} AS start_time, o_custkey, o_totalprice FROM orders WHERE NOT coalesce({m['isTrialMeeting']}, false) "
            f"AND NOT coalesce({m['isJumpout']}, false) AND NOT ({r['dropped']}) AND {r['prize']} >= 1000"
        )
    return f"races AS ({' UNION ALL '.join(parts)}) {select}"


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.parse_feed(documents(spark, sf_dir, "orders", _calendar_body()), "value", schemas.CALENDAR)


@query(
    "calendar_races",
    "WITH " + _calendar_sql("SELECT * EXCLUDE (o_custkey, o_totalprice) FROM races WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'"),
)
def calendar_races(spark: SparkSession, sf_dir: str) -> DataFrame:
    races = flatten.calendar_races(calendar(spark, sf_dir), dt.date(1996, 1, 1), dt.date(2000, 12, 31))
    return races.drop("track_grading", "rail_position")


# Three entries per race: a runner, one with a bad price, and one that is scratched now and then.
_ENTRIES = {
    1: {"price": "CAST(o_custkey % 9 AS STRING)", "scratched": "CAST(NULL AS BOOLEAN)", "rating": "o_totalprice / 1000"},
    2: {"price": "'n/a'", "scratched": "false", "rating": "o_totalprice / 900"},
    3: {"price": "concat(o_custkey % 4, '.5')", "scratched": "o_custkey % 2 = 0", "rating": "CAST(NULL AS DOUBLE)"},
}


def _run_id(k: int) -> str:
    return f"o_orderkey * 100 + {k}"


def detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every race's detail twice: at first other prices and ratings, and one runner more."""
    entries = {
        k: {
            "runId": _run_id(k),
            "isScratched": e["scratched"],
            "tabNumber": f"{k}",
            "barrier": f"CAST(o_custkey % 10 + {k} AS INT)",
            "horse": f"concat('Horse ', {k})",
            "jockey": "o_orderpriority",
            "trainer": "o_orderstatus",
            "rating": e["rating"],
            "ratingPrice": "o_totalprice / 5000",
            "speed": f"CAST(o_custkey % 30 + {k} AS DOUBLE)",
            "fixedWinPrice": e["price"],
            "sectEarly": "CAST(NULL AS DOUBLE)",
            "weightCarried": f"50.5e0 + {k}",
        }
        for k, e in _ENTRIES.items()
    }
    early = [struct({**e, "rating": "1.0e0", "fixedWinPrice": "'99'", "isScratched": "false"}) for e in entries.values()]
    early.append(struct({**entries[1], "runId": _run_id(4)}))

    def landed(runners: list[str]) -> DataFrame:
        body = struct({"raceId": "o_orderkey * 10 + 1", "runners": f"array({', '.join(runners)})"})
        return landing.parse_feed(documents(spark, sf_dir, "orders", body), "value", schemas.DETAIL)

    return landed_twice(landed(early), landed([struct(e) for e in entries.values()]))


def _entries_sql() -> str:
    parts = [
        f"SELECT o_orderkey, CAST(o_orderkey * 10 + 1 AS STRING) AS race_id, CAST({_run_id(k)} AS STRING) AS run_id, {k} AS tab_number, "
        f"concat('Horse ', {k}) AS horse, {e['rating']} AS rating, CAST(o_custkey % 30 + {k} AS DOUBLE) AS speed_rating, "
        f"TRY_CAST({e['price']} AS DOUBLE) AS fixed_win_price, CAST(o_orderdate AS DATE) AS race_day, o_custkey AS ck, o_totalprice AS tp "
        f"FROM orders WHERE NOT coalesce({e['scratched']}, false)"
        for k, e in _ENTRIES.items()
    ]
    return f"entries AS ({' UNION ALL '.join(parts)})"


@query("live_prices", f"WITH {_entries_sql()} SELECT run_id, fixed_win_price AS price FROM entries WHERE fixed_win_price > 1")
def live_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.live_prices(detail(spark, sf_dir))


@query(
    "result_rows",
    """SELECT CAST(o_orderkey AS STRING) AS race_id, CAST(o_orderkey * 100 + k AS STRING) AS run_id, finish, sp, top FROM (
      SELECT o_orderkey, 1 AS k, CAST(o_custkey % 4 AS INT) AS finish, o_totalprice / 1000 AS sp, o_totalprice / 900 AS top FROM orders
      UNION ALL SELECT o_orderkey, 2, CASE WHEN o_orderstatus = 'F' THEN 2 END, o_totalprice / 1100, NULL FROM orders) WHERE finish <> 0""",
)
def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = {"runId": _run_id(1), "positionFinish": "CAST(o_custkey % 4 AS INT)", "priceStarting": "o_totalprice / 1000", "priceTop": "o_totalprice / 900"}
    second = {"runId": _run_id(2), "positionFinish": "CASE WHEN o_orderstatus = 'F' THEN 2 END", "priceStarting": "o_totalprice / 1100", "priceTop": "CAST(NULL AS DOUBLE)"}
    third = {"runId": "CAST(NULL AS BIGINT)", "positionFinish": "1", "priceStarting": "1.0e0", "priceTop": "1.0e0"}
    body = struct({"raceId": "o_orderkey", "runners": f"array({struct(first)}, {struct(second)}, {struct(third)})"})
    feed = landing.parse_feed(documents(spark, sf_dir, "orders", body), "value", schemas.RESULTS)
    return flatten.result_rows(feed).drop("row_pos")


# Past runs of entry 1 only: two rated before the day, one on it, one trial. Entry 2 has an empty form.
_PAST = (
    {"days": "7", "wpr": "CAST(o_custkey % 50 AS DOUBLE)", "trial": "false", "finish": "CAST(o_custkey % 11 AS INT)"},
    {"days": "21", "wpr": "CAST(o_custkey % 40 + 1 AS DOUBLE)", "trial": "CAST(NULL AS BOOLEAN)", "finish": "CAST(NULL AS INT)"},
    {"days": "0", "wpr": "90.0e0", "trial": "false", "finish": "1"},
    {"days": "30", "wpr": "80.0e0", "trial": "true", "finish": "1"},
)


@query(
    "runner_rows",
    "WITH "
    + _calendar_sql(
        f""", {_entries_sql()},
      nett AS (SELECT race_id, run_id, {rounded("CASE tab_number WHEN 1 THEN tp / 1000 WHEN 2 THEN tp / 1000 + 2 END", 1)} AS wpr_nett,
          row_number() OVER (PARTITION BY race_id ORDER BY CASE tab_number WHEN 1 THEN tp / 1000 WHEN 2 THEN tp / 1000 + 2 END DESC NULLS LAST) AS n FROM entries),
      final AS (SELECT r.race_id, e.run_id, r.date, r.prize_money, r.start_time, e.horse, e.rating, e.speed_rating, e.fixed_win_price,
          wpr_nett, CASE WHEN wpr_nett IS NOT NULL THEN n END AS wpr_rank,
          CASE tab_number WHEN 1 THEN CASE WHEN ck % 50 = 0 THEN 1 ELSE 2 END WHEN 2 THEN 0 END AS runs_with_wpr,
          CASE WHEN tab_number = 1 THEN CASE WHEN ck % 50 = 0 THEN CAST(ck % 40 + 1 AS DOUBLE) ELSE CAST(ck % 50 AS DOUBLE) END END AS wpr_last1,
          CASE WHEN tab_number = 1 THEN CASE WHEN ck % 50 = 0 THEN '?' ELSE concat(CASE WHEN ck % 11 IN (0, 10) THEN 'x' ELSE CAST(ck % 11 AS STRING) END, '-?') END END AS form_string,
          CASE WHEN tab_number = 2 THEN 12.5e0 END AS jockey_win_pct_90d, 0 AS resulted, CAST(NULL AS INT) AS won
          FROM entries e JOIN races r USING (race_id) LEFT JOIN nett USING (race_id, run_id)) SELECT * FROM final"""
    ).replace(") , entries", "), entries", 1),
)
def runner_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runner rows from all feeds of a race, each landed twice: detail, net ratings, form and statistics."""
    orders = star.table(spark, sf_dir, "orders")
    # the ratings differ by more than their rounding, so ranking before or after it is the same
    adjustments = [
        struct({"runId": _run_id(k), "defaults": struct({"wprBase": base, "wprAdjustment": "0.0e0"}), "adjustments": struct({"wprAdjustment": adj})})
        for k, base, adj in ((1, "o_totalprice / 1000", "0.0e0"), (2, "o_totalprice / 1000", "2.0e0"), (3, "CAST(NULL AS DOUBLE)", "1.0e0"))
    ]
    def cached(more: str) -> DataFrame:
        listed = ", ".join(a.replace("o_totalprice / 1000", f"o_totalprice / 1000 + {more}") for a in adjustments)
        body = struct({"raceId": "o_orderkey * 10 + 1", "runAdjustments": f"array({listed})"})
        return landing.parse_feed(documents(spark, sf_dir, "orders", body), "value", schemas.NET_RATINGS)

    caches = landed_twice(cached("3.5e0"), cached("0.0e0"))
    past = [
        struct(
            {
                "formNumber": f"{i}",
                "date": f"CAST(date_sub(CAST(o_orderdate AS DATE), {p['days']}) AS STRING)",
                "wpr": p["wpr"],
                "isBarrierTrial": p["trial"],
                "positionFinish": p["finish"],
            }
        )
        for i, p in enumerate(_PAST)
    ]
    forms = landing.parse_feed(
        documents(spark, sf_dir, "orders", struct({"runId": _run_id(1), "form": f"array({', '.join(past)})"})), "value", schemas.FORM
    ).unionByName(
        landing.parse_feed(orders.select(F.expr(f"concat('{{\"runId\":', {_run_id(2)}, ',\"form\":[]}}')").alias("value")), "value", schemas.FORM)
    )
    domain = struct({"region": "'All'", "startingPrice": "'all'", "periodDays": "90", "jumpsOrFlats": "'flatsOnly'"})
    forms = landed_twice(forms.withColumn("form", F.slice("form", 1, 1)), forms)

    def rated(percent: str) -> DataFrame:
        one = struct({"domain": domain, "winPercent": percent})
        body = struct({"runId": _run_id(2), "jockeyStats": f"array({one})"})
        return landing.parse_feed(documents(spark, sf_dir, "orders", body), "value", schemas.STATS)

    stats = landed_twice(rated("99.5e0"), rated("12.5e0"))
    rows = flatten.runner_rows(flatten.calendar_races(calendar(spark, sf_dir)), detail(spark, sf_dir), caches, forms, stats)
    return rows.select(
        "race_id", "run_id", "date", "prize_money", "start_time", "horse", "rating", "speed_rating", "fixed_win_price", "wpr_nett",
        "wpr_rank", "runs_with_wpr", "wpr_last1", "form_string", "jockey_win_pct_90d", "resulted", "won",
    )


_TRACK = {"name": "concat('Track ', c_nationkey)", "trackId": "CAST(c_nationkey AS STRING)", "state": "c_mktsegment", "country": "'AUS'", "abbrev": "'TRK'", "surface": "'Turf'"}
_MEETING = {
    "meetingId": "CAST(c_custkey AS STRING)",
    "tabMeeting": "CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE c_nationkey % 3 = 1 END",
    "isBarrierTrial": "CASE WHEN c_nationkey % 5 = 0 THEN true WHEN c_nationkey % 5 = 1 THEN false END",
    "railPosition": "'True'",
    "stage": "c_mktsegment",
    "expectedCondition": "'Good'",
    "formUpdated": "concat('f', c_custkey)",
    "ratingsUpdated": "concat('r', c_custkey)",
    "hasSectionals": "c_acctbal > 0",
}


def _meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = struct({**_MEETING, "track": struct(_TRACK)})
    docs = documents(spark, sf_dir, "customer", body, "date_add(DATE '2024-01-01', CAST(c_custkey % 90 AS INT)) AS date")
    return landing.parse_feed(docs, "value", schemas.MEETINGS)


@query(
    "meeting_rows",
    f"""SELECT CAST(DATE '2024-01-01' + CAST(c_custkey % 90 AS INT) AS DATE) AS date, {_MEETING['meetingId']} AS meeting_id, {_TRACK['name']} AS venue,
      {_TRACK['trackId']} AS track_id, c_mktsegment AS state, 'AUS' AS country, 'TRK' AS abbrev, 'Turf' AS surface, 'True' AS rail_position,
      c_mktsegment AS stage, true AS tab_meeting, 'Good' AS expected_condition, {_MEETING['formUpdated']} AS form_updated,
      {_MEETING['ratingsUpdated']} AS ratings_updated, c_acctbal > 0 AS has_sectionals
      FROM customer WHERE c_nationkey % 3 = 1 AND c_nationkey % 5 <> 0""",
)
def meeting_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.meeting_rows(flatten.bet_meetings(_meetings(spark, sf_dir)))


_PRIZES = {1: "CAST(p_retailprice * 25 AS STRING)", 2: "CASE WHEN p_size % 3 = 0 THEN '0' WHEN p_size % 3 = 1 THEN 'tba' ELSE '19999' END"}


def _value(path: str, dtype: str, seed: int) -> str:
    """A value that differs by field, runner and part, in SQL both sides read."""
    k = sum(ord(c) for c in path) % 97 + seed
    if dtype == "STRING":
        return f"concat('{path.split('.')[-1]}', p_partkey, '-{seed}')"
    if dtype == "BOOLEAN":
        return f"(p_size + {k}) % 2 = 0"
    return f"p_size + {k}.25e0" if dtype == "DOUBLE" else f"p_size + {k}"


def _build(fields: dict, prefix: str, seed: int) -> str:
    return struct(
        {
            name: _value(f"{prefix}.{name}", t, seed) if isinstance(t, str) else _build(t, f"{prefix}.{name}", seed)
            for name, t in fields.items()
        }
    )


def _leaf(path: str) -> str:
    found = {"race": schemas.FIELD_RACE, "runner": schemas.FIELD_RUNNER}
    for name in path.split("."):
        found = found[name]
    return found


_DAY = "date_add(DATE '2024-01-01', CAST(p_partkey % 30 AS INT))"


def _two_days(meetings: DataFrame) -> DataFrame:
    """Each meeting, and another one of the same id forty days later."""
    other = meetings.withColumns({"date": F.date_add("date", 40), "track": F.col("track").withField("name", F.lit("elsewhere"))})
    return meetings.unionByName(other)


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    races = []
    for r, prize in _PRIZES.items():
        runners = [_build(schemas.FIELD_RUNNER, "runner", 10 * r + i) for i in (1, 2)]
        scalars = {n: _value(f"race.{n}", t, r) for n, t in schemas.FIELD_RACE.items() if n != "prizeMoney"}
        races.append(struct({**scalars, "prizeMoney": prize, "runners": f"array({', '.join(runners)})"}))
    body = struct({"meetingId": "CAST(p_partkey AS STRING)", "races": f"array({', '.join(races)})"})
    return landing.parse_feed(documents(spark, sf_dir, "part", body, f"{_DAY} AS date"), "value", schemas.FIELDS)


def _field_columns_sql(r: int, seed: int) -> str:
    out = []
    paths = dict(flatten.RUNNER_PATHS)
    paths |= {f"{p}_{n}": f"runner.{b}.{n}" for b, p in schemas.RECORD_BLOCKS.items() for n in flatten.RECORD_FIELDS}
    paths |= {f"{b}_{s}": f"runner.{b}.{n}" for b in schemas.PERFORMANCE_BLOCKS for s, n in flatten.PERFORMANCE_FIELDS.items()}
    own = {
        "ext_date": "DATE '2024-01-01' + CAST(p_partkey % 30 AS INT)",
        "ext_meeting_id": "CAST(p_partkey AS STRING)",
        "ext_venue": "p_name",
        "ext_state": "p_brand",
        "ext_surface": "p_type",
        "race_prize": _PRIZES[r],
    }
    for name, path in paths.items():
        out.append(f"{own[name] if name in own else _value(path, _leaf(path), r if path.startswith('race.') else seed)} AS {name}")
    return ", ".join(out)


@query(
    "field_runners",
    " UNION ALL ".join(
        f"SELECT {_field_columns_sql(r, 10 * r + i)} FROM part WHERE p_size <> 5 AND coalesce(floor(TRY_CAST({_PRIZES[r]} AS DOUBLE)), 0) NOT BETWEEN 1 AND 19999"
        for r in _PRIZES
        for i in (1, 2)
    ),
)
def field_runners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second provider's fields as wide rows: 40 scalars, 8 records and 6 performance blocks."""
    meetings = star.table(spark, sf_dir, "part").select(
        F.expr(_DAY).alias("date"),
        F.expr("CASE WHEN p_size = 5 THEN concat('x', p_partkey) ELSE CAST(p_partkey AS STRING) END").alias("meetingId"),
        F.expr("named_struct('name', p_name, 'state', p_brand, 'surface', p_type)").alias("track"),
    )
    return flatten.field_runners(_two_days(meetings), _fields(spark, sf_dir)).drop("row_pos")


_ITEM = (
    "'{{\"raceId\":\"', p_partkey, '\",\"runnerId\":\"', p_size, '-{k}\",\"raceNo\":{k},\"runnerName\":\"', p_name, '\",\"aiRank\":', p_size, "
    "',\"runStyle\":\"', p_brand, '   \",\"isReliable\":true}}'"
)


def _rating_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = _ITEM.format(k=1), _ITEM.format(k=2)
    flat = f"concat('[', {first}, ',5,null,', {second}, ']')"
    nested = f"concat('{{\"races\":[{{\"raceId\":\"r', p_partkey, '\",\"number\":4,\"runners\":[', {first}, ',\"x\"]}},{{\"raceId\":\"e\",\"number\":5}}]}}')"
    return star.table(spark, sf_dir, "part").select(
        F.expr(_DAY).alias("ext_date"),
        F.col("p_partkey").cast("string").alias("ext_meeting_id"),
        F.expr(f"CASE WHEN p_size % 4 = 0 THEN {nested} ELSE {flat} END").alias("value"),
    )


@query(
    "rating_rows",
    """WITH items AS (SELECT part.*, 1 AS k FROM part UNION ALL SELECT part.*, 2 FROM part WHERE p_size % 4 <> 0)
      SELECT CAST(p_partkey AS STRING) AS ext_meeting_id, DATE '2024-01-01' + CAST(p_partkey % 30 AS INT) AS ext_date, p_type AS ext_venue,
      concat(p_size, '-', k) AS runnerId, k AS raceNo, p_name AS runnerName, p_size AS aiRank, p_brand AS runStyle, true AS isReliable,
      CASE WHEN p_size % 4 = 0 THEN concat('r', p_partkey) END AS ext_race_id, CASE WHEN p_size % 4 = 0 THEN 4 END AS ext_race_number FROM items""",
)
def rating_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rating documents of both shapes, with stray entries among the items."""
    items = landing.split_shapes(_rating_documents(spark, sf_dir), "value", schemas.RATING_ITEM)
    meetings = star.table(spark, sf_dir, "part").select(
        F.expr(_DAY).alias("date"),
        F.col("p_partkey").cast("string").alias("meetingId"),
        F.expr("named_struct('name', p_type)").alias("track"),
    )
    return flatten.rating_rows(items, _two_days(meetings)).select(
        "ext_meeting_id", "ext_date", "ext_venue", "runnerId", "raceNo", "runnerName", "aiRank", "runStyle", "isReliable",
        "ext_race_id", "ext_race_number",
    )


@query(
    "sectional_rows",
    """SELECT CAST(p_partkey AS STRING) AS ext_meeting_id, CAST(p_size AS STRING) AS runner_id, p_retailprice AS last600 FROM part""",
)
def sectional_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sectional documents whose runner key goes by three names."""
    name = "CASE WHEN p_size % 3 = 0 THEN 'runnerId' WHEN p_size % 3 = 1 THEN 'RunnerId' ELSE 'runner_id' END"
    docs = star.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("ext_meeting_id"),
        F.expr(f"concat('[{{\"', {name}, '\":', p_size, ',\"last600\":', p_retailprice, '}}]')").alias("value"),
    )
    return landing.sectional_rows(docs, "value", "last600 DOUBLE").select("ext_meeting_id", "runner_id", "last600")


@query(
    "payload_envelopes",
    """SELECT event_id, event_id % 5 IN (1, 3) AS failed, CASE WHEN event_id % 5 NOT IN (1, 3) THEN CAST(props->>'$.k' AS INT) END AS k FROM events""",
)
def payload_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses with and without an envelope, some failed, some malformed."""
    wrapped = {
        0: "concat('{\"payLoad\":', props, ',\"error\":null,\"errors\":[]}')",
        1: "concat('{\"payLoad\":', props, ',\"error\":\"no access\"}')",
        2: "props",
        3: "concat('{\"payLoad\":', props)",
        4: "concat('{\"payLoad\":', props, ',\"errors\":\"\"}')",
    }
    cases = " ".join(f"WHEN {k} THEN {e}" for k, e in wrapped.items())
    docs = star.table(spark, sf_dir, "events").select("event_id", F.expr(f"CASE event_id % 5 {cases} END").alias("value"))
    return landing.payloads(docs).select(
        "event_id", "failed", F.get_json_object("payload", "$.k").cast("int").alias("k")
    )
