"""Within-race queries: votes, ranks, pace, rules, scores and nested records."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railbird.functions.scalars import half_even
from railbird.operators import payload, race, ranks, rules, score, tables
from railbird.operators.groups import Groups
from railbird.operators.ranks import ANCHORS, SIGNALS, Signal
from railbird.plans.catalog import over_races, query, rounded, with_runners
from railbird.plans.star import TIE, runners

BY_ROW = "ln, pk, sk"

LONG_SQL = "long AS (" + " UNION ALL ".join(
    f"SELECT race_id, run_id, ln, pk, sk, {i} AS sig, CAST({'' if s.descending else '-'}{s.column} AS DOUBLE) AS score "
    f"FROM runners WHERE {s.column} IS NOT NULL"
    for i, s in enumerate(SIGNALS)
) + ")"
PLACED_SQL = (
    "placed AS (SELECT race_id, run_id, sig, row_number() OVER "
    f"(PARTITION BY race_id, sig ORDER BY score DESC, {BY_ROW}) AS place FROM long)"
)
VOTES_SQL = (
    "totals AS (SELECT race_id, CAST(count(DISTINCT sig) AS INT) AS total_signals FROM long GROUP BY race_id), "
    "votes AS (SELECT race_id, run_id, CAST(count(*) AS INT) AS votes, min(sig) AS first_signal FROM placed "
    "WHERE place = 1 GROUP BY race_id, run_id)"
)
TOP_SQL = (
    "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY votes DESC, first_signal) AS n "
    "FROM votes JOIN totals USING (race_id)) WHERE n = 1)"
)


@query(
    "signal_votes",
    with_runners(
        LONG_SQL, PLACED_SQL, VOTES_SQL,
        select="SELECT race_id, run_id, votes, first_signal, total_signals FROM votes JOIN totals USING (race_id)",
    ),
)
def signal_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_races(
        spark,
        sf_dir,
        lambda df, g: race.votes(df, g, tie=TIE)
        .where("votes > 0")
        .select("race_id", "run_id", "votes", "first_signal", "total_signals"),
    )


@query(
    "top_selection",
    with_runners(LONG_SQL, PLACED_SQL, VOTES_SQL, TOP_SQL, select="SELECT race_id, run_id, votes, total_signals FROM top"),
)
def top_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_races(
        spark,
        sf_dir,
        lambda df, g: race.top_selection(race.votes(df, g, tie=TIE), g).select(
            "race_id", "run_id", "votes", "total_signals"
        ),
    )


def _ordinal_sql(column: str, direction: str = "DESC") -> str:
    return (
        f"CASE WHEN {column} IS NOT NULL THEN row_number() OVER "
        f"(PARTITION BY race_id ORDER BY {column} {direction} NULLS LAST, {BY_ROW}) END"
    )


ORDINALS = {"rating_place": Signal("rating"), "late_place": Signal("late_speed_score"), "form_place": Signal("wpr_consistency", False)}


@query(
    "rank_ordinal",
    with_runners(
        select="SELECT race_id, run_id, "
        + ", ".join(
            f"{_ordinal_sql(s.column, 'DESC' if s.descending else 'ASC')} AS {name}" for name, s in ORDINALS.items()
        )
        + " FROM runners"
    ),
)
def rank_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(df: DataFrame, g: Groups) -> DataFrame:
        df = df.select("race_id", "run_id", *TIE, *[s.column for s in ORDINALS.values()])
        return ranks.ordinal_ranks(df, g, ORDINALS, TIE).select("race_id", "run_id", *ORDINALS)

    return over_races(spark, sf_dir, work)


@query(
    "rank_competition",
    with_runners(
        select="""SELECT race_id, run_id,
          CASE WHEN speed_rating IS NOT NULL THEN rank() OVER (PARTITION BY race_id ORDER BY speed_rating DESC NULLS LAST) END AS speed_rank_in_race,
          CASE WHEN wpr_dist IS NOT NULL THEN rank() OVER (PARTITION BY race_id ORDER BY wpr_dist ASC NULLS LAST) END AS dist_rank
          FROM runners"""
    ),
)
def rank_competition(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(df: DataFrame, g: Groups) -> DataFrame:
        df = race.speed_rank(df.select("race_id", "run_id", "speed_rating", "wpr_dist"), g)
        df = ranks.competition_ranks(df, g, {"dist_rank": Signal("wpr_dist", descending=False)})
        return df.select("race_id", "run_id", "speed_rank_in_race", "dist_rank")

    return over_races(spark, sf_dir, work)


BOTTOM_SQL = """
  rank() OVER (PARTITION BY race_id ORDER BY late_speed_score DESC NULLS LAST) AS late_rank,
  rank() OVER (PARTITION BY race_id ORDER BY ext_ai_rank ASC NULLS LAST) AS ai_rank"""


def _bottom(df: DataFrame, g: Groups) -> DataFrame:
    return ranks.bottom_ranks(
        df, g, {"late_rank": Signal("late_speed_score"), "ai_rank": Signal("ext_ai_rank", descending=False)}
    )


@query("rank_nulls_last", with_runners(select=f"SELECT race_id, run_id, {BOTTOM_SQL} FROM runners"))
def rank_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(df: DataFrame, g: Groups) -> DataFrame:
        narrow = df.select("race_id", "run_id", "late_speed_score", "ext_ai_rank")
        return _bottom(narrow, g).select("race_id", "run_id", "late_rank", "ai_rank")

    return over_races(spark, sf_dir, work)


@query(
    "pct_rank",
    with_runners(
        f"ranked AS (SELECT race_id, run_id, count(*) OVER (PARTITION BY race_id) AS n, {BOTTOM_SQL} FROM runners)",
        select=f"SELECT race_id, run_id, {rounded('(n - late_rank) / nullif(n - 1, 0)', 4)} AS late_pct, "
        f"{rounded('(n - ai_rank) / nullif(n - 1, 0)', 4)} AS ai_pct FROM ranked",
    ),
)
def pct_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(df: DataFrame, g: Groups) -> DataFrame:
        narrow = df.select("race_id", "run_id", "late_speed_score", "ext_ai_rank")
        sized = g.totals(_bottom(narrow, g), n=F.count(F.lit(1)))
        n = F.col("n")
        return sized.select(
            "race_id",
            "run_id",
            half_even(ranks.percentile(F.col("late_rank"), n), 4).alias("late_pct"),
            half_even(ranks.percentile(F.col("ai_rank"), n), 4).alias("ai_pct"),
        )

    return over_races(spark, sf_dir, work)


ANCHOR_SIGNALS = {short: next(s for s in SIGNALS if s.column == c) for short, c in ANCHORS.items()}


@query(
    "anchor_ranks",
    with_runners(
        select="SELECT race_id, run_id, "
        + ", ".join(
            f"{_ordinal_sql(s.column, 'DESC' if s.descending else 'ASC')} AS rnk_{k}, "
            f"CAST(nullif(count({s.column}) OVER (PARTITION BY race_id), 0) AS INT) AS fsz_{k}"
            for k, s in ANCHOR_SIGNALS.items()
        )
        + " FROM runners"
    ),
)
def anchor_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(df: DataFrame, g: Groups) -> DataFrame:
        df = df.select("race_id", "run_id", *TIE, *[s.column for s in ANCHOR_SIGNALS.values()])
        df = ranks.anchor_ranks(df, g, ANCHOR_SIGNALS, TIE)
        return df.select(
            "race_id",
            "run_id",
            *[F.col(f"{group}.{k}").alias(f"{group}_{k}") for k in ANCHORS for group in ("rnk", "fsz")],
        )

    return over_races(spark, sf_dir, work)


@query(
    "topk_per_signal",
    with_runners(LONG_SQL, PLACED_SQL, select="SELECT race_id, run_id, sig, place FROM placed WHERE place <= 5"),
)
def topk_per_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_races(
        spark, sf_dir, lambda df, g: ranks.leaders(df, SIGNALS, tie=TIE).select("race_id", "run_id", "sig", "place")
    )


RANKINGS_SQL = """
  positions AS (SELECT race_id, run_id, row_number() OVER (PARTITION BY race_id ORDER BY ln, pk, sk) - 1 AS pos FROM runners),
  lists AS (SELECT race_id, sig, list(pos ORDER BY place) AS l FROM placed JOIN positions USING (race_id, run_id)
            WHERE place <= 5 GROUP BY race_id, sig),
  slots AS (SELECT race_id, sig FROM (SELECT DISTINCT race_id FROM long), (SELECT unnest(range(12)) AS sig)),
  rankings AS (SELECT race_id, string_agg(array_to_string(list_resize(coalesce(l, []), 5, -1), ','), '|' ORDER BY sig) AS sig_rankings
               FROM slots LEFT JOIN lists USING (race_id, sig) GROUP BY race_id)"""


def _rankings_text(c: str) -> F.Column:
    return F.array_join(F.transform(c, lambda a: F.array_join(a.cast("array<string>"), ",")), "|")


@query(
    "leader_positions",
    with_runners(LONG_SQL, PLACED_SQL, RANKINGS_SQL, select="SELECT race_id, sig_rankings FROM rankings"),
)
def leader_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(df: DataFrame, g: Groups) -> DataFrame:
        df = g.numbers(df, {"pos": [F.col(c) for c in TIE]}).withColumn("pos", F.col("pos") - 1)
        return ranks.leader_positions(df, SIGNALS, tie=TIE).select(
            "race_id", _rankings_text("sig_rankings").alias("sig_rankings")
        )

    return over_races(spark, sf_dir, work)


TEMPO_SQL = "CASE WHEN {q} IS NULL THEN NULL WHEN {q} <= 1 THEN 'slow' WHEN {q} >= 4 THEN 'fast' ELSE 'neutral' END"
PACE_SQL = f"""
  sorted AS (SELECT race_id, run_id, speed_rating, avg_800m_pos,
      row_number() OVER (PARTITION BY race_id ORDER BY speed_rating DESC NULLS LAST, {BY_ROW}) AS nth,
      avg(speed_rating) OVER (PARTITION BY race_id) AS mean FROM runners),
  pace_race AS (SELECT race_id, count(avg_800m_pos) AS known, count(*) FILTER (WHERE avg_800m_pos <= 3.0) AS early,
      count(*) FILTER (WHERE avg_800m_pos <= 2.5) AS close, count(speed_rating) AS rated,
      count(*) FILTER (WHERE speed_rating > mean + 5) AS quick,
      max(speed_rating) FILTER (WHERE nth = 1) AS s1, max(speed_rating) FILTER (WHERE nth = 3) AS s3
      FROM sorted GROUP BY race_id),
  pace AS (SELECT *, CASE WHEN known >= 3 THEN early WHEN rated >= 4 THEN quick END AS q,
      CASE WHEN known >= 3 THEN close >= 3 WHEN rated >= 4 THEN s1 - s3 < 5 END AS contested_pace FROM pace_race)"""
SETTLED_SQL = """CASE
  WHEN avg_settled_pos <= 2.5 THEN 'leader' WHEN avg_settled_pos <= 4.5 THEN 'on-pace'
  WHEN avg_settled_pos <= 8 THEN 'midfield' WHEN avg_settled_pos IS NOT NULL THEN 'backmarker'
  WHEN speed_rating IS NULL OR n = 1 THEN 'unknown'
  WHEN sr <= 2 THEN 'leader' WHEN sr <= 4 THEN 'on-pace' WHEN (sr - 1) / (n - 1) <= 0.6 THEN 'midfield'
  ELSE 'backmarker' END"""
SETTLING_SQL = f"""
  speeds AS (SELECT *, count(*) OVER (PARTITION BY race_id) AS n,
      rank() OVER (PARTITION BY race_id ORDER BY speed_rating DESC NULLS LAST) AS sr FROM runners),
  settled AS (SELECT *, {SETTLED_SQL} AS settling FROM speeds)"""


@query(
    "pace_scenario",
    with_runners(PACE_SQL, select=f"SELECT race_id, {TEMPO_SQL.format(q='q')} AS pace_scenario, contested_pace FROM pace"),
)
def pace_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(df: DataFrame, g: Groups) -> DataFrame:
        paced = race.pace(df.select("race_id", *TIE, "avg_800m_pos", "speed_rating"), g, tie=TIE)
        return paced.select("race_id", "pace_scenario", "contested_pace").distinct()

    return over_races(spark, sf_dir, work)


@query("settling", with_runners(SETTLING_SQL, select="SELECT race_id, run_id, settling FROM settled"))
def settling(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(df: DataFrame, g: Groups) -> DataFrame:
        df = race.speed_rank(df.select("race_id", "run_id", "speed_rating", "avg_settled_pos"), g)
        return race.settling(df, g).select("race_id", "run_id", "settling")

    return over_races(spark, sf_dir, work)


@query(
    "race_pace",
    with_runners(
        SETTLING_SQL, PACE_SQL,
        """counted AS (SELECT race_id, count(*) FILTER (WHERE CASE WHEN avg_800m_pos IS NOT NULL THEN avg_800m_pos <= 3
             ELSE settling IN ('leader', 'on-pace') END) AS k FROM settled GROUP BY race_id)""",
        select=f"""SELECT race_id, {TEMPO_SQL.format(q='k')} AS race_pace_score,
             coalesce(contested_pace, s1 - s3 < 5) AS contested_pace FROM counted JOIN pace USING (race_id)""",
    ),
)
def race_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(df: DataFrame, g: Groups) -> DataFrame:
        df = df.select("race_id", *TIE, "avg_800m_pos", "speed_rating", "avg_settled_pos")
        df = race.contested_fallback(race.pace(df, g, tie=TIE), g, tie=TIE)
        df = race.race_pace(race.settling(race.speed_rank(df, g), g), g)
        return df.select("race_id", "race_pace_score", "contested_pace").distinct()

    return over_races(spark, sf_dir, work)


@query(
    "runner_flags",
    with_runners(
        SETTLING_SQL, PACE_SQL,
        select="""SELECT s.race_id, run_id, bool_or(runs_with_wpr = 0) OVER (PARTITION BY s.race_id) AS has_first_starter,
          CASE WHEN settling = 'backmarker' THEN CASE WHEN q >= 4 THEN 'caution' WHEN q IS NOT NULL THEN 'watch' ELSE 'unknown' END END AS backmarker_flag,
          CASE WHEN barrier = 0 THEN NULL WHEN barrier <= 4 THEN 'inside' WHEN barrier <= 8 THEN 'mid' WHEN barrier > 8 THEN 'wide' END AS barrier_pos,
          speed_rating IS NOT NULL AND sr <= 2 AS is_on_pace
          FROM settled s JOIN pace USING (race_id)""",
    ),
)
def runner_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(df: DataFrame, g: Groups) -> DataFrame:
        df = df.select(
            "race_id", "run_id", *TIE, "avg_800m_pos", "speed_rating", "avg_settled_pos", "barrier", "runs_with_wpr"
        )
        df = race.race_context(df, g, tie=TIE)
        return df.select(
            "race_id",
            "run_id",
            "has_first_starter",
            race.backmarker_flag(F.col("settling"), F.col("pace_scenario")).alias("backmarker_flag"),
            race.barrier_position(F.col("barrier")).alias("barrier_pos"),
            race.is_on_pace(F.col("speed_rank_in_race")).alias("is_on_pace"),
        )

    return over_races(spark, sf_dir, work)


@query(
    "optimal_selections",
    with_runners(
        LONG_SQL, PLACED_SQL, VOTES_SQL, TOP_SQL,
        "firsts AS (SELECT race_id, bool_or(runs_with_wpr = 0) AS hfs FROM runners GROUP BY race_id)",
        select="""SELECT race_id, run_id, votes, total_signals,
          votes >= 7 AND fixed_win_price >= 2 AND prize_money >= 25000 AND coalesce(wpr_trend >= 0, true) AND NOT hfs AS is_optimal
          FROM top JOIN runners USING (race_id, run_id) JOIN firsts USING (race_id)""",
    ),
)
def optimal_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_races(
        spark, sf_dir, lambda df, g: race.optimal_flags(race.first_starter(df, g), g, tie=TIE)
    )


FIRST_ROW_SQL = (
    "firsts AS (SELECT race_id, bool_or(runs_with_wpr = 0) AS hfs, count(*) AS n FROM runners GROUP BY race_id)"
)
RANKED_SQL = (
    "ranked AS (SELECT runners.*, hfs, "
    + ", ".join(f"{_ordinal_sql(c)} AS r_{name}" for name, c in rules.RANKED.items())
    + " FROM runners JOIN firsts USING (race_id))"
)
_RANK_EXPR = {
    "wpr_rank": "r_wpr_rank",
    "late_rank": "r_late_rank",
    "ext_class_rank": "ext_class_rank",
    "ext_last600_rank": "ext_last600_rank",
    "ext_ai_rank": "ext_ai_rank",
    "rating_rank": "r_rating_rank",
}
_FIRSTS = " + ".join(f"CASE WHEN {e} = 1 THEN 1 ELSE 0 END" for e in _RANK_EXPR.values())
_THREES = " + ".join(f"CASE WHEN {e} BETWEEN 1 AND 3 THEN 1 ELSE 0 END" for e in _RANK_EXPR.values())
JUDGED_SQL = f"judged AS (SELECT *, {_FIRSTS} AS firsts, {_THREES} AS threes FROM ranked WHERE prize_money >= 20000 AND NOT hfs)"
PICKS_SQL = (
    "picks AS (SELECT *, 'main' AS model FROM judged WHERE firsts >= 3 AND threes >= 5 UNION ALL "
    "SELECT *, 'loose' AS model FROM judged WHERE firsts >= 2 AND threes >= 4)"
)
PICK_SHOWN = (
    "date", "venue", "race", "race_id", "start_time", "model", "run_id", "horse", "jockey", "trainer", "tab_number",
    "barrier", "ext_ai_rank", "ext_ai_price", "ext_class_rank", "ext_last600_rank", "ext_run_style", "weight_trend",
    "wins_at_dist", "fixed_win_price", "starting_price_sp", "price_top", "finish_position", "won", "placed", "resulted",
)


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_races(spark, sf_dir, lambda df, g: rules.picks(df, g, tie=TIE))


@query(
    "rule_picks",
    with_runners(
        FIRST_ROW_SQL, RANKED_SQL, JUDGED_SQL, PICKS_SQL,
        select=f"SELECT {', '.join(PICK_SHOWN)}, {', '.join(f'r_{n} AS computed_{n}' for n in rules.RANKED)} FROM picks",
    ),
)
def rule_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picks(spark, sf_dir).select(*PICK_SHOWN, *[F.col(n).alias(f"computed_{n}") for n in rules.RANKED])


@query(
    "registered_rule",
    with_runners(
        FIRST_ROW_SQL, RANKED_SQL,
        select="""SELECT race_id, run_id, 'late_value' AS model FROM ranked
          WHERE prize_money >= 20000 AND r_late_rank <= 2 AND fixed_win_price >= 3 AND dayname(date) = 'Saturday'""",
    ),
)
def registered_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule a user adds to the book: late speed at a price, on Saturdays."""
    late_value = rules.Rule(
        "late_value",
        "Late value",
        "Second or better on late speed at three or more, Saturdays",
        lambda: (F.col("late_rank") <= 2) & (F.col("fixed_win_price") >= 3.0) & (F.col("dow") == "Saturday"),
    )
    book = rules.RuleBook().register(late_value)
    return over_races(
        spark, sf_dir, lambda df, g: rules.picks(df, g, book, tie=TIE).select("race_id", "run_id", "model")
    )


@query(
    "pick_summary",
    with_runners(
        FIRST_ROW_SQL, RANKED_SQL, JUDGED_SQL, PICKS_SQL,
        "meta AS (SELECT * FROM (VALUES ('main', 0.238, 7.6, 3.0, true), ('loose', 0.214, 20.7, 3.0, false)) "
        "AS m(model, wr, per_day, min_odds, is_primary))",
        select="""SELECT model, CAST(wr AS DOUBLE) AS wr, CAST(per_day AS DOUBLE) AS per_day, CAST(min_odds AS DOUBLE) AS min_odds,
          is_primary, count(*) AS picks, count(DISTINCT horse) AS horses, count(DISTINCT race_id) AS races,
          greatest(count(*) - 15, 0) AS more FROM picks JOIN meta USING (model) GROUP BY ALL""",
    ),
)
def pick_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.pick_summary(picks(spark, sf_dir)).select(
        "model", "wr", "per_day", "min_odds", "is_primary", "picks", "horses", "races", "more"
    )


@query(
    "shown_picks",
    with_runners(
        FIRST_ROW_SQL, RANKED_SQL, JUDGED_SQL, PICKS_SQL,
        select="""SELECT model, race_id, run_id, place FROM (SELECT model, race_id, run_id,
          row_number() OVER (PARTITION BY model ORDER BY date, start_time, race_id, run_id) AS place FROM picks) WHERE place <= 15""",
    ),
)
def shown_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 15 picks of each model, as the report lists them."""
    order = [F.col(c).asc() for c in ("date", "start_time", "race_id", "run_id")]
    return payload.shown_picks(picks(spark, sf_dir), order).select("model", "race_id", "run_id", "place")


def _nested_pick_sql() -> str:
    computed = {c: f"r_{c}" for c in rules.RANKED}
    return ", ".join(f"{computed.get(c, c)} AS {k}" for k, c in payload.NESTED_PICK.items())


PICK_LIST_SQL = f"""SELECT race_id, 0 AS part, model, CAST(row_number() OVER (PARTITION BY race_id, model ORDER BY run_id) - 1 AS INT) AS place,
  {_nested_pick_sql()} FROM picks"""


def _pick_list(nested: DataFrame) -> DataFrame:
    """The nested pick map pick by pick, with every field of a pick."""
    by_model = nested.select("race_id", "part", F.explode("picks").alias("model", "_list"))
    listed = by_model.select("race_id", "part", "model", F.posexplode("_list").alias("place", "_p"))
    return listed.select("race_id", "part", "model", "place", *[F.col("_p")[k].alias(k) for k in payload.NESTED_PICK])


@query("picks_by_race", with_runners(FIRST_ROW_SQL, RANKED_SQL, JUDGED_SQL, PICKS_SQL, select=PICK_LIST_SQL))
def picks_by_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pick_list(over_races(spark, sf_dir, lambda df, g: payload.picks_by_race(rules.picks(df, g, tie=TIE), g)))


@query(
    "picks_of_day",
    with_runners(
        FIRST_ROW_SQL, RANKED_SQL, JUDGED_SQL, PICKS_SQL,
        "today AS (SELECT * FROM picks WHERE date = DATE '1998-06-15')",
        select="""SELECT model, race_id, run_id, place, CAST(n AS BIGINT) AS picks FROM (SELECT model, race_id, run_id,
          count(*) OVER (PARTITION BY model) AS n, row_number() OVER (PARTITION BY model ORDER BY start_time, race_id, run_id) AS place
          FROM today) WHERE place <= 15""",
    ),
)
def picks_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picks of one day as the daily report lists them, with how many there are."""
    day, found = dt.date(1998, 6, 15), picks(spark, sf_dir)
    order = [F.col(c).asc() for c in ("start_time", "race_id", "run_id")]
    shown = payload.shown_picks(found, order, day)
    return shown.join(payload.pick_summary(found, day=day).select("model", "picks"), "model").select(
        "model", "race_id", "run_id", "place", "picks"
    )


def _score_sql(paths: dict[str, dict[str, float]], trust: bool, values: dict[str, str]) -> tuple[str, ...]:
    signals = list(dict.fromkeys(s for w in paths.values() for s in w))
    ranked = ", ".join(
        f"rank() OVER (PARTITION BY race_id ORDER BY v_{s} {'ASC' if s in score.LOWER_IS_BETTER else 'DESC'} NULLS LAST) AS k_{s}"
        for s in signals
    )
    pct = ", ".join(f"(n - k_{s}) / nullif(n - 1, 0) AS p_{s}" for s in signals)

    def weighted(w):
        return " + ".join(["CAST(0 AS DOUBLE)", *[f"CAST({x} AS DOUBLE) * p_{s}" for s, x in w.items()]])

    def linear(w):
        return f"({weighted(w)}) / {sum(abs(x) for x in w.values())!r}"

    z = f"(CAST({score.LOGISTIC_INTERCEPT} AS DOUBLE) + ({weighted(paths['C'])}))"
    raw = f"WHEN 'C' THEN 1 / (1 + exp(-greatest(-30, least(30, {z})))) WHEN 'B' THEN {linear(paths['B'])}"
    combo = "WHEN have_jt >= n * 0.5 THEN 'A' " if trust else ""
    if trust:
        raw += f" WHEN 'A' THEN {linear(paths['A'])}"

    def conf(w):
        terms = [rounded(f"p_{s}", 3) for s in w]
        k = len(terms)
        mean = f"(({' + '.join(terms)}) / {k})"
        var = " + ".join(f"({t} - {mean}) * ({t} - {mean})" for t in terms)
        return rounded(f"greatest(0, least(1, 1 - sqrt(({var}) / {k}) / 0.5))", 3)

    sure = " ".join(f"WHEN '{p}' THEN {conf(w)}" for p, w in paths.items())
    sums = " ".join(
        f"WHEN '{p}' THEN " + rounded(" + ".join(rounded(f"p_{s}", 3) for s in w), 3) for p, w in paths.items()
    )
    return (
        "vals AS (SELECT race_id, run_id, ln, pk, sk, ext_ai_rank, ext_class_rank, ext_last600_rank, "
        + ", ".join(f"{values.get(s, s)} AS v_{s}" for s in signals) + " FROM runners)",
        "cover AS (SELECT race_id, count(*) AS n, greatest(count(ext_ai_rank), count(ext_class_rank), count(ext_last600_rank)) AS have"
        + (", count(v_jt_combo_win_pct) AS have_jt" if trust else "") + " FROM vals GROUP BY race_id)",
        f"ranks AS (SELECT vals.*, n, CASE {combo}WHEN have >= n * 0.5 THEN 'C' ELSE 'B' END AS cs_path, {ranked} FROM vals JOIN cover USING (race_id))",
        f"pcts AS (SELECT *, {pct} FROM ranks)",
        f"scored AS (SELECT *, CASE WHEN n = 1 THEN 1 ELSE CASE cs_path {raw} END END AS s, "
        f"CASE WHEN n = 1 THEN 1 ELSE CASE cs_path {sure} END END AS csc, "
        f"CASE WHEN n = 1 THEN 0 ELSE CASE cs_path {sums} END END AS sig_sum FROM pcts)",
    )


def _score_select() -> str:
    return (
        f"SELECT race_id, run_id, {rounded('s', 4)} AS cs, row_number() OVER (PARTITION BY race_id ORDER BY s DESC, {BY_ROW}) AS crk, "
        "cs_path, CAST(csc AS DOUBLE) AS csc, CAST(sig_sum AS DOUBLE) AS sig_sum FROM scored"
    )


SCORE_COLUMNS = (
    "race_id", "run_id", *TIE, "rating", "wpr_avg_last3", "late_speed_score", "ext_ai_rank", "ext_class_rank",
    "ext_last600_rank", "jt_combo_win_pct", "jt_combo_rides",
)


def _scored(spark: SparkSession, sf_dir: str, spec: score.ScoreSpec, names: tuple[str, ...]) -> DataFrame:
    def work(df: DataFrame, g: Groups) -> DataFrame:
        df = score.score_races(df.select(*SCORE_COLUMNS), g, spec, TIE)
        # the breakdown is checked through its sum, taken in the signals' order
        parts = F.array_compact(F.array(*[F.col("csg")[s] for s in names]))
        total = F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)
        return df.select("race_id", "run_id", "cs", "crk", "cs_path", "csc", half_even(total, 3).alias("sig_sum"))

    return over_races(spark, sf_dir, work)


_DEFAULT_PATHS = {"C": score.LOGISTIC_WEIGHTS, "B": score.LINEAR_WEIGHTS}


@query("score_races", with_runners(*_score_sql(_DEFAULT_PATHS, False, {}), select=_score_select()))
def score_races(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, score.ScoreSpec(), tuple(score.LOGISTIC_WEIGHTS))


_COMBO_PATHS = {"A": score.COMBO_WEIGHTS, **_DEFAULT_PATHS}
_SHRUNK = "(jt_combo_rides * jt_combo_win_pct + 30 * 9.0e0) / (jt_combo_rides + 30)"


@query(
    "score_combo",
    with_runners(*_score_sql(_COMBO_PATHS, True, {"jt_combo_win_pct": _SHRUNK}), select=_score_select()),
)
def score_combo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score with the combined jockey and trainer rate trusted: path A where half the field has it."""
    names = tuple(dict.fromkeys([*score.COMBO_WEIGHTS, *score.LOGISTIC_WEIGHTS]))
    return _scored(spark, sf_dir, score.ScoreSpec(trust_combo=True), names)


@query("shrunk_rates", with_runners(select=f"SELECT race_id, run_id, {rounded(_SHRUNK, 4)} AS rate FROM runners"))
def shrunk_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = score.shrunk_rate(F.col("jt_combo_win_pct"), F.col("jt_combo_rides"))
    return runners(spark, sf_dir).select("race_id", "run_id", half_even(rate, 4).alias("rate"))


def _with_nested(df: DataFrame) -> DataFrame:
    entry = "struct(1 AS starts, CAST(ln = 1 AS INT) AS wins, CAST(ln <= 3 AS INT) AS places)"
    return df.withColumn("going_breakdown", F.expr(f"map('good', {entry})"))


RECORDS_SQL = (
    "rows AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY ln, pk, sk) AS pos FROM runners)",
    "hfs AS (SELECT race_id, bool_or(runs_with_wpr = 0) AS hfs FROM runners GROUP BY race_id)",
)


def _runner_sql() -> str:
    """Every field of a runner record, from the runner's row, its score and its place."""
    text = [f"coalesce(CAST(x.{c} AS VARCHAR), '') AS {k}" for k, c in payload.TEXT_KEYS.items()]
    wholes = [f"CAST(trunc(x.{c}) AS INT) AS {k}" for k, c in payload.WHOLE_KEYS.items()]
    numbers = [f"{rounded('x.' + c, 3)} AS {k}" for k, c in payload.NUMBER_KEYS.items()]
    shares = []
    for signal in SCORE_SIGNALS:
        paths = ", ".join(f"'{p}'" for p, w in _DEFAULT_PATHS.items() if signal in w)
        shares.append(f"CASE WHEN sc.cs_path IN ({paths}) THEN {rounded(f'p_{signal}', 3)} END AS csg_{signal}")
    own = ["1 AS gb_starts, CAST(x.ln = 1 AS INT) AS gb_wins, CAST(x.ln <= 3 AS INT) AS gb_places"]
    own += ["nullif(form_string, '') AS fm", "nullif(ext_run_style, '') AS rs", "cs.cs AS cs", "crk", "cs.csc AS csc"]
    return ", ".join([*text, *wholes, *numbers, *own, *shares])


def _race_sql() -> str:
    """Every field of the record itself; in this data all runners of a race say the same of it."""
    texts = [f"coalesce({c}, '') AS {k}" for k, c in payload.RACE_TEXT.items()]
    wholes = [f"coalesce(CAST(trunc({c}) AS INT), 0) AS {k}" for k, c in payload.RACE_WHOLE.items()]
    return ", ".join([*texts, *wholes, *[f"CAST({c} AS DOUBLE) AS {k}" for k, c in payload.RACE_NUMBER.items()]])


SCORE_SIGNALS = tuple(dict.fromkeys([*score.LOGISTIC_WEIGHTS, *score.LINEAR_WEIGHTS]))


@query(
    "race_payload",
    with_runners(
        *RECORDS_SQL, *_score_sql(_DEFAULT_PATHS, False, {}),
        f"cs AS ({_score_select()})",
        """whole AS (SELECT race_id, CAST(count(*) AS INT) AS fs, CAST(count(ext_ai_rank) = count(*) AS INT) AS rated,
          CAST(count(*) FILTER (WHERE resulted = 1) = count(*) AS INT) AS done FROM runners GROUP BY race_id)""",
        select=f"""SELECT race_id, 0 AS part, pos - 1 AS place, CAST(date AS STRING) AS date, {_race_sql()},
          CAST(hfs AS INT) AS hfs, rated, whole.fs AS fs, done, cs.cs_path AS cs_path, {_runner_sql()}
          FROM rows x JOIN cs USING (race_id, run_id) JOIN scored sc USING (race_id, run_id) JOIN hfs USING (race_id)
          JOIN whole USING (race_id)""",
    ),
)
def race_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested race records, runner by runner with every field of the record and of the runner."""
    listed = _records(spark, sf_dir).select("*", F.posexplode("runners").alias("place", "r"))
    keys = [*payload.TEXT_KEYS, *payload.WHOLE_KEYS, *payload.NUMBER_KEYS, "fm", "rs", "cs", "crk", "csc"]
    return listed.select(
        "race_id", "part", "place", "date", *payload.RACE_TEXT, *payload.RACE_WHOLE, *payload.RACE_NUMBER, "hfs", "rated",
        "fs", "done", "cs_path", *[F.col("r")[k].alias(k) for k in keys],
        *[F.col("r")["gb"]["good"][k].alias(f"gb_{k}") for k in ("starts", "wins", "places")],
        *[F.col("r")["csg"][s].alias(f"csg_{s}") for s in SCORE_SIGNALS],
    )


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(df: DataFrame, g: Groups) -> DataFrame:
        return payload.race_payload(race.first_starter(_with_nested(df), g), g, tie=TIE)

    return over_races(spark, sf_dir, work)


@query(
    "payload_counts",
    with_runners(
        FIRST_ROW_SQL, RANKED_SQL, JUDGED_SQL, PICKS_SQL,
        "dones AS (SELECT race_id, count(*) FILTER (WHERE resulted = 1) = count(*) AS done FROM runners GROUP BY race_id)",
        select="""SELECT count(*) AS races, count(*) FILTER (WHERE done) AS resulted, count(*) FILTER (WHERE NOT done) AS pending,
          (SELECT count(*) FROM picks WHERE model = 'main') AS primary_picks FROM dones""",
    ),
)
def payload_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.payload_counts(_records(spark, sf_dir), picks(spark, sf_dir))


@query(
    "ordered_sink",
    with_runners(
        "races AS (SELECT race_id, any_value(date) AS date, any_value(start_time) AS start_time, any_value(venue) AS venue, "
        "any_value(race) AS race FROM runners GROUP BY race_id)",
        select="SELECT race_id, CAST(date AS STRING) AS date, start_time, venue, race, "
        "row_number() OVER (ORDER BY date, start_time, venue, race, race_id) AS place FROM races",
    ),
)
def ordered_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Races in the order they are written, with their place in it.

    The place comes from ranking the races within one group that holds them all, in slices.
    """
    from railbird.operators.groups import Spread

    races = runners(spark, sf_dir).groupBy("race_id").agg(
        F.first("date").cast("string").alias("date"),
        F.first("start_time").alias("start_time"),
        F.first("venue").alias("venue"),
        F.first("race").alias("race"),
        F.lit(0).alias("part"),
    )
    order = [F.col(c).asc() for c in ("date", "start_time", "venue", "race", "race_id")]
    placed = Spread(["part"]).numbers(races, {"place": order})
    return payload.in_race_order(placed).drop("part")


BRIEF_KEYS = tuple(k for k in race.RUNNER_BRIEF if k not in ("rnk", "fsz"))


def _brief_sql() -> str:
    """Every field of a runner in a selection's list."""
    own = {"settling": "s.settling", "pace_scenario": TEMPO_SQL.format(q="pace.q")}
    plain = [f"{own.get(race.RUNNER_BRIEF[k], 'x.' + race.RUNNER_BRIEF[k])} AS u_{k}" for k in BRIEF_KEYS]
    anchors = [
        f"{_ordinal_sql(v.column, 'DESC' if v.descending else 'ASC')} AS u_rnk_{k}, "
        f"CAST(nullif(count({v.column}) OVER (PARTITION BY race_id), 0) AS INT) AS u_fsz_{k}"
        for k, v in ANCHOR_SIGNALS.items()
    ]
    return ", ".join([*plain, *anchors])


LISTED_SQL = (
    f"listed AS (SELECT race_id, row_number() OVER (PARTITION BY race_id ORDER BY ln, pk, sk) - 1 AS place, {_brief_sql()} FROM runners x "
    "JOIN (SELECT race_id, run_id, settling FROM settled) s USING (race_id, run_id) JOIN (SELECT race_id, q FROM pace) pace USING (race_id))"
)


@query(
    "selections",
    with_runners(
        LONG_SQL, PLACED_SQL, VOTES_SQL, TOP_SQL, RANKINGS_SQL, SETTLING_SQL, PACE_SQL,
        "hfs AS (SELECT race_id, bool_or(runs_with_wpr = 0) AS has_first_starter FROM runners GROUP BY race_id)",
        """paces AS (SELECT race_id, count(*) FILTER (WHERE CASE WHEN avg_800m_pos IS NOT NULL THEN avg_800m_pos <= 3
             ELSE settling IN ('leader', 'on-pace') END) AS k FROM settled GROUP BY race_id)""",
        LISTED_SQL,
        select=f"""SELECT t.race_id, t.run_id, votes, total_signals, horse, {rounded('coalesce(starting_price_sp, fixed_win_price)', 4)} AS sp,
          wpr_nett, CASE WHEN speed_rating IS NOT NULL THEN sr END AS speed_rank_in_race,
          speed_rating IS NOT NULL AND sr <= 2 AS is_on_pace,
          CASE WHEN barrier = 0 THEN NULL WHEN barrier <= 4 THEN 'inside' WHEN barrier <= 8 THEN 'mid' WHEN barrier > 8 THEN 'wide' END AS barrier_pos,
          settling, CASE WHEN settling = 'backmarker' THEN CASE WHEN q >= 4 THEN 'caution' WHEN q IS NOT NULL THEN 'watch' ELSE 'unknown' END END AS backmarker_flag,
          coalesce(contested_pace, s1 - s3 < 5) AS contested_pace, has_first_starter,
          {rounded("CASE WHEN resulted = 1 THEN CASE WHEN won = 1 THEN coalesce(starting_price_sp, fixed_win_price) ELSE 0 END END", 4)} AS returned,
          coalesce(resulted, 0) AS resulted, pos AS top_idx, {TEMPO_SQL.format(q='k')} AS race_pace_score, sig_rankings, listed.* EXCLUDE (race_id)
          FROM top t JOIN settled s USING (race_id, run_id) JOIN positions USING (race_id, run_id) JOIN rankings USING (race_id)
          JOIN hfs USING (race_id) JOIN pace USING (race_id) JOIN paces USING (race_id)
          JOIN listed USING (race_id)""",
    ),
)
def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One selection per race in context, beside each runner of its list with all the runner's fields."""

    def work(df: DataFrame, g: Groups) -> DataFrame:
        # the pace sorts by speed and position, and what follows goes by the same order
        df = race.speed_rank(race.pace(df, g, tie=TIE), g)
        return race.selections(df, g, tie=TIE)

    found = over_races(spark, sf_dir, work).withColumn("sig_rankings", _rankings_text("sig_rankings"))
    listed = found.select("*", F.posexplode("u_list").alias("place", "_u"))
    return listed.select(
        "race_id", "run_id", "votes", "total_signals", "horse", half_even("sp", 4).alias("sp"), "wpr_nett",
        "speed_rank_in_race", "is_on_pace", "barrier_pos", "settling", "backmarker_flag", "contested_pace",
        "has_first_starter", half_even("returned", 4).alias("returned"), "resulted", "top_idx", "race_pace_score",
        "sig_rankings", "place",
        *[F.col("_u")[k].alias(f"u_{k}") for k in BRIEF_KEYS],
        *[F.col("_u")[g][k].alias(f"u_{g}_{k}") for k in ANCHORS for g in ("rnk", "fsz")],
    )


def _compact_sql() -> str:
    """Every field of a runner in a compact record."""
    own = {"pace_scenario": TEMPO_SQL.format(q="q"), "settling": "settling"}
    out = []
    for key, column in payload.COMPACT_RUNNER.items():
        if key in ("h", "j", "st", "ps"):
            out.append(f"{own.get(column, column)} AS u_{key}")
        elif key in ("f", "b"):
            out.append(f"CAST(trunc({column}) AS INT) AS u_{key}")
        else:
            out.append(f"{rounded(column, 3)} AS u_{key}")
    return ", ".join(out)


@query(
    "compact_races",
    with_runners(
        "done AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY tab_number NULLS LAST, ln, pk, sk) - 1 AS pos "
        "FROM runners WHERE race_id IN (SELECT race_id FROM runners WHERE finish_position IS NOT NULL))",
        "slong AS (" + " UNION ALL ".join(
            f"SELECT race_id, pos, {i} AS sig, CAST({'' if s.descending else '-'}{s.column} AS DOUBLE) AS score FROM done WHERE {s.column} IS NOT NULL"
            for i, s in enumerate(SIGNALS)
        ) + ")",
        "splaced AS (SELECT race_id, sig, pos, row_number() OVER (PARTITION BY race_id, sig ORDER BY score DESC, pos) AS place FROM slong)",
        "slists AS (SELECT race_id, sig, list(pos ORDER BY place) AS l FROM splaced WHERE place <= 5 GROUP BY race_id, sig)",
        "sslots AS (SELECT race_id, sig FROM (SELECT DISTINCT race_id FROM done), (SELECT unnest(range(12)) AS sig))",
        "sranks AS (SELECT race_id, string_agg(array_to_string(list_resize(coalesce(l, []), 5, -1), ','), '|' ORDER BY sig) AS s "
        "FROM sslots LEFT JOIN slists USING (race_id, sig) GROUP BY race_id)",
        SETTLING_SQL, PACE_SQL,
        select=f"""SELECT race_id AS rid, CAST(date AS STRING) AS d, venue AS v, race AS r, CAST(trunc(prize_money) AS INT) AS p, s,
          CAST(count(*) OVER (PARTITION BY race_id) AS INT) AS fs, distance AS dist, nullif(going, '') AS going, {TEMPO_SQL.format(q='q')} AS ps,
          CAST(pos AS INT) AS place, {_compact_sql()}
          FROM done JOIN sranks USING (race_id) JOIN (SELECT race_id, run_id, settling FROM settled) USING (race_id, run_id)
          JOIN (SELECT race_id, q FROM pace) USING (race_id)""",
    ),
)
def compact_races(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resulted races as compact records, beside each runner with all its fields."""

    def work(df: DataFrame, g: Groups) -> DataFrame:
        df = race.settling(race.pace(race.speed_rank(df, g), g, tie=TIE), g)
        return payload.compact_races(df, g, tie=TIE)

    found = over_races(spark, sf_dir, work).withColumn("s", _rankings_text("s"))
    listed = found.select("*", F.posexplode("u").alias("place", "_u"))
    return listed.select(
        "rid", "d", "v", "r", "p", "s", "fs", "dist", "going", "ps", "place",
        *[F.col("_u")[k].alias(f"u_{k}") for k in payload.COMPACT_RUNNER],
    )


@query(
    "ingest_counts",
    with_runners(
        select="""SELECT count(*) AS runners, count(DISTINCT race_id) AS races FROM (SELECT DISTINCT race_id, run_id FROM runners r
          WHERE NOT EXISTS (SELECT 1 FROM runners e WHERE e.resulted = 1 AND e.race_id = r.race_id AND e.run_id = r.run_id))"""
    ),
)
def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is added to a table that holds the resulted runners when all runners come in."""
    incoming = runners(spark, sf_dir)
    return payload.ingest_counts(tables.new_rows(incoming.where("resulted = 1"), incoming, ["race_id", "run_id"], TIE))
