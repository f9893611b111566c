"""Within-race features: votes, pace, settling positions, flags, and one selection per race."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railbird.functions.scalars import first_truthy, is_true, number, truthy
from railbird.operators.groups import Groups, InTask
from railbird.operators.ranks import (
    ANCHORS, SIGNALS, Signal, anchor_ranks, best_entries, competition_ranks, leader_positions, merged_leaders, ordinal_ranks,
)
from railbird.operators.tables import ROW_ORDER

# Settling positions and the last average position of each, and of the speed ranks
# and share of the field that stand in for it.
SETTLED = (("leader", 2.5), ("on-pace", 4.5), ("midfield", 8.0))
SETTLED_BY_RANK = (("leader", 2), ("on-pace", 4))
MIDFIELD_SHARE = 0.6

# Who counts as early speed, and how many of them make a slow, neutral or fast race.
EARLY_POSITION = 3.0
CLOSE_POSITION = 2.5
SPEED_MARGIN = 5
CONTESTED_GAP = 5
SLOW_AT_MOST = 1
FAST_FROM = 4

# The gates of the optimal-selection flag.
OPTIMAL = {"votes": 7, "price": 2.0, "prize": 25000}


def votes(
    df: DataFrame,
    groups: Groups,
    signals: Sequence[Signal] = SIGNALS,
    tie: Sequence[str] = ROW_ORDER,
    position: str | None = None,
) -> DataFrame:
    """Each signal votes for its best runner; ties go to the earlier row, told by ``position`` where rows are numbered already.

    Adds ``votes``, ``first_signal`` (the place of the first signal that chose the runner, NULL
    without a vote) and ``total_signals`` (the signals any runner of the race has).
    """
    places = range(len(signals))
    row = position or "_row"
    if position is None:
        df = groups.numbers(df, {row: [F.col(c).asc() for c in tie]})
    best = {
        f"_best{i}": F.max(s.column) if s.descending else F.min(s.column) for i, s in enumerate(signals)
    }
    df = groups.totals(df, **best)
    first = {f"_at{i}": F.min(F.when(F.col(s.column) == F.col(f"_best{i}"), F.col(row))) for i, s in enumerate(signals)}
    df = groups.totals(df, **first)
    chosen = [F.coalesce(F.col(row) == F.col(f"_at{i}"), F.lit(False)) for i in places]
    known = [F.col(f"_best{i}").isNotNull() for i in places]

    def count(conditions: Sequence[Column]) -> Column:
        return sum((c.cast("int") for c in conditions), F.lit(0))

    first_chosen = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(chosen)])
    df = df.withColumns({"votes": count(chosen), "first_signal": first_chosen, "total_signals": count(known)})
    return df.drop(*([row] if position is None else []), *best, *first)


def top_selection(voted: DataFrame, groups: Groups) -> DataFrame:
    """The runner with most votes of each race with any; among equals the one chosen first.

    A signal chooses one runner, so no two runners of a race share votes and first signal.
    """
    standing = F.struct(F.col("votes"), -F.col("first_signal"))
    leading = groups.totals(voted.where(F.col("votes") > 0), _top=F.max(standing))
    return leading.where(F.col("_top") == standing).drop("_top")


def first_starter(df: DataFrame, groups: Groups, runs: str = "runs_with_wpr", name: str = "has_first_starter") -> DataFrame:
    """Whether any runner of the race is known to have no rated run."""
    return groups.totals(df, **{name: F.max(F.coalesce(F.col(runs) == 0, F.lit(False)))})


def pace(
    df: DataFrame,
    groups: Groups,
    position: str = "avg_800m_pos",
    speed: str = "speed_rating",
    tie: Sequence[str] = ROW_ORDER,
    scenario: str = "pace_scenario",
    contested: str = "contested_pace",
) -> DataFrame:
    """How fast the race should be run, from known early positions, else from speed ratings."""
    where, rate = F.col(position), F.col(speed)
    df = ordinal_ranks(df, groups, {"_nth": Signal(speed)}, tie)
    df = groups.totals(
        df,
        _known=F.count(where),
        _early=F.count_if(where <= EARLY_POSITION),
        _close=F.count_if(where <= CLOSE_POSITION),
        _rated=F.count(rate),
        _mean=F.avg(rate),
        _first=F.max(F.when(F.col("_nth") == 1, rate)),
        _third=F.max(F.when(F.col("_nth") == 3, rate)),
    )
    df = groups.totals(df, _quick=F.count_if(rate > F.col("_mean") + SPEED_MARGIN))
    by_position, by_speed = F.col("_known") >= 3, F.col("_rated") >= 4
    quick = F.when(by_position, F.col("_early")).when(by_speed, F.col("_quick"))
    df = df.withColumns(
        {
            scenario: _tempo(quick, fast_from=FAST_FROM),
            contested: F.when(by_position, F.col("_close") >= 3).when(
                by_speed, F.col("_first") - F.col("_third") < CONTESTED_GAP
            ),
        }
    )
    return df.drop("_nth", "_known", "_early", "_close", "_rated", "_mean", "_first", "_third", "_quick")


def _tempo(quick: Column, fast_from: int) -> Column:
    return (
        F.when(quick.isNull(), F.lit(None))
        .when(quick <= SLOW_AT_MOST, F.lit("slow"))
        .when(quick >= fast_from, F.lit("fast"))
        .otherwise(F.lit("neutral"))
    )


def settled_by_position(average: Column) -> Column:
    out = F.lit("backmarker")
    for name, last in reversed(SETTLED):
        out = F.when(average <= last, F.lit(name)).otherwise(out)
    return F.when(average.isNotNull(), out)


def settled_by_rank(rank: Column, field: Column) -> Column:
    share = (rank - 1) / F.nullif(field - 1, F.lit(0))
    out = F.when(share <= MIDFIELD_SHARE, F.lit("midfield")).otherwise(F.lit("backmarker"))
    for name, last in reversed(SETTLED_BY_RANK):
        out = F.when(rank <= last, F.lit(name)).otherwise(out)
    return F.when(rank.isNotNull() & (field > 1), out)


def speed_rank(df: DataFrame, groups: Groups, speed: str = "speed_rating", name: str = "speed_rank_in_race") -> DataFrame:
    return competition_ranks(df, groups, {name: Signal(speed)})


def settling(
    df: DataFrame,
    groups: Groups,
    average: str = "avg_settled_pos",
    rank: str | Column = "speed_rank_in_race",
    name: str = "settling",
) -> DataFrame:
    """Where the runner settles: by its average position, else by its speed rank, else unknown."""
    rank = F.col(rank) if isinstance(rank, str) else rank
    df = groups.totals(df, _field=F.count(F.lit(1)))
    place = F.coalesce(settled_by_position(F.col(average)), settled_by_rank(rank, F.col("_field")), F.lit("unknown"))
    return df.withColumn(name, place).drop("_field")


def race_pace(
    df: DataFrame,
    groups: Groups,
    position: str = "avg_800m_pos",
    settled: str = "settling",
    name: str = "race_pace_score",
) -> DataFrame:
    """The race's pace from its early-speed runners, an unknown position judged by settling."""
    where = F.col(position)
    early = F.when(where.isNotNull(), where <= EARLY_POSITION).otherwise(F.col(settled).isin("leader", "on-pace"))
    df = groups.totals(df, _quick=F.count_if(early))
    return df.withColumn(name, _tempo(F.col("_quick"), fast_from=FAST_FROM)).drop("_quick")


def contested_fallback(
    df: DataFrame,
    groups: Groups,
    contested: str = "contested_pace",
    speed: str = "speed_rating",
    tie: Sequence[str] = ROW_ORDER,
) -> DataFrame:
    """Fill an unknown flag where at least three runners have a speed rating."""
    df = ordinal_ranks(df, groups, {"_nth": Signal(speed)}, tie)
    rate = F.col(speed)
    df = groups.totals(
        df, _first=F.max(F.when(F.col("_nth") == 1, rate)), _third=F.max(F.when(F.col("_nth") == 3, rate))
    )
    filled = F.coalesce(F.col(contested), F.col("_first") - F.col("_third") < CONTESTED_GAP)
    return df.withColumn(contested, filled).drop("_nth", "_first", "_third")


def backmarker_flag(settled: Column, scenario: Column) -> Column:
    judged = (
        F.when(scenario == "fast", F.lit("caution"))
        .when(scenario.isin("neutral", "slow"), F.lit("watch"))
        .otherwise(F.lit("unknown"))
    )
    return F.when(settled == "backmarker", judged)


def barrier_position(barrier: Column) -> Column:
    known = truthy(barrier)
    return F.when(known <= 4, F.lit("inside")).when(known <= 8, F.lit("mid")).when(known.isNotNull(), F.lit("wide"))


def is_on_pace(rank: Column) -> Column:
    return F.coalesce(rank <= 2, F.lit(False))


def is_optimal(voted: Column, price: Column, prize: Column, trend: Column, first_start: Column) -> Column:
    """Many votes, a fair price and prize, no falling trend and no first starter."""
    trend_holds = F.coalesce(trend >= 0, F.lit(True))
    gates = (voted >= OPTIMAL["votes"]) & (price >= OPTIMAL["price"]) & (prize >= OPTIMAL["prize"])
    return F.coalesce(gates & trend_holds & ~is_true(first_start), F.lit(False))


def race_context(df: DataFrame, groups: Groups, tie: Sequence[str] = ROW_ORDER) -> DataFrame:
    """The race-level columns of the ingest: speed rank, pace, settling and first starter."""
    return settling(pace(speed_rank(first_starter(df, groups), groups), groups, tie=tie), groups)


def optimal_flags(
    df: DataFrame, groups: Groups, signals: Sequence[Signal] = SIGNALS, tie: Sequence[str] = ROW_ORDER
) -> DataFrame:
    """Races with their top selection and whether it passes the optimal gates."""
    top = top_selection(votes(df, groups, signals, tie), groups)
    flag = is_optimal(
        F.col("votes"), F.col("fixed_win_price"), F.col("prize_money"), F.col("wpr_trend"), F.col("has_first_starter")
    )
    return top.select("race_id", "run_id", "votes", "total_signals", flag.alias("is_optimal"))


# The short keys of a runner in a selection record.
RUNNER_BRIEF = {
    "h": "horse", "rid": "run_id", "j": "jockey", "tn": "trainer", "f": "finish_position", "sp": "starting_price_sp",
    "fx": "fixed_win_price", "trp": "rating_price", "trr": "rating", "tr": "wpr_trend", "w": "wpr_nett", "b": "barrier",
    "tab": "tab_number", "st": "settling", "ps": "pace_scenario", "es": "early_speed_score", "ms": "mid_speed_score",
    "ls": "late_speed_score", "ts": "total_speed_score", "ap": "avg_settled_pos", "a8": "avg_800m_pos",
    "wd": "wpr_dist", "dn": "wpr_dist_n", "rnk": "rnk", "fsz": "fsz",
}


# the columns of the chosen runner that are taken, or read, as they are
OF_CHOSEN = (
    "run_id", "date", "venue", "race", "horse", "jockey", "trainer", "starting_price_sp", "fixed_win_price", "prize_money",
    "wpr_nett", "wpr_trend", "wpr_rank", "wpr_peak_rank_1yr", "rating", "rating_price", "speed_rating", "barrier", "distance",
    "going", "pace_scenario", "finish_position", "won", "placed", "resulted", "start_time",
)


def selections(
    df: DataFrame,
    groups: Groups,
    signals: Sequence[Signal] = SIGNALS,
    tie: Sequence[str] = ROW_ORDER,
    max_runners: int = 1000,
) -> DataFrame:
    """One row per race with any vote: its top selection in context, the signals' leaders and the runners.

    A race of more than ``max_runners`` runners gives several rows that differ in ``part`` and hold
    the next runners each, so that no record outgrows a task.
    """
    position_order = [F.col(c).asc() for c in tie]
    # sorts within races move what ranks and totals read, and the rest as one value
    read = dict.fromkeys([
        "race_id", *tie, *[s.column for s in signals], *ANCHORS.values(), "avg_800m_pos", "avg_settled_pos", "speed_rating",
        "speed_rank_in_race", "contested_pace", "runs_with_wpr",
    ])
    packed = [c for c in dict.fromkeys([*RUNNER_BRIEF.values(), *OF_CHOSEN]) if c in df.columns and c not in read and c != "settling"]
    df = df.select(*read, F.struct(*packed).alias("_rest"))
    # what goes by speed comes first and what goes by position last, so that rows are sorted once for each order
    df = contested_fallback(df, groups, tie=tie)
    df = competition_ranks(df, groups, {"_speed_rank": Signal("speed_rating")})
    df = df.withColumn("_speed_rank", F.coalesce("_speed_rank", number("speed_rank_in_race")))
    df = settling(df, groups, rank="_speed_rank", name="settling")
    df = first_starter(df.drop("has_first_starter"), groups)
    df = anchor_ranks(df, groups, {short: Signal(c, _direction(c, signals)) for short, c in ANCHORS.items()}, tie, first="speed")
    df = race_pace(df, groups)
    df = groups.numbers(df, {"_pos": position_order}).withColumn("_pos", F.col("_pos") - 1)
    # positions are 0..n-1, so cutting them into parts needs no further ranking
    df = df.withColumn("_part", F.floor(F.col("_pos") / max_runners).cast("int"))

    # unpacked where the rows meet in a record
    unpacked = {c: F.col("_rest")[c].alias(c) for c in packed}
    if not isinstance(groups, InTask):
        df, unpacked = df.select(*[c for c in df.columns if c != "_rest"], "_rest.*"), {}

    def own(c: str) -> Column:
        return unpacked.get(c, F.col(c))

    brief = ["_pos", *[own(c).alias(short) for short, c in RUNNER_BRIEF.items()]]
    price = first_truthy(own("starting_price_sp"), own("fixed_win_price"), falsy=0.0)
    plain = {c: own(c) for c in OF_CHOSEN}
    of_chosen = [
        "run_id", "votes", "total_signals", "date", "venue", "race", "horse", "jockey", "trainer",
        price.alias("sp"), "prize_money", "wpr_nett", "wpr_trend", "wpr_rank", "wpr_peak_rank_1yr",
        "rating", "rating_price", "speed_rating", F.col("_speed_rank").cast("int").alias("speed_rank_in_race"),
        is_on_pace(F.col("_speed_rank")).alias("is_on_pace"), "barrier",
        barrier_position(own("barrier")).alias("barrier_pos"),
        F.coalesce(own("distance"), F.lit(0)).alias("distance"), truthy(own("going"), "").alias("going"),
        "pace_scenario", "contested_pace", "settling",
        backmarker_flag(F.col("settling"), own("pace_scenario")).alias("backmarker_flag"),
        "has_first_starter", own("finish_position").alias("finish"), "won", "placed",
        F.when(truthy(own("resulted")).isNotNull(), F.when(truthy(own("won")).isNotNull(), price).otherwise(0.0)).alias("returned"),
        F.coalesce(own("resulted"), F.lit(0)).alias("resulted"), F.col("_pos").alias("top_idx"),
        "race_pace_score", "start_time",
    ]
    of_chosen = [plain.get(c, F.col(c)) if isinstance(c, str) else c for c in of_chosen]
    if isinstance(groups, InTask):
        # a race's few parts meet again in the task that made them, so its runners are ranked once for all three
        voted = votes(df, groups, signals, tie, position="_pos")
        standing = F.when(F.col("votes") > 0, F.struct(F.col("votes"), -F.col("first_signal")))
        lists = voted.groupBy("race_id", F.col("_part").alias("part")).agg(
            F.max_by(F.struct(*of_chosen), standing).alias("_top"),
            F.max(standing).alias("_standing"),
            F.sort_array(F.collect_list(F.struct(brief[0], F.struct(*brief[1:]).alias("_r"))))["_r"].alias("u_list"),
            best_entries(signals).alias("_best"),
        )
        lists = lists.where(F.col("race_id").isNotNull())
        lists = groups.totals(lists, _top=F.max_by("_top", "_standing"), _best=F.collect_list("_best"))
        return lists.where(F.col("_top").isNotNull()).select(
            "race_id",
            "_top.*",
            merged_leaders(F.col("_best"), signals).alias("sig_rankings"),
            "part",
            "u_list",
        )
    lists = df.groupBy("race_id", F.col("_part").alias("part")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(*brief))), lambda r: r.dropFields("_pos")).alias("u_list")
    )
    places = leader_positions(df, signals, tie=tie, position="_pos")
    chosen = top_selection(votes(df, groups, signals, tie, position="_pos"), groups).select("race_id", *of_chosen)
    return chosen.join(places, "race_id").join(lists, "race_id")


def _direction(column: str, signals: Sequence[Signal]) -> bool:
    return next((s.descending for s in signals if s.column == column), True)
