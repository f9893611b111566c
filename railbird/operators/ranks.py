"""Ranks, percentiles and leaders of the runners of a race."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railbird.functions.scalars import as_column
from railbird.operators.groups import Groups
from railbird.operators.tables import ROW_ORDER


@dataclass(frozen=True)
class Signal:
    """A column to rank by, and which end of it is better."""

    column: str
    descending: bool = True


# The voting signals, in voting order.
SIGNALS = (
    Signal("wpr_nett"),
    Signal("wpr_last1"),
    Signal("wpr_avg_last3"),
    Signal("wpr_dist"),
    Signal("wpr_going"),
    Signal("jockey_win_pct_90d"),
    Signal("trainer_win_pct_365d"),
    Signal("rating"),
    Signal("speed_rating"),
    Signal("wpr_trend"),
    Signal("wpr_peak_rank_1yr", descending=False),
    Signal("wpr_consistency", descending=False),
)

# The signals whose full ranks are reported, and their short names.
ANCHORS = {
    "jky": "jockey_win_pct_90d",
    "peak": "wpr_peak_rank_1yr",
    "speed": "speed_rating",
    "tr": "rating",
    "trn": "trainer_win_pct_365d",
}

LEADERS = 5


def best_first(signal: Signal, tie: Sequence[str | Column] = ROW_ORDER) -> list[Column]:
    """Order by the signal, best first and NULLs last; equal values in row order."""
    value = F.col(signal.column)
    by = value.desc_nulls_last() if signal.descending else value.asc_nulls_last()
    return [by, *[as_column(c).asc() for c in tie]]


def _where_known(df: DataFrame, signals: Mapping[str, Signal]) -> DataFrame:
    return df.withColumns({name: F.when(F.col(s.column).isNotNull(), F.col(name)) for name, s in signals.items()})


def ordinal_ranks(
    df: DataFrame, groups: Groups, signals: Mapping[str, Signal], tie: Sequence[str | Column] = ROW_ORDER
) -> DataFrame:
    """1..k over the runners that have the signal, ties in row order; NULL for the others.

    Signals are ranked in turn: rows that lie in the order of the first one are not sorted for it.
    """
    for name, s in signals.items():
        df = groups.numbers(df, {name: best_first(s, tie)})
    return _where_known(df, signals)


def competition_ranks(df: DataFrame, groups: Groups, signals: Mapping[str, Signal]) -> DataFrame:
    """One more than the number of strictly better runners; NULL without the signal."""
    return _where_known(bottom_ranks(df, groups, signals), signals)


def bottom_ranks(df: DataFrame, groups: Groups, signals: Mapping[str, Signal]) -> DataFrame:
    """Competition ranks in which all runners without the signal share the place after the last."""
    return groups.competitions(df, {name: (F.col(s.column), s.descending) for name, s in signals.items()})


def percentile(rank: Column, size: Column) -> Column:
    """1 for the first, 0 for the last; NULL in a field of one."""
    return (size - rank) / F.nullif(size - 1, F.lit(0))


def long_signals(
    df: DataFrame, signals: Sequence[Signal], keys: Sequence[str], tie: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """One row per runner and signal it has: ``sig`` is the signal's place, ``score`` is better when higher."""
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("sig"),
                (F.col(s.column).cast("double") if s.descending else -F.col(s.column).cast("double")).alias("score"),
            )
            for i, s in enumerate(signals)
        ]
    )
    rows = df.select(*keys, *tie, *keep, F.explode(entries).alias("_e"))
    return rows.select(*keys, *tie, *keep, "_e.sig", "_e.score").where(F.col("score").isNotNull())


def leaders(
    df: DataFrame,
    signals: Sequence[Signal],
    key: str = "race_id",
    tie: Sequence[str] = ROW_ORDER,
    keep: Sequence[str] = ("run_id",),
    top: int = LEADERS,
) -> DataFrame:
    """The best ``top`` runners of each race by each signal: one row per race, signal and place."""
    rows = long_signals(df, signals, [key], tie, keep)
    w = Window.partitionBy(key, "sig").orderBy(F.col("score").desc(), *[F.col(c).asc() for c in tie])
    # the filter on row_number is applied per task before the shuffle, too
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).drop("score")


def leader_positions(
    df: DataFrame,
    signals: Sequence[Signal] = SIGNALS,
    key: str = "race_id",
    tie: Sequence[str] = ROW_ORDER,
    position: str = "pos",
    top: int = LEADERS,
) -> DataFrame:
    """Per race, for each signal in turn the positions of its best runners, padded with -1."""
    found = leaders(df, signals, key, tie, [position], top)
    lists = found.groupBy(key, "sig").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", position))), lambda e: e[position]).alias("_p")
    )
    filled = lists.select(key, "sig", F.concat("_p", F.array_repeat(F.lit(-1), top - F.size("_p"))).alias("_p"))
    by_race = filled.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("sig", "_p"))).alias("_m"))
    padded = F.transform(
        F.sequence(F.lit(0), F.lit(len(signals) - 1)),
        lambda i: F.coalesce(F.try_element_at("_m", i), F.array_repeat(F.lit(-1), top)),
    )
    return by_race.select(key, padded.alias("sig_rankings"))


def best_entries(signals: Sequence[Signal] = SIGNALS, position: str = "_pos", top: int = LEADERS) -> Column:
    """An aggregate: for each signal the best rows of a group, as structs led by the score; equal scores by position.

    Rows are grouped for a race's record anyway, so an entry per signal needs neither rows nor a join of its own. No lambda is
    run over them, as Spark does not compile these.
    """

    def best(s: Signal) -> Column:
        score = F.col(s.column).cast("double") if s.descending else -F.col(s.column).cast("double")
        entry = F.struct(score.alias("score"), (-F.col(position)).alias("back"), F.col(position).alias("pos"))
        return F.slice(F.sort_array(F.collect_list(F.when(score.isNotNull(), entry)), asc=False), 1, top)

    return F.array(*[best(s) for s in signals])


def merged_leaders(parts: Column, signals: Sequence[Signal] = SIGNALS, top: int = LEADERS) -> Column:
    """The positions of the best of the ``best_entries`` of a race's parts, padded with -1; nearly all races have one part."""

    def best(i: int) -> Column:
        both = F.sort_array(F.flatten(F.transform(parts, lambda p: F.get(p, F.lit(i)))), asc=False)
        found = F.when(F.size(parts) == 1, F.get(F.get(parts, F.lit(0)), F.lit(i))).otherwise(F.slice(both, 1, top))["pos"]
        return F.concat(found, F.array_repeat(F.lit(-1), top - F.size(found)))

    return F.array(*[best(i) for i in range(len(signals))])


def anchor_ranks(
    df: DataFrame,
    groups: Groups,
    signals: Mapping[str, Signal],
    tie: Sequence[str] = ROW_ORDER,
    rank_name: str = "rnk",
    size_name: str = "fsz",
    first: str | None = None,
) -> DataFrame:
    """Add two structs: the runner's place by each anchor signal, and how many runners have it.

    ``first`` names the signal in whose order rows may lie already; it is ranked before the others.
    """
    sizes = {f"_size_{short}": F.count(s.column) for short, s in signals.items()}
    df = groups.totals(df, **sizes)
    in_turn = sorted(signals, key=lambda short: short != first)
    df = ordinal_ranks(df, groups, {f"_rank_{short}": signals[short] for short in in_turn}, tie)
    known = {short: F.nullif(F.col(f"_size_{short}"), F.lit(0)) for short in signals}
    df = df.withColumns(
        {
            rank_name: F.struct(*[F.col(f"_rank_{short}").alias(short) for short in signals]),
            size_name: F.struct(*[c.cast("int").alias(short) for short, c in known.items()]),
        }
    )
    return df.drop(*sizes, *[f"_rank_{short}" for short in signals])


def top_of_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], top: int, name: str = "place"
) -> DataFrame:
    """The first ``top`` rows of each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= top)
