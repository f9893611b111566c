"""The two strategies must agree, and the sizes must decide between them."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from railbird.operators import groups, payload, race, ranks, rules, score
from railbird.operators.groups import InTask, Spread, oversized, per_group
from railbird.operators.ranks import ANCHORS, SIGNALS, Signal
from railbird.plans import race_queries, star
from railbird.plans.race_queries import SCORE_COLUMNS
from railbird.plans.star import TIE

SF = "/root/testdata/sf0.001"
CONTEXT_COLUMNS = ("race_id", "run_id", *TIE, "runs_with_wpr", "speed_rating", "avg_800m_pos", "avg_settled_pos")


@pytest.fixture(scope="module")
def values(spark):
    # one group holds a third of the rows, with many equal and some missing values
    data = [("hot", i, (i * 7) % 10 if i % 6 else None) for i in range(300)]
    data += [(f"g{i % 100}", i, i % 4 if i % 5 else None) for i in range(600)]
    return spark.createDataFrame(data, "g string, i int, v int").repartition(6)


@pytest.fixture(scope="module")
def runners(spark):
    # unique line keys only; half the races are made one race to give it many runners
    lines = star.runners(spark, SF).dropDuplicates(["run_id"])
    merged = lines.withColumn("race_id", F.when(F.col("race_id") % 2 == 0, F.lit(0)).otherwise(F.col("race_id")))
    return merged.withColumns({"ln": F.xxhash64("run_id"), "pk": F.lit(0), "sk": F.lit(0)}).checkpoint()


def same(df, work, keys=("race_id",), split=False):
    plain = rows(work(df, InTask(list(keys))))
    assert rows(work(df, Spread(list(keys)))) == plain
    if split:
        assert rows(per_group(df, list(keys), work, max_rows=20)) == plain
    return plain


def test_numbers(values):
    got = same(values, lambda d, g: g.numbers(d, {"n": [F.col("v").desc_nulls_last(), F.col("i")]}), ["g"], split=True)
    hot = sorted(r[3] for r in got if r[0] == "hot")
    assert hot == list(range(1, 301))


@pytest.mark.parametrize("descending", [True, False])
def test_competitions(values, descending):
    got = same(values, lambda d, g: g.competitions(d, {"k": (F.col("v"), descending)}), ["g"], split=True)
    hot = [(r[2], r[3]) for r in got if r[0] == "hot"]
    known = [v for v, _ in hot if v is not None]
    for v, k in hot:
        better = len(known) if v is None else sum(w > v if descending else w < v for w in known)
        assert k == better + 1


def test_totals(values):
    same(values, lambda d, g: g.totals(d, n=F.count(F.lit(1)), best=F.max("v"), first=F.min_by("v", "i")), ["g"], split=True)


def test_null_is_a_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, v int")
    assert same(df, lambda d, g: g.totals(d, n=F.count(F.lit(1))), ["g"]) == [("a", 3, 1), (None, 1, 2), (None, 2, 2)]


def test_only_big_groups_are_spread(values):
    assert oversized(values, ["g"], 300) is None
    assert rows(oversized(values, ["g"], 299)) == [("hot",)]
    seen = []
    per_group(values, ["g"], lambda d, g: seen.append(type(g)) or d, max_rows=299)
    assert seen == [InTask, Spread]


def test_votes_and_selection(runners):
    same(
        runners,
        lambda d, g: race.top_selection(race.votes(d, g, tie=TIE), g).select(
            "race_id", "run_id", "votes", "first_signal", "total_signals"
        ),
    )


def test_context(runners):
    same(
        runners,
        lambda d, g: race.race_context(d.select(*CONTEXT_COLUMNS), g, tie=TIE).select(
            "race_id", "run_id", "has_first_starter", "speed_rank_in_race", "pace_scenario", "contested_pace", "settling"
        ),
    )


def test_picks(runners):
    got = same(runners, lambda d, g: rules.picks(d, g, tie=TIE).select("race_id", "run_id", "model", "late_rank"))
    # what the strict rule picks, the loose one picks too
    main = {r[:2] for r in got if r[2] == "main"}
    assert main and main <= {r[:2] for r in got if r[2] == "loose"}


def test_score(runners):
    got = same(
        runners,
        lambda d, g: score.score_races(d.select(*SCORE_COLUMNS), g, tie=TIE).select("race_id", "run_id", "cs", "crk", "cs_path", "csc"),
    )
    assert all(0 <= r[2] <= 1 for r in got)


def test_anchor_ranks(runners):
    signals = {k: next(s for s in SIGNALS if s.column == c) for k, c in ANCHORS.items()}
    same(runners, lambda d, g: ranks.anchor_ranks(d, g, signals, TIE).select("race_id", "run_id", "rnk", "fsz"))


def test_ordinal_ranks_have_no_gaps(runners):
    got = same(
        runners, lambda d, g: ranks.ordinal_ranks(d, g, {"k": Signal("late_speed_score")}, TIE).select("race_id", "k")
    )
    by_race = {}
    for r, k in got:
        by_race.setdefault(r, []).append(k)
    for places in by_race.values():
        known = sorted(k for k in places if k is not None)
        assert known == list(range(1, len(known) + 1))


def test_records_of_a_big_race_come_in_parts(values):
    """Nested picks of a big group are cut; together the parts hold what one record would."""
    picked = values.select(F.col("g").alias("race_id"), F.lit("main").alias("model"), F.col("i").cast("string").alias("run_id"))
    picked = picked.withColumns({c: F.lit(None).cast("int") for c in payload.NESTED_PICK.values() if c != "run_id"})

    def nested(max_rows):
        work = lambda d, g: payload.picks_by_race(d, g, max_picks=100)
        return per_group(picked, ["race_id"], work, max_rows=max_rows).collect()

    whole, parts = nested(10_000), nested(200)
    assert sorted(r["part"] for r in whole if r["race_id"] == "hot") == [0, 1, 2]
    assert sorted(r["part"] for r in parts if r["race_id"] == "hot") == [0, 1, 2]
    runs = lambda found: sorted(p["run_id"] for r in found if r["race_id"] == "hot" for p in r["picks"]["main"])
    assert runs(whole) == runs(parts) and len(runs(parts)) == 300
    assert all(len(r["picks"]["main"]) <= 100 for r in parts)


@pytest.mark.parametrize(
    ("name", "max_rows"), [("picks_by_race", 1), ("picks_by_race", 3), ("compact_races", 3)]
)
def test_records_have_one_shape_at_every_size(runners, name, max_rows):
    """A record is cut by its own limit, never by the size from which a race is treated apart."""
    nested = race_queries._with_nested(runners)
    some = nested.where(F.col("race_id") < 40)
    works = {
        "picks_by_race": lambda df, g: payload.picks_by_race(rules.picks(df, g, tie=TIE), g, max_picks=2),
        "compact_races": lambda df, g: payload.compact_races(
            race.settling(race.pace(race.speed_rank(df, g), g, tie=TIE), g), g, tie=TIE, max_runners=4
        ),
    }

    def text(df):
        return sorted(r[0] for r in df.select(F.to_json(F.struct(*df.columns))).collect())

    # one race of many runners, and small ones
    plain = text(per_group(some, ["race_id"], works[name]))
    assert text(per_group(some, ["race_id"], works[name], max_rows=max_rows)) == plain
    assert any('"part":1' in line for line in plain) or name == "picks_by_race"


def test_together_bounds_the_rows_of_a_partition(spark, monkeypatch):
    monkeypatch.setattr(groups, "TASK_ROWS", 50)
    df = spark.range(1000).select((F.col("id") % 250).alias("race_id"), "id")
    dealt = groups.together(df, ["race_id"], 1000).withColumn("_p", F.spark_partition_id())
    found = dealt.groupBy("race_id").agg(F.count_distinct("_p").alias("parts"), F.count("*").alias("n")).collect()
    assert {(r["parts"], r["n"]) for r in found} == {(1, 4)}
    assert dealt.rdd.getNumPartitions() == 20
    # few rows stay as they are
    assert groups.together(df, ["race_id"], 100) is df


def test_runners_of_races_lie_in_bounded_partitions_and_leaders_need_no_shuffle(spark, tmp_path, monkeypatch):
    from railbird.operators.ranks import SIGNALS, leaders
    from railbird.plans import star
    from railbird.plans.catalog import over_races

    monkeypatch.setattr(groups, "TASK_ROWS", 20)
    spark.range(300).selectExpr(
        "id div 3 AS l_orderkey", "id % 7 AS l_partkey", "id % 5 AS l_suppkey", "CAST(id % 3 AS INT) AS l_linenumber",
        "CAST(id % 50 + 1 AS DOUBLE) AS l_quantity", "CAST(id AS DOUBLE) AS l_extendedprice", "0.05D AS l_discount", "0.02D AS l_tax",
        "'A' AS l_returnflag", "'F' AS l_linestatus", "TIMESTAMP '1996-01-01' AS l_shipdate",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(100).selectExpr(
        "id AS o_orderkey", "id AS o_custkey", "'O' AS o_orderstatus", "9.0D AS o_totalprice", "TIMESTAMP '1996-01-01' AS o_orderdate",
        "'1-URGENT' AS o_orderpriority",
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(7).selectExpr(
        "id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "CAST(id AS INT) AS p_size", "1.0D AS p_retailprice"
    ).write.parquet(f"{tmp_path}/part.parquet")
    sized = over_races(spark, str(tmp_path), lambda df, g: df.withColumn("_p", F.spark_partition_id()))
    assert sized.rdd.getNumPartitions() == 15
    assert {r["n"] for r in sized.groupBy("race_id").agg(F.count_distinct("_p").alias("n")).collect()} == {1}
    top = over_races(spark, str(tmp_path), lambda df, g: leaders(df, SIGNALS, tie=star.TIE))
    plan = top._jdf.queryExecution().executedPlan().toString()
    # the runners, and at most the other sides of the joins; the signals' entries are ranked where the race lies
    assert plan.split("Generate")[0].count("Exchange") == 0
    assert {r["count"] for r in top.where("place = 1").groupBy("sig").count().collect()} == {100}
