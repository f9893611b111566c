"""Votes, pace, rules and scores on hand-made races."""

import datetime as dt
import math

from pyspark.sql import functions as F

from conftest import rows
from railbird.operators import payload, race, rules, score
from railbird.operators.groups import InTask, Spread
from railbird.operators.ranks import Signal, bottom_ranks, percentile
from railbird.plans.jobs import RUNNERS
from railbird.sources.schemas import conform, struct_type

G = InTask(["race_id"])


def runners(spark, *given):
    """Full runner rows from what a case needs; rows of a race in the order given."""
    full = [{"race_id": "r", "run_id": str(i), "ingest_seq": 1, "row_pos": i, "resulted": 0, **row} for i, row in enumerate(given)]
    return spark.createDataFrame(full, struct_type(RUNNERS))


def test_ties_go_to_the_earlier_row(spark):
    df = runners(spark, {"wpr_nett": 5.0, "rating": 1.0}, {"wpr_nett": 5.0, "rating": 2.0}, {"wpr_consistency": 1.0})
    voted = race.votes(df, G)
    assert rows(voted.select("run_id", "votes", "first_signal", "total_signals")) == [("0", 1, 0, 3), ("1", 1, 7, 3), ("2", 1, 11, 3)]
    # all have one vote: the one the first signal chose is selected
    assert rows(race.top_selection(voted, G).select("run_id")) == [("0",)]


def test_votes_add_up(spark):
    df = runners(spark, {"wpr_nett": 5.0, "wpr_trend": -1.0}, {"wpr_nett": 7.0, "wpr_peak_rank_1yr": 2}, {"wpr_peak_rank_1yr": 1})
    got = race.votes(df, G).select("votes", "total_signals").collect()
    assert sum(r[0] for r in got) == got[0][1] == 3


def test_race_without_signals_has_no_selection(spark):
    voted = race.votes(runners(spark, {}, {}), G)
    assert rows(voted.select("votes", "total_signals")) == [(0, 0), (0, 0)]
    assert race.top_selection(voted, G).count() == 0


def test_nulls_share_the_last_place(spark):
    """Field of four: no, one, two and only NULLs."""
    for values, want in (
        ([4.0, 3.0, 2.0, 1.0], [1.0, 0.667, 0.333, 0.0]),
        ([4.0, 3.0, 2.0, None], [1.0, 0.667, 0.333, 0.0]),
        ([4.0, 3.0, None, None], [1.0, 0.667, 0.333, 0.333]),
        ([None] * 4, [1.0] * 4),
    ):
        ranked = bottom_ranks(runners(spark, *[{"rating": v} for v in values]), G, {"k": Signal("rating")})
        got = ranked.orderBy("row_pos").select(F.round(percentile(F.col("k"), F.lit(4)), 3)).collect()
        assert [r[0] for r in got] == want


def paced(spark, column, values):
    got = race.pace(runners(spark, *[{column: v} for v in values]), G).select("pace_scenario", "contested_pace").distinct().collect()
    assert len(got) == 1
    return tuple(got[0])


def test_pace(spark):
    assert paced(spark, "avg_800m_pos", [1.0, 2.0]) == (None, None)
    assert paced(spark, "avg_800m_pos", [1.0, 5.0, 6.0]) == ("slow", False)
    assert paced(spark, "avg_800m_pos", [1.0, 2.0, 2.5, 3.0]) == ("fast", True)
    assert paced(spark, "avg_800m_pos", [1.0, 3.0, 6.0]) == ("neutral", False)
    assert paced(spark, "speed_rating", [90.0, 89.0, 85.5, 85.0]) == ("slow", True)
    assert paced(spark, "speed_rating", [90.0, 80.0, 70.0]) == (None, None)


def test_settling(spark):
    df = runners(spark, {"avg_settled_pos": 2.5}, {"avg_settled_pos": 4.6}, {"avg_settled_pos": 8.1}, {"speed_rating": 9.0}, {})
    got = race.settling(race.speed_rank(df, G), G).orderBy("row_pos").select("settling").collect()
    assert [r[0] for r in got] == ["leader", "midfield", "backmarker", "leader", "unknown"]
    alone = race.settling(race.speed_rank(runners(spark, {"speed_rating": 9.0}), G), G)
    assert alone.first()["settling"] == "unknown"


def test_first_starter_ignores_unknown(spark):
    assert race.first_starter(runners(spark, {"runs_with_wpr": None}, {"runs_with_wpr": 3}), G).first()["has_first_starter"] is False
    assert race.first_starter(runners(spark, {"runs_with_wpr": 0}, {"runs_with_wpr": 3}), G).first()["has_first_starter"] is True


BEST = {
    "prize_money": 20000.0, "date": dt.date(2024, 5, 4), "runs_with_wpr": 5, "wpr_nett": 9.0, "late_speed_score": 9.0,
    "rating": 9.0, "ext_class_rank": 2, "ext_last600_rank": 2, "ext_ai_rank": 9,
}
OTHER = {**BEST, "wpr_nett": 1.0, "late_speed_score": 1.0, "rating": 1.0, "ext_class_rank": 9, "ext_last600_rank": 9}


def picked(spark, *given, book=None):
    return rows(rules.picks(runners(spark, *given), G, book).select("run_id", "model"))


def test_both_rules_and_the_prize_gate(spark):
    assert picked(spark, BEST, OTHER) == [("0", "loose"), ("0", "main")]
    assert picked(spark, {**BEST, "prize_money": 19999.9}, OTHER) == []
    assert picked(spark, {**BEST, "prize_money": None}, OTHER) == []
    # the race's prize is that of its first row
    assert picked(spark, {**OTHER, "prize_money": 0.0}, BEST) == []


def test_rank_zero_null_and_nan_are_no_rank(spark):
    for bad in (0, None):
        assert picked(spark, {**BEST, "ext_class_rank": bad, "ext_last600_rank": bad}, OTHER) == []
    df = runners(spark, BEST, OTHER).withColumn("ext_class_rank", F.lit(float("nan"))).withColumn("ext_last600_rank", F.lit(float("nan")))
    assert rules.picks(conform(df, RUNNERS), G).count() == 0


def test_first_starter_races_have_no_picks(spark):
    assert picked(spark, BEST, {**OTHER, "runs_with_wpr": 0}) == []


def test_own_rule(spark):
    saturday = rules.Rule("sat", "Saturday", "Best rating on Saturdays", lambda: (F.col("rating_rank") == 1) & (F.col("dow") == "Saturday"))
    book = rules.default_rules().register(saturday)
    assert picked(spark, BEST, OTHER, book=book) == [("0", "loose"), ("0", "main"), ("0", "sat")]
    assert book.primary == "main" and [r["model"] for r in book.meta(spark).collect()] == ["main", "loose", "sat"]


def scored(spark, *given, **spec):
    df = score.score_races(runners(spark, *given), G, score.ScoreSpec(**spec))
    return df.orderBy("row_pos").select("cs", "crk", "cs_path", "csc", "csg").collect()


def test_a_runner_alone(spark):
    assert tuple(scored(spark, {"rating": 1.0})[0]) == (1.0, 1, "B", 1.0, {})


def test_linear_path_without_coverage(spark):
    a, b = scored(spark, {"rating": 2.0, "wpr_avg_last3": 1.0}, {"rating": 1.0, "wpr_avg_last3": 2.0})
    # late speed is unknown for both, which makes both first by it
    assert a["cs_path"] == "B" and a["cs"] == round((2.0 + 0.3) / 2.8, 4) and b["cs"] == round((0.5 + 0.3) / 2.8, 4)
    assert (a["crk"], b["crk"]) == (1, 2) and a["csg"] == {"rating": 1.0, "wpr_avg_last3": 0.0, "late_speed_score": 1.0}
    spread = math.sqrt(2 / 9)
    assert a["csc"] == round(1 - spread / 0.5, 3)


def test_logistic_path(spark):
    a, b = scored(spark, {"rating": 2.0, "ext_ai_rank": 1}, {"rating": 1.0})
    z = -1.96 + 2.5 + 0.17 + 0.20 + 0.10 - 0.09 - 0.04
    assert a["cs_path"] == "C" and a["cs"] == round(1 / (1 + math.exp(-z)), 4)
    z = -1.96 + 0.17 + 0.20 + 0.0 - 0.09 - 0.04
    assert b["cs"] == round(1 / (1 + math.exp(-z)), 4)


def test_combo_path_needs_trust(spark):
    given = ({"rating": 1.0, "jt_combo_win_pct": 60.0, "jt_combo_rides": 5}, {"rating": 2.0, "jt_combo_win_pct": 20.0, "jt_combo_rides": 300})
    assert scored(spark, *given)[0]["cs_path"] == "B"
    a, b = scored(spark, *given, trust_combo=True)
    # shrunk: (5*60 + 270)/35 = 16.3 against (300*20 + 270)/330 = 19
    assert a["cs_path"] == "A" and (a["cs"], b["cs"]) == (0.0, 1.0)


def test_skip_nulls(spark):
    a, _ = scored(spark, {"rating": 2.0}, {"rating": 1.0}, skip_nulls=True)
    assert a["cs"] == round(2.0 / 2.8, 4) and a["csc"] is None and a["csg"] == {"rating": 1.0}


def test_sorts_for_a_record_move_no_columns_of_the_runner(spark):
    from railbird.operators import payload, race
    from railbird.operators.groups import InTask
    from railbird.plans import race_queries, star

    runners = race_queries._with_nested(star.runners(spark, "/root/testdata/sf0.001"))
    records = payload.race_payload(race.first_starter(runners, InTask(["race_id"])), InTask(["race_id"]), tie=star.TIE)
    plan = records._jdf.queryExecution().optimizedPlan().toString().splitlines()
    scored = [line for line in plan if "cs_path#" in line and "Window" in "".join(plan[plan.index(line) :])]
    assert scored and not [line for line in scored if "jockey#" in line or "trainer_rating#" in line]


def _field(spark):
    given = [
        {"race_id": f"r{i % 3}", "wpr_nett": float(i % 4), "rating": None if i % 5 == 0 else float(i * 7 % 6), "speed_rating": float(i % 3) * 8,
         "wpr_consistency": float(i % 2), "tab_number": None if i == 4 else i * 5 % 9, "finish_position": i if i % 3 else None, "horse": f"h{i}",
         "runs_with_wpr": i % 6, "avg_settled_pos": float(i % 9), "prize_money": 5.0 * i}
        for i in range(24)
    ]
    return runners(spark, *given, {"race_id": "none", "horse": "alone"})


def test_compact_records_take_leaders_from_their_lists(spark):
    df = race.race_context(_field(spark), G)
    plain = payload.compact_races(df, G, max_runners=3)
    assert "Join" not in plain._jdf.queryExecution().optimizedPlan().toString()
    spread = payload.compact_races(df, Spread(["race_id"]), max_runners=3)
    assert plain.columns == spread.columns and rows(plain, "rid", "part") == rows(spread, "rid", "part")
    assert {(r["rid"], r["part"]) for r in plain.collect()} == {(r, p) for r in ("r1", "r2") for p in (0, 1, 2)}


def test_selections_rank_runners_once(spark):
    df = race.race_context(_field(spark), G)
    plain = race.selections(df, G, max_runners=3)
    assert "Join" not in plain._jdf.queryExecution().optimizedPlan().toString()
    spread = race.selections(df, Spread(["race_id"]), max_runners=3)
    assert plain.columns == spread.columns and rows(plain, "race_id", "part") == rows(spread, "race_id", "part")
    assert {(r["race_id"], r["part"]) for r in plain.collect()} == {(f"r{r}", p) for r in (0, 1, 2) for p in (0, 1, 2)}


def test_selections_sort_runners_once_for_each_order(spark):
    df = race.speed_rank(race.pace(_field(spark), G), G)
    plan = race.selections(df, G)._jdf.queryExecution().executedPlan().toString()
    # by speed, by four more anchors and by position; and the records
    assert plan.count(" Sort [race_id") == 7
    # no lambda is run over the runners of a race
    assert "lambdafunction(struct" not in plan and "array_sort" not in plan


def test_numbers_of_records_are_rounded_as_python_does(spark):
    values = [0.0005, 2.6755, 1.0005, -0.0004, -1.0015, 0.4994999, 0.4995001, 123456.7895, 999999.9995, 1000000.0005, 1e15 + 0.3, 5e-324, 0.0, None]
    values += [(i * 2 + 1) / 2000 for i in range(60)]
    found = payload.with_rounded(runners(spark, *[{"rating": v, "rating_price": float("inf")} for v in values])).select("run_id", "_numbers").collect()
    at = list(payload.NUMBER_KEYS.values()).index("rating")
    assert [(r["_numbers"][at], r["_numbers"][at + 1]) for r in sorted(found, key=lambda r: int(r["run_id"]))] == [
        (None if v is None else round(v, 3), float("inf")) for v in values
    ]
