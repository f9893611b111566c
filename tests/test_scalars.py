import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from railbird.functions import scalars


def one(spark, ddl, value, *columns):
    return tuple(spark.createDataFrame([(value,)], f"x {ddl}").select(*columns).first())


def test_half_even_is_pythons_round(spark):
    # values on and next to ties, among them some that are ties only in decimal
    values = [2.675, 0.35, 0.25, 1.005, 1.015, 0.00025, 0.00095, 0.00645, -0.001, -2.5, 0.5, 1.5, 1e9 + 0.005, 0.0]
    values += [k / 2000 for k in range(-999, 1000, 7)] + [k / 8 for k in range(-50, 50)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select("x", *[scalars.half_even("x", n).alias(f"r{n}") for n in (1, 2, 3, 4)]).collect()
    for row in got:
        for n in (1, 2, 3, 4):
            assert row[f"r{n}"] == round(row["x"], n), (row["x"], n)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=200, max_size=400))
def test_half_even_on_any_value(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for row in df.select("x", scalars.half_even("x", 2).alias("r")).collect():
        assert row["r"] == round(row["x"], 2)


def test_half_even_keeps_null(spark):
    assert one(spark, "double", None, scalars.half_even("x", 2)) == (None,)


def test_numbers_from_text(spark):
    got = [one(spark, "string", v, scalars.number("x"), scalars.whole("x")) for v in ("3.9", "-3.9", "abc", "NaN", None)]
    assert got == [(3.9, 3), (-3.9, -3), (None, None), (None, None), (None, None)]


def test_nan_becomes_null(spark):
    assert one(spark, "double", float("nan"), scalars.null_if_nan("x"), scalars.number("x"), scalars.whole("x")) == (None,) * 3


def test_first_truthy_skips_zero_and_empty(spark):
    assert one(spark, "int", 0, scalars.first_truthy("x", F.lit(None).cast("int"), F.lit(7))) == (7,)
    assert one(spark, "string", "", scalars.first_truthy("x", F.lit("b"), falsy="")) == ("b",)


def test_going_categories(spark):
    texts = ["Firm 1", "GOOD 4", "soft 7", "Heavy 10", "Synthetic", "dirt", None]
    got = [one(spark, "string", t, scalars.going_category("x"))[0] for t in texts]
    assert got == ["firm", "good", "soft", "heavy", "synth", None, None]


def test_start_instants(spark):
    at = {
        "2024-05-01T03:00:00Z": dt.datetime(2024, 5, 1, 3),
        "2024-05-01 03:00:00": dt.datetime(2024, 5, 1, 3),
        "2024-05-01T13:00:00+10:00": dt.datetime(2024, 5, 1, 3),
        "14:05": dt.datetime(2024, 5, 2, 14, 5),
        "9:05": dt.datetime(2024, 5, 2, 9, 5),
        "soon": None,
        None: None,
    }
    for text, want in at.items():
        got = one(spark, "string", text, F.to_timestamp_ntz(scalars.start_instant("x", F.lit(dt.date(2024, 5, 2))).cast("string")))
        assert got == (want,), text
    assert one(spark, "string", "14:05", scalars.start_instant("x")) == (None,)
