"""Expressions against Python's own rules."""

import math
import statistics
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import stats, text


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression.alias("y")).first()["y"]


def many(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", expression.alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


ODD = ["", " ", "\t a \n", " b　", "\x1cc\x1f", "\x85d ", "plain", "a b", "é "]


def test_strip_is_pythons(spark):
    assert many(spark, ODD, text.py_strip("x")) == [x.strip() for x in ODD]


def test_strip_of_any_text(spark):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.text(alphabet=st.sampled_from(list(" \t\n\x0b\x1c\x1d 　abé"))), min_size=40, max_size=40))
    def run(values):
        got = many(spark, values, text.py_strip("x"))
        assert got == [v.strip() for v in values]
        assert many(spark, got, text.py_strip("x")) == got

    run()


def test_strip_is_linear(spark):
    """A million blanks inside a text cost no more than other characters."""
    inner = "a" + " " * 1_000_000 + "b"
    began = time.perf_counter()
    assert many(spark, [f"  {inner}\n"], text.py_strip("x")) == [inner]
    assert time.perf_counter() - began < 10


def test_first_word_of_whole_texts(spark):
    cases = ["  Owl! is", "...", "", " ", "A,b c", "\u2003Word\u3000x", "ΑΣ. b", None]
    assert many(spark, cases, text.first_word_of("x")) == many(spark, cases, text.first_word(text.normalised("x")))


def test_report_formats(spark):
    for x in (0.125, 0.0625, -0.5, 1.0, 0.9996, 0.0):
        assert one(spark, x, text.percent("x"), "double") == f"{x:.1%}"
        assert one(spark, x, text.percent("x", signed=True, width=9), "double") == f"{x:>+9.1%}"
    assert one(spark, None, text.percent("x", width=7), "double") == "   nan%"
    assert one(spark, 7, text.padded("x"), "int") == "00007" and one(spark, 1234567, text.padded("x"), "int") == "1234567"
    assert one(spark, 1234567, text.grouped("x"), "int") == "1,234,567"
    assert one(spark, "ab", text.aligned("x", 4)) == "ab  " and one(spark, "abcde", text.aligned("x", 4)) == "abcde"
    with pytest.raises(Exception, match="no <x>"):
        one(spark, "abc", text.before("x", "<x>", strict=True))


def test_percent_rounds_as_printf(spark):
    """Halves by the exact double, and a minus before what rounds to zero."""
    for x in (-0.0004, -0.0, 0.0004, 0.4845, 0.9845, -0.9965, 0.0005, -0.0005, 0.0025, 12.3456, -1234.5):
        assert one(spark, x, text.percent("x"), "double") == f"{x:.1%}"
        assert one(spark, x, text.percent("x", signed=True, width=9), "double") == f"{x:>+9.1%}"


def test_reasoning_block(spark):
    cases = ["<think>a\nb</think>\n 1, 2", "x<think>a</think> y <think>b</think>z", "<think>open", "none", " <think></think> "]
    assert many(spark, cases, text.strip_block("x")) == ["1, 2", "xy z", "<think>open", "none", ""]


def test_first_word(spark):
    cases = ["owl. is", "  Owl!", "...", "", " ", "a,b c", " word x"]
    want = [c.split()[0].strip(".,!") if c.split() else c for c in cases]
    assert many(spark, cases, text.first_word("x")) == want


def test_hits(spark):
    assert many(spark, ["owl", "bowl", "cat"], text.hits("x", "owl")) == [True, True, False]
    assert many(spark, ["owl", "bowl", "an owl."], text.hits("x", "owl", whole_word=True)) == [True, False, True]


def test_small_expressions(spark):
    assert one(spark, "Org/Model-2.5-7B", text.model_slug("x")) == "model_2_5_7b"
    assert one(spark, "ab{x}c", text.before("x", "{x}")) == "ab"
    assert one(spark, "abc", text.before("x", "{x}")) is None
    assert one(spark, "a" * 81, text.preview("x")) == "a" * 80 + "..."
    assert one(spark, "a" * 80, text.preview("x")) == "a" * 80
    assert one(spark, "abcdefg", text.token_estimate("x")) == 1
    assert one(spark, "a a", text.replaced("x", [("a", "b"), ("b", "c")])) == "c c"


def test_intervals(spark):
    z = statistics.NormalDist().inv_cdf(0.975)
    low, high = stats.bernoulli_ci(F.lit(0.3), F.lit(10))
    got = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert math.isclose(got["l"], 0.3 - z * math.sqrt(0.021)) and math.isclose(got["h"], 0.3 + z * math.sqrt(0.021))
    low, high = stats.bernoulli_ci(F.lit(0.0), F.lit(10), method="wilson")
    got = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert abs(got["l"]) < 1e-12 and math.isclose(got["h"], z * z / (10 + z * z))
    with pytest.raises(ValueError):
        stats.z_value(1.0)


def test_verdicts(spark):
    cases = [(0.051, "validated"), (0.05, "inconclusive"), (0.0, "failed"), (-1.0, "failed"), (None, "failed"), (float("nan"), "failed")]
    for value, want in cases:
        assert one(spark, value, stats.verdict(F.col("x")), "double") == want
    assert spark.createDataFrame([(0.5,)], "x double").agg(stats.sample_std(F.col("x")).alias("s")).first()["s"] == 0.0
