import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.functions import pairmath, probability, text


def one_column(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def test_lenient_parse(spark, rows):
    df = one_column(spark, ["7", " 7 ", "7.9", "abc", "", None], "string")
    got = rows(df.select("i", text.lenient_int(F.col("v")), text.lenient_double(F.col("v"))), "i")
    assert [g[1] for g in got] == [7, 7, None, None, None, None]
    assert [g[2] for g in got] == [7.0, 7.0, 7.9, None, None, None]


def test_split_record(spark, rows):
    df = one_column(spark, ["185-23", "185", "x-3", "3-x", "", None], "string")
    wins, losses = text.split_record(F.col("v"))
    got = rows(df.select("i", wins, losses), "i")
    assert [g[1:] for g in got] == [(185, 23), (None, None), (None, None), (3, None), (None, None), (None, None)]


def test_normalize_category(spark, rows):
    names = ["First Four", "FIRST ROUND", "Second Round", "Third Round", "SWEET 16&#174;", "Elite Eight",
             "FINAL FOUR®", "National Championship", "3", "bogus"]
    df = one_column(spark, names, "string")
    got = rows(df.select("i", text.normalize_category(F.col("v"))), "i")
    assert [g[1] for g in got] == [0, 1, 1, 2, 3, 4, 5, 6, 3, -1]


def test_normalize_key_and_slug(spark, rows):
    df = one_column(spark, ["  St.  John's\t(NY) ", "A . B"], "string")
    got = rows(df.select("i", text.normalize_key(F.col("v")), text.slugify(F.col("v"))), "i")
    assert got[0][1] == "st john's (ny)"
    assert got[1][1] == "a b"
    assert got[1][2] == "a-.-b"


def test_pad_array(spark, rows):
    df = spark.createDataFrame([([1, 2],), ([],), ([1, 2, 3, 4],)], "v array<int>")
    assert [list(r[0]) for r in rows(df.select(text.pad_array(F.col("v"), 3)))] == [
        [1, 2, None], [None, None, None], [1, 2, 3]]


def test_pct_diff_denominators(spark, rows):
    df = spark.createDataFrame([(3.0, 1.0), (1.0, -1.0), (-3.0, -1.0), (None, 1.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    got = rows(df.select(pairmath.pct_diff(a, b), pairmath.pct_diff(a, b, "abs_clip"), pairmath.safe_pct_diff(a, b)))
    assert got[0] == (1.0, 1.0, 1.0)
    assert got[1] == (2000.0, 2000.0, 0.0)
    assert got[2] == (-2000.0, -1.0, 1.0)
    assert got[3] == (None, None, None)
    with pytest.raises(ValueError):
        pairmath.pct_diff(a, b, "other")


def test_buckets_and_groups(spark, rows):
    df = spark.createDataFrame([(0,), (3,), (-4,), (7,), (-8,), (None,)], "d int")
    assert [r[0] for r in rows(df.select(pairmath.diff_bucket(F.col("d"))))] == [0, 0, 1, 1, 2, 2]
    assert [r[0] for r in rows(df.select(pairmath.ordinal_group(F.col("d"))))] == [0, 2, 0, 3, 0, None]


def test_impute_zero(spark, rows):
    df = one_column(spark, [1.5, None, float("nan"), float("inf"), float("-inf")], "double")
    got = [r[1] for r in rows(df.select("i", pairmath.impute_zero(F.col("v"))), "i")]
    assert got == [1.5, 0.0, 0.0, np.finfo(float).max, -np.finfo(float).max]


def test_prior_blend(spark, rows):
    cases = [(0.5, 0.2, [0.6, 0.7]), (1.0, 0.2, [0.6, 0.7]), (0.6, None, [0.4, 0.7]), (0.6, 0.4, [0.4, 0.3]),
             (0.6, 0.4, [0.4])]
    df = spark.createDataFrame(cases, "p double, rate double, preds array<double>")
    got = [r[0] for r in rows(df.select(probability.prior_blend(F.col("p"), F.col("rate"), F.col("preds"))))]
    for value, (p, rate, preds) in zip(got, cases):
        votes = sum(q < 0.5 for q in preds) if len(preds) >= 2 else 0
        pull = 0.35 * (1 - (abs(p - 0.5) * 2) ** 1.2) + {0: 0.0, 1: 0.08}.get(votes, 0.15)
        assert value == pytest.approx(p * (1 - pull) + (1 - (0.30 if rate is None else rate)) * pull)


def test_row_stats_match_numpy(spark, rows):
    values = [[0.2, 0.9, 0.4], [0.5, 0.5, 0.5]]
    df = spark.createDataFrame([(v,) for v in values], "p array<double>")
    stats = probability.row_stats(F.col("p"))
    for got, v in zip(rows(df.select(*stats.values())), values):
        v = np.array(v)
        want = (v.mean(), v.std(), v.max() - v.min(), np.abs(v - 0.5).max())
        assert got == pytest.approx(want)


def test_digamma(spark, rows):
    n = [1, 2, 5, 17, 1000]
    df = one_column(spark, [float(x) for x in n], "double")
    got = [r[1] for r in rows(df.select("i", probability.digamma(F.col("v"))), "i")]
    want = [sum(1 / j for j in range(1, x)) - 0.5772156649015329 for x in n]
    assert got == pytest.approx(want, abs=1e-12)


def test_decisions_and_tiers(spark, rows):
    df = spark.createDataFrame([(0.7, 5, 3), (0.5, 2, 9), (0.4, None, 3)], "p double, sa int, sb int")
    picked = probability.decision_columns(F.col("p"), F.lit("a"), F.lit("b"), F.col("sa"), F.col("sb"))
    got = rows(df.select(*picked))
    assert [g[0] for g in got] == ["a", "b", "b"]
    assert [g[4] for g in got] == [True, True, False]
    tiers = spark.createDataFrame([(1, 2), (2, 2), (2, 1)], "h int, l int")
    assert [r[0] for r in rows(tiers.select(probability.confidence_tier(F.col("h"), F.col("l"))))] == ["HIGH", "LOW", "MED"]


def test_log_loss_clips(spark, rows):
    df = spark.createDataFrame([(0.0, 1), (1.0, 1), (0.5, 0)], "p double, y int")
    got = [r[0] for r in rows(df.select(probability.log_loss_term(F.col("p"), F.col("y"))))]
    assert got[0] > 30 and got[1] == pytest.approx(0.0, abs=1e-12) and got[2] == pytest.approx(math.log(2))


def test_rounding_by_arithmetic_equals_rounding_by_text(spark):
    rng = np.random.default_rng(4)
    ties = [(k + 0.5) / 10.0**d for k in range(-60, 60) for d in (4, 6)]
    odd = [0.0, -0.0, 1e-9, -1e-9, 999.9999995, -999.9999995, 1e3, 123456.7890125, 1e9, 1e15, -1e300, 5e-324, math.nan, math.inf, -math.inf, None]
    near = [np.nextafter(t, s) for t in ties for s in (-1.0, 1.0)]
    values = [*ties, *odd, *near, *(rng.normal(size=4000) * 10.0 ** rng.integers(-7, 12, 4000)).tolist()]
    df = one_column(spark, [None if v is None else float(v) for v in values], "double").repartition(2)
    for digits in (4, 6):
        both = df.select("v", pairmath.round_digits(F.col("v"), digits).alias("got"), F.round("v", digits).alias("want")).collect()
        assert [repr(r["got"]) for r in both] == [repr(r["want"]) for r in both]
    plan = df.select(pairmath.round_digits(F.col("v"), 6))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan and "floor" in plan.lower()


def test_registered_queries_round_by_arithmetic(spark):
    from pairlab.plans.registry import rounded

    df = one_column(spark, [1.23456789], "double")
    assert "floor" in rounded(df)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert rounded(df).head()["v"] == 1.234568


def test_queries_fuse_only_what_java_compiles(spark):
    from pairlab.plans.registry import QUERIES, register

    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit)
    try:
        register("wide_test")(lambda spark, sf: spark.range(1))
        for given, want in (("65535", "8000"), ("4000", "4000")):
            spark.conf.set(limit, given)
            QUERIES["wide_test"](spark, "")
            assert spark.conf.get(limit) == want
    finally:
        QUERIES.pop("wide_test", None)
        spark.conf.set(limit, before)
