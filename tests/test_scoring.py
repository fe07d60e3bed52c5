"""Scalar rules D1-D7, C1, C10 — golden values of the reference tests and the
derived table (FIXTURES §2-§3), evaluated as Spark Column expressions."""
import math

import pytest
from pyspark.sql import functions as F

from outcry.functions import scoring as S


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("cur,mean,std,expected", [
    (30, 30.0, 10.0, 0.0), (50, 30.0, 10.0, 2.0), (10, 30.0, 10.0, -2.0)])
def test_z_score(spark, cur, mean, std, expected):
    assert one(spark, S.z_score(F.lit(cur), F.lit(mean), F.lit(std)))[0] == pytest.approx(expected)


def test_z_score_zero_std_is_finite_and_positive(spark):
    z = one(spark, S.z_score(F.lit(40), F.lit(30.0), F.lit(0.0)))[0]
    assert math.isfinite(z) and z > 0
    assert z == pytest.approx(10 / 3)


@pytest.mark.parametrize("share,exp,expected", [
    (0.4, 0.4, 1.0), (0.6, 0.4, 1.5), (0.2, 0.4, 0.5), (0.0, 0.4, 0.0), (0.1, 0.0, 2.0)])
def test_disproportionality(spark, share, exp, expected):
    assert one(spark, S.disproportionality(F.lit(share), F.lit(exp)))[0] == pytest.approx(expected)


@pytest.mark.parametrize("z,band", [(-2, 5), (-1.0, 5), (-0.5, 4), (0.3, 4), (0.5, 4), (1.5, 3),
                                    (1.8, 2), (2.5, 2), (3, 1)])
def test_z_band(spark, z, band):
    assert one(spark, S.z_band(F.lit(float(z))))[0] == band


@pytest.mark.parametrize("d,band", [(0.3, 5), (0.5, 5), (0.8, 4), (1.0, 3), (1.2, 3), (1.5, 2), (2.0, 1)])
def test_d_band(spark, d, band):
    assert one(spark, S.d_band(F.lit(float(d))))[0] == band


@pytest.mark.parametrize("z,d,conf,score", [
    (3, 2, 1, 1.0), (0.3, 1, 1, 3.6), (-2, 0.3, 1, 5.0), (3, 0.3, 1, 2.6), (3, 2, 0.25, 2.5),
    (3, 2, 0, 3.0), (0, 1, 1, 3.6)])
def test_combined_score(spark, z, d, conf, score):
    got = one(spark, S.combined_score(F.lit(float(z)), F.lit(float(d)), F.lit(float(conf))))[0]
    assert got == score


def test_combined_score_grid(spark):
    # raw = 0.6*s1 + 0.4*s2 at full confidence, s1, s2 in 1..5
    zs = {5: -2.0, 4: 0.0, 3: 1.0, 2: 2.0, 1: 3.0}
    ds = {5: 0.1, 4: 0.7, 3: 1.0, 2: 1.4, 1: 2.0}
    cols = [S.combined_score(F.lit(zs[a]), F.lit(ds[b]), F.lit(1.0)).alias(f"s{a}{b}")
            for a in range(1, 6) for b in range(1, 6)]
    r = one(spark, *cols)
    for a in range(1, 6):
        for b in range(1, 6):
            assert r[f"s{a}{b}"] == round(0.6 * a + 0.4 * b, 1)


def test_score_sweep_one_decimal_in_range(spark):
    grid = F.explode(F.sequence(F.lit(0), F.lit(20 * 11 * 5 - 1)))
    df = spark.range(1).select(grid.alias("i")).select(
        ((F.col("i") % 21) / 4 - 2.5).alias("z"),
        ((F.floor(F.col("i") / 21) % 11) / 4).alias("d"),
        ((F.floor(F.col("i") / 231) % 5) / 4).alias("c"))
    out = df.select(S.combined_score("z", "d", "c").alias("s")).collect()
    for r in out:
        assert 1.0 <= r.s <= 5.0
        assert abs(r.s * 10 - round(r.s * 10)) < 1e-9


@pytest.mark.parametrize("score,label", [
    (5.0, "genius"), (4.5, "genius"), (4.4, "smart"), (3.5, "smart"), (3.4, "normal"),
    (2.5, "normal"), (2.4, "dumb"), (1.5, "dumb"), (1.4, "braindead"), (1.0, "braindead"),
    (0.0, "unknown")])
def test_status_label(spark, score, label):
    assert one(spark, S.status_label(F.lit(score)))[0] == label


@pytest.mark.parametrize("n,expected", [(0, 0.5), (1, 0.5), (2, 0.353553), (4, 0.25), (10, 0.158114),
                                        (24, 0.102062), (25, 0.1), (100, 0.1), (1000, 0.1)])
def test_alpha(spark, n, expected):
    assert one(spark, S.alpha(F.lit(n)))[0] == pytest.approx(expected, abs=1e-6)


NULL = None


@pytest.mark.parametrize("slot_n,hour_n,agg_n,mean", [
    (1, 5, 20, 20.0), (NULL, 5, 20, 15.0), (NULL, NULL, 10, 10.0), (0, 3, 10, 15.0),
    (0, 2, 10, 10.0), (0, 1, 2, NULL)])
def test_resolve_tier(spark, slot_n, hour_n, agg_n, mean):
    lit = lambda v, t: F.lit(v).cast(t)
    r = S.resolve_tier(lit(20.0, "double"), lit(5.0, "double"), lit(slot_n, "long"),
                       lit(15.0, "double"), lit(6.0, "double"), lit(hour_n, "long"),
                       lit(10.0, "double"), lit(8.0, "double"), lit(agg_n, "long"))
    got = one(spark, r["mean"], r["confidence"], r["tier"])
    assert got[0] == mean
    if mean is None:
        assert got[1] == 0.0 and got[2] == "none"


@pytest.mark.parametrize("n,w,expected", [(1, "slot", 0.3), (4, "slot", 1.0), (3, "hour", 0.45),
                                          (10, "aggregate", 0.5), (40, "aggregate", 1.0)])
def test_confidence(spark, n, w, expected):
    args = {"slot": (n, None, None), "hour": (0, n, None), "aggregate": (0, 0, n)}[w]
    lit = lambda v: F.lit(v).cast("long")
    r = S.resolve_tier(F.lit(1.0), F.lit(1.0), lit(args[0]), F.lit(1.0), F.lit(1.0), lit(args[1]),
                       F.lit(1.0), F.lit(1.0), lit(args[2]))
    got = one(spark, r["confidence"], r["tier"])
    assert got[0] == pytest.approx(expected) and got[1] == w


@pytest.mark.parametrize("x,k,expected", [(-2.5, 0, -2.0), (2.5, 0, 3.0), (1.25, 1, 1.3),
                                          (-1.25, 1, -1.2), (0.125, 2, 0.13)])
def test_round_half_up_matches_js(spark, x, k, expected):
    assert one(spark, S.round_half_up(F.lit(x), k))[0] == expected


@pytest.mark.parametrize("x,dp,text", [(3.0, 1, "3"), (3.4, 1, "3.4"), (-0.35, 2, "-0.35"),
                                       (10.0, 1, "10"), (0.5, 2, "0.5")])
def test_fmt_number(spark, x, dp, text):
    assert one(spark, S.fmt_number(F.lit(x), dp))[0] == text
