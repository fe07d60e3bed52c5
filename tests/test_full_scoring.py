"""Full scoring table (FIXTURES §3): (n, total, mean, std, confidence,
expected share) -> z, d, score, label, through ``score_columns``."""
import pytest
from pyspark.sql import types as T

from outcry.plans.status import score_columns

CASES = [
    (1, 1, 30, 10, 1, .5, -2.9, 2.0, 3.4, "normal"),
    (50, 80, 30, 10, 1, .5, 2.0, 1.25, 2.0, "dumb"),
    (60, 80, 30, 10, 1, .5, 3.0, 1.5, 1.4, "braindead"),
    (0, 0, 0, 5, .3, 0, 0.0, 0.0, 3.4, "normal"),
    (0, 40, 2, 5, .3, .1, -0.4, 0.0, 3.4, "normal"),
    (5, 10, 0, 0, 1, 0, 5.0, 2.0, 1.0, "braindead"),
    (8, 20, 4, 2, .6, .4, 2.0, 1.0, 2.6, "normal"),
    (12, 20, 4, 2, .25, .2, 4.0, 3.0, 2.5, "normal"),
    (0, 0, 20, 8, 1, .33, -2.5, 0.0, 5.0, "genius"),
]

SCHEMA = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("total", T.LongType()),
    T.StructField("slot_mean", T.DoubleType()), T.StructField("slot_std", T.DoubleType()),
    T.StructField("slot_n", T.LongType()),
    T.StructField("hour_mean", T.DoubleType()), T.StructField("hour_std", T.DoubleType()),
    T.StructField("hour_n", T.LongType()),
    T.StructField("agg_mean", T.DoubleType()), T.StructField("agg_std", T.DoubleType()),
    T.StructField("agg_n", T.LongType()),
    T.StructField("expected_share", T.DoubleType()),
])


def _slot_n_for(conf):
    # slot confidence = min(1, n * 3 / 10); pick n hitting the wanted value, else use
    # the aggregate tier (weight 0.5) which reaches 0.3 / 0.25 / 0.6 exactly
    for n in range(1, 11):
        if min(1.0, n * 3 / 10) == conf:
            return ("slot", n)
    for n in range(5, 21):
        if min(1.0, n * 0.5 / 10) == conf:
            return ("agg", n)
    raise AssertionError(conf)


@pytest.mark.parametrize("case", CASES)
def test_full_scoring(spark, case):
    n, total, mean, std, conf, exp, z, d, score, label = case
    tier, k = _slot_n_for(conf)
    row = (n, total,
           float(mean) if tier == "slot" else None, float(std) if tier == "slot" else None,
           k if tier == "slot" else None, None, None, None,
           float(mean) if tier == "agg" else None, float(std) if tier == "agg" else None,
           k if tier == "agg" else None, float(exp))
    out = score_columns(spark.createDataFrame([row], SCHEMA)).first()
    assert out.z_score == pytest.approx(z)
    assert out.disproportionality == pytest.approx(d)
    assert out.score == score
    assert out.status == label


def test_unresolved_is_unscored(spark):
    row = (7, 10, None, None, None, None, None, None, None, None, None, 0.5)
    out = score_columns(spark.createDataFrame([row], SCHEMA)).first()
    assert (out.z_score, out.disproportionality, out.score, out.status) == (0.0, 0.0, 0.0, "unknown")
    assert out.baseline_mean is None and out.confidence == 0.0 and out.tier == "none"
