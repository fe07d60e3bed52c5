"""EWMA slot baseline (C1/C2), share EWMA (C5), time bucketing (A5) and the
24-bucket trend (B7) — reference golden values and derived sequences."""
import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outcry.functions.scoring import ewma_step
from outcry.functions.time import with_bucket
from outcry.operators import baselines as C
from outcry.operators import counts as CN
from outcry.operators import replay as H

UTC = dt.timezone.utc


def step(spark, mean, std, n, x, a=None):
    m, s, k = ewma_step(F.lit(float(mean)), F.lit(float(std)), F.lit(n).cast("long"), F.lit(x),
                        None if a is None else F.lit(a))
    return spark.range(1).select(m, s, k).first()


def test_first_observation_seeds(spark):
    assert tuple(step(spark, 0, 0, 0, 25)) == (25.0, 5.0, 1)


def test_step_with_given_alpha(spark):
    m, s, k = step(spark, 30, 10, 5, 50, 0.3)
    assert m == pytest.approx(36.0) and k == 6


def test_constant_series_converges(spark):
    cat = spark.createDataFrame([("e",)], "entity_id string")
    # 100 weeks of x = 42 in one slot (daily buckets: one slot per weekday)
    start = dt.datetime(2024, 1, 1, tzinfo=UTC)
    rows = [("e", start + dt.timedelta(days=7 * i), 42, 1, 0) for i in range(100)]
    counts = spark.createDataFrame(rows, "entity_id string, hour timestamp, n long, dow int, hod int")
    lo, hi = F.lit(start), F.lit(start + dt.timedelta(days=7 * 99))
    st = C.slot_baselines(counts, cat, lo, hi, "day").where("dow = 1").first()
    assert st.mean == pytest.approx(42.0) and st.std < 1 and st.n == 100


def _series_counts(spark, xs, start):
    rows = [("e", start + dt.timedelta(days=7 * i), x, 1, 0) for i, x in enumerate(xs) if x]
    return spark.createDataFrame(rows, "entity_id string, hour timestamp, n long, dow int, hod int")


SEQ = [25, 50, 0, 10, 40, 7]
EXPECTED = [(25, 5, 1), (37.5, 12.99038105676658, 2), (24.241747852752233, 20.74827874449291, 3),
            (20.1305093744936, 18.65121827071402, 4), (25.0978820308702, 18.30096529034237, 5),
            (21.05107258389043, 17.80156631253284, 6)]


def test_fold_and_history_sequence(spark):
    start = dt.datetime(2024, 1, 1, tzinfo=UTC)  # a Monday
    cat = spark.createDataFrame([("e",)], "entity_id string")
    counts = _series_counts(spark, SEQ, start)
    lo, hi = F.lit(start), F.lit(start + dt.timedelta(days=7 * 5))
    final = C.slot_baselines(counts, cat, lo, hi, "day").where("dow = 1").first()
    assert (final.mean, final.std, final.n) == EXPECTED[-1]
    hist = H.slot_history(counts, cat, lo, hi, "day").where("dow = 1").orderBy("hour").collect()
    assert [(r.mean, r.std, r.n) for r in hist] == [tuple(map(float, e[:2])) + (e[2],) for e in EXPECTED]
    assert hist[0].prev_mean is None and hist[0].prev_n == 0
    assert (hist[3].prev_mean, hist[3].prev_std, hist[3].prev_n) == EXPECTED[2]


def test_share_sequence(spark):
    # (n, total) per hour: (0,4),(0,0),(2,4),(0,5),(0,0),(3,3)
    start = dt.datetime(2024, 1, 1, tzinfo=UTC)
    pairs = [(0, 4), (0, 0), (2, 4), (0, 5), (0, 0), (3, 3)]
    rows = []
    for i, (n, t) in enumerate(pairs):
        h = start + dt.timedelta(hours=i)
        if n:
            rows.append(("e", h, n, 1, i))
        if t - n:
            rows.append(("o", h, t - n, 1, i))
    counts = spark.createDataFrame(rows, "entity_id string, hour timestamp, n long, dow int, hod int")
    cat = spark.createDataFrame([("e",), ("o",)], "entity_id string")
    lo, hi = F.lit(start), F.lit(start + dt.timedelta(hours=5))
    final = C.share_baselines(counts, cat, lo, hi).where("entity_id = 'e'").first()
    assert final.expected_share == pytest.approx(0.545) and final.total == 5
    hist = (H.share_history(H.entity_series(counts, cat, lo, hi))
            .where("entity_id = 'e'").orderBy("hour").collect())
    assert [round(r.share, 6) for r in hist] == [0, 0, 0.5, 0.35, 0.35, 0.545]
    assert [r.lifetime_total for r in hist] == [0, 0, 2, 2, 2, 5]
    assert hist[-1].share == final.expected_share


@pytest.mark.parametrize("ts,hour,hod,dow", [
    (dt.datetime(2026, 3, 30, 14, 37, 22, tzinfo=UTC), dt.datetime(2026, 3, 30, 14, tzinfo=UTC), 14, 1),
    (dt.datetime(2026, 3, 30, 0, 5, tzinfo=UTC), dt.datetime(2026, 3, 30, 0, tzinfo=UTC), 0, 1),
    (dt.datetime(2026, 3, 29, 23, 59, 59, tzinfo=UTC), dt.datetime(2026, 3, 29, 23, tzinfo=UTC), 23, 0)])
def test_bucket(spark, ts, hour, hod, dow):
    df = spark.createDataFrame([(ts,)], T.StructType([T.StructField("ts", T.TimestampType())]))
    r = with_bucket(df, "ts").select(F.unix_seconds("hour").alias("h"), "hod", "dow").first()
    assert r.h == int(hour.timestamp()) and r.hod == hod and r.dow == dow


def test_trend_24_rows_zero_filled_across_midnight(spark):
    now = dt.datetime(2026, 3, 30, 3, tzinfo=UTC)
    rows = [("e", now - dt.timedelta(hours=2), 4, 1, 1), ("e", now - dt.timedelta(hours=30), 9, 0, 21)]
    counts = spark.createDataFrame(rows, "entity_id string, hour timestamp, n long, dow int, hod int")
    cat = spark.createDataFrame([("e",)], "entity_id string")
    tr = CN.trend(counts, cat, F.lit(now)).orderBy("pos").collect()
    assert len(tr) == 24
    assert [r.pos for r in tr] == list(range(24))
    assert sum(r.n for r in tr) == 4 and tr[21].n == 4
    first = F.lit(now - dt.timedelta(hours=23))
    got = CN.trend(counts, cat, F.lit(now)).where(F.col("pos") == 0) \
        .select((F.unix_seconds("hour") == F.unix_seconds(first)).alias("ok")).first()
    assert got.ok
