"""Brute force: replay the reference's hourly procedure literally (score the
current hour against the stored tables, then run the hourly update over every
catalog entity) on a seeded random fixture, and compare with the Spark
``score_history`` row by row."""
import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from outcry.plans.status import score_history

UTC = dt.timezone.utc


def js_round(x, k):
    s = 10 ** k
    return math.floor(x * s + 0.5) / s


def band(v, cuts):
    for score, cut in zip((5, 4, 3, 2), cuts):
        if v <= cut:
            return score
    return 1


def label(s):
    if s <= 0:
        return "unknown"
    if s < 1.5:
        return "braindead"
    if s < 2.5:
        return "dumb"
    if s < 3.5:
        return "normal"
    if s < 4.5:
        return "smart"
    return "genius"


def simulate(counts, entities, hours):
    base, shares, out = {}, {}, []
    for h in hours:
        dow, hod = (h.weekday() + 1) % 7, h.hour
        total = sum(counts.get((e, h), 0) for e in entities)
        for e in entities:
            n = counts.get((e, h), 0)
            slot = base.get((e, dow, hod))
            hs = [v for (ee, d, o), v in base.items() if ee == e and o == hod]
            ag = [v for (ee, d, o), v in base.items() if ee == e]
            tier = None
            if slot and slot[2] >= 1:
                tier = ("slot", slot[0], slot[1], min(1, slot[2] * 3 / 10))
            elif hs and sum(v[2] for v in hs) >= 3:
                k = sum(v[2] for v in hs)
                tier = ("hour", js_round(math.fsum(v[0] for v in hs) / len(hs), 9),
                        js_round(math.fsum(v[1] for v in hs) / len(hs), 9), min(1, k * 1.5 / 10))
            elif ag and sum(v[2] for v in ag) >= 5:
                k = sum(v[2] for v in ag)
                tier = ("aggregate", js_round(math.fsum(v[0] for v in ag) / len(ag), 9),
                        js_round(math.fsum(v[1] for v in ag) / len(ag), 9), min(1, k * 0.5 / 10))
            share = n / total if total > 0 else 0.0
            exp = shares.get(e, (0.0, 0))[0]
            if tier is None:
                out.append((e, h, "none", 0.0, 0.0, 0.0, "unknown", None))
            else:
                _, m, s, c = tier
                sigma = s if s > 0 else max(m * 0.1, 1)
                z = (n - m) / sigma
                d = 0.0 if share == 0 else (2.0 if exp <= 0 else share / exp)
                raw = 0.6 * band(z, (-1.0, 0.5, 1.5, 2.5)) + 0.4 * band(d, (0.5, 0.8, 1.2, 1.5))
                score = js_round(max(1, min(5, 3 + (raw - 3) * c)), 1)
                out.append((e, h, tier[0], js_round(z, 2), js_round(d, 2), score, label(score), js_round(m, 1)))
        # hourly update of every entity (the closed hour h)
        for e in entities:
            x = counts.get((e, h), 0)
            m, s, k = base.get((e, dow, hod), (0.0, 0.0, 0))
            if k == 0:
                base[(e, dow, hod)] = (float(x), 5.0, 1)
            else:
                a = max(0.1, 0.5 / math.sqrt(max(k, 1)))
                diff = x - m
                base[(e, dow, hod)] = (a * x + (1 - a) * m,
                                       math.sqrt(max((1 - a) * (s * s + a * diff * diff), 0.01)), k + 1)
            if total > 0:
                old, tot = shares.get(e, (0.0, 0))
                cur = x / total
                shares[e] = (0.3 * cur + (1 - 0.3) * old if tot > 0 else cur, tot + x)
    return out


@pytest.mark.parametrize("seed", [7, 11])
def test_history_matches_hourly_procedure(spark, seed):
    rnd = random.Random(seed)
    entities = ["a", "b", "c"]
    start = dt.datetime(2024, 3, 4, tzinfo=UTC)  # Monday
    hours = [start + dt.timedelta(hours=i) for i in range(24 * 17)]
    counts = {}
    for h in hours:
        if rnd.random() < 0.15:
            continue  # a silent hour for everybody (total 0)
        for e in entities:
            if rnd.random() < 0.6:
                counts[(e, h)] = rnd.choice([1, 1, 2, 3, 5, 8, 20])
    rows = [(e, h, n, (h.weekday() + 1) % 7, h.hour) for (e, h), n in counts.items()]
    cdf = spark.createDataFrame(rows, "entity_id string, hour timestamp, n long, dow int, hod int")
    cat = spark.createDataFrame([(e,) for e in entities], "entity_id string")
    got = score_history(cdf, cat, F.lit(hours[0]), F.lit(hours[-1])).collect()
    by = {(r.entity_id, r.hour): r for r in got}
    expected = simulate(counts, entities, hours)
    assert len(got) == len(expected)
    for e, h, tier, z, d, score, status, mean in expected:
        r = by[(e, h.strftime("%Y-%m-%dT%H:%M:%SZ"))]
        assert (r.tier, r.z_score, r.disproportionality, r.score, r.status, r.baseline_mean) == \
            (tier, z, d, score, status, mean), (e, h)


@pytest.mark.parametrize("seed", [3])
def test_snapshot_matches_hourly_procedure(spark, seed):
    """The direct snapshot path (JVM folds, decimal tier sums) against the
    same literal simulation, at several as-of hours."""
    from outcry.plans.status import status_snapshot
    rnd = random.Random(seed)
    entities = ["a", "b", "c", "d"]
    start = dt.datetime(2024, 3, 4, tzinfo=UTC)
    hours = [start + dt.timedelta(hours=i) for i in range(24 * 10)]
    counts = {}
    for h in hours:
        if rnd.random() < 0.2:
            continue
        for e in entities:
            if rnd.random() < 0.5:
                counts[(e, h)] = rnd.choice([1, 2, 3, 4, 9])
    rows = [(e, h, n, (h.weekday() + 1) % 7, h.hour) for (e, h), n in counts.items()]
    cdf = spark.createDataFrame(rows, "entity_id string, hour timestamp, n long, dow int, hod int")
    cat = spark.createDataFrame([(e,) for e in entities], "entity_id string")
    expected = {(e, h): rest for e, h, *rest in simulate(counts, entities, hours)}
    for k in (3, 50, 100, 171, len(hours) - 1):
        as_of = hours[k]
        got = status_snapshot(cdf, cat, F.lit(as_of), F.lit(hours[0])).collect()
        assert len(got) == len(entities)
        for r in got:
            tier, z, d, score, status, mean = expected[(r.entity_id, as_of)]
            assert (r.tier, r.z_score, r.disproportionality, r.score, r.status, r.baseline_mean) == \
                (tier, z, d, score, status, mean), (r.entity_id, as_of)
