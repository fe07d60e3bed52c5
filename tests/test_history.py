"""Replay by blocks, stored history (extension, late repair), as-of reads and
the pointer-committed partition store."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from outcry import constants as K
from outcry.operators import asof as J
from outcry.operators import baselines as C
from outcry.operators import counts as CN
from outcry.operators import replay as H
from outcry.plans.history import HistoryStore
from outcry.plans.status import score_history
from outcry.sources.signals import read_signal_sink, write_signals
from outcry.sources.versions import PartitionStore

UTC = dt.timezone.utc
START = dt.datetime(2023, 12, 27, 5, tzinfo=UTC)
COUNTS = "entity_id string, hour timestamp, n long, dow int, hod int"
STATE = ["prev_mean", "prev_std", "prev_n", "mean", "std", "n", "prev_share", "prev_total", "share", "lifetime_total",
         "hour_mean", "hour_n", "agg_mean", "agg_std", "agg_n"]


def random_counts(rnd, hours, entities=4, silent=0.3):
    rows = []
    for i in range(hours):
        h = START + dt.timedelta(hours=i)
        if rnd.random() < 0.05:
            continue  # nobody at all
        for e in range(entities):
            if rnd.random() > silent and not (e == 1 and i < hours // 2):
                rows.append((f"e{e}", h, rnd.randint(1, 30), (h.weekday() + 1) % 7, h.hour))
    return rows


@pytest.fixture(scope="module")
def world(spark):
    rows = random_counts(random.Random(1), 24 * 40)
    counts = spark.createDataFrame(rows, COUNTS).repartition(4).cache()
    born = [("e0", None), ("e1", None), ("e2", START + dt.timedelta(hours=333, minutes=20)), ("e3", None), ("quiet", None)]
    catalog = spark.createDataFrame(born, "entity_id string, valid_from timestamp")
    lo, hi = F.lit(START), F.lit(START + dt.timedelta(hours=24 * 40 - 1))
    counts = CN.born(counts, catalog).cache()
    return counts, catalog, lo, hi, rows


def plain_history(rows, born, hours):
    """The sequential procedure: one bucket after the other, every entity."""
    n_at = {(e, h): n for e, h, n, *_ in rows}
    slots, share, total, out = {}, {}, {}, {}
    for i in range(hours):
        h = START + dt.timedelta(hours=i)
        live = [e for e, since in born.items() if since is None or h >= since.replace(minute=0)]
        t = sum(n_at.get((e, h), 0) for e in live)
        for e in live:
            x = n_at.get((e, h), 0)
            s0, t0 = share.get(e, 0.0), total.get(e, 0)
            m, s, n = slots.get((e, h.weekday(), h.hour), (0.0, 0.0, 0))
            before = [v for k, v in slots.items() if k[0] == e]
            same = [v for k, v in slots.items() if k[0] == e and k[2] == h.hour]
            if t > 0:
                share[e] = K.SHARE_ALPHA * (x / t) + (1 - K.SHARE_ALPHA) * s0 if t0 > 0 else x / t
                total[e] = t0 + x
            if n == 0:
                after = (float(x), K.INITIAL_STD, 1)
            else:
                a = max(K.ALPHA_FLOOR, K.ALPHA_SCALE / max(n, 1) ** 0.5)
                after = (a * x + (1 - a) * m, max((1 - a) * (s * s + a * (x - m) ** 2), K.VARIANCE_FLOOR) ** 0.5, n + 1)
            slots[(e, h.weekday(), h.hour)] = after
            out[(e, h)] = dict(prev_n=n, mean=after[0], std=after[1], n=after[2], prev_share=s0, prev_total=t0,
                               share=share.get(e, 0.0), lifetime_total=total.get(e, 0), prev_mean=m if n else None,
                               hour_n=sum(v[2] for v in same) or None, agg_n=sum(v[2] for v in before) or None,
                               agg_mean=sum(v[0] for v in before) / len(before) if before else None)
    return out


def history_rows(df):
    return {(r.entity_id, r.hour.replace(tzinfo=UTC)): r for r in df.collect()}


def test_replay_over_many_blocks_equals_the_sequential_procedure(spark, world, monkeypatch):
    counts, catalog, lo, hi, rows = world
    monkeypatch.setattr(H, "BLOCK", {"hour": 168, "day": 7})
    born = {r.entity_id: r.valid_from and r.valid_from.replace(tzinfo=UTC) for r in catalog.collect()}
    got = history_rows(H.slot_history(counts, catalog, lo, hi))
    want = plain_history(rows, born, 24 * 40)
    assert got.keys() == want.keys()
    for key, w in want.items():
        for c, v in w.items():
            assert got[key][c] == (pytest.approx(v, rel=1e-9, abs=1e-9) if isinstance(v, float) else v), (key, c)


def test_blocks_and_warm_up_give_the_same_bits(spark, world, monkeypatch):
    counts, catalog, lo, hi, _ = world
    whole = history_rows(H.slot_history(counts, catalog, lo, hi))
    monkeypatch.setattr(H, "BLOCK", {"hour": 336, "day": 7})
    cut = history_rows(H.slot_history(counts, catalog, lo, hi))
    assert whole.keys() == cut.keys()
    assert all([whole[k][c] for c in STATE] == [cut[k][c] for c in STATE] for k in whole)


def test_share_scan_equals_the_fold_at_every_end(spark, world):
    counts, catalog, lo, hi, _ = world
    first = int(START.timestamp()) // 3600
    a = (F.unix_seconds("hour") / 3600).cast("long").alias("a")
    own = counts.select("entity_id", a, "n")
    totals = CN.hourly_totals(counts).select(a, F.col("total").alias("t"))
    ends = [first, first + 1, first + 30, first + 500, first + 959]
    got = {(r.entity_id, ends[r.part]): (r.share, r.total) for r in H.share_scan(own, totals, ends).collect()}
    for e in ends[1:]:
        fold = C.share_baselines(counts, catalog, lo, F.timestamp_seconds(F.lit((e - 1) * 3600)))
        for r in fold.collect():
            share, total = got.get((r.entity_id, e), (0.0, 0))
            assert share == pytest.approx(r.expected_share, rel=1e-12, abs=1e-15) and total == r.total


def test_the_replay_is_spread_over_tasks(spark, world, monkeypatch):
    counts, catalog, lo, hi, _ = world
    monkeypatch.setattr(H, "BLOCK", {"hour": 168, "day": 7})
    history = H.slot_history(counts.where("entity_id = 'e0'"), catalog.where("entity_id = 'e0'"), lo, hi)
    used = history.select(F.spark_partition_id().alias("p")).distinct().count()
    assert history.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert used >= 3  # one entity, six blocks


@pytest.mark.parametrize("cuts", [[100, 500, 959], [0, 168, 959]])
def test_a_history_grows_by_batches(spark, world, tmp_path, cuts):
    counts, catalog, lo, hi, _ = world
    store = HistoryStore(spark, str(tmp_path), catalog)
    base = int(START.timestamp())
    for token, c in enumerate(cuts):
        store.extend(counts, base + c * 3600, token)
        store.extend(counts, base + c * 3600, token)  # run again
        assert store.last() == base + c * 3600
    want = score_history(counts, catalog, lo, hi)
    assert sorted(map(str, store.scored().collect())) == sorted(map(str, want.collect()))
    some = store.scored(base + 800 * 3600, base + 810 * 3600).select("hour").distinct().count()
    assert some == 11


def test_late_counts_are_repaired_from_the_first_changed_bucket(spark, world, tmp_path, monkeypatch):
    counts, catalog, lo, hi, rows = world
    monkeypatch.setattr(H, "BLOCK", {"hour": 168, "day": 7})
    import outcry.plans.history as PH
    monkeypatch.setattr(PH, "BLOCK", {"hour": 168, "day": 7})
    store = HistoryStore(spark, str(tmp_path), catalog)
    end = int(START.timestamp()) + 959 * 3600
    store.extend(counts, end, 0)
    blocks = {r.block: r.version for r in store.rows.manifest().collect()}
    hours = [START + dt.timedelta(hours=i) for i in (600, 601, 720)]
    late = [(e, h, n) for e, h, n, *_ in rows if h in hours and e != "e0"] + [("e0", hours[1], 77), ("quiet", hours[2], 5)]
    recount = spark.createDataFrame(late, "entity_id string, hour timestamp, n long")
    hour_rows = spark.createDataFrame([(h,) for h in hours], "hour timestamp")
    first = store.repair(recount, hour_rows, 1)
    assert store.repair(recount, hour_rows, 1) is None
    changed = {(e, h): n for e, h, n in late}
    fixed = [(e, h, n, d, o) for e, h, n, d, o in rows if h not in hours]
    fixed += [(e, h, n, (h.weekday() + 1) % 7, h.hour) for (e, h), n in changed.items()]
    fixed = CN.born(spark.createDataFrame(fixed, COUNTS), catalog)
    want = score_history(fixed, catalog, lo, hi)
    assert sorted(map(str, store.scored().collect())) == sorted(map(str, want.collect()))
    # Blocks before the first changed bucket are neither read nor written.
    assert first >= int(hours[0].timestamp())
    after = {r.block: r.version for r in store.rows.manifest().collect()}
    b0 = first // (168 * 3600)
    assert {b for b in after if after[b] != blocks[b]} == {b for b in blocks if b >= b0}
    assert any(b < b0 for b in blocks)


def test_a_repair_that_changes_nothing_writes_nothing(spark, world, tmp_path):
    counts, catalog, lo, hi, rows = world
    store = HistoryStore(spark, str(tmp_path), catalog)
    store.extend(counts, int(START.timestamp()) + 300 * 3600, 0)
    h = START + dt.timedelta(hours=200)
    same = counts.where(F.col("hour") == F.lit(h))
    assert store.repair(same, spark.createDataFrame([(h,)], "hour timestamp"), 1) is None
    assert store.rows.head() == 0
    future = START + dt.timedelta(hours=301)
    assert store.repair(counts.where(F.col("hour") == F.lit(future)), spark.createDataFrame([(future,)], "hour timestamp"), 1) is None


def test_a_repair_goes_on_after_a_crash_between_its_tables(spark, world, tmp_path):
    counts, catalog, lo, hi, rows = world
    store = HistoryStore(spark, str(tmp_path), catalog)
    store.extend(counts, int(START.timestamp()) + 400 * 3600, 0)
    h = START + dt.timedelta(hours=350)
    new = spark.createDataFrame([("e0", h, 99)], "entity_id string, hour timestamp, n long")
    hours = spark.createDataFrame([(h,)], "hour timestamp")
    store._replace_counts(new, int(h.timestamp()), hours, 1)  # the counts are committed, the history is not
    assert store.rows.head() == 0
    assert store.repair(new, hours, 1) == int(h.timestamp())
    row = store.scored(int(h.timestamp()), int(h.timestamp())).where("entity_id = 'e0'").first()
    assert row.n_signals == 99 and row.total == 99


# ------------------------------------------------------------------ as of
def test_asof_join_takes_the_row_before(spark):
    rnd = random.Random(2)
    at = lambda m: START + dt.timedelta(minutes=m)
    right = [(rnd.choice(["a", "b", None]), at(m), m) for m in rnd.sample(range(60 * 24 * 90), 300)]
    left = [(rnd.choice(["a", "b", "c", None]), at(rnd.randrange(60 * 24 * 100)), i) for i in range(400)] + [("a", None, -1)]
    left += [(k, t, 1000 + v) for k, t, v in right[:30]] + left[:5]
    r = spark.createDataFrame(right, "k string, since timestamp, v long")
    p = spark.createDataFrame(left, "k string, t timestamp, i long")
    for inclusive in (False, True):
        got = J.asof_join(p, r, ["k"], "t", "since", ["v"], seconds=86400, inclusive=inclusive).collect()
        want = []
        for k, t, i in left:
            before = [(s, v) for kk, s, v in right if t is not None and kk == k and (s < t or inclusive and s == t)]
            want.append((k, i, max(before)[1] if before else None))
        assert sorted(((r.k, r.i, r.v) for r in got), key=str) == sorted(want, key=str)


def test_state_as_of_equals_what_the_replay_used(spark, world):
    counts, catalog, lo, hi, _ = world
    history = H.slot_history(counts, catalog, lo, hi).cache()
    probes = history.select("entity_id", "hour", F.lit(1).alias("extra")).where("entity_id <> 'e3'")
    probes = probes.unionByName(probes.limit(3))
    found = J.state_as_of(probes, J.state_intervals(history), J.share_intervals(history))
    assert found.count() == probes.count()
    used = {(r.entity_id, r.hour): r for r in history.collect()}
    for r in found.collect():
        u = used[(r.entity_id, r.hour)]
        assert (r["mean"], r["std"], r.n or 0, r.share or 0.0, r.total or 0) == (u.prev_mean, u.prev_std, u.prev_n, u.prev_share, u.prev_total)
    day = START + dt.timedelta(days=20)
    at = J.valid_at(J.state_intervals(history), F.lit(day)).groupBy("entity_id").count().collect()
    assert {r.entity_id: r["count"] for r in at}["e0"] == 168


# ------------------------------------------------------------------ partition store
def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "p int, q int, k string, v double")


def test_upsert_touches_its_partitions_only(spark, tmp_path):
    store = PartitionStore(spark, str(tmp_path), ["p", "q"], ["k"])
    assert store.read() is None and store.head() is None
    store.write(frame(spark, [(0, 0, "a", 1.0), (0, 1, "a", 2.0), (1, 0, "a", None)]), 0)
    store.upsert(frame(spark, [(0, 1, "a", 5.0), (0, 1, "b", 6.0), (2, 2, "z", 7.0)]), ["p", "q", "k"], 4)
    assert rows_of(store.read()) == [(0, 0, "a", 1.0), (0, 1, "a", 5.0), (0, 1, "b", 6.0), (1, 0, "a", None), (2, 2, "z", 7.0)]
    assert {(r.p, r.q): r.version for r in store.manifest().collect()} == {(0, 0): 0, (0, 1): 4, (1, 0): 0, (2, 2): 4}
    assert rows_of(store.read(head=0)) == [(0, 0, "a", 1.0), (0, 1, "a", 2.0), (1, 0, "a", None)]
    assert rows_of(store.read(F.col("p") == 0).where("q = 1")) == [(0, 1, "a", 5.0), (0, 1, "b", 6.0)]
    assert store.read(F.col("p") == 9).count() == 0
    assert len(store.read((F.col("p") == 0) & (F.col("q") == 0)).inputFiles()) == 1


def test_an_aborted_write_is_not_seen_and_a_repeated_one_changes_nothing(spark, tmp_path):
    store = PartitionStore(spark, str(tmp_path), ["p", "q"])
    store.write(frame(spark, [(0, 0, "a", 1.0)]), 0)
    store.stage(frame(spark, [(0, 0, "a", -1.0), (3, 3, "x", -1.0)]), 1)  # dies before its commit
    assert rows_of(store.read()) == [(0, 0, "a", 1.0)] and store.head() == 0
    new = frame(spark, [(0, 0, "a", 2.0)])
    store.upsert(new, ["p", "q", "k"], 1)
    assert rows_of(store.read()) == [(0, 0, "a", 2.0)]
    store.upsert(frame(spark, [(0, 0, "a", 9.0)]), ["p", "q", "k"], 1)
    store.write(frame(spark, [(0, 0, "a", 9.0)]), 0)
    assert rows_of(store.read()) == [(0, 0, "a", 2.0)] and store.head() == 1
    with pytest.raises(RuntimeError):
        store.commit(store.stage(frame(spark, [(0, 0, "a", 9.0)]), 2).limit(1), 1, new.schema)


def test_pruning_leaves_what_heads_refer_to(spark, tmp_path):
    store = PartitionStore(spark, str(tmp_path), ["p", "q"])
    for t in range(4):
        store.write(frame(spark, [(t % 2, 0, "a", float(t))]), t)
    store.stage(frame(spark, [(0, 0, "a", -1.0)]), 9)
    store.prune(keep=0)
    assert rows_of(store.read()) == [(0, 0, "a", 2.0), (1, 0, "a", 3.0)]
    assert store._numbers("heads") == [3] and store._numbers("data", "version=") == [2, 3]


def test_partitions_can_become_empty(spark, tmp_path):
    store = PartitionStore(spark, str(tmp_path), ["p", "q"])
    store.write(frame(spark, [(0, 0, "a", 1.0), (1, 0, "a", 1.0)]))
    store.write(frame(spark, [(2, 0, "b", 1.0)]), replaced=spark.createDataFrame([(1, 0)], "p int, q int"))
    assert rows_of(store.read()) == [(0, 0, "a", 1.0), (2, 0, "b", 1.0)]


# ------------------------------------------------------------------ sink reads
def test_sink_reads_are_pruned_by_date(spark, tmp_path):
    rows = [(i, START + dt.timedelta(hours=i)) for i in range(24 * 10)]
    write_signals(spark.createDataFrame(rows, "signal_id long, hour timestamp"), str(tmp_path / "s"), "overwrite")
    since, until = [(START + dt.timedelta(hours=h)).replace(tzinfo=None) for h in (70, 100)]
    got = read_signal_sink(spark, str(tmp_path / "s"), since, until)
    assert sorted(r.signal_id for r in got.collect()) == list(range(70, 101))
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "date" in filters and ">=" in filters and "<=" in filters
    assert "GreaterThanOrEqual(hour" in plan
