"""Stream = batch parity over several micro-batches (events split into
time-ordered files, one file per trigger), cross-batch rate-cap quota,
bucket close state and idempotent micro-batch replay."""
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from outcry import bindings as B
from outcry.operators import admission as A
from outcry.operators import baselines as C
from outcry.plans import queries as Q
from outcry.sources.signals import stream_signals, table
from outcry.streaming import jobs as G

SLICES = 4


@pytest.fixture(scope="module")
def sliced(spark):
    """A folder with the sf0.01 events in SLICES time-ordered Parquet files."""
    root = tempfile.mkdtemp(prefix="outcry-stream-src-")
    ev = table(spark, SF01, "events")
    bounds = ev.agg(F.unix_seconds(F.min(F.col("ts").cast("timestamp"))).alias("lo"),
                    F.unix_seconds(F.max(F.col("ts").cast("timestamp"))).alias("hi")).first()
    step = (bounds.hi - bounds.lo) // SLICES + 1
    for i in range(SLICES):
        part = ev.where((F.unix_seconds(F.col("ts").cast("timestamp")) >= bounds.lo + i * step)
                        & (F.unix_seconds(F.col("ts").cast("timestamp")) < bounds.lo + (i + 1) * step))
        part.coalesce(1).write.mode("overwrite").parquet(f"{root}/tmp{i}")
        f = [p for p in __import__("os").listdir(f"{root}/tmp{i}") if p.endswith(".parquet")][0]
        __import__("os").rename(f"{root}/tmp{i}/{f}", f"{root}/slice-{i}.parquet")
        time.sleep(1.1)  # file source orders files by modification time
    return root, table(spark, SF01, "events").schema


def _stream(spark, sliced):
    root, schema = sliced
    return stream_signals(spark, root, schema, signal_id="event_id", entity="event_type",
                          actor="user_id", ts="ts", max_files_per_trigger=1, glob="slice-*.parquet")


def test_rate_cap_across_batches(spark, sliced):
    out = tempfile.mkdtemp(prefix="outcry-g3-")
    capper = G.RateCapper(spark, f"{out}/state", f"{out}/sink", k=1)
    G.run_available_now(_stream(spark, sliced), f"{out}/ckpt", foreach_batch=capper)
    got = spark.read.parquet(f"{out}/sink")
    assert got.select("batch").distinct().count() == SLICES
    expected = A.rate_cap(B.ev_signals(spark, SF01), k=1)
    a = sorted(r.signal_id for r in got.select("signal_id").collect())
    b = sorted(r.signal_id for r in expected.select("signal_id").collect())
    assert a == b


def test_closed_counts_and_state_match_batch(spark, sliced):
    out = tempfile.mkdtemp(prefix="outcry-g4-")
    cat = B.ev_catalog(spark, SF01)
    sdf = G.stream_hourly_counts(G.stream_dedup(_stream(spark, sliced), cat))
    closer = G.BucketCloser(spark, cat, f"{out}/state")
    G.run_available_now(sdf, f"{out}/ckpt", foreach_batch=closer)
    x = Q.Ctx(spark, SF01)
    closed_hi = F.timestamp_seconds(F.unix_seconds(x.hi) - F.lit(3 * 3600))
    batch = C.slot_baselines(x.counts, x.catalog, x.lo, closed_hi)
    base, shares = G.closed_state(spark, f"{out}/state")
    key = ["entity_id", "dow", "hod", "mean", "std", "n"]
    assert sorted(tuple(r) for r in base.select(*key).collect()) == \
        sorted(tuple(r) for r in batch.select(*key).collect())
    bs = C.share_baselines(x.counts, x.catalog, x.lo, closed_hi)
    assert sorted(tuple(r) for r in shares.select("entity_id", "expected_share", "total").collect()) == \
        sorted(tuple(r) for r in bs.select("entity_id", "expected_share", "total").collect())
    # the state was built over several micro-batches
    versions = spark.read.parquet(f"{out}/state/baselines").select("version").distinct().count()
    assert versions >= 2

    # replaying the last micro-batch (same id, same rows) rewrites the same state
    closed = spark.read.parquet(f"{out}/state/closed_counts")
    last_v = closed.agg(F.max("version")).first()[0]
    replay = closed.where(F.col("version") == last_v).drop("version")
    before = sorted(tuple(r) for r in base.select(*key).collect())
    closer(replay, last_v)
    again, _ = G.closed_state(spark, f"{out}/state")
    assert sorted(tuple(r) for r in again.select(*key).collect()) == before


def test_late_rows_are_dropped_from_closed_counts(spark, tmp_path):
    """Rows older than the watermark are not counted.  With chained
    stateful operators Spark filters late rows against the watermark of the
    previous micro-batch, so the late file arrives two batches after the data
    that moved the watermark."""
    import datetime as dt
    import os
    src = tmp_path / "src"
    base = dt.datetime(2024, 1, 1, 0, 10)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    files = {
        "a": [(i, base + dt.timedelta(hours=i), 1, "click", 0.0, "{}") for i in range(10)],
        "b": [(50, base + dt.timedelta(hours=9), 3, "click", 0.0, "{}")],
        "c": [(100, base + dt.timedelta(hours=1), 2, "click", 0.0, "{}")],  # hour 1: long closed
    }
    for name, rows in files.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / name))
        f = [p for p in os.listdir(src / name) if p.endswith(".parquet")][0]
        os.rename(src / name / f, src / f"{name}.parquet")
        time.sleep(1.1)
    st = stream_signals(spark, str(src), spark.createDataFrame([], schema).schema, signal_id="event_id",
                        entity="event_type", actor="user_id", ts="ts", max_files_per_trigger=1,
                        glob="*.parquet")
    out = tmp_path / "out"
    G.run_available_now(G.stream_hourly_counts(G.stream_dedup(st)), str(tmp_path / "ckpt"), path=str(out))
    got = {r.hour.hour: r.n for r in spark.read.parquet(str(out)).collect()}
    assert got.get(1) == 1          # the late second actor was not counted
    assert max(got) == 6            # hours 7..9 are still open (2 h watermark + 1 h bucket)


def test_prune_keeps_version_needed_for_replay(spark, tmp_path):
    t = G.VersionedTable(spark, str(tmp_path / "t"))
    df = spark.createDataFrame([(1,)], "x int")
    for v in (0, 5, 9):
        t.write(df.withColumn("x", F.lit(v)), v)
        t.prune(v)
    # a replay of batch 9 must still find version 5
    assert t.latest(before=9).first().x == 5
    assert t.latest().first().x == 9
    versions = sorted(r.version for r in spark.read.parquet(str(tmp_path / "t")).select("version").distinct().collect())
    assert versions == [5, 9]


def test_stream_signal_sink_keeps_every_row(spark, sliced, tmp_path):
    G.stream_signal_sink(_stream(spark, sliced), str(tmp_path / "sink"), str(tmp_path / "ckpt"))
    back = spark.read.parquet(str(tmp_path / "sink"))
    assert back.count() == 10000
    assert back.select("date").distinct().count() == 30


def _attempts(spark, rows):
    return spark.createDataFrame(rows, "signal_id long, entity_id string, actor_key string, ts timestamp")


def test_late_attempts_get_no_forgotten_quota(spark, tmp_path):
    """k = 1: id 3 comes for hour 10 after hour 15 was seen; it is late, not accepted."""
    import datetime as dt
    h = lambda n: dt.datetime(2024, 1, 1, n, 5, tzinfo=dt.timezone.utc)
    capper = G.RateCapper(spark, str(tmp_path / "state"), str(tmp_path / "sink"), k=1)
    for k, row in enumerate([(1, "e", "a", h(10)), (2, "e", "a", h(15)), (3, "e", "a", h(10)), (4, "e", None, h(15)), (5, "e", None, h(14))]):
        capper(_attempts(spark, [row]), k)
    capper(_attempts(spark, [(6, "e", None, h(15)), (7, "e", "a", h(15))]), 5)
    ids = lambda df: sorted(r.signal_id for r in df.collect())
    assert ids(spark.read.parquet(str(tmp_path / "sink"))) == [1, 2, 4, 5]
    assert ids(G.late_attempts(spark, str(tmp_path / "state"))) == [3]
    capper(_attempts(spark, [(6, "e", None, h(15)), (7, "e", "a", h(15))]), 5)  # replay
    assert ids(spark.read.parquet(str(tmp_path / "sink"))) == [1, 2, 4, 5]


class _Counting:
    """A batch frame that counts how often its rows are evaluated."""

    def __init__(self, spark, rows, schema):
        self.seen = spark.sparkContext.accumulator(0)
        seen = self.seen

        def run(frames):
            for f in frames:
                seen.add(len(f))
                yield f
        self.df = spark.createDataFrame(rows, schema).coalesce(1).mapInPandas(run, schema)


def test_a_micro_batch_is_evaluated_once(spark, tmp_path):
    import datetime as dt
    h = dt.datetime(2024, 1, 1, 10, tzinfo=dt.timezone.utc)
    cat = spark.createDataFrame([("e",)], "entity_id string")
    batch = _Counting(spark, [("e", h, 3)], "entity_id string, hour timestamp, n long")
    G.BucketCloser(spark, cat, str(tmp_path / "s"))(batch.df, 0)
    assert batch.seen.value == 1
    live = _Counting(spark, [("e", h + dt.timedelta(hours=1), 2)], "entity_id string, hour timestamp, n long")
    status = G.LiveStatus(spark, cat, str(tmp_path / "s"), str(tmp_path / "out"))
    status(live.df, 0)
    assert live.seen.value == 1
    before = G.VersionedTable(spark, str(tmp_path / "out")).latest().collect()
    # More buckets are closed, then batch 0 is replayed: its status stays.
    G.BucketCloser(spark, cat, str(tmp_path / "s"))(
        spark.createDataFrame([("e", h + dt.timedelta(hours=1), 7)], "entity_id string, hour timestamp, n long"), 1)
    status(live.df, 0)
    assert G.VersionedTable(spark, str(tmp_path / "out")).latest().collect() == before
    capped = _Counting(spark, [(1, "e", "a", h)], "signal_id long, entity_id string, actor_key string, ts timestamp")
    G.RateCapper(spark, str(tmp_path / "c"), str(tmp_path / "sink"))(capped.df, 0)
    assert capped.seen.value == 1


def test_counts_behind_the_closed_buckets_are_kept_apart(spark, tmp_path):
    import datetime as dt
    h = dt.datetime(2024, 1, 1, 10, tzinfo=dt.timezone.utc)
    frame = lambda *rows: spark.createDataFrame(list(rows), "entity_id string, hour timestamp, n long")
    cat = spark.createDataFrame([("e",)], "entity_id string")
    closer = G.BucketCloser(spark, cat, str(tmp_path / "s"))
    for k in range(4):
        closer(frame(("e", h + dt.timedelta(hours=k), k + 1)), k)
    before, _ = G.closed_state(spark, str(tmp_path / "s"))
    before = sorted(map(tuple, before.collect()))
    closer(frame(("e", h, 50)), 4)
    after, _ = G.closed_state(spark, str(tmp_path / "s"))
    assert sorted(map(tuple, after.collect())) == before
    assert [r.n for r in spark.read.parquet(str(tmp_path / "s" / "late_counts")).collect()] == [50]
    closed = spark.read.parquet(str(tmp_path / "s" / "closed_counts"))
    assert closed.count() == 4  # the whole history


# ------------------------------------------------------------------ A8, A9 and late repair on the stream
def _hour(n, minute=5):
    import datetime as dt
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=n, minutes=minute)


def _random_batches(rnd, n=400, batches=5):
    rows = []
    for i in range(n):
        late = rnd.random() < .05
        at = i * 40 // n if not late else max(0, i * 40 // n - rnd.randint(5, 9))
        rows.append((i, rnd.choice(["e", "f", "stranger", "", None]), rnd.choice(["a", "b", None]), _hour(at, rnd.randint(0, 59))))
    size = n // batches
    return [rows[k * size:(k + 1) * size] for k in range(batches)]


def test_stream_rejects_equal_the_batch_report_over_closed_hours(spark, tmp_path):
    import random
    from outcry.operators.admission import admission_report
    cat = spark.createDataFrame([("e",), ("f",)], "entity_id string")
    capper = G.RateCapper(spark, str(tmp_path / "cap"), str(tmp_path / "sink"), k=2)
    report = G.AdmissionReport(spark, cat, capper, str(tmp_path / "state"), str(tmp_path / "out"))
    batches = _random_batches(random.Random(3))
    ontime, late, newest = [], [], None
    for k, rows in enumerate(batches):
        report(_attempts(spark, rows), k)
        if k in (0, 3):
            report(_attempts(spark, rows), k)  # replayed
        floor = None if newest is None else newest - 2 * 3600
        hour = lambda r: int(r[3].timestamp()) // 3600 * 3600
        for r in rows:
            (late if floor is not None and hour(r) < floor else ontime).append(r)
        newest = max([hour(r) for r in rows if r[1] in ("e", "f")] + ([newest] if newest is not None else []))
    got = {(r.reason, r.hour): r.n for r in G.admission_counts(spark, str(tmp_path / "out")).collect()}
    want = {}
    for r in admission_report(_attempts(spark, ontime), cat, k=2).where(F.unix_seconds("hour") < newest - 2 * 3600).collect():
        want[(r.reason, r.hour)] = r.n
    for r in _attempts(spark, late).groupBy(F.date_trunc("hour", "ts").alias("hour")).count().collect():
        want[("late", r.hour)] = r["count"]
    assert late and got == want


def test_signal_table_equals_the_batch_dedup(spark, tmp_path):
    import random
    from outcry.operators.admission import dedup_signals
    batches = [[r for r in b if r[1]] for b in _random_batches(random.Random(5))]
    table = G.SignalTable(spark, str(tmp_path / "t"))
    assert table.read() is None
    for k, rows in enumerate(batches):
        table(_attempts(spark, rows), k)
        table(_attempts(spark, rows), k)  # a batch that is replayed after its commit
        before = table.store.head()
        table(_attempts(spark, rows[:0]), k + 100)  # an empty batch writes nothing
        assert table.store.head() == before == k
    want = dedup_signals(_attempts(spark, [r for b in batches for r in b]))
    columns = ["signal_id", "actor_key", "entity_id", "hour", "created_at", "dow", "hod"]
    key = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert key(table.read()) == key(want)
    days = {r.day: r.version for r in table.store.manifest().collect()}
    assert len(days) == 2 and days[min(days)] < days[max(days)]  # closed days are left alone


def test_recount_reads_the_days_of_late_hours(spark, tmp_path):
    from outcry.sources.signals import write_signals
    rows = [(i, "e", f"a{i % 7}", _hour(i // 4, i % 60)) for i in range(4 * 96)]
    raw = _attempts(spark, rows).withColumn("hour", F.date_trunc("hour", "ts"))
    write_signals(raw, str(tmp_path / "raw"), "overwrite")
    late = raw.where("signal_id in (30, 31, 200)")
    counts, hours = G.recount(spark, str(tmp_path / "raw"), late, None, 1)
    assert {(r.hour.day, r.hour.hour) for r in hours.collect()} == {(1, 7), (3, 2)}
    assert {(r.hour.day, r.hour.hour): r.n for r in counts.collect()} == {(1, 7): 4, (3, 2): 4}
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "date" in plan.split("PartitionFilters: [")[1].split("]")[0]
