"""Edge cases: malformed payloads, silent catalog entities, rate-cap ties."""
import datetime as dt

from pyspark.sql import functions as F

from outcry.operators import admission as A
from outcry.plans.status import score_history, status_snapshot
from outcry.sources.signals import parse_payload

UTC = dt.timezone.utc


def test_parse_payload_malformed_and_missing(spark):
    df = spark.createDataFrame([(1, '{"entity": "a"}'), (2, "not json"), (3, "{}"), (4, '{"entity": ""}'),
                                (5, "null"), (6, None)], "id long, body string")
    got = {r.id: (r.entity_id, r.parse_status) for r in parse_payload(df, "body").collect()}
    assert got[1] == ("a", "ok")
    for k in (2, 3, 4, 5, 6):
        assert got[k] == (None, "missing_entity")


def test_silent_catalog_entity_is_scored(spark):
    start = dt.datetime(2024, 1, 1, tzinfo=UTC)
    rows = [("busy", start + dt.timedelta(hours=i), 2, 1, i % 24) for i in range(200)]
    counts = spark.createDataFrame(rows, "entity_id string, hour timestamp, n long, dow int, hod int") \
        .withColumn("dow", (F.dayofweek("hour") - 1).cast("int")).withColumn("hod", F.hour("hour").cast("int"))
    cat = spark.createDataFrame([("busy",), ("silent",)], "entity_id string")
    lo, hi = F.lit(start), F.lit(start + dt.timedelta(hours=199))
    snap = {r.entity_id: r for r in status_snapshot(counts, cat, hi, lo).collect()}
    assert set(snap) == {"busy", "silent"}
    s = snap["silent"]
    assert s.n_signals == 0 and s.current_share == 0.0 and s.expected_share == 0.0
    assert s.tier == "slot" and s.baseline_mean == 0.0 and s.score > 0
    hist = score_history(counts, cat, lo, hi).where("entity_id = 'silent'")
    assert hist.count() == 200 and hist.where(F.isnan("score")).count() == 0


def test_rate_cap_ties_broken_by_id(spark):
    t = dt.datetime(2024, 1, 1, 10, 5, tzinfo=UTC)
    rows = [(i, "e", "u", t) for i in (5, 3, 9, 1)]
    sig = spark.createDataFrame(rows, "signal_id long, entity_id string, actor_key string, ts timestamp")
    kept = sorted(r.signal_id for r in A.rate_cap(sig, k=2).collect())
    assert kept == [1, 3]
    cat = spark.createDataFrame([("e",)], "entity_id string")
    tags = {r.signal_id: r.reason for r in A.admission(sig, cat, k=2).collect()}
    assert tags == {1: "accepted", 3: "accepted", 5: "rate_limited", 9: "rate_limited"}
    rep = {r.reason: r.n for r in A.admission_report(sig, cat, k=2).collect()}
    assert rep == {"accepted": 2, "rate_limited": 2}


def test_null_actors_share_one_quota_in_tags_and_report(spark):
    t = dt.datetime(2024, 1, 1, 10, 5, tzinfo=UTC)
    sig = spark.createDataFrame([(i, "e", None, t) for i in range(4)],
                                "signal_id long, entity_id string, actor_key string, ts timestamp")
    cat = spark.createDataFrame([("e",)], "entity_id string")
    assert A.rate_cap(sig, k=2).count() == 2
    tags = sorted(r.reason for r in A.admission(sig, cat, k=2).collect())
    assert tags == ["accepted"] * 2 + ["rate_limited"] * 2
    assert {r.reason: r.n for r in A.admission_report(sig, cat, k=2).collect()} == {"accepted": 2, "rate_limited": 2}


def test_rank_keeps_rows_of_a_null_group(spark):
    from outcry.operators.ranking import ordered_rank
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "g string, k int")
    got = {(r.g, r.k, r.rank) for r in ordered_rank(df, [F.col("k").asc()], partition_by=["g"]).collect()}
    assert got == {("a", 1, 1), (None, 2, 1), (None, 3, 2)}


def test_names_rank_by_unicode_collation(spark):
    from outcry.operators.ranking import rank_by_name
    rows = [(str(i), n, i) for i, n in enumerate(["zeta", "Éclair", "echo", "Zebra", "eclipse"])]
    df = spark.createDataFrame(rows, "entity_id string, display_name string, sort_order int")
    asc = [r.display_name for r in rank_by_name(df, "asc").orderBy("rank").collect()]
    assert asc == ["echo", "Éclair", "eclipse", "Zebra", "zeta"]


def test_catalog_check_always_reports_its_verdict(spark):
    from outcry.operators.catalog import catalog_check
    cat = spark.createDataFrame([("p.one-2",)], "entity_id string")
    (only,) = catalog_check(spark.createDataFrame([("P-ONE.2",)], "entity_id string"), cat, 40).collect()
    assert (only.kind, only.entity_id, only.catalog_rows, only.meets_min, only.missing_rows) == ("summary", None, 1, False, 0)
    got = catalog_check(spark.createDataFrame([("x",), ("x",), ("p.one-2",)], "entity_id string"), cat, 1).collect()
    assert {(r.kind, r.entity_id, r.meets_min, r.missing_rows) for r in got} == {("summary", None, True, 1), ("missing", "x", True, 1)}


def test_entity_born_late_is_observed_from_its_bucket_on(spark):
    from outcry.operators import baselines as C
    from outcry.operators import counts as CN
    start = dt.datetime(2024, 1, 1, tzinfo=UTC)
    late = start + dt.timedelta(days=20, minutes=30)
    counts = spark.createDataFrame([("old", start, 3, 1, 0), ("new", late.replace(minute=0), 2, 0, 0), ("new", start, 9, 1, 0)],
                                   "entity_id string, hour timestamp, n long, dow int, hod int")
    cat = spark.createDataFrame([("old", None), ("new", late)], "entity_id string, valid_from timestamp")
    lo, hi = F.lit(start), F.lit(start + dt.timedelta(hours=21 * 24 - 1))
    counts = CN.born(counts, cat)
    n = {r.entity_id: r.n for r in C.slot_baselines(counts, cat, lo, hi).groupBy("entity_id").agg(F.sum("n").alias("n")).collect()}
    assert n == {"old": 504, "new": 24}
    spine = CN.dense_spine(counts, cat, lo, hi)
    assert {r.entity_id: (r.c, r.s) for r in spine.groupBy("entity_id").agg(
        F.count("*").alias("c"), F.sum("n").alias("s")).collect()} == {"old": (504, 3), "new": (24, 2)}
    assert score_history(counts, cat, lo, hi).where("entity_id = 'new'").count() == 24
    early = status_snapshot(counts, cat, F.lit(start + dt.timedelta(days=10)), lo)
    assert [r.entity_id for r in early.collect()] == ["old"]


def test_recent_reads_push_the_time_range_into_the_scan(spark):
    from conftest import SF001
    from outcry.plans.queries import RecentCtx
    x = RecentCtx(spark, SF001, 24)
    plan = x.counts._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in plan and "LessThan(ts," in plan


def test_cluster_session_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    import pytest
    from outcry.session import checkpoint_dir
    conf = SimpleNamespace(get=lambda *a: None)
    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None, getConf=lambda: conf)
    with pytest.raises(ValueError, match="checkpoint.dir"):
        checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=conf))


def test_release_scratch_removes_this_applications_tables(spark):
    from outcry.session import materialize, release_scratch, scratch_path
    path = scratch_path(spark, "probe")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    release_scratch(spark)
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path)
    assert materialize(spark.range(2), "again").count() == 2
