"""Structured Streaming: dedup (G2), closed-bucket counts (G1), rate cap (G3),
bucket close -> baseline/share update (G4), live status (G5), late policy (G6).

Event time = arrival time.  The watermark (default 2 hours, G6) bounds the
state of the dedup and the windowed count; rows later than the watermark are
dropped from the stream aggregates (they stay in the raw signal sink for batch
replay).  With chained stateful operators Spark checks lateness against the
previous micro-batch's watermark, so the cut-off lags by one batch.

Stateful updates that have no built-in streaming operator (rate-cap quota,
baseline folds, live status) run in ``foreachBatch`` against versioned Parquet
tables under a state root in the shared checkpoint folder.  Every write is
keyed by the micro-batch id (dynamic partition overwrite of ``version=id``)
and reads only versions < id, so a replayed micro-batch after a failure
rewrites exactly the same output: exactly-once end to end.  Each micro-batch is
persisted once and reused by all its writes.

The chain is source -> RateCapper (G3) -> capped_stream -> stream_dedup (G2) ->
stream_hourly_counts (G1) -> BucketCloser (G4) / LiveStatus (G5): the cap comes
before the dedup, as in the batch path.  AdmissionReport (A8) stands around the
RateCapper and counts why attempts were rejected; SignalTable (A9) keeps the
accepted signals with refreshed created_at.  Late attempts are taken up by
``recount`` and ``plans.history.HistoryStore.repair``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outcry import constants as K
from outcry.functions.time import BUCKETS, bucket_start, dow, hod, slot_index
from outcry.operators.admission import dedup_signals, tag_known
from outcry.operators.baselines import share_baselines, slot_baselines
from outcry.operators.counts import born
from outcry.plans.status import signal_counts, status_from_state
from outcry.sources.versions import PartitionStore

DEFAULT_WATERMARK = "2 hours"
WATERMARK_BUCKETS = 2


# ------------------------------------------------------------------ G2 / G1
def stream_dedup(stream: DataFrame, catalog: DataFrame | None = None,
                 watermark: str = DEFAULT_WATERMARK, bucket: str = "hour") -> DataFrame:
    """Known entities only (stream-static semi join), one row per
    (actor, entity, bucket) — the first arrival.  State is evicted once the
    bucket is older than the watermark."""
    s = stream.withColumn("hour", bucket_start("ts", bucket))
    if catalog is not None:
        s = s.join(catalog.select("entity_id"), "entity_id", "left_semi")
    return (s.withWatermark("hour", watermark)
             .dropDuplicates(["actor_key", "entity_id", "hour"]))


def stream_hourly_counts(deduped: DataFrame, bucket: str = "hour") -> DataFrame:
    """G1: signals per (entity, bucket), emitted once the bucket is closed by
    the watermark (append mode)."""
    secs, _ = BUCKETS[bucket]
    return (deduped.groupBy(F.window("hour", f"{secs} seconds").alias("w"), "entity_id")
                   .agg(F.count(F.lit(1)).alias("n"))
                   .select("entity_id", F.col("w.start").alias("hour"), F.col("n").cast("long")))


def run_available_now(sdf: DataFrame, checkpoint: str, mode: str = "append",
                      path: str | None = None, foreach_batch=None, fmt: str = "parquet") -> None:
    """Run a streaming query over everything available, then stop."""
    w = sdf.writeStream.outputMode(mode).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True)
    if foreach_batch is not None:
        q = w.foreachBatch(foreach_batch).start()
    else:
        q = w.format(fmt).option("path", path).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def stream_signal_sink(stream: DataFrame, path: str, checkpoint: str, bucket: str = "hour",
                       available_now: bool = True):
    """A10 for streams: every arriving signal (late ones included, so batch
    replay can recount them) appended to Parquet partitioned by UTC date; the
    file sink's checkpoint makes it exactly-once."""
    out = (stream.withColumn("hour", bucket_start("ts", bucket))
                 .withColumn("date", F.to_date("hour")))
    w = (out.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).partitionBy("date").outputMode("append"))
    if available_now:
        q = w.trigger(availableNow=True).start()
        q.awaitTermination()
        return q
    return w.start()


# ------------------------------------------------------------------ versioned tables
class VersionedTable:
    """A Parquet table partitioned by ``version`` (micro-batch id)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        path, fs = self._fs()
        return fs.exists(path)

    def has(self, version: int) -> bool:
        path, fs = self._fs()
        return fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, f"version={version}"))

    def latest(self, before: int | None = None) -> DataFrame | None:
        """The newest version strictly below ``before`` (None: any)."""
        if not self.exists():
            return None
        df = self.spark.read.parquet(self.root)
        if before is not None:
            df = df.where(F.col("version") < F.lit(before))
        v = df.agg(F.max("version")).first()[0]
        if v is None:
            return None
        return df.where(F.col("version") == F.lit(v)).drop("version")

    def write(self, df: DataFrame, version: int) -> None:
        (df.withColumn("version", F.lit(version).cast("long"))
           .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy("version").parquet(self.root))

    def prune(self, current: int) -> None:
        """Delete versions that no replay can need: everything older than the
        newest version below ``current`` (a replay of ``current`` reads exactly
        that one).  Versions exist only for batches that wrote, so ids have gaps."""
        path, fs = self._fs()
        if not fs.exists(path):
            return
        found = []
        for st in fs.listStatus(path):
            name = st.getPath().getName()
            if name.startswith("version="):
                try:
                    found.append((int(name.split("=", 1)[1]), st.getPath()))
                except ValueError:
                    continue
        older = [v for v, _ in found if v < current]
        if not older:
            return
        keep_from = max(older)
        for v, p in found:
            if v < keep_from:
                fs.delete(p, True)


# ------------------------------------------------------------------ G3, G6
class RateCapper:
    """At most ``k`` accepted attempts per (actor, bucket) across
    micro-batches.

    Used quota per (actor, bucket) is a versioned table, kept as long as a
    bucket can still take attempts: down to the watermark, the newest bucket of
    the earlier batches minus ``watermark`` buckets.  Attempts behind it are
    not accepted with a forgotten quota; they go to the ``late`` sink with
    their bucket (G6), from where a batch recount can take them up.

    The batch is ranked and cut to ``k`` per (actor, bucket) before it meets
    the stored quota: Spark plans a partial ``WindowGroupLimit`` below the
    exchange, so a hot actor ships at most k rows per map partition.
    """

    def __init__(self, spark: SparkSession, state_root: str, sink: str, k: int = K.RATE_CAP,
                 bucket: str = "hour", watermark: int = WATERMARK_BUCKETS):
        self.k, self.bucket, self.sink, self.watermark = k, bucket, sink, watermark
        self.late = f"{state_root}/late"
        self.used = VersionedTable(spark, f"{state_root}/rate_used")
        self.seen = VersionedTable(spark, f"{state_root}/newest")

    def newest(self, before: int) -> int | None:
        """The newest bucket (unix seconds) of the batches before one."""
        seen = self.seen.latest(before=before)
        return None if seen is None else seen.first()["newest"]

    def floor(self, batch_id: int) -> int | None:
        """The first bucket that still takes attempts in a batch."""
        newest = self.newest(batch_id)
        return None if newest is None else newest - self.watermark * BUCKETS[self.bucket][0]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, (secs, _) = batch.sparkSession, BUCKETS[self.bucket]
        b = batch.withColumn("hour", bucket_start("ts", self.bucket)).persist()
        newest = self.newest(batch_id)
        floor = None if newest is None else newest - self.watermark * secs
        behind = F.lit(False) if floor is None else F.unix_seconds("hour") < F.lit(floor)
        _write_batch(b.where(behind), self.late, batch_id)
        w = Window.partitionBy("actor_key", "hour").orderBy("ts", "signal_id")
        first = (b.where(~behind).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.lit(self.k)))
        prior = self.used.latest(before=batch_id)
        if prior is None:
            prior = spark.createDataFrame([], "actor_key string, hour timestamp, used long")
        quota = prior.select(F.col("actor_key").alias("_actor"), F.col("hour").alias("_hour"), "used")
        acc = (first.join(quota, F.col("actor_key").eqNullSafe(F.col("_actor")) & (F.col("hour") == F.col("_hour")), "left")
               .where(F.col("_rn") + F.coalesce("used", F.lit(0)) <= F.lit(self.k)).select(*b.columns).persist())
        _write_batch(acc, self.sink, batch_id)
        merged = (prior.unionByName(acc.groupBy("actor_key", "hour").agg(F.count(F.lit(1)).alias("used")))
                       .groupBy("actor_key", "hour").agg(F.sum("used").cast("long").alias("used")))
        top = b.agg(F.unix_seconds(F.max("hour"))).first()[0]
        top = max((t for t in (top, newest) if t is not None), default=None)
        if top is not None:
            merged = merged.where(F.unix_seconds("hour") >= F.lit(top - self.watermark * secs))
            self.seen.write(spark.sql("SELECT CAST(:t AS BIGINT) AS newest", args={"t": top}), batch_id)
        self.used.write(merged, batch_id)
        for t in (self.used, self.seen):
            t.prune(batch_id)
        acc.unpersist()
        b.unpersist()


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    (df.withColumn("batch", F.lit(batch_id).cast("long"))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path))


def _batch_of(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """What ``_write_batch`` wrote for one batch (nothing, if it was empty)."""
    rows = spark.read.schema(f"{_SIGNAL}, batch long").parquet(path)
    return rows.where(F.col("batch") == F.lit(batch_id))


_SIGNAL = "signal_id long, entity_id string, actor_key string, ts timestamp, hour timestamp"


def late_attempts(spark: SparkSession, state_root: str) -> DataFrame:
    """Attempts (signal_id, entity_id, actor_key, ts, hour) that came behind
    the watermark of a ``RateCapper``."""
    return spark.read.schema(_SIGNAL).parquet(f"{state_root}/late")


def recount(spark: SparkSession, raw: str, late: DataFrame, catalog: DataFrame | None, k: int = K.RATE_CAP,
            bucket: str = "hour") -> tuple[DataFrame, DataFrame]:
    """(counts, hours) of the buckets of ``late`` attempts, counted anew from
    the raw sink (``stream_signal_sink``, which holds on-time and late signals):
    cap, dedup and count as in batch.  Only the days of these buckets are read."""
    hours = late.select("hour").distinct()
    days = [r[0] for r in hours.select(F.to_date("hour")).distinct().collect()]
    signals = (spark.read.parquet(raw).where(F.col("date").isin(days)).drop("date")
               .join(hours, "hour", "left_semi").select("signal_id", "entity_id", "actor_key", "ts", "hour"))
    return signal_counts(signals, catalog, k, bucket).select("entity_id", "hour", "n"), hours


# ------------------------------------------------------------------ A8
class AdmissionReport:
    """A8 on the stream: attempts per (reason, bucket), reasons missing_entity,
    unknown_entity, rate_limited, accepted and, for attempts behind the
    watermark of ``capper``, late.

    Takes the raw attempts, hands those on known entities to ``capper`` and
    counts what became of them.  Open buckets are state (a few rows per bucket,
    versioned by micro-batch); a bucket behind the watermark is closed: its rows
    move to ``out`` under the batch that closed it.  Late attempts are reported
    with the batch that brought them.  A replayed batch rewrites the same rows.
    """

    def __init__(self, spark: SparkSession, catalog: DataFrame, capper: RateCapper, state_root: str, out: str):
        self.catalog, self.capper, self.out = catalog, capper, out
        self.open = VersionedTable(spark, f"{state_root}/open_rejects")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        capper = self.capper
        b = tag_known(batch.withColumn("hour", bucket_start("ts", capper.bucket)), self.catalog).persist()
        floor = capper.floor(batch_id)
        capper(b.where("_ok").select("signal_id", "entity_id", "actor_key", "ts"), batch_id)
        behind = F.lit(False) if floor is None else F.unix_seconds("hour") < F.lit(floor)
        reason = (F.when(behind, F.lit("late")).when(F.col("_missing"), F.lit("missing_entity"))
                   .when(~F.col("_ok"), F.lit("unknown_entity")).otherwise(F.lit("rate_limited")))
        tried = b.groupBy(reason.alias("reason"), "hour").agg(F.count(F.lit(1)).cast("long").alias("n"))
        # Every accepted attempt was counted as rate limited above.
        accepted = _batch_of(batch.sparkSession, capper.sink, batch_id).groupBy("hour").agg(F.count(F.lit(1)).cast("long").alias("n"))
        signs = accepted.select(F.explode(F.array(F.struct(F.lit("accepted").alias("reason"), F.col("n").alias("n")),
                                                  F.struct(F.lit("rate_limited").alias("reason"), (-F.col("n")).alias("n")))).alias("r"), "hour")
        now = tried.select("reason", "hour", "n").unionByName(signs.select("r.reason", "hour", "r.n"))
        prior = self.open.latest(before=batch_id)
        merged = now if prior is None else prior.unionByName(now)
        merged = merged.groupBy("reason", "hour").agg(F.sum("n").cast("long").alias("n")).where("n > 0").persist()
        newest = capper.newest(batch_id + 1)
        open_from = 0 if newest is None else newest - capper.watermark * BUCKETS[capper.bucket][0]
        closed = (F.unix_seconds("hour") < F.lit(open_from)) | (F.col("reason") == F.lit("late"))
        _write_batch(merged.where(closed), self.out, batch_id)
        self.open.write(merged.where(~closed), batch_id)
        self.open.prune(batch_id)
        merged.unpersist()
        b.unpersist()


def admission_counts(spark: SparkSession, out: str) -> DataFrame:
    """(reason, hour, n) of the closed buckets and late attempts of an
    ``AdmissionReport``."""
    rows = spark.read.schema("reason string, hour timestamp, n long").parquet(out)
    return rows.groupBy("reason", "hour").agg(F.sum("n").cast("long").alias("n"))


# ------------------------------------------------------------------ A9
class SignalTable:
    """A9 on the stream with refreshed created_at: one row per (actor, entity,
    bucket) with the first arrival's id and the latest arrival's time, merged
    micro-batch by micro-batch.

    The table is partitioned by day and committed by a pointer
    (``sources.versions``): a batch reads and rewrites only the days of its
    signals, a batch that is replayed after its commit changes nothing, and
    readers never see half a batch.  Days behind the watermark get no more
    signals from a ``RateCapper``, so their partitions are final."""

    KEYS = ["actor_key", "entity_id", "hour"]

    def __init__(self, spark: SparkSession, root: str, bucket: str = "hour"):
        self.bucket = bucket
        self.store = PartitionStore(spark, root, ["day"])

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        new = dedup_signals(batch, self.bucket).select("signal_id", *self.KEYS, "created_at")
        new = new.withColumn("day", F.floor(F.unix_seconds("hour") / F.lit(86400)).cast("int")).persist()
        days = [r["day"] for r in new.select("day").distinct().collect()]
        if days:
            old = self.store.read(F.col("day").isin(days))
            merged = new if old is None else (
                old.unionByName(new).groupBy(*self.KEYS, "day")
                .agg(F.min("signal_id").alias("signal_id"), F.max("created_at").alias("created_at")).select(*new.columns))
            self.store.write(merged, batch_id)
            self.store.prune()
        new.unpersist()

    def read(self) -> DataFrame | None:
        """The signals so far, with weekday and hour of day."""
        rows = self.store.read()
        return None if rows is None else rows.drop("day").withColumn("dow", dow("hour")).withColumn("hod", hod("hour", self.bucket))


def capped_stream(spark: SparkSession, sink: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The signals a ``RateCapper`` accepted, as a stream: the input of
    ``stream_dedup`` (cap before dedup, as in the batch path)."""
    reader = spark.readStream.schema(_SIGNAL)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(sink).select("signal_id", "entity_id", "actor_key", "ts")


# ------------------------------------------------------------------ G4
class SlotStore:
    """Slot baselines partitioned by ``slot`` (position in the weekly cycle)
    and ``version`` (micro-batch id).  A closed bucket touches exactly one slot
    per entity, so a batch reads and rewrites only the slot partitions of its
    buckets (partition pruning + dynamic partition overwrite) instead of the
    whole state; the current state of a slot is its newest version."""

    def __init__(self, spark: SparkSession, root: str, bucket: str = "hour"):
        self.spark, self.root, self.bucket = spark, root.rstrip("/"), bucket
        self._versions = VersionedTable(spark, self.root)

    def current(self, before: int | None = None, slots: list[int] | None = None) -> DataFrame | None:
        if not self._versions.exists():
            return None
        df = self.spark.read.parquet(self.root)
        if slots is not None:
            df = df.where(F.col("slot").isin(slots))
        if before is not None:
            df = df.where(F.col("version") < F.lit(before))
        newest = df.groupBy("slot").agg(F.max("version").alias("version"))  # <= one row per slot
        return df.join(newest, ["slot", "version"], "left_semi").drop("slot", "version")

    def write(self, df: DataFrame, version: int) -> None:
        s = slot_index("dow", "hod", self.bucket)
        (df.withColumn("slot", s.cast("int")).withColumn("version", F.lit(version).cast("long"))
           .repartition("slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy("slot", "version").parquet(self.root))

    def prune(self, current: int) -> None:
        path, fs = self._versions._fs()
        if not fs.exists(path):
            return
        for st in fs.listStatus(path):
            if st.getPath().getName().startswith("slot="):
                VersionedTable(self.spark, st.getPath().toString()).prune(current)


def _touched_slots(lo_s: int, hi_s: int, bucket: str) -> list[int]:
    """Slot positions of the buckets lo_s..hi_s (unix seconds), at most one cycle."""
    import datetime as _dt
    secs, period = BUCKETS[bucket]
    out = set()
    for k in range(min((hi_s - lo_s) // secs + 1, period)):
        t = _dt.datetime.fromtimestamp(lo_s + k * secs, _dt.timezone.utc)
        d = (t.weekday() + 1) % 7
        out.add(d * 24 + t.hour if bucket == "hour" else d)
    return sorted(out)


class BucketCloser:
    """Fold each newly closed bucket onto the stored slot baselines and
    shares.  Input rows: closed (entity_id, hour, n) from G1.

    The fold range is (last closed bucket, newest closed bucket in the batch]:
    buckets without any signal are replayed as zeros (the reference's hourly
    job skips missed hours; here they are caught up), and a bucket already
    folded is never folded again, so re-runs are no-ops.  Only the slot
    partitions of the range are read and rewritten.
    """

    def __init__(self, spark: SparkSession, catalog: DataFrame, state_root: str,
                 bucket: str = "hour"):
        self.catalog, self.bucket = catalog, bucket
        self.slots = SlotStore(spark, f"{state_root}/baselines", bucket)
        self.shares = VersionedTable(spark, f"{state_root}/shares")
        self.closed = VersionedTable(spark, f"{state_root}/closed_counts")  # history: never pruned
        self.late = f"{state_root}/late_counts"

    def __call__(self, batch: DataFrame, batch_id: int, until: int | None = None) -> None:
        """``until`` (unix seconds of a bucket) closes silent buckets up to it,
        for callers that know time has passed."""
        batch = batch.select("entity_id", "hour", F.col("n").cast("long").alias("n")).persist()
        try:
            self._close(batch, batch_id, until)
        finally:
            batch.unpersist()

    def _close(self, batch: DataFrame, batch_id: int, until: int | None) -> None:
        secs, _ = BUCKETS[self.bucket]
        rng = batch.agg(F.unix_seconds(F.min("hour")).alias("lo"),
                        F.unix_seconds(F.max("hour")).alias("hi")).first()
        shares = self.shares.latest(before=batch_id)
        last = None if shares is None else shares.agg(F.unix_seconds(F.max("last_hour"))).first()[0]
        ends = [t for t in (rng["hi"], until) if t is not None]
        if not ends or rng["lo"] is None and last is None:
            return
        lo_s = rng["lo"] if last is None else last + secs
        hi_s = max(ends)
        # Counts of buckets that are folded already change nothing; they are kept apart.
        if last is not None and rng["lo"] is not None and rng["lo"] <= last:
            _write_batch(batch.where(F.unix_seconds("hour") <= F.lit(last)), self.late, batch_id)
        if hi_s < lo_s:
            return
        touched = _touched_slots(lo_s, hi_s, self.bucket)
        state = self.slots.current(before=batch_id, slots=touched)
        lo = F.timestamp_seconds(F.lit(lo_s).cast("long"))
        hi = F.timestamp_seconds(F.lit(hi_s).cast("long"))
        counts = born(batch.where(F.unix_seconds("hour") >= F.lit(lo_s)), self.catalog, self.bucket) \
            .withColumn("dow", dow("hour")).withColumn("hod", hod("hour", self.bucket))
        new_slots = slot_baselines(counts, self.catalog, lo, hi, self.bucket, seed=state)
        new_shares = share_baselines(counts, self.catalog, lo, hi, self.bucket, seed=shares) \
            .withColumn("last_hour", hi)
        self.slots.write(new_slots, batch_id)
        self.shares.write(new_shares, batch_id)
        self.closed.write(counts, batch_id)
        for t in (self.slots, self.shares):
            t.prune(batch_id)


def closed_state(spark: SparkSession, state_root: str,
                 bucket: str = "hour") -> tuple[DataFrame | None, DataFrame | None]:
    """Current (baselines, shares) written by a ``BucketCloser``."""
    return (SlotStore(spark, f"{state_root}/baselines", bucket).current(),
            VersionedTable(spark, f"{state_root}/shares").latest())


# ------------------------------------------------------------------ G5
class LiveStatus:
    """Live status of the newest (unfinished) bucket.  Input: update-mode
    counts (entity_id, hour, n) of the dedup stream; the counts of buckets that
    are not closed yet are upserted into a versioned table and the status is
    computed against the state stored by ``BucketCloser``.  A batch whose status
    is already written is left as it is, so a replay changes nothing even if
    more buckets were closed meanwhile."""

    def __init__(self, spark: SparkSession, catalog: DataFrame, state_root: str, out: str,
                 bucket: str = "hour"):
        self.spark, self.catalog, self.state_root, self.bucket = spark, catalog, state_root, bucket
        self.live = VersionedTable(spark, f"{state_root}/live_counts")
        self.out = VersionedTable(spark, out)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.out.has(batch_id):
            return
        batch = batch.select("entity_id", "hour", F.col("n").cast("long").alias("n")).persist()
        try:
            self._score(batch, batch_id)
        finally:
            batch.unpersist()

    def _score(self, upd: DataFrame, batch_id: int) -> None:
        prior = self.live.latest(before=batch_id)
        merged = upd if prior is None else \
            prior.join(upd.select("entity_id", "hour"), ["entity_id", "hour"], "left_anti").unionByName(upd)
        newest = merged.agg(F.unix_seconds(F.max("hour"))).first()[0]
        if newest is None:
            return
        baselines, shares = closed_state(self.spark, self.state_root, self.bucket)
        if shares is not None:  # closed buckets are in the stored state; the newest is always kept
            last = shares.agg(F.unix_seconds(F.max("last_hour"))).first()[0]
            merged = merged.where(F.unix_seconds("hour") > F.lit(min(last, newest - 1)))
        self.live.write(merged, batch_id)
        self.live.prune(batch_id)
        if baselines is None:
            return
        as_of = F.timestamp_seconds(F.lit(newest).cast("long"))
        self.out.write(status_from_state(self.catalog, baselines, shares,
                                         self.live.latest(before=batch_id + 1), as_of, self.bucket),
                       batch_id)
