"""A stored score history that grows by batches and takes late corrections.

``HistoryStore`` keeps the counts and the replayed rows (state before and after
every bucket, tiers, shares) in tables partitioned by the replay's blocks of
buckets and committed by a pointer (``sources.versions``).  The rows hold the
state, so any bucket can be replayed on from: a cycle of rows before it gives
every slot's and share's state (``operators.replay.state_after``).

* ``extend`` (D12, incremental): the newly closed buckets are replayed from the
  state of the last stored one; older buckets are not read but for that cycle.
* ``repair`` (G6): buckets whose counts changed after late signals were taken
  up.  Replay begins at the first changed bucket, from the state before it; the
  blocks before stay as they are and are not read but for that cycle.  From
  that bucket on every row may change: tiers of a corrected entity for good,
  shares of all entities through the changed total.

Both carry a token and do nothing when run again with one that is committed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outcry.functions.time import BUCKETS
from outcry.labels import DEFAULT_LABELS
from outcry.operators.counts import born
from outcry.operators.replay import BLOCK, slot_history, state_after
from outcry.plans.status import score_replayed
from outcry.sources.versions import PartitionStore


def _ts(seconds: int) -> Column:
    return F.timestamp_seconds(F.lit(seconds).cast("long"))


class HistoryStore:
    def __init__(self, spark: SparkSession, root: str, catalog: DataFrame, bucket: str = "hour"):
        self.spark, self.catalog, self.bucket = spark, catalog, bucket
        self.secs, period = BUCKETS[bucket]
        self.cycle = self.secs * period
        self.counts = PartitionStore(spark, f"{root}/counts", ["block"], ["hour"])
        self.rows = PartitionStore(spark, f"{root}/history", ["block"], ["hour"])

    # ------------------------------------------------------------ reading
    def _block_of(self, seconds: int) -> int:
        return seconds // (self.secs * BLOCK[self.bucket])

    def _with_block(self, df: DataFrame) -> DataFrame:
        return df.withColumn("block", F.floor(F.unix_seconds("hour") / F.lit(self.secs * BLOCK[self.bucket])).cast("int"))

    def between(self, store: PartitionStore, lo: int | None = None, hi: int | None = None) -> DataFrame | None:
        """Rows with lo <= hour <= hi (unix seconds); only the files of their
        blocks are opened."""
        blocks, hours = F.lit(True), F.lit(True)
        if lo is not None:
            blocks, hours = blocks & (F.col("block") >= self._block_of(lo)), hours & (F.col("hour") >= _ts(lo))
        if hi is not None:
            blocks, hours = blocks & (F.col("block") <= self._block_of(hi)), hours & (F.col("hour") <= _ts(hi))
        found = store.read(blocks)
        return None if found is None else found.where(hours).drop("block")

    def last(self) -> int | None:
        """The last stored bucket (unix seconds): read from the last block."""
        manifest = self.rows.manifest()
        if manifest is None:
            return None
        block = manifest.agg(F.max("block")).first()[0]
        return self.rows.read(F.col("block") == block).agg(F.unix_seconds(F.max("hour"))).first()[0]

    def state_before(self, hour: int) -> DataFrame | None:
        """The state (``replay.STATE_SCHEMA``) before a bucket."""
        rows = self.between(self.rows, hour - self.cycle, hour - self.secs)
        return None if rows is None else state_after(rows, self.bucket)

    def scored(self, lo: int | None = None, hi: int | None = None, labels=DEFAULT_LABELS) -> DataFrame:
        """D12 of the stored buckets in a range."""
        return score_replayed(self.between(self.rows, lo, hi), labels)

    # ------------------------------------------------------------ writing
    def _replace_counts(self, counts: DataFrame, lo: int, changed: DataFrame | None, token: int | None) -> None:
        """Puts ``counts`` in place of the stored ones from ``lo`` on (all of
        them, or those of the hours in ``changed``)."""
        new = self._with_block(counts.select("entity_id", "hour", F.col("n").cast("long").alias("n")))
        old, touched = self.counts.read(F.col("block") >= self._block_of(lo)), None
        if old is not None:
            kept = old.where(F.col("hour") < _ts(lo)) if changed is None else old.join(changed, "hour", "left_anti")
            touched = new.select("block").distinct() if changed is None else self._with_block(changed).select("block").distinct()
            new = kept.join(touched, "block", "left_semi").select(*new.columns).unionByName(new)
        self.counts.write(new, token, touched)

    def _replay_from(self, lo: int, hi: int, token: int | None) -> None:
        counts = self.between(self.counts, lo, hi)
        seed = self.state_before(lo)
        new = self._with_block(slot_history(born(counts, self.catalog, self.bucket), self.catalog, _ts(lo), _ts(hi), self.bucket, seed))
        head = self.rows.read(F.col("block") == self._block_of(lo))
        if head is not None:
            new = head.where(F.col("hour") < _ts(lo)).select(*new.columns).unionByName(new)
        self.rows.write(new, token)

    @staticmethod
    def _done(store: PartitionStore, token: int | None) -> bool:
        head = store.head()
        return token is not None and head is not None and token <= head

    def extend(self, counts: DataFrame, until: int, token: int | None = None) -> None:
        """Adds the closed buckets after the last stored one up to ``until``
        (unix seconds); silent buckets count as zeros."""
        if self._done(self.rows, token):
            return
        last = self.last()
        if last is None:
            lo = counts.agg(F.unix_seconds(F.min("hour"))).first()[0]
        else:
            lo = last + self.secs
        if lo is None or lo > until:
            return
        if not self._done(self.counts, token):
            self._replace_counts(counts.where((F.col("hour") >= _ts(lo)) & (F.col("hour") <= _ts(until))), lo, None, token)
        self._replay_from(lo, until, token)

    def first_change(self, recount: DataFrame, hours: DataFrame) -> int | None:
        """The first of ``hours`` (unix seconds) whose stored counts differ from
        ``recount`` (entity_id, hour, n)."""
        ends = hours.agg(F.unix_seconds(F.min("hour")).alias("lo"), F.unix_seconds(F.max("hour")).alias("hi")).first()
        stored = None if ends["lo"] is None else self.between(self.counts, ends["lo"], ends["hi"])
        if stored is None:
            return None
        both = (stored.join(hours, "hour", "left_semi").select("entity_id", "hour", F.col("n").alias("was"))
                .join(recount.select("entity_id", "hour", F.col("n").cast("long").alias("now")), ["entity_id", "hour"], "full_outer"))
        return both.where(~F.col("was").eqNullSafe(F.col("now"))).agg(F.unix_seconds(F.min("hour"))).first()[0]

    def repair(self, recount: DataFrame, hours: DataFrame, token: int | None = None) -> int | None:
        """Takes up the counts of ``hours`` (column hour, distinct) counted
        anew: ``recount`` (entity_id, hour, n) holds all their non-zero counts.
        Returns the first bucket replayed, None if nothing changed.  Hours after
        the last stored bucket are left to ``extend``."""
        if self._done(self.rows, token):
            return None
        last = self.last()
        if last is None:
            return None
        hours = hours.where(F.col("hour") <= _ts(last)).select("hour").distinct()
        recount = recount.join(hours, "hour", "left_semi").select("entity_id", "hour", "n")
        first = self.first_change(recount, hours)
        if first is None and not self._done(self.counts, token):
            return None
        if not self._done(self.counts, token):
            lo = hours.agg(F.unix_seconds(F.min("hour"))).first()[0]
            self._replace_counts(recount, lo, hours, token)
        else:  # the counts were committed before the history: all their hours again
            first = hours.agg(F.unix_seconds(F.min("hour"))).first()[0]
        self._replay_from(first, last, token)
        return first
