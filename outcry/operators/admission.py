"""Admission: known-entity filter (A6), rate cap (A7), reject accounting
and de-duplication (A9).

Order of the reference's ingest path: entity check -> rate cap -> dedup, so
unknown entities never use quota while duplicates do.

Scale notes
* The catalog is a dimension table; joins to it are left to Spark, which
  broadcasts it when its measured size is under the broadcast threshold (AQE
  re-checks at runtime) and falls back to a sort-merge join otherwise.
* The rate cap is ``row_number() <= k`` directly above the window, so Spark
  plans a partial ``WindowGroupLimit`` before the shuffle: a bot actor with a
  third of all rows ships at most k rows per map partition.
* Dedup is a plain aggregate (min id, max ts) with map-side partial
  aggregation, so a hot (actor, entity, hour) collapses before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outcry import constants as K
from outcry.functions.time import bucket_start, dow, hod


def admit_known(signals: DataFrame, catalog: DataFrame) -> DataFrame:
    """Signals whose entity is in the catalog (left semi join)."""
    return signals.join(catalog.select("entity_id"), on="entity_id", how="left_semi")


def unknown_rejects(signals: DataFrame, catalog: DataFrame) -> DataFrame:
    """Signals whose entity is not in the catalog (left anti join)."""
    return (signals.where(F.col("entity_id").isNotNull() & (F.col("entity_id") != F.lit("")))
                   .join(catalog.select("entity_id"), on="entity_id", how="left_anti"))


def _with_hour(signals: DataFrame, bucket: str) -> DataFrame:
    if "hour" in signals.columns:
        return signals
    return signals.withColumn("hour", bucket_start("ts", bucket))


def rate_cap(signals: DataFrame, k: int = K.RATE_CAP, bucket: str = "hour") -> DataFrame:
    """Keep the first ``k`` attempts per (actor, bucket) in arrival order.

    Adds the ``hour`` (bucket) column.  The shuffle on (actor_key, hour) also
    satisfies the dedup aggregate on (actor_key, entity_id, hour) downstream,
    so cap + dedup cost one exchange.
    """
    w = Window.partitionBy("actor_key", "hour").orderBy("ts", "signal_id")
    return (_with_hour(signals, bucket)
            .withColumn("_rl_rank", F.row_number().over(w))
            .where(F.col("_rl_rank") <= F.lit(k))
            .drop("_rl_rank"))


def tag_known(signals: DataFrame, catalog: DataFrame) -> DataFrame:
    """Attempts with ``_missing`` (no entity) and ``_ok`` (known entity)."""
    known = catalog.select("entity_id", F.lit(True).alias("_known"))
    missing = F.col("entity_id").isNull() | (F.col("entity_id") == F.lit(""))
    return (signals.join(known, on="entity_id", how="left")
                   .withColumn("_missing", missing)
                   .withColumn("_ok", F.col("_known").isNotNull() & ~missing)
                   .drop("_known"))


def admission(signals: DataFrame, catalog: DataFrame, k: int = K.RATE_CAP,
              bucket: str = "hour") -> DataFrame:
    """Tag every attempt with its reason:
    missing_entity / unknown_entity / rate_limited / accepted.

    Only attempts on known entities count toward the cap.  No full per-row
    ranking: the k earliest attempts of each (actor, bucket) come from a
    top-k (partial ``WindowGroupLimit`` before the shuffle), their latest
    (ts, id) is the group's cut-off, and every attempt is compared with the
    cut-off of its group (a join on (actor, bucket) with one row per key on the
    small side — broadcast when small, otherwise sort-merge with AQE skew
    splitting of a hot key).
    """
    tagged = tag_known(_with_hour(signals, bucket), catalog)
    ok = tagged.where(F.col("_ok"))
    w = Window.partitionBy("actor_key", "hour").orderBy("ts", "signal_id")
    cut = (ok.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.lit(k))
             .groupBy(F.col("actor_key").alias("_actor"), F.col("hour").alias("_hour"))
             .agg(F.max(F.struct("ts", "signal_id")).alias("_cut")))
    # Null-safe: attempts without an actor share one quota, as in the window.
    j = tagged.join(cut, F.col("actor_key").eqNullSafe(F.col("_actor"))
                    & F.col("hour").eqNullSafe(F.col("_hour")), "left")
    within = (F.col("ts") < F.col("_cut.ts")) | (
        (F.col("ts") == F.col("_cut.ts")) & (F.col("signal_id") <= F.col("_cut.signal_id")))
    reason = (F.when(F.col("_missing"), F.lit("missing_entity"))
               .when(~F.col("_ok"), F.lit("unknown_entity"))
               .when(within, F.lit("accepted"))
               .otherwise(F.lit("rate_limited")))
    return j.withColumn("reason", reason).drop("_missing", "_ok", "_cut", "_actor", "_hour")


def admission_report(signals: DataFrame, catalog: DataFrame, k: int = K.RATE_CAP,
                     bucket: str = "hour") -> DataFrame:
    """Attempts per (reason, bucket), by aggregation only: per
    (actor, bucket) the first min(c, k) known attempts are accepted and the
    rest rate limited, so no attempt needs a rank.  Every step is a partial
    (map-side) aggregate, whatever the skew."""
    tagged = tag_known(_with_hour(signals, bucket), catalog)
    rejects = (tagged.where(~F.col("_ok"))
                     .groupBy(F.when(F.col("_missing"), F.lit("missing_entity"))
                               .otherwise(F.lit("unknown_entity")).alias("reason"), "hour")
                     .agg(F.count(F.lit(1)).alias("n")))
    per_actor = (tagged.where(F.col("_ok")).groupBy("actor_key", "hour")
                       .agg(F.count(F.lit(1)).alias("_c")))
    acc = F.least(F.col("_c"), F.lit(k))
    split = (per_actor.groupBy("hour")
                      .agg(F.sum(acc).alias("accepted"), F.sum(F.col("_c") - acc).alias("rate_limited")))
    kept = split.select("hour", F.explode(F.array(
        F.struct(F.lit("accepted").alias("reason"), F.col("accepted").alias("n")),
        F.struct(F.lit("rate_limited").alias("reason"), F.col("rate_limited").alias("n")))).alias("_r"))
    kept = kept.select(F.col("_r.reason").alias("reason"), "hour", F.col("_r.n").cast("long").alias("n")) \
               .where(F.col("n") > F.lit(0))
    return rejects.select("reason", "hour", F.col("n").cast("long")).unionByName(kept)


def accepted(signals: DataFrame, catalog: DataFrame, k: int = K.RATE_CAP,
             bucket: str = "hour") -> DataFrame:
    """A6 + A7 in the reference's order, returning only the accepted attempts."""
    return rate_cap(admit_known(signals, catalog), k=k, bucket=bucket)


def dedup_signals(signals: DataFrame, bucket: str = "hour") -> DataFrame:
    """One row per (actor, entity, bucket); the first arrival's id is kept and
    ``created_at`` is refreshed to the latest arrival."""
    return (_with_hour(signals, bucket).groupBy("actor_key", "entity_id", "hour")
                   .agg(F.min("signal_id").alias("signal_id"),
                        F.max("ts").alias("created_at"))
                   .withColumn("dow", dow("hour"))
                   .withColumn("hod", hod("hour", bucket)))
