"""Counting operators: hourly counts (B1), totals (B2), point counts (B3),
peer counts (B4), shares (B5), the dense spine (B6), trends (B7), trend
scaling (F5) and the has-signal flag (F6).

The dense spine (every catalog entity observed in every closed bucket, 0 when
silent) shuffles sparse rows only: the counts of an entity are gathered in
bucket order, every observation is given the length of the silent run behind
it, and the runs are expanded in place after an even redistribution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outcry import constants as K
from outcry.functions.scoring import current_share
from outcry.functions.time import BUCKETS, add_buckets, bucket_index, bucket_start, dow, hod


def hourly_counts(dedup: DataFrame) -> DataFrame:
    """B1: signals per (entity, bucket) after dedup (= distinct actors)."""
    return (dedup.groupBy("entity_id", "hour")
                 .agg(F.count(F.lit(1)).alias("n"))
                 .withColumn("dow", dow("hour"))
                 .withColumn("hod", F.hour("hour").cast("int")))


def hourly_totals(counts: DataFrame) -> DataFrame:
    """B2: total signals per bucket, from B1 (never a rescan of raw signals)."""
    return counts.groupBy("hour").agg(F.sum("n").cast("long").alias("total"))


def count_at(counts: DataFrame, entity: str, hour: Column) -> DataFrame:
    """Count of one entity in one bucket; 0 when absent (one row)."""
    return (counts.where((F.col("entity_id") == F.lit(entity)) & (F.col("hour") == hour))
                  .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
                  .select(F.lit(entity).alias("entity_id"), hour.alias("hour"), "n"))


def peer_counts(counts: DataFrame, entity: str, hour: Column) -> DataFrame:
    """Counts of every other entity in the bucket (B0c + B1)."""
    return counts.where((F.col("entity_id") != F.lit(entity)) & (F.col("hour") == hour))


def with_share(counts: DataFrame) -> DataFrame:
    """Add the bucket total and the entity's share of it (0 when total is 0).
    Totals come from a partial aggregate and are joined back, so the rows of a
    bucket need not meet in one task."""
    return (counts.join(hourly_totals(counts), "hour")
                  .withColumn("share", current_share("n", "total")))


def where_entity_hour(rows: DataFrame, entity: str | None = None, lo: Column | None = None,
                      hi: Column | None = None) -> DataFrame:
    """B0b, B0d: point and range predicates on entity and bucket."""
    if entity is not None:
        rows = rows.where(F.col("entity_id") == F.lit(entity))
    if lo is not None:
        rows = rows.where(F.col("hour") >= lo)
    if hi is not None:
        rows = rows.where(F.col("hour") <= hi)
    return rows


def bounds(counts: DataFrame) -> tuple[Column, Column]:
    """First and last bucket with data as literal Columns (one tiny action that
    returns two numbers), so range filters on ``hour`` are pushed into scans."""
    row = counts.agg(F.unix_seconds(F.min("hour")).alias("lo"),
                     F.unix_seconds(F.max("hour")).alias("hi")).first()
    if row is None or row["lo"] is None:
        raise ValueError("no signals in range")
    return (F.timestamp_seconds(F.lit(row["lo"]).cast("long")),
            F.timestamp_seconds(F.lit(row["hi"]).cast("long")))


def birth_index(catalog: DataFrame, lo: Column, bucket: str = "hour") -> Column:
    """Index (from ``lo``) of the first bucket in which an entity is observed:
    the bucket of its optional ``valid_from``, or 0."""
    if "valid_from" not in catalog.columns:
        return F.lit(0).cast("long")
    first = bucket_index(bucket_start("valid_from", bucket), lo, bucket)
    return F.greatest(F.coalesce(first, F.lit(0).cast("long")), F.lit(0).cast("long"))


def born(rows: DataFrame, catalog: DataFrame, bucket: str = "hour") -> DataFrame:
    """Rows (entity_id, hour) of entities that exist at that bucket: signals on
    an entity before its ``valid_from`` are unknown-entity rejects."""
    if "valid_from" not in catalog.columns:
        return rows
    since = catalog.select("entity_id", bucket_start("valid_from", bucket).alias("_since"))
    return (rows.join(since, "entity_id")
                .where(F.col("_since").isNull() | (F.col("hour") >= F.col("_since"))).drop("_since"))


def bucket_arrays(counts: DataFrame, catalog: DataFrame, lo: Column, hi: Column, bucket: str = "hour") -> DataFrame:
    """One row per catalog entity: ``_birth`` (index of its first bucket) and
    ``_obs``, its non-zero buckets (i, n) in order.  At most one element per
    bucket of the range, whatever the signal volume."""
    idx = bucket_index("hour", lo, bucket)
    obs = (where_entity_hour(counts, lo=lo, hi=hi).groupBy("entity_id")
           .agg(F.array_sort(F.collect_list(F.struct(idx.alias("i"), F.col("n").cast("long").alias("n")))).alias("_all")))
    none = F.array().cast("array<struct<i:bigint,n:bigint>>")
    return (catalog.select("entity_id", birth_index(catalog, lo, bucket).alias("_birth")).join(obs, "entity_id", "left")
            .select("entity_id", "_birth", F.filter(F.coalesce("_all", none), lambda o: o["i"] >= F.col("_birth")).alias("_obs")))


def dense_spine(counts: DataFrame, catalog: DataFrame, lo: Column, hi: Column,
                bucket: str = "hour") -> DataFrame:
    """One row per catalog entity and bucket in [lo, hi] from the entity's
    birth on; n = 0 when silent.  Every observation carries the length of the
    run up to the next one; runs are spread evenly, then expanded in place."""
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nb = bucket_index(hi, lo, bucket) + F.lit(1)
    rows = bucket_arrays(counts, catalog, lo, hi, bucket).where(F.col("_birth") < nb)
    silent = F.when((F.size("_obs") == 0) | (F.get("_obs", F.lit(0))["i"] > F.col("_birth")),
                    F.array(F.struct(F.col("_birth").alias("i"), F.lit(0).cast("long").alias("n"))))
    marks = F.concat(F.coalesce(silent, F.array().cast("array<struct<i:bigint,n:bigint>>")), F.col("_obs"))
    runs = F.transform(F.col("_marks"), lambda o, k: F.struct(
        o["i"].alias("i"), o["n"].alias("n"),
        (F.coalesce(F.get(F.col("_marks"), k + 1)["i"], F.col("_nb")) - o["i"]).alias("len")))
    spread = (rows.select("entity_id", marks.alias("_marks"), nb.alias("_nb"))
              .select("entity_id", F.explode(runs).alias("r")).repartition(parts))
    one = spread.select("entity_id", "r.i", "r.n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("r.len") - 1)).alias("k"))
    hour = add_buckets(lo, F.col("i") + F.col("k"), bucket)
    return one.select("entity_id", hour.alias("hour"),
                      F.when(F.col("k") == 0, F.col("n")).otherwise(F.lit(0).cast("long")).alias("n"),
                      dow(hour).alias("dow"), hod(hour, bucket).alias("hod"))


def trend(counts: DataFrame, catalog: DataFrame, now: Column, hours: int = K.TREND_BUCKETS,
          bucket: str = "hour") -> DataFrame:
    """The last ``hours`` buckets up to and including ``now``, ascending,
    zero-filled, for every catalog entity; ``pos`` 0 is the oldest."""
    secs, _ = BUCKETS[bucket]
    lo = F.timestamp_seconds(F.unix_seconds(now) - F.lit((hours - 1) * secs))
    window = counts.where((F.col("hour") >= lo) & (F.col("hour") <= now))
    spine = dense_spine(window, catalog, lo, now, bucket)
    return spine.withColumn("pos", bucket_index("hour", lo, bucket).cast("int"))


def scaled_trend(tr: DataFrame) -> DataFrame:
    """n / max(max n of the entity's trend, 1)."""
    w = Window.partitionBy("entity_id")
    return tr.withColumn("scaled",
                         F.col("n").cast("double")
                         / F.greatest(F.max("n").over(w), F.lit(1)).cast("double"))


def has_signal(tr: DataFrame) -> DataFrame:
    """whether an entity's trend has any non-zero point (empty -> false)."""
    return (tr.groupBy("entity_id")
              .agg(F.coalesce(F.bool_or(F.col("n") > F.lit(0)), F.lit(False)).alias("has_signal")))
