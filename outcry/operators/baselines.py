"""Baselines: slot EWMA (C1/C2), tiers (C7/C8/C9), share EWMA (C5), lifetime
totals (C6) and the incremental one-bucket update (C4).

Design
* Every catalog entity gets an observation in every closed bucket (0 when
  silent), exactly as the reference's hourly job does.  Final states (C2, C5)
  never build that dense spine: the sparse counts of each slot
  (entity, weekday, hour-of-day) — or of each entity, for shares — are gathered
  into an array sorted by bucket, and Spark's ``aggregate`` higher-order
  function walks the dense bucket sequence with a pointer into it (0 where the
  pointer does not match).  JVM-side, no Python, O(buckets); a slot array holds
  at most one value per week whatever the signal volume, so a hot entity only
  has larger numbers, not longer arrays.  Operand order follows the reference,
  so results are bit-equal to a sequential evaluation.
* Histories (state before every bucket, for the no-look-ahead replay) are in
  ``operators.replay``; an array-append fold would be quadratic in the number
  of buckets.
* Tier averages are rounded to 9 decimals (exact decimal sums in the direct
  path, numpy sums in the replay), which absorbs summation-order differences
  between engines before z-scores are banded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outcry import constants as K
from outcry.functions.scoring import ewma_step, round_half_up, share_step
from outcry.functions.time import (BUCKETS, add_buckets, bucket_index, dow, hod,
                                   slot_index)
from outcry.operators.counts import birth_index
from outcry.sources.signals import upsert

_DEC = T.DecimalType(38, 18)


def _nullable(c: Column) -> Column:
    """Same value, nullable type (aggregate() seeds must match the merge type)."""
    return F.when(F.lit(True), c)


def _state_seed() -> Column:
    return F.struct(_nullable(F.lit(0.0)).alias("mean"),
                    _nullable(F.lit(0.0)).alias("std"),
                    _nullable(F.lit(0).cast("long")).alias("n"),
                    _nullable(F.lit(0)).alias("p"))


def _round9(c: Column) -> Column:
    return round_half_up(c, K.TIER_DECIMALS)


# ------------------------------------------------------------------ slot keys
def slot_frame(counts: DataFrame, catalog: DataFrame, lo: Column, hi: Column,
               bucket: str = "hour") -> DataFrame:
    """One row per catalog entity and slot with the slot's sparse observations.

    Columns: entity_id, dow, hod, i0 (first bucket index of the slot in the
    range), n_weeks, obs (array of (k = week, n) sorted by week; at most one
    entry per week, so bounded by the number of weeks in the range).
    """
    _, period = BUCKETS[bucket]
    idx = bucket_index("hour", lo, bucket)
    obs = (counts.where((F.col("hour") >= lo) & (F.col("hour") <= hi))
                 .groupBy("entity_id", "dow", "hod")
                 .agg(F.array_sort(F.collect_list(F.struct(
                      F.floor(idx / F.lit(period)).cast("long").alias("k"),
                      F.col("n").cast("long").alias("n")))).alias("obs")))
    s = F.col("_s")
    slots = catalog.select("entity_id", birth_index(catalog, lo, bucket).alias("_birth"),
                           F.explode(F.sequence(F.lit(0), F.lit(period - 1))).alias("_s"))
    if bucket == "hour":
        slots = slots.select("entity_id", "_birth", (s / 24).cast("int").alias("dow"), (s % 24).cast("int").alias("hod"))
    else:
        slots = slots.select("entity_id", "_birth", s.cast("int").alias("dow"), F.lit(0).alias("hod"))
    s_lo = slot_index(dow(lo), hod(lo, bucket), bucket)
    first = ((slot_index("dow", "hod", bucket) - s_lo + F.lit(period)) % F.lit(period)).cast("long")
    # The slot's first bucket at or after the entity's birth.
    late = F.greatest(F.col("_birth") - first, F.lit(0).cast("long"))
    i0 = first + F.ceil(late / F.lit(period)).cast("long") * F.lit(period)
    n_hi = bucket_index(hi, lo, bucket)
    n_weeks = F.when(i0.cast("long") <= n_hi,
                     F.floor((n_hi - i0) / F.lit(period)) + F.lit(1)).otherwise(F.lit(0))
    return (slots.join(obs, ["entity_id", "dow", "hod"], "left")
                 .withColumn("i0", i0.cast("long"))
                 .withColumn("w0", F.floor(F.col("i0") / F.lit(period)).cast("long"))
                 .withColumn("n_weeks", n_weeks.cast("long"))
                 .withColumn("obs", F.filter("obs", lambda o: o["k"] >= F.col("w0")))
                 .drop("_birth"))


def _walk(obs: Column, p: Column, key: Column) -> tuple[Column, Column]:
    """Merge-walk a sorted sparse array of (k, n): the value at ``key`` (0 when
    absent) and the advanced pointer.  O(1) per step (array indexing), where a
    map lookup would scan the map."""
    cur = F.try_element_at(obs, p + F.lit(1))
    hit = F.coalesce(cur["k"] == key, F.lit(False))
    return (F.when(hit, cur["n"]).otherwise(F.lit(0).cast("long")),
            (p + F.when(hit, F.lit(1)).otherwise(F.lit(0))).cast("int"))


def fold_state(acc: Column, w: Column) -> Column:
    """State (mean, std, n, pointer) after the slot's observation of week ``w``."""
    x, p = _walk(F.col("obs"), acc["p"], w)
    m, s, n = ewma_step(acc["mean"], acc["std"], acc["n"], x)
    return F.struct(m.alias("mean"), s.alias("std"), n.alias("n"), p.alias("p"))


def slot_baselines(counts: DataFrame, catalog: DataFrame, lo: Column, hi: Column,
                   bucket: str = "hour", seed: DataFrame | None = None) -> DataFrame:
    """EWMA state of every slot after folding buckets [lo, hi].

    Columns: entity_id, dow, hod, mean, std, n, last_hour.  Slots with no bucket
    in the range have no row (the reference creates a row on first update).
    ``seed`` (same columns) continues from stored state: its slots start from
    their stored (mean, std, n) and slots untouched by the range keep it.
    """
    _, period = BUCKETS[bucket]
    sf = slot_frame(counts, catalog, lo, hi, bucket)
    init = _state_seed()
    keys = ["entity_id", "dow", "hod"]
    if seed is not None:
        sd = seed.select(*keys, F.struct(F.col("mean").cast("double").alias("mean"),
                                          F.col("std").cast("double").alias("std"),
                                          F.col("n").cast("long").alias("n"),
                                          _nullable(F.lit(0)).alias("p")).alias("_seed"),
                         F.col("last_hour").alias("_seed_last"))
        sf = sf.join(sd, keys, "full_outer").fillna({"n_weeks": 0})
        init = F.coalesce(F.col("_seed"), init)
    active = F.col("n_weeks") > F.lit(0)
    sf = sf.where(active | F.col("_seed").isNotNull() if seed is not None else active)
    weeks = F.sequence(F.col("w0"), F.col("w0") + F.col("n_weeks") - F.lit(1))
    state = F.when(F.col("n_weeks") > F.lit(0),
                   F.aggregate(weeks, init, fold_state)).otherwise(init)
    last_i = F.col("i0") + (F.col("n_weeks") - F.lit(1)) * F.lit(period)
    last = add_buckets(lo, last_i, bucket)
    if seed is not None:
        last = F.when(F.col("n_weeks") > F.lit(0), last).otherwise(F.col("_seed_last"))
    return sf.select("entity_id", "dow", "hod",
                     state["mean"].alias("mean"), state["std"].alias("std"),
                     state["n"].alias("n"), last.alias("last_hour"))


# ------------------------------------------------------------------ tiers
def _dec(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(_DEC)


def _avg_exact(sum_dec: Column, cnt: Column) -> Column:
    return _round9(sum_dec.cast("double") / cnt.cast("double"))


def tiers(baselines: DataFrame, dow_col: Column, hod_col: Column) -> DataFrame:
    """C7 + C8 + C9: slot, hour and aggregate tiers of every entity for one
    (dow, hod), in a single pass (one conditional aggregate by entity).

    Hour/aggregate tiers are null when their sample sum is 0 or absent.
    """
    is_slot = (F.col("dow") == dow_col) & (F.col("hod") == hod_col)
    is_hour = F.col("hod") == hod_col
    # At most one slot row matches per entity, so a max per field picks it;
    # plain numeric aggregates keep this a HashAggregate (a struct max would
    # force a sort-based aggregate).
    g = baselines.groupBy("entity_id").agg(
        F.max(F.when(is_slot, F.col("n"))).alias("_slot_n"),
        F.max(F.when(is_slot, F.col("mean"))).alias("_slot_mean"),
        F.max(F.when(is_slot, F.col("std"))).alias("_slot_std"),
        F.sum(F.when(is_hour, _dec("mean"))).alias("_hm"),
        F.sum(F.when(is_hour, _dec("std"))).alias("_hs"),
        F.count(F.when(is_hour, F.lit(1))).alias("_hc"),
        F.sum(F.when(is_hour, F.col("n"))).alias("_hn"),
        F.sum(_dec("mean")).alias("_am"),
        F.sum(_dec("std")).alias("_as"),
        F.count(F.lit(1)).alias("_ac"),
        F.sum("n").alias("_an"),
    )
    hour_ok = F.coalesce(F.col("_hn"), F.lit(0)) > F.lit(0)
    agg_ok = F.coalesce(F.col("_an"), F.lit(0)) > F.lit(0)
    return g.select(
        "entity_id",
        F.col("_slot_mean").alias("slot_mean"), F.col("_slot_std").alias("slot_std"),
        F.col("_slot_n").cast("long").alias("slot_n"),
        F.when(hour_ok, _avg_exact(F.col("_hm"), F.col("_hc"))).alias("hour_mean"),
        F.when(hour_ok, _avg_exact(F.col("_hs"), F.col("_hc"))).alias("hour_std"),
        F.when(hour_ok, F.col("_hn")).cast("long").alias("hour_n"),
        F.when(agg_ok, _avg_exact(F.col("_am"), F.col("_ac"))).alias("agg_mean"),
        F.when(agg_ok, _avg_exact(F.col("_as"), F.col("_ac"))).alias("agg_std"),
        F.when(agg_ok, F.col("_an")).cast("long").alias("agg_n"),
    )


TIER_COLUMNS = ["slot_mean", "slot_std", "slot_n", "hour_mean", "hour_std", "hour_n",
                "agg_mean", "agg_std", "agg_n"]


# ------------------------------------------------------------------ shares
def active_buckets(totals: DataFrame, lo: Column, hi: Column, bucket: str = "hour") -> Column:
    """Sorted array of (bucket index, total) for buckets with a positive total,
    as one scalar value (bounded by the number of buckets in the range)."""
    idx = bucket_index("hour", lo, bucket)
    return (totals.where((F.col("hour") >= lo) & (F.col("hour") <= hi) & (F.col("total") > 0))
                  .agg(F.coalesce(F.sort_array(F.collect_list(F.struct(idx.alias("i"),
                                                                       F.col("total").alias("t")))),
                                  F.array().cast("array<struct<i:bigint,t:bigint>>")))
                  .scalar())


def share_baselines(counts: DataFrame, catalog: DataFrame, lo: Column, hi: Column,
                    bucket: str = "hour", seed: DataFrame | None = None) -> DataFrame:
    """Expected share (EWMA, alpha 0.3) and lifetime total of every catalog
    entity after the buckets in [lo, hi] with a positive total.

    While an entity's lifetime total is 0 its share is replaced, so the EWMA
    starts at its first non-zero bucket.
    """
    rng = counts.where((F.col("hour") >= lo) & (F.col("hour") <= hi))
    totals = rng.groupBy("hour").agg(F.sum("n").cast("long").alias("total"))
    active = active_buckets(totals, lo, hi, bucket)
    idx = bucket_index("hour", lo, bucket)
    obs = (rng.groupBy("entity_id")
              .agg(F.array_sort(F.collect_list(F.struct(idx.alias("k"), F.col("n").cast("long").alias("n"))))
                    .alias("obs")))
    init = F.struct(_nullable(F.lit(0.0)).alias("share"),
                    _nullable(F.lit(0).cast("long")).alias("total"),
                    _nullable(F.lit(0)).alias("p"))
    base = catalog.select("entity_id").join(obs, "entity_id", "left")
    if seed is not None:
        sd = seed.select("entity_id", F.struct(F.col("expected_share").cast("double").alias("share"),
                                               F.col("total").cast("long").alias("total"),
                                               _nullable(F.lit(0)).alias("p")).alias("_seed"))
        base = base.join(sd, "entity_id", "left")
        init = F.coalesce(F.col("_seed"), init)

    def step(acc, e):
        n, p = _walk(F.col("obs"), acc["p"], e["i"])
        x = n.cast("double") / e["t"].cast("double")
        s, t = share_step(acc["share"], acc["total"], x, n)
        return F.struct(s.alias("share"), t.alias("total"), p.alias("p"))

    st = F.aggregate(F.col("_active"), init, step)
    return (base.withColumn("_active", active)
                   .select("entity_id", st["share"].alias("expected_share"),
                           st["total"].alias("total")))


def lifetime_totals(counts: DataFrame, catalog: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Lifetime signal total per catalog entity over [lo, hi]."""
    s = (counts.where((F.col("hour") >= lo) & (F.col("hour") <= hi))
               .groupBy("entity_id").agg(F.sum("n").cast("long").alias("total")))
    return (catalog.select("entity_id").join(s, "entity_id", "left")
                   .select("entity_id", F.coalesce("total", F.lit(0).cast("long")).alias("total")))


# ------------------------------------------------------------------ C4
def apply_bucket(state: DataFrame, counts: DataFrame, catalog: DataFrame, hour: Column,
                 bucket: str = "hour") -> DataFrame:
    """C4: fold one closed bucket onto stored slot state and return the new full
    state table (A11 upsert semantics).

    ``state``: entity_id, dow, hod, mean, std, n, last_hour.
    """
    return upsert(state, bucket_updates(state, counts, catalog, hour, bucket), ["entity_id", "dow", "hod"])


def bucket_updates(state: DataFrame, counts: DataFrame, catalog: DataFrame, hour: Column,
                   bucket: str = "hour") -> DataFrame:
    """C4: the rows of one closed bucket's slot after its fold (one per catalog
    entity): what an upsert sink takes.  Idempotent: a slot whose ``last_hour``
    is already >= ``hour`` is left unchanged."""
    d0, h0 = dow(hour), hod(hour, bucket)
    cur = (counts.where(F.col("hour") == hour).select("entity_id", F.col("n").cast("long").alias("x")))
    touched = (catalog.select("entity_id")
                      .join(cur, "entity_id", "left")
                      .join(state.where((F.col("dow") == d0) & (F.col("hod") == h0)),
                            "entity_id", "left"))
    fresh = F.col("n").isNull()
    done = ~fresh & (F.col("last_hour") >= hour)
    x = F.coalesce(F.col("x"), F.lit(0).cast("long"))
    m, s, n = ewma_step(F.coalesce("mean", F.lit(0.0)), F.coalesce("std", F.lit(0.0)),
                        F.coalesce("n", F.lit(0).cast("long")), x)
    return touched.select(
        "entity_id", d0.alias("dow"), h0.alias("hod"),
        F.when(done, F.col("mean")).otherwise(m).alias("mean"),
        F.when(done, F.col("std")).otherwise(s).alias("std"),
        F.when(done, F.col("n")).otherwise(n).alias("n"),
        F.when(done, F.col("last_hour")).otherwise(hour).alias("last_hour"))
