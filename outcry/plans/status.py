"""Status jobs: ingest-to-counts, score columns (D1-D7), the status snapshot
(D9), one entity (D8), submit result (D10), entity detail (D11) and the
no-look-ahead score history (D12).

Shuffle budget.  Ingest: one exchange on (actor, bucket) serves both the rate
cap and the dedup, one more for the count (both with partial aggregation).
Snapshot: one aggregate per slot fold and per share fold over the small counts
table, one conditional aggregate for the tiers, and joins against entity-sized
frames (catalog, tiers, shares, current counts) which Spark broadcasts when
their measured size is under the threshold; ``status_from_state`` scores from
stored state without any fold.  History: the sparse counts are exchanged once,
into the replay, which produces the dense rows block by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outcry import constants as K
from outcry.functions import scoring as S
from outcry.functions.time import BUCKETS, bucket_start, dow, hod, iso_hour
from outcry.labels import DEFAULT_LABELS
from outcry.operators.admission import admit_known, dedup_signals, rate_cap
from outcry.operators.baselines import share_baselines, slot_baselines, tiers
from outcry.operators.counts import born, hourly_counts, trend
from outcry.operators.replay import slot_history


def signal_counts(signals: DataFrame, catalog: DataFrame | None, k: int | None = K.RATE_CAP,
                  bucket: str = "hour") -> DataFrame:
    """A6 -> A7 -> A9 -> B1: accepted, de-duplicated signals per (entity, bucket).

    ``catalog=None`` admits every non-empty entity (a catalog derived from the
    signals themselves), which saves the semi join and lets the catalog be
    derived afterwards from the small counts table instead of a second scan.
    """
    if catalog is None:
        known = signals.where(F.col("entity_id").isNotNull() & (F.col("entity_id") != F.lit("")))
    else:
        known = admit_known(signals, catalog)
    adm = rate_cap(known, k=k, bucket=bucket) if k else known
    return hourly_counts(dedup_signals(adm, bucket))


def prev_bucket(ts: Column, bucket: str = "hour") -> Column:
    secs, _ = BUCKETS[bucket]
    return F.timestamp_seconds(F.unix_seconds(ts) - F.lit(secs))


def score_columns(df: DataFrame, labels=DEFAULT_LABELS) -> DataFrame:
    """D1-D7 + C10 over a frame with n, total, expected_share and the tier
    columns slot_/hour_/agg_ mean/std/n.  Bands use unrounded z and d.
    Two projections (no withColumn chain), so the plan stays small."""
    r = S.resolve_tier("slot_mean", "slot_std", "slot_n", "hour_mean", "hour_std", "hour_n",
                       "agg_mean", "agg_std", "agg_n")
    resolved = r["mean"].isNotNull()
    share = S.current_share("n", "total")
    exp = F.coalesce(F.col("expected_share"), F.lit(0.0))
    z = S.z_score("n", r["mean"], r["std"])
    d = S.disproportionality(share, exp)
    keep = [c for c in df.columns if c not in ("expected_share",)]
    step1 = df.select(*keep, r["tier"].alias("tier"), r["confidence"].alias("confidence"),
                      r["mean"].alias("_mean"),
                      F.when(resolved, z).otherwise(F.lit(0.0)).alias("_z"),
                      F.when(resolved, d).otherwise(F.lit(0.0)).alias("_d"),
                      share.alias("_share"), exp.alias("_exp"))
    score = F.when(F.col("_mean").isNotNull(),
                   S.combined_score("_z", "_d", "confidence")).otherwise(F.lit(0.0))
    step2 = step1.select(*keep, "tier", "confidence", "_mean", "_z", "_d", "_share", "_exp",
                         score.alias("score"))
    return step2.select(*keep, "tier", "confidence", "score",
                        S.status_label("score", labels).alias("status"),
                        S.round_half_up("_mean", 1).alias("baseline_mean"),
                        S.round_half_up("_z", 2).alias("z_score"),
                        S.round_half_up("_d", 2).alias("disproportionality"),
                        S.round_half_up("_share", 3).alias("current_share"),
                        S.round_half_up("_exp", 3).alias("expected_share"))


def with_catalog_defaults(catalog: DataFrame) -> DataFrame:
    """A catalog may be just ``entity_id``: display name defaults to the id,
    provider to null and sort order to null."""
    defaults = {"display_name": F.col("entity_id"), "provider": F.lit(None).cast("string"),
                "sort_order": F.lit(None).cast("int")}
    out = catalog
    for c, v in defaults.items():
        if c not in catalog.columns:
            out = out.withColumn(c, v)
    return out


STATUS_COLUMNS = ["entity_id", "display_name", "provider", "sort_order", "hour", "n_signals",
                  "total", "current_share", "expected_share", "tier", "confidence",
                  "baseline_mean", "z_score", "disproportionality", "score", "status"]


def status_from_state(catalog: DataFrame, baselines: DataFrame, shares: DataFrame, current: DataFrame,
                      as_of: Column, bucket: str = "hour", labels=DEFAULT_LABELS) -> DataFrame:
    """D9 from stored state: tiers from the slot baselines at the slot of
    ``as_of``, expected shares from the shares, counts of the (possibly
    unfinished) bucket ``as_of`` from ``current`` (entity_id, hour, n).
    Entities born after ``as_of`` are not listed."""
    if "valid_from" in catalog.columns:
        catalog = catalog.where(F.col("valid_from").isNull() | (bucket_start("valid_from", bucket) <= as_of))
    t = tiers(baselines, dow(as_of), hod(as_of, bucket))
    cur = (born(current.where(F.col("hour") == as_of), catalog, bucket)
           .select("entity_id", F.col("n").cast("long").alias("n")))
    total = cur.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long")).scalar()
    df = (with_catalog_defaults(catalog).join(cur, "entity_id", "left")
                 .join(t, "entity_id", "left")
                 .join(shares.select("entity_id", "expected_share"), "entity_id", "left")
                 .withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
                 .withColumn("total", total))
    scored = score_columns(df, labels)
    return scored.select(*[c if c not in ("hour", "n_signals") else
                           (iso_hour(as_of).alias("hour") if c == "hour" else F.col("n").alias("n_signals"))
                           for c in STATUS_COLUMNS])


def status_snapshot(counts: DataFrame, catalog: DataFrame, as_of: Column, lo: Column,
                    bucket: str = "hour", labels=DEFAULT_LABELS) -> DataFrame:
    """Score every catalog entity at bucket ``as_of`` against state built
    from the buckets in [lo, as_of)."""
    hi = prev_bucket(as_of, bucket)
    counts = born(counts, catalog, bucket)
    base = slot_baselines(counts, catalog, lo, hi, bucket)
    shares = share_baselines(counts, catalog, lo, hi, bucket)
    return status_from_state(catalog, base, shares, counts, as_of, bucket, labels)


HISTORY_COLUMNS = ["entity_id", "hour", "n_signals", "total", "current_share", "expected_share",
                   "tier", "confidence", "baseline_mean", "z_score", "disproportionality",
                   "score", "status"]


def score_history(counts: DataFrame, catalog: DataFrame, lo: Column, hi: Column,
                  bucket: str = "hour", labels=DEFAULT_LABELS) -> DataFrame:
    """D9 for every entity and bucket in [lo, hi], each scored only with
    state from earlier buckets (no look-ahead)."""
    return score_replayed(slot_history(born(counts, catalog, bucket), catalog, lo, hi, bucket), labels)


def score_replayed(history: DataFrame, labels=DEFAULT_LABELS) -> DataFrame:
    """D12 columns of replayed rows."""
    df = (history.drop("n").withColumnRenamed("x", "n")
                 .withColumnRenamed("prev_share", "expected_share"))
    scored = score_columns(df, labels)
    return scored.select("entity_id", iso_hour("hour").alias("hour"),
                         F.col("n").alias("n_signals"), *HISTORY_COLUMNS[3:])


def score_entity(snapshot: DataFrame, entity: str) -> DataFrame:
    """One entity's row of the snapshot."""
    return snapshot.where(F.col("entity_id") == F.lit(entity))


def signal_result(snapshot: DataFrame, entity: str) -> DataFrame:
    """The submitter's view.  One row with ``role`` = 'self' (baseline_mean
    null -> 0) and one row per other entity with ``role`` = 'peer' and its
    catalog position ``pos`` (1-based; 0 for self)."""
    from outcry.operators.ranking import ordered_rank
    is_self = F.col("entity_id") == F.lit(entity)
    ranked = ordered_rank(snapshot, [is_self.desc(), F.col("sort_order").asc(),
                                     F.col("entity_id").asc()], "pos")
    return ranked.select(
        F.when(is_self, F.lit("self")).otherwise(F.lit("peer")).alias("role"),
        (F.col("pos") - F.lit(1)).alias("pos"),
        "entity_id", "display_name", "provider", "n_signals",
        F.when(is_self, F.coalesce("baseline_mean", F.lit(0.0)))
         .otherwise(F.col("baseline_mean")).alias("baseline_mean"),
        "z_score", "current_share", "expected_share", "disproportionality", "score", "status")


def entity_detail(counts: DataFrame, snapshot: DataFrame, catalog: DataFrame, entity: str,
                  as_of: Column, hours: int = K.TREND_BUCKETS, bucket: str = "hour") -> DataFrame:
    """One entity's metrics (baseline_mean stays null when unresolved)
    with its zero-filled trend, one row per trend bucket."""
    own = (snapshot.where(F.col("entity_id") == F.lit(entity))
                   .select("entity_id", "display_name", "provider", "n_signals", "baseline_mean",
                           "z_score", "score", "status"))
    tr = trend(counts.where(F.col("entity_id") == F.lit(entity)),
               catalog.where(F.col("entity_id") == F.lit(entity)), as_of, hours, bucket)
    tr = tr.select("entity_id", F.col("pos").alias("trend_pos"),
                   iso_hour("hour").alias("trend_hour"), F.col("n").alias("trend_n"))
    return own.join(tr, "entity_id")
