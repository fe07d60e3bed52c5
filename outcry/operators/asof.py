"""As-of reads.  ``asof_join`` gives every row of the left frame the latest
row of the right frame before it (sort-merge over the union of both);
``state_intervals`` and ``state_as_of`` apply it to stored baselines.

Time is cut into ranges.  The last right row of each (key, range) is carried to
the later ranges of the key by a window over ranges, and the rows of a range
then meet on their own, after the row carried into it.  A key with a long or a
hot history so spreads over as many tasks as it has ranges, and no task sees
more of a key than a range's rows (in order, streamed) or its list of ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outcry.functions.time import BUCKETS, dow, hod

#: Seconds of a time range.
RANGE = 28 * 86400


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str,
              take: list[str], seconds: int = RANGE, inclusive: bool = False) -> DataFrame:
    """``left`` with the columns ``take`` of the latest row of ``right`` with
    equal ``on`` (null equals null) and ``right_time`` before ``left_time`` (or
    at it, if ``inclusive``); null where there is none.  Left rows without a
    time get nulls; ``right`` has at most one row per key and time (of several,
    the greatest by ``take`` counts); ``take`` must not name columns of ``left``."""
    span = lambda c: F.floor(F.unix_seconds(c) / F.lit(seconds)).cast("long")
    found = F.struct(*[F.col(c) for c in take])
    states = right.where(F.col(right_time).isNotNull()).select(
        *on, span(right_time).alias("_span"), F.col(right_time).alias("_t"), found.alias("_found"))
    probes = left.select(*on, span(left_time).alias("_span"), F.col(left_time).alias("_t"), F.struct(*left.columns).alias("_row"))
    none_found, none_row = F.lit(None).cast(states.schema["_found"].dataType), F.lit(None).cast(probes.schema["_row"].dataType)
    # What each range begins with: the last state of the ranges before it.
    ends = states.groupBy(*on, "_span").agg(F.max(F.struct("_t", "_found"))["_found"].alias("_found"))
    asked = probes.select(*on, "_span").distinct().withColumn("_found", none_found)
    ranges = ends.unionByName(asked).groupBy(*on, "_span").agg(F.max("_found").alias("_found"))
    earlier = Window.partitionBy(*on).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.withColumn("_found", F.last("_found", ignorenulls=True).over(earlier)).where(F.col("_found").isNotNull())
    kind = {"carried": 0, "state": 1 if inclusive else 2, "probe": 2 if inclusive else 1}
    columns = [*on, "_span", "_t", "_kind", "_found", "_row"]
    first = F.lit(None).cast(states.schema["_t"].dataType)
    rows = (carried.select(*on, "_span", first.alias("_t"), F.lit(kind["carried"]).alias("_kind"), "_found", none_row.alias("_row"))
            .union(states.withColumn("_kind", F.lit(kind["state"])).withColumn("_row", none_row).select(*columns))
            .union(probes.withColumn("_kind", F.lit(kind["probe"])).withColumn("_found", none_found).select(*columns)))
    upto = (Window.partitionBy(*on, "_span").orderBy(F.col("_t").asc_nulls_first(), "_kind", "_found")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = rows.withColumn("_met", F.when(F.col("_t").isNotNull(), F.last("_found", ignorenulls=True).over(upto)))
    return met.where(F.col("_row").isNotNull()).select("_row.*", *[F.col(f"_met.{c}").alias(c) for c in take])


def state_intervals(history: DataFrame) -> DataFrame:
    """Slot states of a replayed history with their validity: a state holds for
    the buckets after ``valid_from`` up to and with ``valid_to`` (null: still)."""
    w = Window.partitionBy("entity_id", "dow", "hod").orderBy("hour")
    return history.select("entity_id", "dow", "hod", F.col("hour").alias("valid_from"), F.lead("hour").over(w).alias("valid_to"),
                          "mean", "std", "n")


def share_intervals(history: DataFrame) -> DataFrame:
    """Share states with their validity, as ``state_intervals``; buckets that
    change nothing open no interval."""
    changed = (~F.col("share").eqNullSafe(F.col("prev_share"))) | (F.col("lifetime_total") != F.col("prev_total"))
    w = Window.partitionBy("entity_id").orderBy("hour")
    return (history.where(changed).select("entity_id", F.col("hour").alias("valid_from"), F.lead("hour").over(w).alias("valid_to"),
                                          "share", F.col("lifetime_total").alias("total")))


def state_as_of(probes: DataFrame, slots: DataFrame, shares: DataFrame | None = None, bucket: str = "hour",
                hour: str = "hour") -> DataFrame:
    """The baseline that any (entity_id, hour) is scored with: ``probes`` with
    mean, std and n of the slot and, given ``shares``, share and total, all from
    buckets before the hour.  Equal probes are looked up once."""
    secs, period = BUCKETS[bucket]
    asked = probes.select("entity_id", F.col(hour).alias("_hour")).distinct()
    asked = asked.withColumn("dow", dow("_hour")).withColumn("hod", hod("_hour", bucket))
    # A slot has a state a week: ranges of many weeks.
    found = asof_join(asked, slots, ["entity_id", "dow", "hod"], "_hour", "valid_from", ["mean", "std", "n"], RANGE * period)
    take = ["mean", "std", "n"]
    if shares is not None:
        found = asof_join(found, shares, ["entity_id"], "_hour", "valid_from", ["share", "total"])
        take += ["share", "total"]
    key = [F.col("_e"), F.col("_h")]
    looked = found.select(F.col("entity_id").alias("_e"), F.col("_hour").alias("_h"), *take)
    met = probes.join(looked, probes["entity_id"].eqNullSafe(key[0]) & probes[hour].eqNullSafe(key[1]))
    return met.drop("_e", "_h")


def valid_at(intervals: DataFrame, hour: Column) -> DataFrame:
    """The states that hold for one bucket."""
    return intervals.where((F.col("valid_from") < hour) & (F.col("valid_to").isNull() | (F.col("valid_to") >= hour)))
