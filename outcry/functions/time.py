"""Time bucketing (A5) and time labels (F7).  All Column expressions, UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket geometry: seconds per bucket and buckets per weekly cycle.
BUCKETS = {
    "hour": (3600, 168),
    "day": (86400, 7),
}

ISO_HOUR = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bucket_start(ts, bucket: str = "hour") -> Column:
    """Truncate a timestamp to its bucket (hour or day), UTC."""
    if bucket not in BUCKETS:
        raise ValueError(f"unknown bucket {bucket!r}")
    return F.date_trunc(bucket, _c(ts))


def dow(ts) -> Column:
    """Day of week, 0 = Sunday."""
    return (F.dayofweek(_c(ts)) - F.lit(1)).cast("int")


def hod(ts, bucket: str = "hour") -> Column:
    """Hour of day; 0 for daily buckets (one slot per weekday)."""
    return F.hour(_c(ts)).cast("int") if bucket == "hour" else F.lit(0).cast("int")


def with_bucket(df, ts: str = "ts", bucket: str = "hour", out: str = "hour"):
    """A5: add bucket start, dow (0=Sun) and hod columns."""
    b = bucket_start(ts, bucket)
    return (df.withColumn(out, b)
              .withColumn("dow", dow(out))
              .withColumn("hod", hod(out, bucket)))


def slot_index(dow_col, hod_col, bucket: str = "hour") -> Column:
    """Position of a (dow, hod) slot inside the weekly cycle."""
    if bucket == "hour":
        return _c(dow_col) * F.lit(24) + _c(hod_col)
    return _c(dow_col)


def bucket_index(ts, lo, bucket: str = "hour") -> Column:
    """Whole buckets between ``lo`` and ``ts`` (both bucket starts)."""
    secs, _ = BUCKETS[bucket]
    return ((F.unix_seconds(_c(ts)) - F.unix_seconds(_c(lo))) / F.lit(secs)).cast("long")


def add_buckets(lo, n, bucket: str = "hour") -> Column:
    secs, _ = BUCKETS[bucket]
    return F.timestamp_seconds(F.unix_seconds(_c(lo)) + _c(n) * F.lit(secs))


def iso_hour(ts) -> Column:
    """Render a bucket as ``YYYY-MM-DDTHH:00:00Z`` (the wire format)."""
    return F.date_format(_c(ts), ISO_HOUR)


def local_label(ts, tz: str) -> Column:
    """local wall-clock label ``H:mm`` of a UTC bucket in time zone ``tz``."""
    return F.date_format(F.from_utc_timestamp(_c(ts), tz), "H:mm")
