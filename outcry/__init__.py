"""outcry — crowd-signal anomaly scoring on Spark.

Signals ("somebody complained about entity X") are admitted, rate capped and
de-duplicated, counted into hourly series, folded into adaptive EWMA baselines
per (entity, weekday, hour) slot and into an EWMA of each entity's share of all
signals, then scored 1-5 against a tiered baseline.  Everything is DataFrame /
Spark SQL / Structured Streaming code.
"""

from outcry.session import get_session, ensure_utc, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "ensure_utc", "checkpoint_dir"]
