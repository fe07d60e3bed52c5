"""Key derivation: actor key (A4) and catalog normalisation key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_ADDRESS = "0.0.0.0"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def actor_key(*address_cols, default: str = DEFAULT_ADDRESS) -> Column:
    """A4: SHA-256 hex of the first non-empty address column, else ``default``.

    The whole column value is hashed (a forwarded-for list is not split).
    """
    candidates = [F.nullif(_c(c).cast("string"), F.lit("")) for c in address_cols]
    return F.sha2(F.coalesce(*candidates, F.lit(default)), 256)


def norm_key(c) -> Column:
    """Lower-case and strip everything outside ``[a-z0-9]``."""
    return F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]", "")
