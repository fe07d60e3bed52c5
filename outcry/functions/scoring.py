"""Scalar rules as Column expressions: alpha (C1), EWMA step (C2), tier
resolution (C10), z (D1), disproportionality (D2), bands (D3/D4), combined
score (D5), label (D6) and output rounding (D7 with R1 half-up rounding).

All of these run inside jobs over whole entity x hour tables — no UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from outcry import constants as K
from outcry.labels import DEFAULT_LABELS


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _d(v: float) -> Column:
    return F.lit(float(v))


def round_half_up(x, decimals: int) -> Column:
    """JS ``Math.round(x * 10^k) / 10^k`` — halves go toward +infinity."""
    scale = float(10 ** decimals)
    return F.floor(_c(x) * _d(scale) + _d(0.5)) / _d(scale)


# ---------------------------------------------------------------- C1 / C2
def alpha(n) -> Column:
    """Adaptive smoothing factor from the sample count before the update."""
    n = _c(n).cast("double")
    return F.greatest(_d(K.ALPHA_FLOOR), _d(K.ALPHA_SCALE) / F.sqrt(F.greatest(n, _d(1.0))))


def ewma_step(mean, std, n, x, a=None) -> tuple[Column, Column, Column]:
    """One EWMA update; returns (mean', std', n').

    The first observation (n = 0) seeds mean = x, std = 5, n = 1.  Later ones use
    the *old* mean in the variance term and floor the variance at 0.01.
    ``a`` defaults to the adaptive alpha of the old count (C1).
    """
    mean, std, n = _c(mean), _c(std), _c(n)
    x = _c(x).cast("double")
    a = alpha(n) if a is None else _c(a).cast("double")
    one_minus = _d(1.0) - a
    new_mean = a * x + one_minus * mean
    diff = x - mean
    var = one_minus * (std * std + a * diff * diff)
    new_std = F.sqrt(F.greatest(var, _d(K.VARIANCE_FLOOR)))
    first = n == F.lit(0)
    return (
        F.when(first, x).otherwise(new_mean),
        F.when(first, _d(K.INITIAL_STD)).otherwise(new_std),
        (n + F.lit(1)).cast("long"),
    )


def share_step(share, total, x, n) -> tuple[Column, Column]:
    """Share EWMA update for one hour with a positive hour total.

    While the entity's lifetime total is still 0 the new share replaces the old.
    Returns (share', total').
    """
    share, total, x, n = _c(share), _c(total), _c(x), _c(n)
    a = _d(K.SHARE_ALPHA)
    blended = a * x + (_d(1.0) - a) * share
    return (F.when(total > F.lit(0), blended).otherwise(x),
            (total + n).cast("long"))


# ---------------------------------------------------------------- C10
def resolve_tier(slot_mean, slot_std, slot_n, hour_mean, hour_std, hour_n,
                 agg_mean, agg_std, agg_n) -> dict[str, Column]:
    """Slot if n>=1, else hour if n>=3, else aggregate if n>=5, else none.

    Returns Columns mean, std, confidence, tier (null mean/std when unresolved).
    """
    slot_ok = _c(slot_n) >= F.lit(K.MIN_SLOT_SAMPLES)
    hour_ok = _c(hour_n) >= F.lit(K.MIN_HOUR_SAMPLES)
    agg_ok = _c(agg_n) >= F.lit(K.MIN_AGGREGATE_SAMPLES)

    def conf(n, w):
        return F.least(_d(1.0), (_c(n).cast("double") * _d(w)) / _d(K.FULL_CONFIDENCE_SAMPLES))

    def pick(s, h, a):
        return (F.when(slot_ok, _c(s)).when(hour_ok, _c(h)).when(agg_ok, _c(a)))

    return {
        "mean": pick(slot_mean, hour_mean, agg_mean),
        "std": pick(slot_std, hour_std, agg_std),
        "confidence": pick(conf(slot_n, K.SLOT_WEIGHT), conf(hour_n, K.HOUR_WEIGHT),
                           conf(agg_n, K.AGGREGATE_WEIGHT)).otherwise(_d(0.0)),
        "tier": pick(F.lit("slot"), F.lit("hour"), F.lit("aggregate")).otherwise(F.lit("none")),
    }


# ---------------------------------------------------------------- D1 - D6
def z_score(current, mean, std) -> Column:
    """(current - mean) / sigma, sigma = std if > 0 else max(0.1 * mean, 1)."""
    mean, std = _c(mean), _c(std)
    sigma = F.when(std > _d(0.0), std).otherwise(
        F.greatest(mean * _d(K.Z_FALLBACK_SCALE), _d(1.0)))
    return (_c(current).cast("double") - mean) / sigma


def current_share(n, total) -> Column:
    """N / total, 0 when the total is 0."""
    return F.when(_c(total) > F.lit(0), _c(n).cast("double") / _c(total).cast("double")) \
            .otherwise(_d(0.0))


def disproportionality(share, expected) -> Column:
    """0 if share = 0; 2.0 if expected <= 0; else share / expected."""
    share, expected = _c(share), _c(expected)
    return (F.when(share == _d(0.0), _d(0.0))
             .when(expected <= _d(0.0), _d(K.D_NO_EXPECTATION))
             .otherwise(share / expected))


def _band(v, cuts) -> Column:
    v = _c(v)
    out = F.when(v <= _d(cuts[0]), F.lit(5))
    for score, cut in zip((4, 3, 2), cuts[1:]):
        out = out.when(v <= _d(cut), F.lit(score))
    return out.otherwise(F.lit(1))


def z_band(z) -> Column:
    """D3: z -> 5..1 (upper bounds inclusive)."""
    return _band(z, K.Z_BANDS)


def d_band(d) -> Column:
    """Disproportionality -> 5..1 (upper bounds inclusive)."""
    return _band(d, K.D_BANDS)


def combined_score(z, d, confidence) -> Column:
    """round1(clamp(3 + (0.6*s1 + 0.4*s2 - 3) * confidence, 1, 5))."""
    s1 = z_band(z).cast("double")
    s2 = d_band(d).cast("double")
    raw = _d(K.Z_WEIGHT) * s1 + _d(K.D_WEIGHT) * s2
    adjusted = _d(K.NEUTRAL_SCORE) + (raw - _d(K.NEUTRAL_SCORE)) * _c(confidence)
    return round_half_up(F.greatest(_d(1.0), F.least(_d(5.0), adjusted)), 1)


def status_label(score, labels=DEFAULT_LABELS) -> Column:
    """Label of the (rounded) score; <= 0 is the unscored label."""
    top, second, middle, low, bottom, unscored = labels
    s = _c(score)
    c1, c2, c3, c4 = K.LABEL_CUTS
    return (F.when(s <= _d(0.0), F.lit(unscored))
             .when(s < _d(c1), F.lit(bottom))
             .when(s < _d(c2), F.lit(low))
             .when(s < _d(c3), F.lit(middle))
             .when(s < _d(c4), F.lit(second))
             .otherwise(F.lit(top)))


def fmt_number(x, decimals: int) -> Column:
    """Print a pre-rounded number the way JS does: no trailing zeros, no '.0'."""
    s = F.format_string(f"%.{decimals}f", _c(x).cast("double"))
    if decimals == 0:
        return s
    trimmed = F.regexp_replace(s, "0+$", "")
    return F.regexp_replace(trimmed, r"\.$", "")
