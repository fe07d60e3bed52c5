"""Model constants.

Fixed values — these must equal the reference's for identical results.

EWMA slot baseline:   first observation std 5; alpha(n) = max(0.1, 0.5 / sqrt(max(n, 1)));
                      variance floor 0.01.
Share baseline:       fixed alpha 0.3.
Tier minimum samples: slot 1, hour 3, aggregate 5.
Confidence:           min(1, samples * weight / 10) with weights slot 3, hour 1.5, aggregate 0.5.
Combined score:       neutral 3; weights z-band 0.6, d-band 0.4; clamp [1, 5]; one decimal.
z bands (upper bounds inclusive): -1.0 -> 5, 0.5 -> 4, 1.5 -> 3, 2.5 -> 2, else 1.
d bands (upper bounds inclusive):  0.5 -> 5, 0.8 -> 4, 1.2 -> 3, 1.5 -> 2, else 1.
z fallback std:       max(0.1 * mean, 1) when std <= 0.
d when expected <= 0: 2.0.
Label cut points on the rounded score: <=0 unscored, <1.5, <2.5, <3.5, <4.5, else top.
Rate cap:             30 accepted attempts per actor per hour.
Trend length:         24 buckets.
Peers listed:         5; unscored peers sort as 99.
"""

INITIAL_STD = 5.0
ALPHA_FLOOR = 0.1
ALPHA_SCALE = 0.5
VARIANCE_FLOOR = 0.01
SHARE_ALPHA = 0.3

MIN_SLOT_SAMPLES = 1
MIN_HOUR_SAMPLES = 3
MIN_AGGREGATE_SAMPLES = 5
FULL_CONFIDENCE_SAMPLES = 10.0
SLOT_WEIGHT = 3.0
HOUR_WEIGHT = 1.5
AGGREGATE_WEIGHT = 0.5

NEUTRAL_SCORE = 3.0
Z_WEIGHT = 0.6
D_WEIGHT = 0.4
Z_BANDS = (-1.0, 0.5, 1.5, 2.5)
D_BANDS = (0.5, 0.8, 1.2, 1.5)
Z_FALLBACK_SCALE = 0.1
D_NO_EXPECTATION = 2.0
LABEL_CUTS = (1.5, 2.5, 3.5, 4.5)

RATE_CAP = 30
TREND_BUCKETS = 24
TOP_PEERS = 5
UNSCORED_SORT_VALUE = 99.0

# Tier rounding before banding: tier means/stds that are averages can differ in
# the last bits between engines (summation order), so they are rounded here.
TIER_DECIMALS = 9
