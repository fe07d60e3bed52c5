"""Registered queries: one per operator of the inventory, each reading the
driver tables at ``sf_dir`` (whole tables) and returning a DataFrame whose
column names match the oracle SQL in ``outcry.plans.oracle``.

Bindings: EV (events, entity = event_type), EVK (entity = props.k), RET
(returned line items, daily), the part feed for catalog maintenance.
Defaults: as_of = last bucket with data; the single-entity views use
``FOCUS`` (EV) and a fixed time zone for local labels.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outcry import bindings as B
from outcry.constants import RATE_CAP, TREND_BUCKETS
from outcry.functions.keys import actor_key
from outcry.functions.scoring import round_half_up
from outcry.functions.time import bucket_start, dow, hod, iso_hour
from outcry.operators import admission as A
from outcry.operators import asof as J
from outcry.operators import baselines as C
from outcry.operators import catalog as E
from outcry.operators import counts as CN
from outcry.operators import ranking as R
from outcry.operators import replay as H
from outcry.operators import reports as RP
from outcry.plans import status as P
from outcry.plans.history import HistoryStore
from outcry.session import materialize
from outcry.sources.signals import parse_payload, table

# Fixed query parameters.
FOCUS = "error"            # entity of the single-entity views (EV)
LOCAL_TZ = "Asia/Kolkata"  # time zone of the local labels (F7)
PEERS_OF = "2"             # entity of the peer lists (EVK)
SEARCH = "o"               # search text of F3
CAP_HOUR = 1               # A7 fixture: cap per (actor, hour)
CAP_DAY = 2                # A7 fixture: cap per (actor, day)
CATALOG_MIN_ROWS = 40      # E9 threshold
SHARE_DECIMALS = 9         # printed decimals of the blocked share history
SHARE_BLOCK = 52 * 7       # its buckets in a block

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss'Z'"


# ------------------------------------------------------------------ helpers
class Ctx:
    """Frames of one binding.  Building it ingests the binding's signals once:
    the counts are written to the shared folder (sorted by bucket, so that
    Parquet statistics on ``hour`` skip row groups) and their bounds are read.
    The binding's catalog is every entity seen, so counts need no catalog filter
    and the catalog comes from the counts (one scan of the raw signals)."""

    def __init__(self, spark: SparkSession, sf_dir: str, kind: str = "ev"):
        self.spark, self.sf_dir, self.kind = spark, sf_dir, kind
        self.bucket = "day" if kind == "ret" else "hour"
        signals = {"ev": B.ev_signals, "evk": B.evk_signals, "ret": B.ret_signals}[kind](spark, sf_dir)
        self.counts = materialize(P.signal_counts(signals, None, bucket=self.bucket)
                                  .sortWithinPartitions("hour"), f"counts-{kind}")
        self.catalog = B.catalog_from(self.counts, kind)
        self.lo, self.hi = CN.bounds(self.counts)

    @property
    def as_of(self):
        return self.hi

    def before(self):
        return P.prev_bucket(self.hi, self.bucket)

    def snapshot(self):
        return P.status_snapshot(self.counts, self.catalog, self.as_of, self.lo, self.bucket)


class RecentCtx:
    """EV frames of the last ``hours`` buckets: cap, dedup and counts are per
    bucket, so only the raw signals of these buckets are read (the range is in
    the scan's pushed filters)."""

    def __init__(self, spark: SparkSession, sf_dir: str, hours: int = 1):
        last = B.ev_last_hour(spark, sf_dir)
        hour = dt.timedelta(hours=1)
        self.as_of = F.timestamp_seconds(F.lit(int(last.replace(tzinfo=dt.timezone.utc).timestamp())).cast("long"))
        self.counts = P.signal_counts(B.ev_signals(spark, sf_dir, last - (hours - 1) * hour, last + hour), None)
        self.catalog = B.ev_catalog(spark, sf_dir)


def _iso(c):
    return iso_hour(c)


# ------------------------------------------------------------------ A
def a3_parse_payload(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "props")
    out = parse_payload(ev, "props", field="k")
    return out.select(F.col("event_id").alias("signal_id"), "entity_id", "parse_status")


def a4_actor_key(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select(F.col("event_id").alias("signal_id"),
                     actor_key(F.col("user_id").cast("string")).alias("actor_key"))


def a5_time_bucket(spark, sf):
    ev = table(spark, sf, "events")
    h = bucket_start(F.col("ts").cast("timestamp"), "hour")
    return ev.select(F.col("event_id").alias("signal_id"), _iso(h).alias("hour"),
                     dow(h).alias("dow"), hod(h).alias("hod"))


def a6_known_entities(spark, sf):
    sig = B.ev_signals(spark, sf)
    return A.admit_known(sig, B.ev_partial_catalog(spark, sf)).select("signal_id", "entity_id", "actor_key")


def a6_unknown_rejects(spark, sf):
    sig = B.ev_signals(spark, sf)
    return A.unknown_rejects(sig, B.ev_partial_catalog(spark, sf)).select("signal_id", "entity_id", "actor_key")


def _first_k(spark, sf, k, bucket):
    sig = B.ev_signals(spark, sf)
    kept = A.rate_cap(A.admit_known(sig, B.ev_catalog(spark, sf)), k=k, bucket=bucket)
    return kept.select("signal_id", "entity_id", "actor_key", _iso("hour").alias("bucket"))


def a7_rate_cap_hour(spark, sf):
    return _first_k(spark, sf, CAP_HOUR, "hour")


def a7_rate_cap_day(spark, sf):
    return _first_k(spark, sf, CAP_DAY, "day")


def a8_admission_report(spark, sf):
    sig = B.ev_signals(spark, sf)
    rep = A.admission_report(sig, B.ev_partial_catalog(spark, sf), k=CAP_HOUR)
    return rep.select("reason", _iso("hour").alias("hour"), "n")


def a8_admission_tags(spark, sf):
    """Per-attempt reasons (row-level A8)."""
    sig = B.ev_signals(spark, sf)
    adm = A.admission(sig, B.ev_partial_catalog(spark, sf), k=CAP_HOUR)
    return adm.select("signal_id", "reason")


def _actorless(spark, sf):
    """EV signals in which every seventh user is unknown (null actor)."""
    return B.ev_signals(spark, sf).withColumn(
        "actor_key", F.when(F.col("actor_key").cast("long") % 7 != 0, F.col("actor_key")))


def a8_admission_tags_no_actor(spark, sf):
    """A8 with null actors: they share one quota per bucket."""
    adm = A.admission(_actorless(spark, sf), B.ev_partial_catalog(spark, sf), k=CAP_HOUR)
    return adm.select("signal_id", "reason")


def a8_admission_report_no_actor(spark, sf):
    rep = A.admission_report(_actorless(spark, sf), B.ev_partial_catalog(spark, sf), k=CAP_HOUR)
    return rep.select("reason", _iso("hour").alias("hour"), "n")


def a9_dedup(spark, sf):
    # The EV catalog is every event type, so the known-entity filter reduces to
    # "entity present" and the raw table is scanned once.
    sig = B.ev_signals(spark, sf).where(F.col("entity_id").isNotNull() & (F.col("entity_id") != ""))
    dd = A.dedup_signals(A.rate_cap(sig))
    return dd.select("signal_id", "actor_key", "entity_id", _iso("hour").alias("hour"), "dow", "hod",
                     F.date_format("created_at", ISO_SECONDS).alias("created_at"))


def a10_signal_sink(spark, sf):
    """A9 output written through the signal sink (Parquet partitioned by UTC
    date) into the shared folder and read back."""
    from outcry.session import scratch_path
    from outcry.sources.signals import write_signals
    sig = B.ev_signals(spark, sf)
    path = scratch_path(spark, "signals")
    write_signals(A.dedup_signals(A.accepted(sig, B.ev_catalog(spark, sf))), path, mode="overwrite")
    back = spark.read.parquet(path)
    return back.select("signal_id", "actor_key", "entity_id", _iso("hour").alias("hour"), "dow", "hod",
                       F.date_format("created_at", ISO_SECONDS).alias("created_at"))


# ------------------------------------------------------------------ B / F5-F7
def _counts_out(df):
    return df.select("entity_id", _iso("hour").alias("hour"), F.col("n").cast("long").alias("n"))


def b1_hourly_counts(spark, sf):
    c = Ctx(spark, sf).counts
    return c.select("entity_id", _iso("hour").alias("hour"), "n", "dow", "hod")


def b1_hourly_counts_evk(spark, sf):
    c = Ctx(spark, sf, "evk").counts
    return c.select("entity_id", _iso("hour").alias("hour"), "n", "dow", "hod")


def b2_hourly_totals(spark, sf):
    return CN.hourly_totals(Ctx(spark, sf).counts).select(_iso("hour").alias("hour"), "total")


def b3_count_at(spark, sf):
    x = RecentCtx(spark, sf)
    return CN.count_at(x.counts, FOCUS, x.as_of).select("entity_id", _iso("hour").alias("hour"), "n")


def b4_peer_counts(spark, sf):
    x = RecentCtx(spark, sf)
    return _counts_out(CN.peer_counts(x.counts, FOCUS, x.as_of))


def b5_shares(spark, sf):
    s = CN.with_share(Ctx(spark, sf).counts)
    return s.select("entity_id", _iso("hour").alias("hour"), "n", "total", "share")


def b6_dense_spine(spark, sf):
    x = Ctx(spark, sf)
    sp = CN.dense_spine(x.counts, x.catalog, x.lo, x.hi)
    return sp.select("entity_id", _iso("hour").alias("hour"), "n", "dow", "hod")


class BornCtx(Ctx):
    """EV with a catalog in which some entities exist only from a later hour."""

    def __init__(self, spark, sf):
        super().__init__(spark, sf)
        self.catalog = B.ev_born_catalog(spark, sf, self.lo)
        self.counts = CN.born(self.counts, self.catalog)


def b6_dense_spine_born(spark, sf):
    x = BornCtx(spark, sf)
    sp = CN.dense_spine(x.counts, x.catalog, x.lo, x.hi)
    return sp.select("entity_id", _iso("hour").alias("hour"), "n", "dow", "hod")


def _trend(spark, sf):
    x = RecentCtx(spark, sf, TREND_BUCKETS)
    return CN.trend(x.counts, x.catalog, x.as_of)


def b7_trend(spark, sf):
    return _trend(spark, sf).select("entity_id", "pos", _iso("hour").alias("hour"), "n")


def f5_scaled_trend(spark, sf):
    t = CN.scaled_trend(_trend(spark, sf))
    return t.select("entity_id", "pos", _iso("hour").alias("hour"), "n", "scaled")


def f6_has_signal(spark, sf):
    return CN.has_signal(_trend(spark, sf))


def f7_local_label(spark, sf):
    t = RP.with_local_label(_trend(spark, sf), LOCAL_TZ)
    return t.select("entity_id", "pos", _iso("hour").alias("hour"), "local_label")


def b0d_sink_trend(spark, sf):
    """B7 from the signal sink: the trend's bounds, known at run time, become a
    range of date partitions."""
    from outcry.sources.signals import read_signal_sink, write_signals
    path = _scratch(spark, "signals")
    cat = materialize(B.ev_catalog(spark, sf), "catalog-ev")
    write_signals(A.dedup_signals(A.accepted(B.ev_signals(spark, sf), cat)), path, mode="overwrite")
    last = B.ev_last_hour(spark, sf)
    signals = read_signal_sink(spark, path, last - dt.timedelta(hours=TREND_BUCKETS - 1), last)
    as_of = F.timestamp_seconds(F.lit(int(last.replace(tzinfo=dt.timezone.utc).timestamp())).cast("long"))
    return CN.trend(CN.hourly_counts(signals), cat, as_of).select("entity_id", "pos", _iso("hour").alias("hour"), "n")


# ------------------------------------------------------------------ C
def _state_out(df):
    return df.select("entity_id", "dow", "hod", "mean", "std", "n", _iso("last_hour").alias("last_hour"))


def c2_slot_baselines(spark, sf):
    x = Ctx(spark, sf)
    return _state_out(C.slot_baselines(x.counts, x.catalog, x.lo, x.hi))


def c2_slot_baselines_born(spark, sf):
    x = BornCtx(spark, sf)
    return _state_out(C.slot_baselines(x.counts, x.catalog, x.lo, x.hi))


def c3_slot_history(spark, sf):
    x = Ctx(spark, sf)
    h = H.slot_history(x.counts, x.catalog, x.lo, x.hi)
    return h.select("entity_id", "dow", "hod", _iso("hour").alias("hour"), "x",
                    "prev_mean", "prev_std", "prev_n", "mean", "std", "n")


TIER_COLS = C.TIER_COLUMNS


def c3b_tier_history(spark, sf):
    x = Ctx(spark, sf)
    h = H.tier_history(H.slot_history(x.counts, x.catalog, x.lo, x.hi))
    return h.select("entity_id", _iso("hour").alias("hour"), *TIER_COLS)


def _close(x: Ctx, *until: int) -> str:
    """State root after closing the history in one batch up to each of
    ``until`` (unix seconds): the batch form of the hourly job.  A batch reads
    and rewrites only the slot partitions of its buckets."""
    from outcry.streaming import jobs as G
    root = _scratch(x.spark, "state")
    closer = G.BucketCloser(x.spark, x.catalog, root)
    sec, lo = F.unix_seconds("hour"), None
    for k, hi in enumerate(until):
        part = x.counts.where((sec <= F.lit(hi)) & (F.lit(True) if lo is None else sec > F.lit(lo)))
        closer(part.select("entity_id", "hour", "n"), k, hi)
        lo = hi
    return root


def _seconds(x: Ctx) -> tuple[int, int]:
    r = x.counts.agg(F.unix_seconds(F.min("hour")).alias("lo"), F.unix_seconds(F.max("hour")).alias("hi")).first()
    return r["lo"], r["hi"]


def _applied_hour(spark, sf):
    """State through as_of - 2h, then the closed hour as_of - 1h as one batch."""
    from outcry.streaming import jobs as G
    x = Ctx(spark, sf)
    _, hi = _seconds(x)
    return G.closed_state(spark, _close(x, hi - 7200, hi - 3600))


def c4_apply_hour(spark, sf):
    """The slots after the one-bucket job: equals c2 over [lo, as_of - 1h]."""
    return _state_out(_applied_hour(spark, sf)[0])


def c4_apply_hour_shares(spark, sf):
    """The shares after the one-bucket job: equals c5 over [lo, as_of - 1h]."""
    return _applied_hour(spark, sf)[1].select("entity_id", "expected_share", "total")


def c4_close_batches(spark, sf):
    """The whole history closed in two batches through the stored-state
    closer (the second continues from the first's slot partitions and shares):
    equals the one-shot fold ``c2_slot_baselines``."""
    from outcry.streaming import jobs as G
    x = Ctx(spark, sf)
    lo, hi = _seconds(x)
    base, _ = G.closed_state(spark, _close(x, lo + (hi - lo) // 7200 * 3600, hi))
    return _state_out(base)


def c5_share_baselines(spark, sf):
    x = Ctx(spark, sf)
    return C.share_baselines(x.counts, x.catalog, x.lo, x.hi)


def c5b_share_history(spark, sf):
    x = Ctx(spark, sf)
    h = H.share_history(H.entity_series(x.counts, x.catalog, x.lo, x.hi))
    return h.select("entity_id", _iso("hour").alias("hour"), "prev_share", "prev_total",
                    "share", "lifetime_total")


def c5b_share_blocks(spark, sf):
    """C5b over several blocks of ``SHARE_BLOCK`` buckets (daily returns,
    ``SHARE_DECIMALS`` decimals): the state at every block start is a scan of
    affine maps."""
    x = Ctx(spark, sf, "ret")
    h = H.share_history(H.entity_series(x.counts, x.catalog, x.lo, x.hi, "day", block=SHARE_BLOCK))
    r = lambda c: round_half_up(c, SHARE_DECIMALS).alias(c)
    return h.select("entity_id", _iso("hour").alias("hour"), r("prev_share"), "prev_total", r("share"), "lifetime_total")


def a11_upsert(spark, sf):
    """A11 as a sink: the state through as_of - 3h, then three closed hours, each
    upserting the partitions of its slot under its own token; one write is
    aborted before its commit and tried again, one is repeated after it."""
    from outcry.sources.versions import PartitionStore
    x = Ctx(spark, sf)
    _, hi = _seconds(x)
    keys = ["entity_id", "dow", "hod"]
    store = PartitionStore(spark, _scratch(spark, "baselines"), ["dow", "hod"])
    at = lambda s: F.timestamp_seconds(F.lit(s).cast("long"))
    store.write(C.slot_baselines(x.counts, x.catalog, x.lo, at(hi - 3 * 3600)), 0)
    for token, hour in enumerate((hi - 7200, hi - 3600, hi), 1):
        def updates():
            slot = (F.col("dow") == dow(at(hour))) & (F.col("hod") == hod(at(hour)))
            return C.bucket_updates(store.read(slot), x.counts, x.catalog, at(hour))
        if token == 2:
            store.stage(store.merged(updates().withColumn("mean", F.lit(-1.0)), keys), token)  # never committed
        store.upsert(updates(), keys, token)
        if token == 3:
            store.upsert(updates(), keys, token)
    return _state_out(store.read())


def j9_state_as_of(spark, sf):
    """Stored states with validity intervals, read as of every hour in which
    an entity has a signal: the baseline and share that hour is scored with."""
    x = Ctx(spark, sf)
    hist = materialize(H.slot_history(x.counts, x.catalog, x.lo, x.hi), "history")
    slots, shares = materialize(J.state_intervals(hist), "slots"), materialize(J.share_intervals(hist), "shares")
    found = J.state_as_of(x.counts.select("entity_id", "hour"), slots, shares)
    return found.select("entity_id", _iso("hour").alias("hour"), "mean", "std", "n",
                        F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("total", F.lit(0)).cast("long").alias("total"))


def c6_lifetime_totals(spark, sf):
    x = Ctx(spark, sf)
    return C.lifetime_totals(x.counts, x.catalog, x.lo, x.hi)


def _tiers_at(x: Ctx):
    base = C.slot_baselines(x.counts, x.catalog, x.lo, x.before(), x.bucket)
    return C.tiers(base, dow(x.as_of), hod(x.as_of, x.bucket))


def c9_tiers(spark, sf):
    return _tiers_at(Ctx(spark, sf)).select("entity_id", *TIER_COLS)


def c7_hour_tier(spark, sf):
    return _tiers_at(Ctx(spark, sf)).select("entity_id", "hour_mean", "hour_std", "hour_n")


def c8_aggregate_tier(spark, sf):
    return _tiers_at(Ctx(spark, sf)).select("entity_id", "agg_mean", "agg_std", "agg_n")


def c10_resolve(spark, sf):
    from outcry.functions.scoring import resolve_tier
    t = _tiers_at(Ctx(spark, sf))
    r = resolve_tier(*TIER_COLS)
    return t.select("entity_id", r["tier"].alias("tier"), r["mean"].alias("mean"),
                    r["std"].alias("std"), r["confidence"].alias("confidence"))


# ------------------------------------------------------------------ D
def d9_status_snapshot(spark, sf):
    return Ctx(spark, sf).snapshot()


def d9_from_state(spark, sf):
    """D9 as a service answers it: the history is closed into stored state once,
    the status reads that state and the current bucket only."""
    from outcry.streaming import jobs as G
    x = Ctx(spark, sf)
    _, hi = _seconds(x)
    baselines, shares = G.closed_state(spark, _close(x, hi - 3600))
    now = RecentCtx(spark, sf)
    return P.status_from_state(now.catalog, baselines, shares, now.counts, now.as_of)


def d8_score_entity(spark, sf):
    return P.score_entity(Ctx(spark, sf).snapshot(), FOCUS)


def d10_signal_result(spark, sf):
    return P.signal_result(Ctx(spark, sf).snapshot(), FOCUS)


def d11_entity_detail(spark, sf):
    x = Ctx(spark, sf)
    return P.entity_detail(x.counts, x.snapshot(), x.catalog, FOCUS, x.as_of)


def d12_score_history(spark, sf):
    x = Ctx(spark, sf)
    return P.score_history(x.counts, x.catalog, x.lo, x.hi)


def d12_score_history_born(spark, sf):
    x = BornCtx(spark, sf)
    return P.score_history(x.counts, x.catalog, x.lo, x.hi)


def d12_score_history_evk(spark, sf):
    x = Ctx(spark, sf, "evk")
    return P.score_history(x.counts, x.catalog, x.lo, x.hi)


def ret_daily_score(spark, sf):
    x = Ctx(spark, sf, "ret")
    return P.score_history(x.counts, x.catalog, x.lo, x.hi, bucket="day")


def _history_in_batches(x: Ctx, ends) -> DataFrame:
    store = HistoryStore(x.spark, _scratch(x.spark, "history"), x.catalog, x.bucket)
    for token, end in enumerate(ends):
        store.extend(x.counts, end, token)
    store.extend(x.counts, ends[-1], len(ends) - 1)  # a batch that is run again
    return store.scored()


def d12_history_batches(spark, sf):
    """D12 grown by three batches that end inside weeks, each replayed from the
    stored state: equals the replay from the start."""
    x = Ctx(spark, sf)
    lo, hi = _seconds(x)
    step = (hi - lo) // 3600 // 3
    return _history_in_batches(x, [lo + step * 3600, lo + 2 * step * 3600 + 7200, hi])


def ret_history_batches(spark, sf):
    """The same with daily buckets."""
    x = Ctx(spark, sf, "ret")
    lo, hi = _seconds(x)
    step = (hi - lo) // 86400 // 3
    return _history_in_batches(x, [lo + step * 86400, lo + (2 * step + 3) * 86400, hi])


def ret_daily_snapshot(spark, sf):
    return Ctx(spark, sf, "ret").snapshot()


# ------------------------------------------------------------------ E
def _providers(spark):
    return E.provider_table(spark, B.PART_PROVIDERS)


def e1_list_catalog(spark, sf):
    return R.list_catalog(Ctx(spark, sf).catalog)


def e2_parse_feed(spark, sf):
    return E.parse_feed(B.part_feed(spark, sf))


def e3_map_provider(spark, sf):
    return E.map_provider(E.parse_feed(B.part_feed(spark, sf)), _providers(spark)) \
            .select("pos", "provider_key", "slug", "display_name", "provider", "sort_base")


def e4_norm_key(spark, sf):
    return E.with_norm_key(E.parse_feed(B.part_feed(spark, sf))).select("pos", "slug", "norm")


def _mapped(spark, sf):
    return E.map_provider(E.parse_feed(B.part_feed(spark, sf)), _providers(spark))


def e5_new_only(spark, sf):
    return E.new_only(_mapped(spark, sf), B.part_catalog(spark, sf)).select("pos", "slug", "norm", "provider")


def e6_first_by_key(spark, sf):
    return E.first_by_key(_mapped(spark, sf)).select("norm", "pos", "slug", "display_name", "provider")


def e7_sort_order(spark, sf):
    new = E.new_entities(B.part_feed(spark, sf), B.part_catalog(spark, sf), _providers(spark))
    return new.select("pos", "slug", "display_name", "provider", "sort_order")


def e8_merge_catalog(spark, sf):
    cat = B.part_catalog(spark, sf)
    new = E.new_entities(B.part_feed(spark, sf), cat, _providers(spark))
    return E.merge_catalog(cat, new)


def e8_dated_merges(spark, sf):
    """E8 with births: the catalog, then two editions of the feed merged at
    different times, the second merge repeated under its id."""
    feed, first = B.part_feed(spark, sf), B.part_first_edition(spark, sf)
    cat = materialize(E.dated_catalog(B.part_dated_catalog(spark, sf)), "catalog")
    times = [F.to_timestamp(F.lit(t)) for t in B.MERGE_TIMES]
    for merge, (edition, at) in enumerate(zip((first, feed, feed), [*times, times[1]]), 1):
        known = E.catalog_at(cat, at).select("entity_id")
        new = E.new_entities(edition, known, _providers(spark))
        cat = materialize(E.merge_dated(cat, new, at, min(merge, 2)), "catalog")
    return cat.select("entity_id", "display_name", "provider", "sort_order", _iso("valid_from").alias("valid_from"),
                      _iso("valid_to").alias("valid_to"), "merge_id")


def e8_merge_births(spark, sf):
    """E8 over a catalog with births, which it keeps."""
    cat = B.part_dated_catalog(spark, sf)
    new = E.new_entities(B.part_feed(spark, sf), cat, _providers(spark))
    merged = E.merge_catalog(cat, new)
    return merged.select("entity_id", "display_name", "provider", "sort_order", _iso("valid_from").alias("valid_from"), "added")


def e10_rules_table(spark, sf):
    """E10 with the rules as a table: one rule per distinct first word of the
    part names and size, and a few general ones behind them."""
    feed = B.part_feed(spark, sf)
    return E.resolve_by_rules(feed, "id", B.part_rules(spark, sf)).select("pos", "id", "entity_id")


def e9_catalog_check(spark, sf):
    expected = _mapped(spark, sf).select(F.col("slug").alias("entity_id"))
    return E.catalog_check(expected, B.part_catalog(spark, sf), CATALOG_MIN_ROWS)


def e9_catalog_complete(spark, sf):
    """E9 when nothing is missing: the summary row alone."""
    cat = B.part_catalog(spark, sf)
    return E.catalog_check(cat.select(F.upper("entity_id").alias("entity_id")), cat, CATALOG_MIN_ROWS)


def e10_resolve_alias(spark, sf):
    feed = B.part_feed(spark, sf)
    return E.resolve_alias(feed, "id", B.PART_ALIAS_RULES).select("pos", "id", "entity_id")


# ------------------------------------------------------------------ F (EVK snapshot)
def _evk_snapshot(spark, sf):
    return Ctx(spark, sf, "evk").snapshot()


LEADER_COLS = ["rank", "entity_id", "display_name", "n_signals", "score", "status"]


def f1_rank_score_desc(spark, sf):
    return R.rank_by_score(_evk_snapshot(spark, sf), "desc").select(*LEADER_COLS)


def f1_rank_score_asc(spark, sf):
    return R.rank_by_score(_evk_snapshot(spark, sf), "asc").select(*LEADER_COLS)


def f2_rank_name(spark, sf):
    return R.rank_by_name(_evk_snapshot(spark, sf), "desc").select(*LEADER_COLS)


def f2_rank_name_asc(spark, sf):
    return R.rank_by_name(_evk_snapshot(spark, sf), "asc").select(*LEADER_COLS)


def f3_search(spark, sf):
    return R.search_entities(_evk_snapshot(spark, sf), SEARCH) \
            .select("entity_id", "display_name", "provider", "score")


def f4_top_peers(spark, sf):
    return R.top_peers(_evk_snapshot(spark, sf), None).select(*LEADER_COLS)


def f4_top_peers_of(spark, sf):
    """F4 seen from one entity, which is not its own peer."""
    return R.top_peers(_evk_snapshot(spark, sf), PEERS_OF).select(*LEADER_COLS)


def f4b_first_peers_of(spark, sf):
    return R.first_peers(_evk_snapshot(spark, sf), PEERS_OF).select(*LEADER_COLS)


def f4b_first_peers(spark, sf):
    return R.first_peers(_evk_snapshot(spark, sf), None).select(*LEADER_COLS)


def f8_digest(spark, sf):
    return RP.digest(_evk_snapshot(spark, sf))


def f9_flags(spark, sf):
    return RP.with_context_flag(_evk_snapshot(spark, sf)).select("entity_id", "z_score", "score", "flag")


def f8_digest_ev(spark, sf):
    return RP.digest(Ctx(spark, sf).snapshot())


# ------------------------------------------------------------------ G (streaming)
def _event_stream(spark, sf):
    from outcry.sources.signals import stream_signals
    schema = table(spark, sf, "events").schema
    return stream_signals(spark, sf.rstrip("/"), schema, signal_id="event_id", entity="event_type",
                          actor="user_id", ts="ts", glob="events.parquet")


def _scratch(spark, name):
    from outcry.session import scratch_path
    return scratch_path(spark, name)


def g1_stream_counts(spark, sf):
    from outcry.streaming import jobs as G
    root = _scratch(spark, "g1")
    src = _event_stream(spark, sf)
    sdf = G.stream_hourly_counts(G.stream_dedup(src, B.ev_catalog(spark, sf)))
    G.run_available_now(sdf, f"{root}/ckpt", path=f"{root}/out")
    return spark.read.parquet(f"{root}/out").select("entity_id", _iso("hour").alias("hour"), "n")


def g2_stream_dedup(spark, sf):
    from outcry.streaming import jobs as G
    root = _scratch(spark, "g2")
    sdf = G.stream_dedup(_event_stream(spark, sf), B.ev_catalog(spark, sf))
    G.run_available_now(sdf.select("actor_key", "entity_id", "hour"), f"{root}/ckpt", path=f"{root}/out")
    return spark.read.parquet(f"{root}/out").select("actor_key", "entity_id", _iso("hour").alias("hour"))


SLICES = 4                 # time-ordered deliveries of the capped streams
LATE_EVERY, LATE_DAYS = 37, 3  # events held back and delivered last: every n-th of the first days


def _delivered(spark, sf, late: bool, each) -> str:
    """A folder that the events reach in ``SLICES`` deliveries, by time; ``late``
    holds some early ones back for a last delivery, far behind the watermark by
    then.  ``each`` is called after every delivery with the folder.  A delivery
    has the files of the scan that made it, so a micro-batch spreads like it."""
    root = _scratch(spark, "events")
    ev = table(spark, sf, "events")
    sec = F.unix_seconds(F.col("ts").cast("timestamp"))
    r = ev.agg(F.min(sec).alias("lo"), F.max(sec).alias("hi")).first()
    held = (F.col("event_id") % LATE_EVERY == 0) & (sec < F.lit(r["lo"] + LATE_DAYS * 86400)) if late else F.lit(False)
    step = (r["hi"] - r["lo"]) // SLICES + 1
    slices = [~held & (sec >= r["lo"] + k * step) & (sec < r["lo"] + (k + 1) * step) for k in range(SLICES)]
    for rows in slices + [held] * late:
        ev.where(rows).write.mode("append").parquet(root)
        each(root)
    return root


def _capped(spark, sf, k: int, late: bool = False, then=None, report: bool = False):
    """(root, catalog) after the rate cap ran over the delivered events, a
    delivery a micro-batch; accepted signals are in root/capped.  ``then`` is
    called after every delivery with root.  With ``report`` all attempts go
    through an ``AdmissionReport`` against the partial catalog."""
    from outcry.sources.signals import stream_signals
    from outcry.streaming import jobs as G
    root = _scratch(spark, "g")
    cat = materialize(B.ev_partial_catalog(spark, sf) if report else B.ev_catalog(spark, sf), "catalog-ev")
    schema = table(spark, sf, "events").schema
    capper = G.RateCapper(spark, f"{root}/cap", f"{root}/capped", k=k)

    def deliver(events):
        src = stream_signals(spark, events, schema, signal_id="event_id", entity="event_type", actor="user_id", ts="ts")
        if report:
            G.run_available_now(src, f"{root}/ckpt-cap",
                                foreach_batch=G.AdmissionReport(spark, cat, capper, f"{root}/report", f"{root}/rejects"))
        else:
            G.run_available_now(src.join(cat.select("entity_id"), "entity_id", "left_semi"), f"{root}/ckpt-cap",
                                foreach_batch=capper)
        if then is not None:
            then(root, events)

    _delivered(spark, sf, late, deliver)
    return root, cat


def g3_stream_rate_cap(spark, sf):
    root, _ = _capped(spark, sf, CAP_HOUR, late=True)
    return spark.read.parquet(f"{root}/capped").select("signal_id", "entity_id", "actor_key",
                                                       _iso("hour").alias("bucket"))


def g6_late_rows(spark, sf):
    """Attempts behind the watermark, per bucket."""
    from outcry.streaming import jobs as G
    root, _ = _capped(spark, sf, CAP_HOUR, late=True)
    return (G.late_attempts(spark, f"{root}/cap").groupBy("hour").agg(F.count(F.lit(1)).cast("long").alias("n"))
            .select(_iso("hour").alias("hour"), "n"))


def g6_repair(spark, sf):
    """G6, taken up: a history kept from the on-time signals, then the buckets
    of late attempts counted anew from the raw sink and the history replayed
    from the first changed one: equals the history of all signals."""
    from outcry.sources.signals import stream_signals
    from outcry.streaming import jobs as G
    schema = table(spark, sf, "events").schema

    def keep(root, events):
        src = stream_signals(spark, events, schema, signal_id="event_id", entity="event_type", actor="user_id", ts="ts")
        G.stream_signal_sink(src, f"{root}/raw", f"{root}/ckpt-raw")

    root, cat = _capped(spark, sf, CAP_HOUR, late=True, then=keep)
    counts = materialize(CN.hourly_counts(A.dedup_signals(spark.read.parquet(f"{root}/capped"))), "counts")
    r = counts.agg(F.unix_seconds(F.min("hour")).alias("lo"), F.unix_seconds(F.max("hour")).alias("hi")).first()
    store = HistoryStore(spark, f"{root}/history", cat)
    store.extend(counts, r["lo"] + (r["hi"] - r["lo"]) // 7200 * 3600, 0)
    store.extend(counts, r["hi"], 1)
    recounted, hours = G.recount(spark, f"{root}/raw", G.late_attempts(spark, f"{root}/cap"), cat, CAP_HOUR)
    store.repair(materialize(recounted, "recount"), materialize(hours, "hours"), 2)
    return store.scored()


def g7_stream_rejects(spark, sf):
    """A8 on the stream: the report of the closed buckets, and the late attempts."""
    from outcry.streaming import jobs as G
    root, _ = _capped(spark, sf, CAP_HOUR, late=True, report=True)
    return G.admission_counts(spark, f"{root}/rejects").select("reason", _iso("hour").alias("hour"), "n")


def g2_stream_refresh(spark, sf):
    """A9 on the stream: the first id and the latest time of every (actor,
    entity, hour), merged delivery by delivery."""
    from outcry.streaming import jobs as G

    def merge(root, _):
        signals = G.SignalTable(spark, f"{root}/signals")
        G.run_available_now(G.capped_stream(spark, f"{root}/capped"), f"{root}/ckpt-signals", foreach_batch=signals)

    root, _ = _capped(spark, sf, RATE_CAP, late=True, then=merge)
    return G.SignalTable(spark, f"{root}/signals").read().select(
        "signal_id", "actor_key", "entity_id", _iso("hour").alias("hour"), "dow", "hod",
        F.date_format("created_at", ISO_SECONDS).alias("created_at"))


def _closed_state(spark, sf, k: int, late: bool = False):
    """The whole chain: cap, dedup, counts, close."""
    from outcry.streaming import jobs as G
    root, cat = _capped(spark, sf, k, late)
    sdf = G.stream_hourly_counts(G.stream_dedup(G.capped_stream(spark, f"{root}/capped"), cat))
    G.run_available_now(sdf, f"{root}/ckpt", foreach_batch=G.BucketCloser(spark, cat, f"{root}/state"))
    return root, cat


def g4_hour_close(spark, sf):
    from outcry.streaming import jobs as G
    root, _ = _closed_state(spark, sf, RATE_CAP)
    base, _ = G.closed_state(spark, f"{root}/state")
    return _state_out(base)


def g4_capped_close(spark, sf):
    """The chain with a cap that binds and late attempts: equals the batch fold."""
    from outcry.streaming import jobs as G
    root, _ = _closed_state(spark, sf, CAP_HOUR, late=True)
    base, _ = G.closed_state(spark, f"{root}/state")
    return _state_out(base)


def g4_share_close(spark, sf):
    from outcry.streaming import jobs as G
    root, _ = _closed_state(spark, sf, RATE_CAP)
    _, shares = G.closed_state(spark, f"{root}/state")
    return shares.select("entity_id", "expected_share", "total")


def g5_stream_status(spark, sf):
    from outcry.streaming import jobs as G
    root, cat = _closed_state(spark, sf, RATE_CAP)
    live = (G.stream_dedup(G.capped_stream(spark, f"{root}/capped"), cat)
             .groupBy("hour", "entity_id").agg(F.count(F.lit(1)).cast("long").alias("n")))
    G.run_available_now(live, f"{root}/ckpt-live", mode="update",
                        foreach_batch=G.LiveStatus(spark, cat, f"{root}/state", f"{root}/status"))
    return G.VersionedTable(spark, f"{root}/status").latest()


NAMES = [
    "a3_parse_payload", "a4_actor_key", "a5_time_bucket", "a6_known_entities", "a6_unknown_rejects",
    "a7_rate_cap_hour", "a7_rate_cap_day", "a8_admission_report", "a8_admission_tags",
    "a8_admission_tags_no_actor", "a8_admission_report_no_actor", "a9_dedup", "a10_signal_sink",
    "b1_hourly_counts", "b1_hourly_counts_evk", "b2_hourly_totals", "b3_count_at", "b4_peer_counts",
    "b5_shares", "b6_dense_spine", "b6_dense_spine_born", "b0d_sink_trend", "b7_trend", "f5_scaled_trend", "f6_has_signal", "f7_local_label",
    "c2_slot_baselines", "c2_slot_baselines_born", "c3_slot_history", "c3b_tier_history", "c4_apply_hour", "c4_apply_hour_shares", "c4_close_batches", "c5_share_baselines",
    "a11_upsert", "c5b_share_history", "c5b_share_blocks", "j9_state_as_of", "c6_lifetime_totals", "c7_hour_tier", "c8_aggregate_tier", "c9_tiers",
    "c10_resolve",
    "d8_score_entity", "d9_status_snapshot", "d9_from_state", "d10_signal_result", "d11_entity_detail",
    "d12_score_history", "d12_score_history_born", "d12_score_history_evk", "d12_history_batches", "ret_daily_score", "ret_history_batches", "ret_daily_snapshot",
    "e1_list_catalog", "e2_parse_feed", "e3_map_provider", "e4_norm_key", "e5_new_only",
    "e6_first_by_key", "e7_sort_order", "e8_merge_catalog", "e8_merge_births", "e8_dated_merges", "e9_catalog_check", "e9_catalog_complete", "e10_resolve_alias",
    "e10_rules_table",
    "f1_rank_score_desc", "f1_rank_score_asc", "f2_rank_name", "f2_rank_name_asc", "f3_search", "f4_top_peers",
    "f4_top_peers_of", "f4b_first_peers_of", "f4b_first_peers", "f8_digest", "f8_digest_ev", "f9_flags",
    "g1_stream_counts", "g2_stream_dedup", "g3_stream_rate_cap", "g4_hour_close", "g4_capped_close", "g4_share_close",
    "g5_stream_status", "g6_late_rows", "g6_repair", "g7_stream_rejects", "g2_stream_refresh",
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: globals()[n] for n in NAMES}
