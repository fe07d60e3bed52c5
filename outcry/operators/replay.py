"""Histories: slot state, as-of tiers and share state before and after every
bucket of every entity (C3, C3b, C5b), from the start or from a stored state.

The range is cut into blocks of ``BLOCK`` buckets (whole weekly cycles, aligned
to absolute time, so blocks of different runs are the same).  A block of an
entity is replayed on its own, given the state before it, so one entity's
history spreads over as many tasks as it has blocks:

* slots: the fold of C2 leaves its state at every block start on the way
  (``aggregate`` over weeks, one row per entity and slot, JVM-side);
* shares: a bucket's update is an affine map of the share (1 or 0.7 times it
  plus a constant), so the buckets of a block compose to one map, summed by a
  plain aggregate, and the state at any block start is a scan over the maps of
  the blocks before.  The scan stops ``WARM`` buckets before a block and the
  replay runs through those first: the recurrence forgets its start at 0.7 per
  active bucket, so what it then writes has the bits of a sequential run.

Within a block the slot recurrence runs week by week and the share recurrence
bucket by bucket, vectorised over entities.  Only sparse rows are exchanged;
the dense rows come into being where they are replayed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outcry import constants as K
from outcry.functions.time import BUCKETS, dow, hod, slot_index
from outcry.operators.baselines import TIER_COLUMNS, fold_state, slot_frame
from outcry.operators.counts import birth_index, hourly_totals

#: Buckets of a block: 8 weeks of hours, 576 weeks of days.  A block has to hold
#: some thousand rows of an entity to outweigh the state it begins with.
BLOCK = {"hour": 8 * 168, "day": 576 * 7}
#: Buckets before a block from which the share recurrence runs.
WARM = 168
#: Entities replayed together.
ENTITIES = 64

#: What the replay writes; tiers of slots are the prev_ columns.
_SCHEMA = T.StructType([T.StructField(n, t) for n, t in [
    ("entity_id", T.StringType()), ("hour", T.TimestampType()), ("dow", T.IntegerType()), ("hod", T.IntegerType()),
    ("x", T.LongType()), ("total", T.LongType()),
    ("prev_mean", T.DoubleType()), ("prev_std", T.DoubleType()), ("prev_n", T.LongType()),
    ("mean", T.DoubleType()), ("std", T.DoubleType()), ("n", T.LongType()),
    ("prev_share", T.DoubleType()), ("prev_total", T.LongType()),
    ("share", T.DoubleType()), ("lifetime_total", T.LongType()),
    ("hour_mean", T.DoubleType()), ("hour_std", T.DoubleType()), ("hour_n", T.LongType()),
    ("agg_mean", T.DoubleType()), ("agg_std", T.DoubleType()), ("agg_n", T.LongType())]])

#: State before a range: (entity_id, slots, share, total); ``slots`` holds
#: (slot, mean, std, n) of the slots seen so far.
STATE_SCHEMA = ("entity_id string, slots array<struct<slot:int,mean:double,std:double,n:bigint>>, "
                "share double, total bigint")


# ------------------------------------------------------------------ kernel
def _np_round9(x):
    """R1 half-up rounding to the tier decimals, numpy version."""
    scale = float(10 ** K.TIER_DECIMALS)
    return np.floor(x * scale + 0.5) / scale


def _split(cur, prev, rows):
    """Sums over the ``rows`` of the slot layout (entities x rows x columns) of
    this week's values before a slot and last week's from it on."""
    c, p = (a.reshape(len(a), rows, -1) for a in (cur, prev))
    before = np.cumsum(c, axis=1) - c
    after = np.cumsum(p[:, ::-1], axis=1)[:, ::-1]
    return (before + after).reshape(len(cur), -1)


def _slot_states(x, ok, mean, std, n, daily):
    """Slot states before and after every bucket and tiers before it; ``x`` and
    ``ok`` (observed) are entities x weeks x slots."""
    weeks, period = x.shape[1:]
    out = {k + c: np.empty(x.shape, np.int64 if c == "n" else np.float64)
           for k in ("prev_", "", "hour_", "agg_") for c in ("mean", "std", "n")}
    # Hour tier: slots with the same hour of day, a column of the 7 x 24 layout
    # (daily buckets: every weekday slot, one column of 7); aggregate tier: all
    # slots in one column.
    tiers = {"hour": period if daily else 7, "agg": period}
    for w in range(weeks):
        out["prev_mean"][:, w], out["prev_std"][:, w], out["prev_n"][:, w] = mean, std, n
        last = mean, std, n
        xv, v = x[:, w], ok[:, w]
        a = np.maximum(K.ALPHA_FLOOR, K.ALPHA_SCALE / np.sqrt(np.maximum(n.astype(np.float64), 1.0)))
        diff = xv - mean
        next_mean = a * xv + (1.0 - a) * mean
        next_std = np.sqrt(np.maximum((1.0 - a) * (std * std + a * diff * diff), K.VARIANCE_FLOOR))
        first = n == 0
        mean = np.where(v, np.where(first, xv, next_mean), mean)
        std = np.where(v, np.where(first, K.INITIAL_STD, next_std), std)
        n = np.where(v, n + 1, n)
        out["mean"][:, w], out["std"][:, w], out["n"][:, w] = mean, std, n
        # Before bucket (w, s) a slot's state is this week's for earlier slots and last week's otherwise.
        seen, seen_last = n > 0, last[2] > 0
        for tier, rows in tiers.items():
            count = _split(seen.astype(np.int64), seen_last.astype(np.int64), rows)
            with np.errstate(invalid="ignore", divide="ignore"):
                out[tier + "_mean"][:, w] = _np_round9(_split(mean * seen, last[0] * seen_last, rows) / count)
                out[tier + "_std"][:, w] = _np_round9(_split(std * seen, last[1] * seen_last, rows) / count)
            out[tier + "_n"][:, w] = _split(n * seen, last[2] * seen_last, rows)
    return out


def _shares(x, totals, share, total, skip):
    """Share states before and after every bucket from ``skip`` on; ``x`` is
    entities x buckets."""
    e, h = x.shape
    out = {"prev_share": np.empty((e, h - skip)), "prev_total": np.empty((e, h - skip), np.int64),
           "share": np.empty((e, h - skip)), "lifetime_total": np.empty((e, h - skip), np.int64)}
    for i, t in enumerate(totals.tolist()):
        if i >= skip:
            out["prev_share"][:, i - skip], out["prev_total"][:, i - skip] = share, total
        if t > 0:
            cur = x[:, i] / t
            share = np.where(total > 0, K.SHARE_ALPHA * cur + (1.0 - K.SHARE_ALPHA) * share, cur)
            total = total + x[:, i]
        if i >= skip:
            out["share"][:, i - skip], out["lifetime_total"][:, i - skip] = share, total
    return out


def _replayed(entities, x, totals, born, seconds, skip, state, daily):
    """Rows of one block for some entities.  ``x`` and ``totals`` begin ``skip``
    buckets before the block, ``seconds`` and ``born`` (first observed bucket) do not."""
    mean, std, n, share, total = state
    period = 7 if daily else 168
    h = len(seconds)
    dow = (seconds // 86400 + 4) % 7  # 1970-01-01 was a Thursday; 0 = Sunday
    hod = np.zeros(h, np.int64) if daily else seconds // 3600 % 24
    off = int(dow[0] if daily else dow[0] * 24 + hod[0])
    weeks = -(-(off + h) // period)
    observed = np.arange(h) >= born[:, None]
    xs = np.zeros((len(x), weeks * period))
    ok = np.zeros(xs.shape, bool)
    xs[:, off:off + h], ok[:, off:off + h] = x[:, skip:], observed
    shape = len(x), weeks, period
    cols = {k: v.reshape(len(x), -1)[:, off:off + h] for k, v in
            _slot_states(xs.reshape(shape), ok.reshape(shape), mean, std, n, daily).items()}
    cols |= _shares(x, totals, share, total, skip)
    who, when = np.nonzero(observed)
    flat = {k: v[observed] for k, v in cols.items()}
    missing = {c: flat[s] == 0 for c, s in [("prev_mean", "prev_n"), ("prev_std", "prev_n")] + [
        (f"{t}_{c}", f"{t}_n") for t in ("hour", "agg") for c in ("mean", "std", "n")]}
    kinds = {T.DoubleType(): pa.float64(), T.LongType(): pa.int64()}
    arrays = {"entity_id": pa.array(entities, pa.string()).take(pa.array(who)),
              "hour": pa.array(seconds[when] * 1_000_000, pa.int64()).cast(pa.timestamp("us", "UTC")),
              "dow": pa.array(dow[when].astype(np.int32)), "hod": pa.array(hod[when].astype(np.int32)),
              "x": pa.array(x[:, skip:][observed]), "total": pa.array(totals[skip:][when])}
    for f in _SCHEMA.fields[6:]:
        arrays[f.name] = pa.array(flat[f.name], kinds[f.dataType], mask=missing.get(f.name))
    return pa.RecordBatch.from_pydict(arrays)


# ------------------------------------------------------------------ series
def _numbers(spark: SparkSession, lo: Column, hi: Column, secs: int) -> tuple[int, int]:
    """Bucket numbers (since 1970) of two bucket starts; literals need no job."""
    r = spark.sql("VALUES (1)").select(F.unix_seconds(lo).alias("lo"), F.unix_seconds(hi).alias("hi")).first()
    return r["lo"] // secs, r["hi"] // secs


class Series:
    """Input of ``replay``: ``rows`` has one row per entity and block with its
    sparse observations and the state before it."""

    def __init__(self, rows: DataFrame, totals: np.ndarray, lo: int, hi: int, bucket: str, block: int):
        self.rows, self.totals, self.lo, self.hi, self.bucket, self.block = rows, totals, lo, hi, bucket, block


def _slot_seeds(counts: DataFrame, catalog: DataFrame, lo: Column, hi: Column, bucket: str,
                size: int, first: int, blocks: range, seed: DataFrame | None) -> DataFrame:
    """(entity_id, block, slots): the states of all slots at the start of
    ``blocks``, left behind by one fold over the weeks."""
    _, period = BUCKETS[bucket]
    dated = counts.select("entity_id", "hour", "n", dow("hour").alias("dow"), hod("hour", bucket).alias("hod"))
    sf = slot_frame(dated, catalog, lo, hi, bucket).withColumn("slot", slot_index("dow", "hod", bucket))
    none = F.lit(None).cast("struct<mean:double,std:double,n:bigint>")
    if seed is None:
        sf = sf.withColumn("_seed", none)
    else:
        old = seed.select("entity_id", F.explode("slots").alias("s")).select(
            "entity_id", F.col("s.slot").alias("slot"), F.struct("s.mean", "s.std", "s.n").alias("_seed"))
        sf = sf.join(old, ["entity_id", "slot"], "left")
    kind = "struct<mean:double,std:double,n:bigint,p:int>"
    begin = F.struct(F.coalesce(F.col("_seed.mean"), F.lit(0.0)).alias("mean"), F.coalesce(F.col("_seed.std"), F.lit(0.0)).alias("std"),
                     F.coalesce(F.col("_seed.n"), F.lit(0).cast("long")).alias("n"), F.lit(0).alias("p")).cast(kind)
    # Weeks of the slot before the start of block b.
    weeks = lambda b: F.least(F.col("n_weeks"), F.greatest(F.lit(0).cast("long"), F.ceil(
        (b * F.lit(size) - F.lit(first) - F.col("i0")) / F.lit(period)).cast("long")))
    acc_kind = f"struct<done:bigint,now:{kind},out:array<struct<block:bigint,mean:double,std:double,n:bigint>>>"

    def step(acc, b):
        upto = weeks(b)
        walked = F.aggregate(F.sequence(F.col("w0") + acc["done"], F.col("w0") + upto - 1), acc["now"],
                             lambda a, w: fold_state(a, w).cast(kind))
        now = F.when(upto > acc["done"], walked).otherwise(acc["now"])
        kept = F.struct(b.alias("block"), now["mean"].alias("mean"), now["std"].alias("std"), now["n"].alias("n"))
        return F.struct(upto.alias("done"), now.alias("now"), F.concat(acc["out"], F.array(kept)).alias("out")).cast(acc_kind)

    init = F.struct(F.lit(0).cast("long").alias("done"), begin.alias("now"),
                    F.array().cast("array<struct<block:bigint,mean:double,std:double,n:bigint>>").alias("out")).cast(acc_kind)
    starts = F.array(*[F.lit(b).cast("long") for b in blocks])
    out = sf.select("entity_id", "slot", F.explode(F.aggregate(starts, init, step)["out"]).alias("s"))
    return (out.where(F.col("s.n") > 0).groupBy("entity_id", F.col("s.block").alias("block"))
            .agg(F.collect_list(F.struct("slot", "s.mean", "s.std", "s.n")).alias("slots")))


def share_scan(counts: DataFrame, totals: DataFrame, ends: list[int],
               seed: DataFrame | None = None) -> DataFrame:
    """C5b, blocked: (entity_id, part, share, total), the share state before the
    bucket ``ends[part]`` (ascending bucket numbers) by composition of affine maps.

    ``counts``: (entity_id, a, n) and ``totals``: (a, t) with bucket numbers
    ``a``.  A bucket of positive total maps share s to
    0.3 n/t + 0.7 s, the entity's first one to n/t; the maps between two ends
    compose to 0.7**k s + B, where k counts active buckets and B is a sum over
    the entity's observations, each decayed by the active buckets behind it."""
    keep = 1.0 - K.SHARE_ALPHA
    edge = F.array(*[F.lit(e).cast("long") for e in ends])
    part = F.size(F.filter(edge, lambda e: e <= F.col("a")))  # number of ends passed
    timed = totals.where((F.col("t") > 0) & (F.col("a") < F.lit(ends[-1]))).withColumn("part", part)
    # One row per bucket; a part holds at most the buckets of a block.
    behind = F.count(F.lit(1)).over(Window.partitionBy("part").orderBy("a").rowsBetween(1, Window.unboundedFollowing))
    timed = timed.withColumn("decay", F.pow(F.lit(keep), behind))
    maps = (counts.where(F.col("n") > 0).join(timed, "a").withColumn("v", F.col("n") / F.col("t") * F.col("decay"))
            .groupBy("entity_id", "part").agg((F.sum("v") * F.lit(K.SHARE_ALPHA)).alias("b"), F.sum("n").cast("long").alias("n"),
                                              F.min(F.struct("a", "v"))["v"].alias("head")))
    lists = maps.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("part", "b", "n", "head"))).alias("maps"))
    counted = timed.groupBy("part").agg(F.count(F.lit(1)).cast("int").alias("k"))
    spine = counts.sparkSession.range(len(ends)).select(F.col("id").cast("int").alias("part")).join(counted, "part", "left")
    ks = spine.agg(F.sort_array(F.collect_list(F.struct("part", F.coalesce("k", F.lit(0)).alias("k"))))).scalar()
    if seed is not None:
        lists = lists.join(seed.select("entity_id", F.col("share").alias("_s"), F.col("total").alias("_t")), "entity_id", "full_outer")
    else:
        lists = lists.withColumn("_s", F.lit(0.0)).withColumn("_t", F.lit(0).cast("long"))
    kind = "struct<s:double,t:bigint,p:int,out:array<struct<part:int,share:double,total:bigint>>>"
    none = F.array().cast("array<struct<part:int,share:double,total:bigint>>")
    init = F.struct(F.coalesce("_s", F.lit(0.0)).alias("s"), F.coalesce("_t", F.lit(0).cast("long")).alias("t"),
                    F.lit(0).alias("p"), none.alias("out")).cast(kind)

    def step(acc, e):
        own = F.try_element_at(F.col("maps"), acc["p"] + 1)
        met = F.coalesce(own["part"] == e["part"], F.lit(False))
        head = F.when(acc["t"] == 0, F.lit(keep) * own["head"]).otherwise(F.lit(0.0))
        s = F.pow(F.lit(keep), e["k"]) * acc["s"] + F.when(met, own["b"] + head).otherwise(F.lit(0.0))
        t = acc["t"] + F.when(met, own["n"]).otherwise(F.lit(0))
        done = F.struct(e["part"].alias("part"), s.alias("share"), t.alias("total"))
        return F.struct(s.alias("s"), t.alias("t"), (acc["p"] + F.when(met, 1).otherwise(0)).alias("p"),
                        F.concat(acc["out"], F.array(done)).alias("out")).cast(kind)

    scanned = F.aggregate(F.col("_ks"), init, step)["out"]
    return lists.withColumn("_ks", ks).select("entity_id", F.explode(scanned).alias("s")).select("entity_id", "s.*")


def entity_series(counts: DataFrame, catalog: DataFrame, lo: Column, hi: Column, bucket: str = "hour",
                  seed: DataFrame | None = None, block: int | None = None) -> Series:
    """The replay's input for the buckets [lo, hi]; ``seed`` (``STATE_SCHEMA``)
    is the state before ``lo``, none for a history from the start; ``block`` is
    the number of buckets of a block (whole cycles), by default ``BLOCK``."""
    secs, period = BUCKETS[bucket]
    size = block or BLOCK[bucket]
    if size % period:
        raise ValueError(f"a block must hold whole cycles of {period} buckets")
    warm = min(WARM, size)  # within the block before
    first, last = _numbers(counts.sparkSession, lo, hi, secs)
    blocks = range(first // size, last // size + 1)
    numbered = (counts.where((F.col("hour") >= lo) & (F.col("hour") <= hi))
                .select("entity_id", "hour", (F.unix_seconds("hour") / F.lit(secs)).cast("long").alias("a"), F.col("n").cast("long").alias("n")))
    born = catalog.select("entity_id", (F.lit(first) + birth_index(catalog, lo, bucket)).alias("_born"))
    by_bucket = hourly_totals(numbered).select((F.unix_seconds("hour") / F.lit(secs)).cast("long").alias("a"), F.col("total").alias("t"))
    # One number per bucket of the range: what every entity's share is taken of.
    totals = np.zeros(last - first + 1, np.int64)
    for r in by_bucket.collect():
        totals[r["a"] - first] = r["t"]
    own = numbered
    if "valid_from" in catalog.columns:
        own = numbered.join(born, "entity_id").where(F.col("a") >= F.col("_born")).drop("_born")
    of = F.floor(F.col("a") / F.lit(size)).cast("long")
    # The last buckets of a block also warm up the next one.
    held = F.when((F.col("a") >= (of + 1) * F.lit(size) - F.lit(warm)) & (of < F.lit(blocks[-1])),
                  F.array(of, of + 1)).otherwise(F.array(of))
    obs = (own.withColumn("_block", F.explode(held)).groupBy("entity_id", "_block")
           .agg(F.collect_list(F.struct("a", "n")).alias("_obs")))
    rows = (born.withColumn("_block", F.explode(F.sequence(F.lit(blocks[0]).cast("long"), F.lit(blocks[-1]).cast("long"))))
            .where(F.col("_born") < (F.col("_block") + 1) * F.lit(size)).where(F.col("_born") <= F.lit(last))
            .join(obs, ["entity_id", "_block"], "left"))
    state = None
    if seed is not None:
        state = seed.select("entity_id", F.lit(blocks[0]).cast("long").alias("_block"), "slots", "share", "total")
    if len(blocks) > 1:
        slots = _slot_seeds(counts, catalog, lo, hi, bucket, size, first, blocks[1:], seed)
        ends = [max(b * size - warm, first) for b in blocks[1:]]
        shares = share_scan(own.select("entity_id", "a", "n"), by_bucket, ends, seed)
        later = (slots.withColumnRenamed("block", "_block")
                 .join(shares.select("entity_id", (F.lit(blocks[1]) + F.col("part")).cast("long").alias("_block"), "share", "total"),
                       ["entity_id", "_block"], "full_outer").select("entity_id", "_block", "slots", "share", "total"))
        state = later if state is None else state.unionByName(later)
    if state is None:
        none = {"slots": T._parse_datatype_string(STATE_SCHEMA)["slots"].dataType, "share": "double", "total": "long"}
        rows = rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    else:
        rows = rows.join(state, ["entity_id", "_block"], "left")
    rows = rows.select(
        "entity_id", "_block", "_born", F.col("_obs.a").alias("_a"), F.col("_obs.n").alias("_n"),
        *[F.col(f"slots.{c}").alias(f"_{c}s") for c in ("slot", "mean", "std", "n")], "share", "total")
    return Series(rows, totals, first, last, bucket, size)


def replay(series: Series) -> DataFrame:
    """C3 + C3b + C5b: slot state, as-of tiers and share state before and after
    every bucket of every entity from its birth on."""
    secs, period = BUCKETS[series.bucket]
    size, daily = series.block, series.bucket == "day"
    totals, lo, hi = series.totals, series.lo, series.hi
    spark = series.rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def lists(column):
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), sizes)

    def some(rows, block):
        begin, end = max(block * size, lo), min((block + 1) * size - 1, hi)
        skip = min(WARM, size, begin - lo) if begin > lo else 0
        e = rows.num_rows
        x = np.zeros((e, end - begin + 1 + skip), np.int64)
        at, who = lists(rows.column("_a"))
        place = at - begin + skip
        inside = (place >= 0) & (place < x.shape[1])
        x[who[inside], place[inside]] = lists(rows.column("_n"))[0][inside]
        mean, std, n = np.zeros((e, period)), np.zeros((e, period)), np.zeros((e, period), np.int64)
        at, who = lists(rows.column("_slots"))
        for name, target in (("_means", mean), ("_stds", std), ("_ns", n)):
            target[who, at] = lists(rows.column(name))[0]
        number = lambda c: np.array([v or 0 for v in rows.column(c).to_pylist()])
        born = np.maximum(rows.column("_born").to_numpy() - begin, 0)
        seconds = np.arange(begin, end + 1, dtype=np.int64) * secs
        return _replayed(rows.column("entity_id"), x, totals[begin - skip - lo:end + 1 - lo], born, seconds, skip,
                         (mean, std, n, number("share").astype(float), number("total").astype(np.int64)), daily)

    def run(batches):
        for b in batches:
            block = b.column("_block").to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(block)]))
            for s, e in zip(edges, edges[1:]):
                for k in range(s, e, ENTITIES):
                    yield some(b.slice(k, min(ENTITIES, e - k)), int(block[s]))

    # Not the columns themselves: a repartition by keys that already hash the
    # rows would be dropped, and the replay would run in one coalesced task.
    spread = series.rows.repartition(parts, F.xxhash64("entity_id", "_block")).sortWithinPartitions("_block")
    out = spread.mapInArrow(run, _SCHEMA)
    return out.select(*[c for c in out.columns if c not in TIER_COLUMNS], F.col("prev_mean").alias("slot_mean"),
                      F.col("prev_std").alias("slot_std"), F.when(F.col("prev_n") > 0, F.col("prev_n")).alias("slot_n"),
                      *TIER_COLUMNS[3:])


def slot_history(counts: DataFrame, catalog: DataFrame, lo: Column, hi: Column, bucket: str = "hour",
                 seed: DataFrame | None = None) -> DataFrame:
    """One row per entity and bucket in [lo, hi] with the slot state before
    (prev_*) and after the bucket's observation x (see ``replay``)."""
    return replay(entity_series(counts, catalog, lo, hi, bucket, seed))


def tier_history(history: DataFrame) -> DataFrame:
    """Tiers as of each bucket (state from earlier buckets only), which
    the replay computes in the same pass."""
    return history.select("entity_id", "hour", *TIER_COLUMNS)


def share_history(series: Series) -> DataFrame:
    """Share state before and after every bucket (from the replay)."""
    return replay(series).select("entity_id", "hour", "prev_share", "prev_total", "share", "lifetime_total")


def state_after(history: DataFrame, bucket: str = "hour") -> DataFrame:
    """The state (``STATE_SCHEMA``) after the rows of a history: the latest
    state of every slot and share.  The last cycle holds every slot once, so a
    history of a cycle before a bucket is enough to go on from there."""
    slot = slot_index("dow", "hod", bucket)
    last = history.groupBy("entity_id", slot.alias("slot")).agg(
        F.max(F.struct("hour", "mean", "std", "n", "share", "lifetime_total")).alias("s"))
    return (last.groupBy("entity_id").agg(
        F.collect_list(F.struct(F.col("slot").cast("int").alias("slot"), "s.mean", "s.std", F.col("s.n").alias("n"))).alias("slots"),
        F.max(F.struct("s.hour", "s.share", "s.lifetime_total")).alias("e"))
        .select("entity_id", "slots", F.col("e.share").alias("share"), F.col("e.lifetime_total").alias("total")))
