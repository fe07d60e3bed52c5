"""Orderings, ranks and top-k: catalog listing (E1), leaderboards by score (F1)
and by name (F2), search (F3), top peers (F4) and first peers (F4b).

Ranks are columns (``rank``), never row order.  A full rank over a frame uses
``ordered_rank``: range-partition + local sort, then per-partition offsets from
a tiny (partitions x groups) count table — no window without PARTITION BY, so
no single task ever holds the whole frame.  Top-k uses ``orderBy().limit(k)``
(TakeOrderedAndProject: a bounded top-k per partition, then a merge).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outcry import constants as K
from outcry.session import checkpoint_dir


def ordered_rank(df: DataFrame, order: list[Column], out: str = "rank",
                 partition_by: list[str] | tuple = ()) -> DataFrame:
    """1-based row number of each row in ``order`` (within ``partition_by``
    groups).  ``order`` must be a total order (end with a unique key)."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in partition_by] + list(order)
    tagged = (df.repartitionByRange(parts, *keys)
                .sortWithinPartitions(*keys)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id())
                .checkpoint(eager=True))
    grp = list(partition_by)
    stats = tagged.groupBy("_pid", *grp).agg(F.count(F.lit(1)).alias("_cnt"),
                                             F.min("_mid").alias("_first"))
    w = (Window.partitionBy(*grp) if grp else Window.partitionBy(F.lit(0))) \
        .orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    stats = stats.select(F.col("_pid").alias("_p"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(grp)],
                         "_first", "_off")
    same = F.col("_pid") == F.col("_p")
    for i, c in enumerate(grp):  # null groups are groups too
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    res = tagged.join(stats, same)
    return (res.withColumn(out, (F.col("_off") + F.col("_mid") - F.col("_first") + F.lit(1)).cast("long"))
               .drop("_pid", "_mid", "_p", "_first", "_off", *[f"_g{i}" for i in range(len(grp))]))


def list_catalog(catalog: DataFrame) -> DataFrame:
    """Catalog in sort_order (entity_id breaks the seed's ties)."""
    return ordered_rank(catalog, [F.col("sort_order").asc(), F.col("entity_id").asc()])


def _dir(c: Column, direction: str) -> Column:
    if direction not in ("asc", "desc"):
        raise ValueError(direction)
    return c.asc() if direction == "asc" else c.desc()


def rank_by_score(status: DataFrame, direction: str = "desc") -> DataFrame:
    """F1: leaderboard by score; unscored (score 0) always last, ordered among
    themselves by n_signals in the same direction; catalog order breaks ties."""
    unscored = (F.col("score") == F.lit(0.0))
    order = [unscored.asc(),
             _dir(F.col("score"), direction),
             _dir(F.when(unscored, F.col("n_signals")).otherwise(F.lit(0)), direction),
             F.col("sort_order").asc(), F.col("entity_id").asc()]
    return ordered_rank(status, order)


def rank_by_name(status: DataFrame, direction: str = "asc") -> DataFrame:
    """leaderboard by display name in root-locale Unicode collation (letters
    before accents before case), then by code point."""
    order = [_dir(F.collate(F.col("display_name"), "UNICODE"), direction), _dir(F.col("display_name"), direction),
             F.col("sort_order").asc(), F.col("entity_id").asc()]
    return ordered_rank(status, order)


def search_entities(status: DataFrame, q: str) -> DataFrame:
    """case-insensitive substring match on name, provider or id; '' = all."""
    q = (q or "").lower()
    if not q:
        return status
    hit = None
    for c in ("display_name", "provider", "entity_id"):
        cond = F.lower(F.col(c)).contains(F.lit(q))
        hit = cond if hit is None else (hit | cond)
    return status.where(hit)


def _peer_key() -> Column:
    return F.when(F.col("score") > F.lit(0.0), F.col("score")).otherwise(F.lit(K.UNSCORED_SORT_VALUE))


def top_peers(status: DataFrame, entity: str | None = None, k: int = K.TOP_PEERS) -> DataFrame:
    """the ``k`` peers with signals, lowest score first (unscored as 99),
    catalog order on ties.  ``entity`` (if given) is excluded."""
    s = status.where(F.col("n_signals") > F.lit(0))
    if entity is not None:
        s = s.where(F.col("entity_id") != F.lit(entity))
    order = [_peer_key().asc(), F.col("sort_order").asc(), F.col("entity_id").asc()]
    top = s.orderBy(*order).limit(k)
    w = Window.partitionBy(F.lit(0)).orderBy(*order)  # at most k rows
    return top.withColumn("rank", F.row_number().over(w).cast("long"))


def first_peers(status: DataFrame, entity: str | None = None, k: int = K.TOP_PEERS) -> DataFrame:
    """The first ``k`` peers with signals in catalog order."""
    s = status.where(F.col("n_signals") > F.lit(0))
    if entity is not None:
        s = s.where(F.col("entity_id") != F.lit(entity))
    order = [F.col("sort_order").asc(), F.col("entity_id").asc()]
    top = s.orderBy(*order).limit(k)
    w = Window.partitionBy(F.lit(0)).orderBy(*order)  # at most k rows
    return top.withColumn("rank", F.row_number().over(w).cast("long"))
