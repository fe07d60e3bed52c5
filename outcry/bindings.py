"""Bindings of the driver tables onto the signal model.

EV   events: signal_id=event_id, actor=user_id, entity=event_type, ts, hourly.
EVK  events: entity = props.k (100 entities), hourly.
RET  lineitem (returned lines) joined to orders and part: actor=o_custkey,
     entity=p_brand, ts=l_shipdate, daily buckets (one slot per weekday).

Catalogs are derived from the data with Spark (distinct entities) plus fixed
attribute rules, so they grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outcry.sources.signals import table, to_signals

# Fixed values — EV catalog attributes: provider and sort order per event type
# (purchase and signup deliberately share a sort order).
EV_PROVIDER = {"click": "web", "error": "web", "view": "web", "purchase": "shop", "signup": "shop"}
EV_SORT_ORDER = {"click": 10, "view": 20, "error": 30, "purchase": 40, "signup": 40}
EV_LEFT_OUT = "signup"  # the event type missing from the "partial" catalog (A6 rejects)


def _map_expr(col: str, mapping: dict, default):
    out = None
    for k, v in mapping.items():
        out = (F.when(F.col(col) == F.lit(k), F.lit(v)) if out is None
               else out.when(F.col(col) == F.lit(k), F.lit(v)))
    return out.otherwise(F.lit(default))


# ------------------------------------------------------------------ EV / EVK
def _ntz(t):
    """A naive UTC datetime as a literal of the raw column's type, so that the
    comparison is pushed into the scan."""
    return F.to_timestamp_ntz(F.lit(t.strftime("%Y-%m-%d %H:%M:%S")))


def ev_last_hour(spark: SparkSession, sf_dir: str):
    """Last hour with a signal on an entity (naive UTC datetime): one aggregate
    over two columns of the raw table."""
    row = (table(spark, sf_dir, "events").where(F.col("event_type").isNotNull() & (F.col("event_type") != F.lit("")))
           .agg(F.max("ts").alias("t")).first())
    if row is None or row["t"] is None:
        raise ValueError("no signals in range")
    return row["t"].replace(minute=0, second=0, microsecond=0, tzinfo=None)


def ev_signals(spark: SparkSession, sf_dir: str, since=None, until=None) -> DataFrame:
    """EV signals, optionally only those in [since, until) (naive UTC)."""
    ev = table(spark, sf_dir, "events")
    if since is not None:
        ev = ev.where(F.col("ts") >= _ntz(since))
    if until is not None:
        ev = ev.where(F.col("ts") < _ntz(until))
    return to_signals(ev, F.col("event_id"), F.col("event_type"), F.col("user_id"), F.col("ts"))


def evk_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return to_signals(ev, F.col("event_id"), F.get_json_object("props", "$.k"),
                      F.col("user_id"), F.col("ts"))


def catalog_from(signals: DataFrame, kind: str = "ev") -> DataFrame:
    """Catalog rows for every distinct entity of a signal frame."""
    ents = signals.select("entity_id").where(F.col("entity_id").isNotNull()).distinct()
    if kind == "ev":
        return ents.select(
            "entity_id",
            F.initcap("entity_id").alias("display_name"),
            _map_expr("entity_id", EV_PROVIDER, "other").alias("provider"),
            _map_expr("entity_id", EV_SORT_ORDER, 90).cast("int").alias("sort_order"))
    if kind == "evk":
        k = F.col("entity_id").cast("int")
        return ents.select(
            "entity_id",
            F.concat(F.lit("Key "), F.col("entity_id")).alias("display_name"),
            F.when(k % 2 == 0, F.lit("even")).otherwise(F.lit("odd")).alias("provider"),
            (k / 10).cast("int").alias("sort_order"))
    if kind == "ret":
        num = F.regexp_extract("entity_id", r"(\d+)$", 1).cast("int")
        return ents.select(
            "entity_id",
            F.col("entity_id").alias("display_name"),
            F.concat(F.lit("group"), (num / 10).cast("int").cast("string")).alias("provider"),
            num.alias("sort_order"))
    raise ValueError(kind)


def ev_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_from(ev_signals(spark, sf_dir), "ev")


# Fixed values — hours after the first bucket from which an entity of the "born"
# catalog exists (the others always did).
EV_BORN_AFTER = {"signup": 245, "click": 30}


def ev_born_catalog(spark: SparkSession, sf_dir: str, lo) -> DataFrame:
    """The EV catalog with ``valid_from`` for some entities (inside an hour, so
    that the bucket rule shows)."""
    base = ev_catalog(spark, sf_dir)
    hours = _map_expr("entity_id", EV_BORN_AFTER, None).cast("long")
    return base.withColumn("valid_from", F.when(hours.isNotNull(), F.timestamp_seconds(
        F.unix_seconds(lo) + hours * F.lit(3600) + F.lit(1500))))


def ev_partial_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev_catalog(spark, sf_dir).where(F.col("entity_id") != F.lit(EV_LEFT_OUT))


# ------------------------------------------------------------------ RET
def ret_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned line items as signals: one per (order, line); daily buckets."""
    li = (table(spark, sf_dir, "lineitem")
          .where(F.col("l_returnflag") == F.lit("R"))
          .select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"))
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    pt = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = (li.join(od, li.l_orderkey == od.o_orderkey)
           .join(pt, li.l_partkey == pt.p_partkey))
    sid = F.col("l_orderkey") * F.lit(16) + F.col("l_linenumber")
    return to_signals(j, sid, F.col("p_brand"), F.col("o_custkey"), F.col("l_shipdate"))


# ------------------------------------------------------------------ part feed
# Fixed values — part-feed provider allow-list: (feed prefix, provider, sort base).
# MEDIUM is deliberately absent (unknown provider -> dropped).
PART_PROVIDERS = [
    ("standard", "Standard", 100),
    ("promo", "Promo", 200),
    ("small", "Small", 300),
    ("large", "Large", 400),
    ("economy", "Economy", 500),
]

# Fixed values — alias rules over feed ids: (glob, entity), first match wins.
PART_ALIAS_RULES = [
    ("*hot*rod*", "hot-rod"),
    ("*bolt*|*gear*", "drivetrain"),
    ("*-ring-*", "ring"),
    ("promo/*", "promo-misc"),
]


def part_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog feed rows (pos, id, name) derived from ``part``."""
    p = table(spark, sf_dir, "part")
    tag = F.when(F.col("p_partkey") % 7 == 0, F.lit(":free")).otherwise(F.lit(""))
    fid = F.concat(F.lower("p_type"), F.lit("/"), F.regexp_replace("p_name", " ", "-"),
                   F.lit("-"), F.col("p_size").cast("string"), tag)
    name = F.concat(F.col("p_type"), F.lit(": "), F.initcap("p_name"))
    return p.select(F.col("p_partkey").alias("pos"), fid.alias("id"), name.alias("name"))


def part_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existing catalog for the feed: every third part, written with '.' in the slug."""
    p = table(spark, sf_dir, "part").where(F.col("p_partkey") % 3 == 0)
    return p.select(
        F.concat(F.regexp_replace("p_name", " ", "."), F.lit("."), F.col("p_size").cast("string"))
         .alias("entity_id"),
        F.initcap("p_name").alias("display_name"),
        F.initcap("p_type").alias("provider"),
        F.col("p_partkey").cast("int").alias("sort_order"))


# Fixed values — the feed's first edition has the parts up to this size; two
# merges of the dated catalog, and the births in the catalog before them.
FIRST_EDITION_SIZE = 25
MERGE_TIMES = ("2024-05-06 07:00:00", "2024-05-13 07:00:00")
FIRST_BIRTH = "2024-01-01 00:30:00"


def part_first_edition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as it was before the larger parts were listed."""
    p = table(spark, sf_dir, "part").where(F.col("p_size") <= FIRST_EDITION_SIZE)
    return part_feed(spark, sf_dir).join(p.select(F.col("p_partkey").alias("pos")), "pos", "left_semi")


def part_dated_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The existing catalog with births: parts of size s since s hours after
    ``FIRST_BIRTH``, the larger ones always."""
    born = F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.lit(FIRST_BIRTH))) + F.col("p_size") * F.lit(3600))
    sizes = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("sort_order"), "p_size")
    return (part_catalog(spark, sf_dir).join(sizes, "sort_order")
            .withColumn("valid_from", F.when(F.col("p_size") <= FIRST_EDITION_SIZE, born)).drop("p_size"))


# Fixed values — general rules before and behind the rules of the table.
FIRST_RULES = [("*hot*rod*", "hot-rod")]
LAST_RULES = [("*-ring-*", "ring"), ("p*", "p-rest"), ("*e", "e-rest")]


def part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias rules (rule, pattern, entity_id) between the general ones: one for
    every name and size of the first edition's parts, which takes all names of its first word in
    that size, so that their order decides."""
    names = table(spark, sf_dir, "part").where(F.col("p_size") <= FIRST_EDITION_SIZE)
    names = names.select("p_name", F.split("p_name", " ")[0].alias("w"), F.col("p_size").alias("s")).distinct()
    glob = F.concat(F.lit("*/"), "w", F.lit("-*-"), F.col("s").cast("string"))
    own = names.select(F.concat(F.lit("2 "), "p_name", F.lit(" "), F.format_string("%03d", "s")).alias("rule"),
                       F.concat(glob, F.lit("|"), glob, F.lit(":free")).alias("pattern"),
                       F.concat("p_name", F.lit(" "), F.col("s").cast("string")).alias("entity_id"))
    rows = [(f"{1 if rules is FIRST_RULES else 3} {k}", *r) for rules in (FIRST_RULES, LAST_RULES) for k, r in enumerate(rules)]
    return own.unionByName(spark.createDataFrame(rows, "rule string, pattern string, entity_id string"))
