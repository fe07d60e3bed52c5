"""Merkle manifest of a dataset, with a proof for every row.

A leaf is the hash of a row.  Leaves stand in order of their id within their
group, runs of ``FAN`` neighbours hash to the level above until one node, the
group's subroot, is left; the subroots, in order of their group, hash to the
root in the same way.

Leaf coordinates come from a bitmap index, not from sorting leaves: the ids of a
group are one bitmap, kept as its 64-bit words without the empty ones, merged
from all tasks by ``bit_or`` and counted by a popcount directory of
``LEVELS`` (prefix counts of words, of runs of 65,536 words, of runs of those,
...; no window ever holds more than 65,536 small rows).  The rank of an id is
its directory entry and the bits below its own.  Nodes are then collected into
arrays of ``FAN`` slots keyed by (group, run), level by level, so no group, run
or level meets in one task.  Proofs go down the same arrays from the root: only
a run's row carries the path above it.

Defined results: null fields hash as ``-``; rows without id come first in their
group, rows of equal id ascend by leaf hash, equal rows get neighbouring
places; a null group comes first; extra columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.ranking import ordered_rank
from .runtime import materialize, prepare

FAN = 16
_BITS = 4
#: Shifts of a word number in the popcount directory.
LEVELS = (16, 32, 48)
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_LEAST = -(1 << 63)


def _hash(parts: Column) -> Column:
    return F.sha2(parts, 256)


def record_hash(*fields: Column) -> Column:
    """Hash of a row: of each field ``-`` if null, else its UTF-8 byte count,
    ``:`` and its value."""
    texts = [f.cast("string") for f in fields]
    return _hash(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


# ------------------------------------------------------------------ coordinates
def ranked(rows: DataFrame, group: str, key: str) -> DataFrame:
    """``rows`` with ``rank`` (rows of the group with a smaller key), ``same``
    (rows with this key) and ``size`` (rows of the group), by the bitmap index
    of the group's keys.  ``group`` and ``key`` (long) hold no nulls."""
    low = (F.col("_key").bitwiseAND(63)).cast("int")
    word = F.shiftright(F.col("_key"), 6)
    keys = (rows.groupBy(F.col(group).alias("_group"), F.col(key).alias("_key"))
            .agg(F.count(F.lit(1)).alias("_n")))
    words = keys.groupBy("_group", word.alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_key & 63 as int))")).alias("_bits"), F.sum("_n").alias("_count"),
        F.collect_list(F.when(F.col("_n") > 1, F.struct(low.alias("low"), (F.col("_n") - 1).alias("more")))).alias("_more"))
    words = materialize(words, "bitmap")
    # Directory: prefix counts of words in a run, of runs in a longer run, ...
    shifts = (0, *LEVELS)
    total, directory = words, None
    for level, shift in enumerate(shifts):
        upper = [F.shiftright("_word", shifts[level + 1]).alias("_up")] if level + 1 < len(shifts) else [F.lit(0).cast("long").alias("_up")]
        at = F.shiftright("_word", shift) if shift else F.col("_word")
        if shift:
            total = words.groupBy("_group", at.alias("_at"), *upper).agg(F.sum("_count").alias("_count"))
        else:
            total = words.select("_group", F.col("_word").alias("_at"), *upper, "_count", "_word", "_bits", "_more")
        inside = Window.partitionBy("_group", "_up").orderBy("_at")
        before = F.coalesce(F.sum("_count").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        part = total.withColumn(f"_before{level}", before)
        if level + 1 == len(shifts):
            part = part.withColumn("_size", F.sum("_count").over(Window.partitionBy("_group", "_up")))
        if directory is None:
            directory = part.select("_group", "_word", "_bits", "_more", "_before0")
        else:
            size = ["_size"] if level + 1 == len(shifts) else []
            directory = directory.withColumn("_at", F.shiftright("_word", shift)).join(
                part.select("_group", "_at", f"_before{level}", *size), ["_group", "_at"]).drop("_at")
    directory = directory.select(
        "_group", "_word", "_bits", "_more", "_size", sum(F.col(f"_before{k}") for k in range(len(shifts))).alias("_before"))
    mine = F.expr(f"cast({key} & 63 as int)")
    below = F.bit_count(F.col("_bits").bitwiseAND(F.expr(f"~shiftleft(-1L, cast({key} & 63 as int))")))
    extra = lambda test: F.aggregate(F.filter("_more", test), F.lit(0).cast("long"), lambda a, x: a + x["more"])
    return (rows.withColumn("_word", F.shiftright(key, 6)).withColumn("_group", F.col(group))
            .join(directory, ["_group", "_word"])
            .withColumn("rank", F.col("_before") + below + extra(lambda x: x["low"] < mine))
            .withColumn("same", extra(lambda x: x["low"] == mine) + 1)
            .withColumn("size", F.col("_size"))
            .drop("_group", "_word", "_bits", "_more", "_before", "_size"))


def coordinates(leaves: DataFrame) -> DataFrame:
    """``leaves`` (grp, id, leaf, row, ...) with ``pos`` and ``size``: the place
    of a leaf in its group and the group's leaves."""
    keyed = leaves.withColumn("key", F.coalesce("id", F.lit(_LEAST)))
    first = materialize(ranked(keyed, "grp", "key"), "ranks")
    tied = first.filter("same > 1")
    if tied.isEmpty():
        return first.select(*leaves.columns, F.col("rank").alias("pos"), "size")
    # Equal ids go by leaf hash (its first 60 bits; without id first), equal rows by row number.
    place = F.conv(F.substr("leaf", F.lit(1), F.lit(15)), 16, 10).cast("long")
    place = place - F.when(F.col("id").isNull(), F.lit(1 << 60)).otherwise(0)
    tied = (tied.withColumn("tie", F.concat_ws("|", "grp", "key")).withColumn("place", place)
            .withColumnRenamed("rank", "rank0").withColumnRenamed("size", "size0").drop("same"))
    second = materialize(ranked(tied, "tie", "place"), "ties")
    third = (second.filter("same > 1").withColumn("twin", F.concat_ws("|", "tie", "place"))
             .withColumnRenamed("rank", "rank1").drop("same", "size"))
    third = ranked(third, "twin", "row")
    done = lambda frame, pos, size: frame.select(*leaves.columns, pos.alias("pos"), F.col(size).alias("size"))
    return (done(first.filter("same = 1"), F.col("rank"), "size")
            .union(done(second.filter("same = 1"), F.col("rank0") + F.col("rank"), "size0"))
            .union(done(third, F.col("rank0") + F.col("rank1") + F.col("rank"), "size0")))


# ------------------------------------------------------------------ tree
def levels(nodes: DataFrame) -> list[DataFrame]:
    """The runs of every level from the leaves up: (grp, run, size, slots, node).
    ``nodes``: (grp, pos, size, node, payload); ``size`` counts the nodes of the
    group on this level, and groups of one node are done."""
    found = []
    most = nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        runs = (nodes.filter("size > 1")
                .groupBy("grp", F.shiftright("pos", _BITS).alias("run"), "size")
                .agg(F.array_sort(F.collect_list(F.struct(
                    F.col("pos").bitwiseAND(FAN - 1).alias("slot"), "node", "payload"))).alias("slots")))
        runs = runs.withColumn("node", _hash(F.array_join(F.transform("slots", lambda s: s["node"]), "")))
        found.append(materialize(runs, "runs"))
        nodes = found[-1].select("grp", F.col("run").alias("pos"), F.ceil(F.col("size") / FAN).alias("size"), "node",
                                 F.lit(None).cast("string").alias("payload"))
        most = -(-most // FAN)
    return found


def tops(nodes: DataFrame, runs: list[DataFrame]) -> DataFrame:
    """(grp, level, node): the last node of every group and its level."""
    out = nodes.filter("size = 1").select("grp", F.lit(0).alias("level"), "node")
    for k, r in enumerate(runs):
        out = out.union(r.filter((F.col("size") > 1) & (F.col("size") <= FAN)).select("grp", F.lit(k + 1).alias("level"), "node"))
    return out


_PATH = "array<struct<left:string,right:string>>"


def paths(nodes: DataFrame, runs: list[DataFrame], above: DataFrame) -> DataFrame:
    """Leaves (grp, node, payload, path, and the other columns of ``above``)
    with their siblings to the left and right, level by level.  ``above``:
    (grp, level, path, ...) per group: what stands over its last node."""
    rest = [c for c in above.columns if c not in ("grp", "level", "path")]
    siblings = lambda test: F.array_join(F.transform(F.filter("slots", test), lambda s: s["node"]), "")
    over = None
    for k in reversed(range(len(runs))):
        top = above.filter(F.col("level") == k + 1).select("grp", F.lit(0).cast("long").alias("run"), "path", *rest)
        over = top if over is None else top.union(over.select("grp", F.col("pos").alias("run"), "path", *rest))
        met = runs[k].select("grp", "run", "slots").join(over, ["grp", "run"])
        slot = met.withColumn("s", F.explode("slots"))
        beside = F.struct(siblings(lambda x: x["slot"] < F.col("s.slot")).alias("left"),
                          siblings(lambda x: x["slot"] > F.col("s.slot")).alias("right"))
        over = slot.select("grp", (F.col("run") * FAN + F.col("s.slot")).alias("pos"), F.col("s.node").alias("node"),
                           F.col("s.payload").alias("payload"), F.concat(F.array(beside), "path").alias("path"), *rest)
    lone = nodes.filter("size = 1").select("grp", "node", "payload").join(above.filter("level = 0").drop("level"), "grp")
    lone = lone.select("grp", "node", "payload", "path", *rest)
    return lone if over is None else lone.union(over.select(*lone.columns))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, p: _hash(F.concat(p["left"], h, p["right"])))


def proof_hash(path: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return _hash(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""))


def manifest(leaves: DataFrame) -> DataFrame:
    """Every leaf with ``subroot``, ``root`` and its ``path``.  ``leaves``:
    (source, id long, leaf, payload), one row per row of the dataset; the result
    has (source, leaf, payload, subroot, root, path)."""
    prepare(leaves.sparkSession)
    # A null group sorts before all others: "0" against "1...".
    grp = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source").cast("string")))
    held = materialize(leaves.select(grp.alias("grp"), "id", "leaf", "payload",
                                     F.monotonically_increasing_id().alias("row")), "leaves")
    nodes = materialize(coordinates(held).select("grp", "pos", "size", F.col("leaf").alias("node"), "payload"), "nodes")
    runs = levels(nodes)
    roots = materialize(tops(nodes, runs), "subroots")
    order = ordered_rank(roots.select("grp", "level", "node"), [F.col("grp").asc()])
    count = roots.count()
    upper = order.select(F.lit("").alias("grp"), (F.col("rank") - 1).alias("pos"), F.lit(count).cast("long").alias("size"), "node",
                         F.struct(F.col("grp"), F.col("level")).alias("payload"))
    upper = materialize(upper, "upper")
    upper_runs = levels(upper)
    none = F.array().cast(_PATH)
    crown = tops(upper, upper_runs).select("grp", "level", none.alias("path"), F.col("node").alias("root"))
    above = paths(upper, upper_runs, crown).select(
        F.col("payload.grp").alias("grp"), F.col("payload.level").alias("level"), "path", F.col("node").alias("subroot"), "root")
    out = paths(nodes, runs, materialize(above, "above"))
    return out.select(F.expr("CASE WHEN grp = '0' THEN NULL ELSE substr(grp, 2) END").alias("source"),
                      F.col("node").alias("leaf"), "payload", "subroot", "root", "path")


def _tampered(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def digests(docs: DataFrame) -> DataFrame:
    """Proof and verification of every row, where rows with a crc32 of doc_id
    divisible by 5 were tampered with after the manifest was made (their A-Z are
    lower-cased; rows without doc_id are left alone)."""
    fields = {c: F.col(c) for c in FIELDS}
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    again = F.when(_tampered(fields["doc_id"]), record_hash(*(fields | {"text": lowered}).values()))
    leaves = docs.select("source", F.col("doc_id").cast("long").alias("id"), record_hash(*fields.values()).alias("leaf"),
                         F.struct(F.col("doc_id"), again.alias("again")).alias("payload"))
    held = manifest(leaves)
    folded = fold(F.coalesce("payload.again", "leaf"), F.col("path"))
    return (held.select("payload.doc_id", "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"),
                        folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


ORACLE_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, text,
    sha256(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')
      || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''),
             lambda ch: ord(ch)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 5 = 0
      THEN sha256(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')
      || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS again
  FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
low AS (
  SELECT source, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM p GROUP BY source
  UNION ALL
  SELECT source, level + 1, list_transform(range(0, len(nodes), 16), lambda i: sha256(array_to_string(nodes[i + 1:i + 16], '')))
  FROM low WHERE len(nodes) > 1),
sub AS (SELECT source, max(level) AS height, arg_max(nodes[1], level) AS subroot FROM low GROUP BY source),
s AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM sub),
high AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM s
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(nodes), 16), lambda i: sha256(array_to_string(nodes[i + 1:i + 16], '')))
  FROM high WHERE len(nodes) > 1),
top AS (SELECT max(level) AS height, arg_max(nodes[1], level) AS root FROM high),
walk AS (
  SELECT p.doc_id, p.leaf, p.source, s.place, s.subroot, coalesce(p.again, p.leaf) AS h, '' AS proof, p.pos AS at, 0 AS step
  FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT w.doc_id, w.leaf, w.source, w.place, w.subroot,
    sha256(array_to_string(n.nodes[w.at // 16 * 16 + 1:w.at], '') || w.h || array_to_string(n.nodes[w.at + 2:w.at // 16 * 16 + 16], '')),
    w.proof || array_to_string(n.nodes[w.at // 16 * 16 + 1:w.at], '') || array_to_string(n.nodes[w.at + 2:w.at // 16 * 16 + 16], ''),
    CASE WHEN n.last THEN w.place ELSE w.at // 16 END, w.step + 1
  FROM walk w JOIN (
    SELECT low.source, level AS step, nodes, false AS top, level + 1 = s.height AS last FROM low
    JOIN s ON low.source IS NOT DISTINCT FROM s.source WHERE level < s.height
    UNION ALL
    SELECT s.source, s.height + level, nodes, true, false FROM high, s, top WHERE level < top.height) n
  ON n.source IS NOT DISTINCT FROM w.source AND n.step = w.step),
fix AS (SELECT * FROM walk)
SELECT w.doc_id, w.leaf, w.subroot, top.root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = top.root AS verified
FROM fix w JOIN s ON s.source IS NOT DISTINCT FROM w.source, top WHERE w.step = s.height + top.height
"""
