"""Repair of conversation structure with a persistent audit trail.

A conversation is damaged in five ways by a checksum of its rows (``damaged``),
its faults are counted, and the cheapest edits that give roles of the form
``(s?(ua)+)?`` are applied: Keep 0, Rerole 1, Delete 2, Insert 5, and 5 more for
a truncated row that stays.  Of equally cheap edits the audit, the initials of
the edits in order, that is least in ASCII wins.

The dynamic programme walks a conversation once with a cell for each state of
the pattern (nothing, after system, after user, after assistant).  A cell is a
cost and the last node of its audit: nodes are linked to the prefix they extend,
so cells share prefixes and a step adds a node, never a copy.  A node keeps its
ancestors at distances of powers of two and a rolling hash of the whole prefix;
two equally cheap audits are compared by descending both chains to their longest
common prefix, and prefixes with equal hashes are read once more, so that a
collision changes nothing.

A conversation may hold any share of the rows.  Rows are sorted over the whole
table (range partitioning) and cut into blocks of at most ``BLOCK``; a block
that may start in any state gives a cell for each pair of states.  Blocks are
then folded in order by the same programme, whose nodes now hold the audits of
blocks.  The digest of a repaired conversation reads its rows in order; they are
sorted by Spark and streamed.

Defined results: a null id, turn, role or text of a row is one space in the
checksum, and a null role or text is one space from there on; rows without id
form one conversation; rows without turn come first; rows of one turn ascend by
role, then by the SHA-256 of their text; a role without an initial letter of the
pattern is reroled or deleted; extra columns are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib
from itertools import chain as _chain, zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .runtime import materialize, prepare

#: Rows of a conversation that one walk takes.
BLOCK = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after system, after user, after assistant.
STATES = 4
#: state -> {initial: next state}
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: state -> next state of a message that is free to choose its role.
FORCED = (2, 2, 3, 2)
ACCEPTED = (0, 3)
ROLE_OF = {2: "user", 3: "assistant"}
#: Blank characters of the fault rules.
_VISIBLE = r"[^\x20\x09-\x0D]"
_MASK = (1 << 61) - 1
_BASE = 0x1B873593CC9E2D51 & _MASK


# ------------------------------------------------------------------ audits
class Node:
    """The last piece of an audit; ``up[k]`` is the node 2**k pieces before."""

    __slots__ = ("up", "piece", "depth", "hash")

    def __init__(self, before: "Node | None", piece: str):
        self.piece = piece
        if before is None:
            self.up, self.depth, self.hash = (), 0, 0
            return
        self.depth = before.depth + 1
        h = before.hash
        for c in piece.encode():
            h = (h * _BASE + c + 1) % _MASK
        self.hash = h
        up, k, at = [before], 0, before
        while k < len(at.up):
            at = at.up[k]
            up.append(at)
            k += 1
        self.up = tuple(up)

    def pieces(self, above: "Node | None" = None) -> list[str]:
        """The pieces behind ``above`` (all, if None) in order."""
        out, at = [], self
        while at is not above and at.up:
            out.append(at.piece)
            at = at.up[0]
        return out[::-1]

    def text(self) -> str:
        return "".join(self.pieces())


def _lifted(node: Node, depth: int) -> Node:
    while node.depth > depth:
        node = node.up[min((node.depth - depth).bit_length(), len(node.up)) - 1]
    return node


def _order(a: list[str], b: list[str]) -> int:
    """Compares two texts given as pieces."""
    for x, y in zip_longest(_chain.from_iterable(a), _chain.from_iterable(b), fillvalue=""):
        if x != y:
            return -1 if x < y else 1
    return 0


def compare(a: Node, b: Node) -> int:
    """-1, 0 or 1 as the audit of ``a`` is less than, equal to or greater than that of ``b``."""
    if a is b:
        return 0
    depth = min(a.depth, b.depth)
    x, y = _lifted(a, depth), _lifted(b, depth)
    if x.hash != y.hash:
        # Down to the last ancestors that differ: what is before them is common.
        while x.up and x.up[0].hash != y.up[0].hash:
            k = 0
            while k + 1 < len(x.up) and x.up[k + 1].hash != y.up[k + 1].hash:
                k += 1
            x, y = x.up[k], y.up[k]
        x, y = x.up[0], y.up[0]
    # Equal hashes: the same node, or else read.
    left, right = x, y
    while left is not right and left.up:
        if left.piece != right.piece:
            return _order(a.pieces(), b.pieces())
        left, right = left.up[0], right.up[0]
    return _order(a.pieces(x), b.pieces(y))


# ------------------------------------------------------------------ cells
#: A cell is (cost, node); cells by state, missing ones are dead ends.
Cells = dict[int, tuple[int, Node]]


def _offer(cells: dict, state: int, cost: int, before: Node, piece: str) -> None:
    held = cells.get(state)
    if held is None or cost < held[0]:
        cells[state] = (cost, before, piece)
    elif cost == held[0]:
        old = held[1] if held[2] is None else Node(held[1], held[2])
        new = Node(before, piece)
        cells[state] = (cost, new, None) if compare(new, old) < 0 else (cost, old, None)


def _settled(cells: dict) -> Cells:
    return {s: (c, n if piece is None else Node(n, piece)) for s, (c, n, piece) in cells.items()}


def inserted(cells: Cells) -> Cells:
    """``cells`` with what inserting messages reaches; more than two in a row
    come back to a state at a higher cost."""
    for _ in range(2):
        out = {s: (c, n, None) for s, (c, n) in cells.items()}
        for s, (c, n) in cells.items():
            _offer(out, FORCED[s], c + INSERT, n, "I")
        cells = _settled(out)
    return cells


def stepped(cells: Cells, initial: str, doomed: bool, truncated: bool) -> Cells:
    """``cells`` after a row; ``doomed`` rows must go."""
    out: dict = {}
    stay = TRUNCATED if truncated else 0
    for s, (c, n) in cells.items():
        _offer(out, s, c + DELETE, n, "D")
        if not doomed:
            to = NEXT[s].get(initial)
            if to is not None:
                _offer(out, to, c + KEEP + stay, n, "K")
            _offer(out, FORCED[s], c + REROLE + stay, n, "R")
    return inserted(_settled(out))


def started(state: int) -> Cells:
    return {state: (0, Node(None, ""))}


def best(cells: Cells) -> tuple[int, str]:
    """(cost, audit) of the cheapest accepted cell."""
    found = None
    for s in ACCEPTED:
        if s in cells and (found is None or cells[s][0] < found[0]
                           or cells[s][0] == found[0] and compare(cells[s][1], found[1]) < 0):
            found = cells[s]
    return found[0], found[1].text()


def joined(cells: Cells, block: dict[tuple[int, int], tuple[int, str]]) -> Cells:
    """``cells`` after a block given by its costs and audits for pairs of states."""
    out: dict = {}
    for (s, t), (cost, audit) in block.items():
        if s in cells:
            _offer(out, t, cells[s][0] + cost, cells[s][1], audit)
    return _settled(out)


# ------------------------------------------------------------------ tables
def _spaced(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows after damage; equal rows of
    a turn are one row with a count."""
    key = F.crc32(F.concat(_spaced(F.col(conv_id)), F.lit(":"), _spaced(F.col(turn))).cast("binary")) % 20
    rows = messages.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                           _spaced(F.col(role)).alias("role"), _spaced(F.col(text)).alias("text"), key.alias("harm"))
    said = F.when(F.col("harm") == 1, F.lit("")).when(F.col("harm") == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text"))
    rows = rows.filter("harm <> 0").select(
        "conv_id", "turn", F.when(F.col("harm") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        said.alias("text"), F.when(F.col("harm") == 3, 2).otherwise(1).alias("copies"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


_ORDER = ["conv_id", "turn", "role", "text_key"]


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (written: they are read twice) with ``text_key``, ``blank``,
    ``truncated`` and ``seen`` (an earlier turn has this role and text)."""
    rows = rows.withColumn("text_key", F.sha2("text", 256))
    last = F.regexp_extract("text", rf"({_VISIBLE})[\x20\x09-\x0D]*$", 1)
    early = (rows.groupBy("conv_id", "role", "text_key")
             .agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
             .select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"), F.col("role").alias("r"),
                     F.col("text_key").alias("k"), F.col("first.turn").alias("first_turn")))
    met = rows.join(early, (F.coalesce(F.col("conv_id").cast("string"), F.lit("")) == F.col("c"))
                    & (F.col("role") == F.col("r")) & (F.col("text_key") == F.col("k")))
    return met.select(*_ORDER, "copies", (~F.col("text").rlike(_VISIBLE)).alias("blank"),
                      (~last.rlike(r"^[.!?]$")).alias("truncated"),
                      (~F.col("turn").eqNullSafe(F.col("first_turn"))).alias("seen"))


def counts(checked: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated) by conversation."""
    n = F.col("copies")
    later = F.when(F.col("blank"), 0).when(F.col("seen"), n).otherwise(n - 1)
    cut = F.when(F.col("blank") | F.col("seen") | ~F.col("truncated"), 0).otherwise(1)
    by_turn = checked.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("blank"), n).otherwise(0)).alias("blank"), F.sum(later).alias("duplicate"), F.sum(cut).alias("truncated"))
    return by_turn.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")])


_CELL = "array<struct<start:int,end:int,cost:long,audit:string>>"
_BLOCKS = f"conv_id long, part int, seq int, head string, tail string, illegal long, cells {_CELL}"
_CELL_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_LEGAL = ("su", "ua", "au")


def blocks(checked: DataFrame, block: int | None = None) -> DataFrame:
    """Blocks of neighbouring rows with their cells for pairs of states, and
    what counting illegal neighbours needs."""
    block = block or BLOCK
    parts = max(int(checked.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = (checked.select(*_ORDER, "copies", "blank", "truncated", "seen").repartitionByRange(parts, *_ORDER)
            .sortWithinPartitions(*_ORDER).select("conv_id", "role", "copies", "blank", "truncated", "seen"))

    def run(batches):
        from pyspark import TaskContext
        part, seq, held, size = TaskContext.get().partitionId(), 0, None, 0

        def closed():
            conv, head, tail, illegal, starts = held
            cells = [{"start": s, "end": t, "cost": c, "audit": n.text()} for s, ends in starts.items() for t, (c, n) in ends.items()]
            return conv, part, seq, head, tail, illegal, cells

        for b in batches:
            done = []
            for conv, role, copies, blank, cut, seen in zip(*(c.to_pylist() for c in b.columns)):
                first = role[:1]
                for k in range(copies):
                    if held is None or held[0] != conv or size >= block:
                        if held is not None:
                            done.append(closed())
                            seq += 1
                        # Only the first block of a conversation knows its state.
                        new = held is not None and held[0] != conv
                        held = [conv, first, None, 0, {s: inserted(started(s)) for s in (range(1) if new else range(STATES))}]
                        size = 0
                    if held[2] is not None and held[2] + first not in _LEGAL:
                        held[3] += 1
                    held[2] = first
                    starts = held[4]
                    for s in starts:
                        starts[s] = stepped(starts[s], first, blank or seen or k > 0, cut)
                    size += 1
            if done:
                yield batch(done)
        if held is not None:
            yield batch([closed()])

    def batch(rows):
        types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), _CELL_TYPE]
        names = ["conv_id", "part", "seq", "head", "tail", "illegal", "cells"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return rows.mapInArrow(run, _BLOCKS)


def audits(cut: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit): the blocks of a conversation folded in order."""
    parts = max(int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = cut.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "seq")

    def run(batches):
        held = None

        def row():
            conv, _, illegal, cells = held
            return (conv, illegal, *best(cells))

        for b in batches:
            done = []
            for conv, _, _, head, tail, illegal, found in zip(*(c.to_pylist() for c in b.columns)):
                block = {(x["start"], x["end"]): (x["cost"], x["audit"]) for x in found}
                if held is None or held[0] != conv:
                    if held is not None:
                        done.append(row())
                    held = [conv, tail, illegal, joined(started(0), block)]
                else:
                    held = [conv, tail, held[2] + illegal + (held[1] + head not in _LEGAL), joined(held[3], block)]
            if done:
                yield batch(done)
        if held is not None:
            yield batch([row()])

    def batch(rows):
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                          names=["conv_id", "illegal", "cost", "audit"])

    return rows.mapInArrow(run, "conv_id long, illegal long, cost long, audit string")


def repaired(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the messages that the audits leave,
    deleted ones excluded, in order of ``place`` within a conversation."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    none = lambda kind: F.lit(None).cast(kind)
    heads = chosen.select("conv_id", F.lit(0).alias("kind"), none("long").alias("turn"), F.col("audit").alias("role"),
                          F.lit("").alias("text_key"), F.lit("").alias("text"), F.lit(1).cast("long").alias("copies"))
    lines = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.sha2("text", 256).alias("text_key"), "text", "copies")
    ordered = (heads.union(lines).repartition(parts, "conv_id")
               .sortWithinPartitions("conv_id", "kind", "turn", "role", "text_key").select("conv_id", "kind", "role", "text", "copies"))

    def run(batches):
        audit, at, state, place, conv = "", 0, 0, 0, None

        def made(edit, role, text):
            nonlocal state, place
            place += 1
            state = NEXT[state][role[:1]]
            return conv, place, edit, role, text

        def inserts():
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                at += 1
                yield made("I", ROLE_OF[FORCED[state]], "")

        for b in batches:
            out = []
            for c, kind, role, text, copies in zip(*(x.to_pylist() for x in b.columns)):
                if kind == 0:
                    conv, audit, at, state, place = c, role, 0, 0, 0
                    out.extend(inserts())
                    continue
                for _ in range(copies):
                    edit = audit[at]
                    at += 1
                    if edit != "D":
                        out.append(made(edit, role if edit == "K" else ROLE_OF[FORCED[state]], text))
                    out.extend(inserts())
            if out:
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)],
                                                 names=["conv_id", "place", "edit", "role", "text"])

    return ordered.mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def _text_digests(lines: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of messages in order, streamed."""
    parts = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = (lines.select("conv_id", "place", "role", "text").repartition(parts, "conv_id")
               .sortWithinPartitions("conv_id", "place"))

    def run(batches):
        conv, said, any_ = None, None, False
        for b in batches:
            done = []
            for c, place, role, text in zip(*(x.to_pylist() for x in b.columns)):
                if place == 1:
                    if any_:
                        done.append((conv, said.hexdigest()))
                    conv, said, any_ = c, hashlib.sha256(), True
                said.update(f"{'' if place == 1 else chr(10)}{role}:{text}".encode())
            if done:
                yield batch(done)
        if any_:
            yield batch([(conv, said.hexdigest())])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64(), pa.string()])],
                                          names=["conv_id", "repaired_sha256"])

    return ordered.mapInArrow(run, "conv_id long, repaired_sha256 string")


def digests(messages: DataFrame) -> DataFrame:
    """Faults, cost, audit and repaired text of every conversation."""
    prepare(messages.sparkSession)
    rows = materialize(damaged(messages), "damaged")
    checked = materialize(faults(rows), "faults")
    chosen = materialize(audits(materialize(blocks(checked), "blocks")), "audits")
    # The parts of a conversation's row meet in one aggregate, where a null id is a key like any other.
    columns = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long",
               "audit": "string", "repaired_sha256": "string"}

    def part(frame, *own):
        return frame.select("conv_id", *[F.col(c) if c in own else F.lit(None).cast(t).alias(c) for c, t in columns.items()])

    ids = messages.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    whole = (part(ids).union(part(counts(checked), "gaps", "blank", "duplicate", "truncated"))
             .union(part(chosen, "illegal", "cost", "audit"))
             .union(part(_text_digests(repaired(rows, chosen)), "repaired_sha256"))
             .groupBy("conv_id").agg(*[F.max(c).alias(c) for c in columns]))
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return whole.select("conv_id", *[F.coalesce(F.col(c), empty.get(c, F.lit(0).cast("long"))).alias(c) for c in columns])


#: The same programme on whole audits: at equal cost and state no audit is a
#: proper prefix of another, so the least text may be kept at every step.
ORACLE_SQL = """
WITH RECURSIVE m AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' ||
      coalesce(turn::VARCHAR, ' '), ''), lambda ch: ord(ch)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS harm
  FROM conversations),
h AS (
  SELECT conv_id, turn, CASE harm WHEN 4 THEN 'user' ELSE role END AS role,
    CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE harm WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM m),
o AS (
  SELECT *, row_number() OVER w AS i, lag(role[1]) OVER w || role[1] AS pair,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
  FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
f AS (
  SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
    regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') AS cut
  FROM o),
r AS (SELECT *, blank OR nth > 1 AS doomed, CASE WHEN cut THEN 5 ELSE 0 END AS stay FROM f),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (NOT blank AND nth > 1) AS duplicate, count(*) FILTER (NOT doomed AND cut) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM r GROUP BY conv_id),
a AS (SELECT DISTINCT conv_id FROM conversations),
walk AS (
  SELECT conv_id, 0 AS i,
    {'c': 0::BIGINT, 'a': '', 't': NULL::VARCHAR} AS c0, {'c': 1000000000::BIGINT, 'a': '', 't': NULL::VARCHAR} AS c1,
    {'c': 5::BIGINT, 'a': 'I', 't': 'user:'} AS c2, {'c': 10::BIGINT, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'} AS c3
  FROM a
  UNION ALL
  SELECT conv_id, i, c0, c1, least(k2, {'c': least(c0, c1, k3).c + 5, 'a': least(c0, c1, k3).a || 'I',
                                       't': concat_ws(chr(10), least(c0, c1, k3).t, 'user:')}) AS c2,
    least(k3, {'c': k2.c + 5, 'a': k2.a || 'I', 't': concat_ws(chr(10), k2.t, 'assistant:')},
          {'c': least(c0, c1).c + 10, 'a': least(c0, c1).a || 'II', 't': concat_ws(chr(10), least(c0, c1).t, 'user:', 'assistant:')}) AS c3
  FROM (
    SELECT w.conv_id, r.i, {'c': w.c0.c + 2, 'a': w.c0.a || 'D', 't': w.c0.t} AS c0,
      least({'c': w.c1.c + 2, 'a': w.c1.a || 'D', 't': w.c1.t},
            {'c': CASE WHEN doomed OR role[1] <> 's' THEN 1000000000 ELSE w.c0.c + stay END, 'a': w.c0.a || 'K',
             't': concat_ws(chr(10), w.c0.t, role || ':' || text)}) AS c1,
      least({'c': w.c2.c + 2, 'a': w.c2.a || 'D', 't': w.c2.t},
        {'c': CASE WHEN doomed OR role[1] <> 'u' THEN 1000000000 ELSE least(w.c0, w.c1, w.c3).c + stay END,
         'a': least(w.c0, w.c1, w.c3).a || 'K', 't': concat_ws(chr(10), least(w.c0, w.c1, w.c3).t, role || ':' || text)},
        {'c': CASE WHEN doomed THEN 1000000000 ELSE least(w.c0, w.c1, w.c3).c + 1 + stay END,
         'a': least(w.c0, w.c1, w.c3).a || 'R', 't': concat_ws(chr(10), least(w.c0, w.c1, w.c3).t, 'user:' || text)}) AS k2,
      least({'c': w.c3.c + 2, 'a': w.c3.a || 'D', 't': w.c3.t},
        {'c': CASE WHEN doomed OR role[1] <> 'a' THEN 1000000000 ELSE w.c2.c + stay END, 'a': w.c2.a || 'K',
         't': concat_ws(chr(10), w.c2.t, role || ':' || text)},
        {'c': CASE WHEN doomed THEN 1000000000 ELSE w.c2.c + 1 + stay END, 'a': w.c2.a || 'R',
         't': concat_ws(chr(10), w.c2.t, 'assistant:' || text)}) AS k3
    FROM walk w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1))
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, least(c0, c3).c::BIGINT AS cost,
  least(c0, c3).a AS audit, sha256(coalesce(least(c0, c3).t, '')) AS repaired_sha256
FROM a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
JOIN walk w ON w.conv_id IS NOT DISTINCT FROM a.conv_id AND w.i = coalesce(c.n, 0)
"""
