"""Chat formatting from event logs.

A conversation is a log of events.  Events of a message are folded in sequence
order: ``start`` opens it with a role and no text, ``delta`` appends text,
``edit`` replaces the text, ``regenerate`` discards it, ``delete`` removes the
message until a later ``start``.  Folding is per message, so a conversation of
any length spreads over all tasks.

A message is rendered as ``### role: text </turn>`` and a line end.  Inside role
and text a backslash, ``#``, ``<`` (and in roles ``:``) get a backslash before
them, so no control string can occur there, and removing the backslashes gives
the text back.  The loss mask covers the escaped text of assistant messages and
nothing else.  ``render`` gives one row per message in conversation order;
``conversations`` joins the pieces of conversations that fit a row.

Defined results: null text and role count as empty; messages of one turn are
ordered by role, then text, and repeated rows stay separate messages; rows with
null conv_id form one conversation, null turns come first; extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .runtime import materialize, prepare, text_or_empty

ASSISTANT = "assistant"
HEAD, COLON, TAIL = "### ", ": ", " </turn>\n"
#: Parts into which a streamed message is cut.
PARTS = 3


def _escape(text, signs: str):
    return F.regexp_replace(text, rf"([\\{signs}])", r"\\$1")


def _unescape(text):
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def event_log(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text") -> DataFrame:
    """The log that a chat service would have kept of finished messages:
    every message is streamed in ``PARTS`` deltas; every third turn was first
    streamed otherwise and regenerated, every fourth was edited afterwards."""
    t = F.col("text")
    cut = F.ceil(F.length(t) / PARTS).cast("int")
    event = lambda k, kind, value: F.struct(F.lit(k).alias("step"), F.lit(kind).alias("kind"), value.alias("text"))
    none = F.lit("")
    deltas = [event(4 + k, "delta", F.substr(t, (cut * k + 1).cast("int"), cut)) for k in range(PARTS)]
    draft = F.when(F.pmod("turn", F.lit(3)) == 1, F.array(event(2, "delta", F.reverse(t)), event(3, "regenerate", none)))
    edited = F.when(F.pmod("turn", F.lit(4)) == 2, F.array(event(8, "delta", F.lit("?")), event(9, "edit", t)))
    empty = F.array().cast("array<struct<step:int,kind:string,text:string>>")
    events = F.concat(F.array(event(1, "start", none)), F.coalesce(draft, empty), F.array(*deltas), F.coalesce(edited, empty))
    rows = messages.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), text_or_empty(messages[role]).alias("role"),
        text_or_empty(messages[text]).alias("text"), F.monotonically_increasing_id().alias("message"))
    # Written, so that message numbers stay what they are if a task is repeated.
    rows = materialize(rows, "messages")
    return (rows.select("conv_id", "turn", "message", "role", F.explode(events).alias("e"))
            .select("conv_id", "turn", "message", (F.coalesce("turn", F.lit(0)) * 16 + F.col("e.step")).alias("seq"),
                    "e.kind", F.when(F.col("e.kind") == "start", F.col("role")).alias("role"), "e.text"))


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, message, role, text): the final messages of a log with
    the columns of ``event_log``; equal sequence numbers go by kind and text."""
    log = F.array_sort(F.collect_list(F.struct("seq", "kind", "text", "role")))
    state = F.struct(F.lit(False).alias("live"), F.lit("").alias("role"), F.lit("").alias("text"))

    def step(a, e):
        is_ = lambda k: e["kind"] == k
        said = F.coalesce(e["text"], F.lit(""))
        return F.struct(
            F.when(is_("start"), True).when(is_("delete"), False).otherwise(a["live"]).alias("live"),
            F.when(is_("start"), F.coalesce(e["role"], F.lit(""))).otherwise(a["role"]).alias("role"),
            F.when(is_("delta"), F.concat(a["text"], said)).when(is_("edit"), said)
            .when(is_("start") | is_("regenerate"), F.lit("")).otherwise(a["text"]).alias("text"))

    folded = events.groupBy("conv_id", "turn", "message").agg(log.alias("log")).select(
        "conv_id", "turn", "message", F.aggregate("log", state, step).alias("final"))
    return folded.filter("final.live").select("conv_id", "turn", "message", "final.role", "final.text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, message, place, formatted, loss_start, loss_length) per
    message; the loss span counts code points of ``formatted``."""
    head = F.concat(F.lit(HEAD), _escape(F.col("role"), "#<:"), F.lit(COLON))
    body = _escape(F.col("text"), "#<")
    learned = F.col("role") == ASSISTANT
    return messages.select(
        "conv_id", "turn", "message", F.concat_ws("\x00", "role", "text").alias("place"),
        F.concat(head, body, F.lit(TAIL)).alias("formatted"),
        F.when(learned, F.length(head)).otherwise(0).alias("loss_start"),
        F.when(learned, F.length(body)).otherwise(0).alias("loss_length"))


def conversations(pieces: DataFrame) -> DataFrame:
    """(conv_id, formatted): whole conversations, for those that fit a row."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "place", "message", "formatted")))
    return pieces.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["formatted"]), "").alias("formatted"))


def parse(pieces: DataFrame) -> DataFrame:
    """``pieces`` with the unescaped ``role``, ``text`` and ``loss_text``."""
    shape = r"(?s)^### ((?:[^\\:]|\\.)*): (.*) </turn>\n$"
    return pieces.select(
        "*", _unescape(F.regexp_extract("formatted", shape, 1)).alias("role"),
        _unescape(F.regexp_extract("formatted", shape, 2)).alias("text"),
        _unescape(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_length"))).alias("loss_text"))


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(messages: DataFrame) -> DataFrame:
    """One row per conversation, read back from the rendered pieces.  A digest
    reads its conversation in order: pieces are sorted by Spark and streamed, so
    one task may hold a long conversation but never more than a batch of it."""
    prepare(messages.sparkSession)
    pieces = materialize(render(fold(event_log(messages))), "pieces")
    back = parse(pieces).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "place", "message", "role", "text",
                                "loss_text", F.length("formatted").alias("chars"))
    parts = max(int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = (back.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "place", "message")
               .select("conv_id", "role", "text", "loss_text", "chars"))

    def run(batches):
        state = None

        def row():
            conv, turns, said, lost, loss, chars = state
            return conv, turns, said.hexdigest(), loss, lost.hexdigest(), chars

        for b in batches:
            done = []
            for conv, role, text, loss_text, chars in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(row())
                    state = [conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3].update(loss_text.encode())
                state[4] += len(loss_text)
                state[5] += chars
            if done:
                yield batch(done)
        if state is not None:
            yield batch([row()])

    def batch(rows):
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [c.split()[0] for c in _DIGEST.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return ordered.mapInArrow(run, _DIGEST)
