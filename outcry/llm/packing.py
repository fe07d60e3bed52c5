"""Packing of tokenized documents into training sequences.

Every task keeps at most ``OPEN`` unfinished windows of ``WINDOW`` tokens.  A
document's full windows are sequences of their own; the rest goes into the open
window whose room is the smallest that holds it.  When none holds it and no
further window may be opened, the fullest window is filled with the head of the
piece and emitted, and the tail opens a new one: emitted windows are full.  What
is open at the end of a task is written too; the leftovers of ``MERGE`` tasks
are packed in the same way by one task, and so on until a single task has them:
it fills its windows one after the other and cuts the last one into sequences
whose lengths are powers of two, which need no padding.

A task holds ``OPEN`` windows (``MERGE`` times as many when merging), whatever
the input, and documents are never shuffled; only leftovers are.

Tokenizing splits a text at single blanks, where the vocabulary's own splitting
always ends a match (texts with a blank inside longer white space go to the
tokenizer library whole), and keeps the ids of the words seen in the process (about twice
``CACHE`` at most), so that the library sees new words only.

Defined results: a null text is empty and gives the end id alone; rows without
doc_id and repeated rows are documents like others; extra columns are ignored;
an empty table gives an empty table.  Which documents share a sequence depends
on the partitions of the input.
"""

from __future__ import annotations

import bisect
import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .memory import tidy
from .runtime import materialize, prepare

WINDOW = 2048
OPEN = 64
#: Tasks whose leftovers meet in one.
MERGE = 16
#: Fixed value: the split of byte-level vocabularies.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


# ------------------------------------------------------------------ tokens
def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others
    for the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of texts by a byte-level BPE vocabulary of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.added = [t["content"] for t in described["added_tokens"]]
        self.ranked = self._by_ranks(described)

    def _by_ranks(self, described: dict):
        """The same vocabulary as byte ranks, which tiktoken encodes in less
        time; None unless merges are in the order of their ids and nothing but
        the common byte-level split comes before them."""
        model, before = described["model"], described["pre_tokenizer"] or {}
        plain = (model["type"] == "BPE" and described["normalizer"] is None and before.get("type") == "ByteLevel"
                 and before.get("use_regex") and not before.get("add_prefix_space")
                 and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
                                                    "byte_fallback", "ignore_merges")))
        letters, ids = _byte_letters(), model["vocab"]
        merged = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if not plain or merged != sorted(merged):
            return None
        import tiktoken
        ranks = {bytes(letters[c] for c in token): k for token, k in ids.items() if token not in self.added}
        return tiktoken.Encoding("vocabulary", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        # The library takes out added tokens before it splits.
        if self.ranked is None or any(t in text for t in self.added):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.ranked.encode_ordinary(text), "<u4")


@functools.lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenize(texts: pa.Array, path: str, end_id: int) -> list[bytes]:
    """The ids of every text with the end id, as little-endian unsigned 32-bit
    integers."""
    encoder, end = _encoder(path), np.array([end_id], "<u4").tobytes()
    return [encoder.ids(t.as_py() or "").tobytes() + end for t in texts]


# ------------------------------------------------------------------ packing
#: A piece: (doc_id, start, doc_tokens, ids as bytes).
Piece = tuple[int | None, int, int, bytes]


class Packer:
    """Open windows of one task; ``ready`` takes the finished sequences."""

    def __init__(self, room: int = WINDOW, most: int = OPEN):
        self.room, self.most = room, most
        #: (free tokens, number, pieces), ascending.
        self.windows: list[tuple[int, int, list[Piece]]] = []
        self.count = 0
        self.ready: list[list[Piece]] = []

    def add(self, piece: Piece) -> None:
        doc, start, total, ids = piece
        full = self.room * 4
        while len(ids) >= full:
            self.ready.append([(doc, start, total, ids[:full])])
            start, ids = start + self.room, ids[full:]
        if ids:
            self._place((doc, start, total, ids))

    def _place(self, piece: Piece) -> None:
        size = len(piece[3]) // 4
        k = bisect.bisect_left(self.windows, (size, -1, []))
        if k < len(self.windows):
            free, number, pieces = self.windows.pop(k)
            pieces.append(piece)
            self._keep(free - size, number, pieces)
            return
        if len(self.windows) >= self.most:
            free, _, pieces = self.windows.pop(0)
            doc, start, total, ids = piece
            pieces.append((doc, start, total, ids[:4 * free]))
            self.ready.append(pieces)
            piece, size = (doc, start + free, total, ids[4 * free:]), size - free
        self._keep(self.room - size, self.count, [piece])
        self.count += 1

    def _keep(self, free: int, number: int, pieces: list[Piece]) -> None:
        if free:
            bisect.insort(self.windows, (free, number, pieces))
        else:
            self.ready.append(pieces)

    def take(self) -> list[list[Piece]]:
        done, self.ready = self.ready, []
        return done

    def leftovers(self) -> list[list[Piece]]:
        """The open windows, the fullest first."""
        done, self.windows = [pieces for _, _, pieces in self.windows], []
        return done


def filled(windows: list[list[Piece]], room: int = WINDOW) -> Iterator[list[Piece]]:
    """The pieces of ``windows`` in full sequences, and the last tokens in
    sequences whose lengths are falling powers of two."""
    left = sum(len(ids) // 4 for w in windows for *_, ids in w)
    goal, held, size = min(room, 1 << left.bit_length() - 1) if left else 0, [], 0
    for doc, start, total, ids in (p for w in windows for p in w):
        while ids:
            n = min(goal - size, len(ids) // 4)
            held.append((doc, start, total, ids[:4 * n]))
            start, ids, size, left = start + n, ids[4 * n:], size + n, left - n
            if size == goal:
                yield held
                held, size = [], 0
                goal = min(room, 1 << left.bit_length() - 1) if left else 0


_PIECES = "doc_id long, start long, doc_tokens long, ids binary, sequence_id long, offset long, part long, is_open boolean"
_NAMES = [c.split()[0] for c in _PIECES.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]


def _rows(sequences: list[list[Piece]], first: int, part: int, is_open: bool) -> pa.RecordBatch:
    cols = [[] for _ in _NAMES]
    for k, pieces in enumerate(sequences):
        at = 0
        for doc, start, total, ids in pieces:
            for c, v in zip(cols, (doc, start, total, ids, first + k, at, part, is_open)):
                c.append(v)
            at += len(ids) // 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=_NAMES)


def _first_id(level: int, part: int) -> int:
    """Sequence numbers of a task: 2**28 sequences for each of 2**28 tasks on a level."""
    return level << 56 | part << 28


def _packed(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    room, most = WINDOW, OPEN

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        packer, number = Packer(room, most), _first_id(0, part)
        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), tokenize(b.column(1), tokenizer_path, end_id)):
                packer.add((doc, 0, len(ids) // 4, ids))
            done = packer.take()
            if done:
                yield _rows(done, number, part, False)
                number += len(done)
        left = packer.leftovers()
        if left:
            yield _rows(left, number, part, True)

    return docs.mapInArrow(lambda batches: tidy(run(batches)), _PIECES)


def _merged(left: DataFrame, level: int, last: bool) -> DataFrame:
    """The leftovers of ``MERGE`` parts packed by one task."""
    room, most = WINDOW, OPEN

    def run(key, rows):
        part = key[0].as_py()
        # Arrow comes without an order: that of parts, windows and places in them.
        order = rows.sort_by([(c, "ascending") for c in ("part", "sequence_id", "offset")])
        pieces = list(zip(*(order.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))))
        number = _first_id(level, part)
        if last:
            return pa.Table.from_batches([_rows(list(filled([pieces], room)), number, part, False)])
        packer = Packer(room, most)
        for p in pieces:
            packer.add(p)
        done = packer.take()
        return pa.Table.from_batches([_rows(done, number, part, False),
                                      _rows(packer.leftovers(), number + len(done), part, True)])

    group = F.shiftright("part", MERGE.bit_length() - 1) if not last else F.lit(0).cast("long")
    return left.withColumn("_group", group).groupBy("_group").applyInArrow(
        lambda key, rows: run(key, rows.drop_columns(["_group"])), _PIECES)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids, sequence_id, offset): the pieces of
    all documents; ``ids`` are little-endian unsigned 32-bit integers."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    written = materialize(_packed(rows, tokenizer_path, end_id), "packed")
    closed, level = [written.filter("not is_open")], 1
    left = written.filter("is_open")
    parts = left.agg(F.max("part")).first()[0]
    while parts is not None:
        last = parts < MERGE
        written = materialize(_merged(left, level, last), "merged")
        closed.append(written.filter("not is_open"))
        left, level, parts = written.filter("is_open"), level + 1, None if last else parts // MERGE
    out = functools.reduce(DataFrame.union, closed)
    return out.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), "doc_tokens", "ids",
                      "sequence_id", "offset")


def digests(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    return pack(docs, tokenizer_path, end_id).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
