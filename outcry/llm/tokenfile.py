"""Token-id files in Simple-8b word-aligned coding.

A 64-bit word holds a 4-bit selector and 60 bits of ids: the selector says how
many ids of which width follow (240 or 120 zeros, 60 ids of 1 bit, ... 1 of 60
bits).  Selector 15 with payload n escapes: the next n words hold one id of up
to 64 bits each.  Ids are cut into blocks of ``BLOCK``; a block starts a new
word and the file keeps the word offset of every block, so any block can be
decoded alone and all blocks of a read at once.

File: magic, block size | words | block offsets | documents (id, validity,
token count) | footer with the counts.  All numbers are little-endian.

``write`` sorts documents by id over the whole table (range partitioning),
tokenizes them, ends each with the end id and writes one or more files per
partition; ``read`` decodes the files again, in parallel over files.

Tokenizing splits a text at ASCII white space, where the vocabulary's
own splitting always ends a token, and keeps the ids of the words seen in the
process (about twice ``CACHE`` at most), so the tokenizer library is called for
new words only.

Defined results: a null text counts as empty and gives the end id alone; rows
with equal doc_id are ordered by text, rows without doc_id come first; repeated
rows are kept; extra columns are ignored; an empty table gives no files and no
rows.
"""

from __future__ import annotations

import functools
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from . import files
from .runtime import materialize, prepare, scratch_path, text_or_empty

MAGIC = b"S8BTOKEN"
BLOCK = 1024
#: Ids after which a file is closed.
FILE_IDS = 8_000_000
CACHE = 250_000
#: Selector -> (ids in a word, bits of an id); 15 is the escape.
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8),
             (6, 10), (5, 12), (4, 15), (3, 20), (2, 30)]
ESCAPE = 15
_COUNT = np.array([c for c, _ in SELECTORS] + [1])


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bit length of every id; above 52 bits a value that no selector takes."""
    return np.where(ids >> np.uint64(52), 64, np.frexp(ids.astype(np.float64))[1]).astype(np.uint8)


#: Room behind a block: a word that starts in it may reach so far.
_ROOM = 256


def _choices(bits: np.ndarray) -> np.ndarray:
    """The selector of a word that starts at each place of the blocks (rows of
    bit lengths with ``_ROOM`` zeros behind them, so that the last word of a
    block may hold fewer ids than it has room for)."""
    widest, step = {1: bits}, 1
    while step < 128:  # widest[c][i]: largest width of the c ids from i
        m = widest[step]
        widest[2 * step] = np.maximum(m[:, :-step], m[:, step:])
        step *= 2
    # A selector that fits is followed by fitting ones only: fewer ids, more bits.
    choice = np.zeros((len(bits), BLOCK), np.uint8)
    for count, width in SELECTORS:
        p = 1 << (count.bit_length() - 1)
        m = np.maximum(widest[p][:, :BLOCK], widest[p][:, count - p:count - p + BLOCK])
        choice += (m > width).view(np.uint8)
    return choice


#: Blocks whose selectors are chosen at a time.
_RUN = 512


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, word offset of each block) of unsigned ids."""
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    wide = BLOCK + _ROOM
    padded = np.zeros((blocks, wide), np.uint64)
    full = len(ids) // BLOCK
    padded[:full, :BLOCK] = ids[:full * BLOCK].reshape(full, BLOCK)
    if full < blocks:
        padded[full, :len(ids) - full * BLOCK] = ids[full * BLOCK:]
    choice = np.empty((blocks, BLOCK), np.uint8)
    for b in range(0, blocks, _RUN):
        choice[b:b + _RUN] = _choices(_bits(padded[b:b + _RUN]))
    choice, padded = choice.ravel(), padded.ravel()
    # All blocks step from word to word together.
    begins = np.zeros(len(choice), bool)
    here = np.arange(blocks) * BLOCK
    end = np.minimum(here + BLOCK, len(ids))
    counts = _COUNT[choice]
    while len(here):
        begins[here] = True
        here = here + counts[here]
        live = here < end
        if not live.all():
            here, end = here[live], end[live]
    first = np.flatnonzero(begins)
    owner = first // BLOCK
    chosen = choice[first]
    place = first + owner * _ROOM
    escaped = chosen == ESCAPE
    words = np.zeros(len(first), np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        at = np.flatnonzero(chosen == s)
        if not len(at):
            continue
        word = np.full(len(at), s << 60, np.uint64)
        if bits:
            base = place[at]
            for k in range(count):
                word |= padded[base + k] << np.uint64(k * bits)
        words[at] = word
    if escaped.any():
        # Neighbouring escapes of a block share one selector word.
        new = escaped.copy()
        new[1:] &= ~(escaped[:-1] & (owner[1:] == owner[:-1]))
        run = np.cumsum(new) - 1
        sizes = np.bincount(run[escaped])
        width = np.where(escaped, np.where(new, 2, 1), 1)
        at = np.cumsum(width) - 1
        out = np.zeros(int(at[-1]) + 1, np.uint64)
        out[at] = np.where(escaped, padded[place], words)
        out[at[new] - 1] = np.uint64(ESCAPE << 60) | sizes.astype(np.uint64)
        begin = at - width + 1
        words = out
    else:
        begin = np.arange(len(first))
    return words, begin[np.searchsorted(owner, np.arange(blocks))].astype(np.uint64)


def decode(words: np.ndarray, offsets: np.ndarray, n_ids: int) -> np.ndarray:
    """Ids of consecutive blocks; ``offsets`` are relative to ``words``."""
    if not n_ids:
        return np.empty(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    offsets = offsets.astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (selector == ESCAPE).any():
        # Escaped words may look like anything: walk from escape to escape.
        at = 0
        for p in np.flatnonzero(selector == ESCAPE):
            if p >= at:
                n = int(words[p] & np.uint64((1 << 60) - 1))
                raw[p + 1:p + 1 + n] = True
                at = p + 1 + n
        selector[raw] = ESCAPE
    count = np.where(raw, 1, np.where(selector == ESCAPE, 0, _COUNT[selector]))
    block = np.repeat(np.arange(len(offsets)), np.diff(offsets, append=len(words)))
    ends = np.cumsum(count)
    before = ends - count
    start = block * BLOCK + before - before[offsets[block]]
    # A block may overshoot its end by the unused room of its last word.
    n_blocks, wide = len(offsets), BLOCK + _ROOM
    out = np.zeros(n_blocks * wide, np.uint64)
    start += block * (wide - BLOCK)
    for s, (n, bits) in enumerate(SELECTORS):
        if not bits:
            continue
        at = np.flatnonzero((selector == s) & ~raw)
        if len(at):
            word, place, mask = words[at], start[at], np.uint64((1 << bits) - 1)
            for k in range(n):
                out[place + k] = (word >> np.uint64(k * bits)) & mask
    at = np.flatnonzero(raw)
    out[start[at]] = words[at]
    return np.ascontiguousarray(out.reshape(n_blocks, wide)[:, :BLOCK]).ravel()[:n_ids]


def write_file(uri: str, doc_ids: list[int | None], lens: np.ndarray, ids: np.ndarray) -> None:
    words, offsets = encode(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    with files.create(uri) as out:
        out.write(MAGIC + struct.pack("<Q", BLOCK))
        out.write(words.astype("<u8").tobytes())
        out.write(offsets.astype("<u8").tobytes())
        out.write(keys.tobytes() + known.tobytes() + lens.astype("<i8").tobytes())
        out.write(struct.pack("<QQQQ", len(words), len(offsets), len(doc_ids), len(ids)) + MAGIC)


def read_file(uri: str, batch_blocks: int = 1024):
    """Yields (doc_ids, lens, ids) for runs of whole documents."""
    with files.read(uri) as f:
        size = f.size()
        n_words, n_blocks, n_docs, n_ids = struct.unpack("<QQQQ", f.read_at(32, size - 40))
        if f.read_at(8, size - 8) != MAGIC or f.read_at(8, 0) != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        body = 16
        offsets = np.frombuffer(f.read_at(8 * n_blocks, body + 8 * n_words), "<u8").astype(np.int64)
        at = body + 8 * (n_words + n_blocks)
        keys = np.frombuffer(f.read_at(8 * n_docs, at), "<i8")
        known = np.frombuffer(f.read_at(n_docs, at + 8 * n_docs), np.uint8)
        lens = np.frombuffer(f.read_at(8 * n_docs, at + 9 * n_docs), "<i8")
        edge = np.append(offsets, n_words)
        stops = np.cumsum(lens)
        held, begun, doc = np.empty(0, np.uint64), 0, 0
        for b in range(0, n_blocks, batch_blocks):
            e = min(b + batch_blocks, n_blocks)
            words = np.frombuffer(f.read_at(8 * int(edge[e] - edge[b]), body + 8 * int(edge[b])), "<u8")
            got = decode(words, offsets[b:e] - edge[b], min(e * BLOCK, n_ids) - b * BLOCK)
            held = np.concatenate([held, got]) if len(held) else got
            done = int(np.searchsorted(stops, begun + len(held), side="right"))
            if done > doc:
                used = int(stops[done - 1]) - begun
                yield [int(k) if o else None for k, o in zip(keys[doc:done], known[doc:done])], lens[doc:done], held[:used]
                held, begun, doc = held[used:], begun + used, done


@functools.lru_cache(2)
def _tokenizer(path: str):
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


#: Words of printable ASCII and Latin-1 letters: for them lower-casing and the
#: vocabulary's split are plain, and every match is one word of the model.
_PLAIN = re.compile(r"[!-~\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]{1,64}")
_LETTER = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_MATCH = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^{_LETTER}0-9]+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others
    for the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Cache(dict):
    """Ids of blank-separated words as bytes (unsigned 32-bit, little-endian)."""

    def __init__(self, path: str):
        super().__init__()
        self.library = _tokenizer(path)
        self.model = self.library.model
        self.letters = _byte_letters()
        self.parts: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}

    def part(self, match: str) -> bytes:
        """Ids of one match of the vocabulary's split."""
        ids = self.old_parts.get(match)
        if ids is None:
            text = match if match.isascii() else "".join(map(self.letters.__getitem__, match.encode()))
            ids = struct.pack(f"<{len(t := self.model.tokenize(text))}I", *[x.id for x in t])
        self.parts[match] = ids
        return ids

    def learn(self, words: set[str]) -> None:
        rest, get, part, old = [], self.parts.get, self.part, self.old.get
        for w in words:
            ids = old(w)
            if ids is not None:
                pass
            elif w.isalpha() and (w.isascii() or max(w) <= "\xff") and len(w) <= 64:
                low = w.lower()
                ids = get(low) or part(low)
            elif _PLAIN.fullmatch(w) and "<|" not in w:
                ids = b"".join([get(m) or part(m) for m in _MATCH.findall(w.lower())])
            else:
                rest.append(w)
                continue
            self[w] = ids
        for w, e in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False)):
            self[w] = np.array(e.ids, "<u4").tobytes()

    def age(self) -> None:
        """Beyond CACHE words or parts, those not asked for again are forgotten
        at the next time."""
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()
        if len(self.parts) > CACHE:
            self.old_parts, self.parts = self.parts, {}


_CACHES: dict[str, _Cache] = {}


def tokenize(texts: list[str | None] | pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, tokens per text, the end id included)."""
    cache = _CACHES.get(path)
    if cache is None:
        cache = _CACHES[path] = _Cache(path)
    if not len(texts):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    if not isinstance(texts, pa.Array):
        texts = pa.array(texts, pa.large_string())
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    try:
        found = list(map(cache.__getitem__, words))
    except KeyError:
        cache.age()
        cache.learn({w for w in words if w not in cache})
        found = list(map(cache.__getitem__, words))
    # The end id is one more word, after the last of every text.
    found.append(np.array([end_id], "<u4").tobytes())
    n_words = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    stops = np.cumsum(n_words)
    codes = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), stops, len(words))
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    by_word = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<u4")))
    ids = by_word.take(pa.array(codes)).flatten().to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(sizes[codes])))[stops + np.arange(1, len(texts) + 1)]
    return ids, np.diff(ends, prepend=0)


def write(docs: DataFrame, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text",
          folder: str | None = None) -> DataFrame:
    """Writes the files and returns their manifest (path, part, seq, n_docs,
    n_ids, start): start counts the ids of all files before."""
    spark = docs.sparkSession
    prepare(spark)
    folder = folder or scratch_path(spark, "tokens")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = (docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(docs[text]).alias("text"))
            .repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text"))

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        held, total, seq = [], 0, 0

        def close():
            uri = files.fresh(folder, ".s8b")
            keys = [k for ks, _, _ in held for k in ks]
            write_file(uri, keys, np.concatenate([n for _, n, _ in held]), np.concatenate([i for _, _, i in held]))
            return pa.RecordBatch.from_pydict(
                {"path": pa.array([uri]), "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                 "n_docs": pa.array([len(keys)], pa.int64()), "n_ids": pa.array([total], pa.int64())})

        for b in batches:
            if not b.num_rows:
                continue
            ids, lens = tokenize(b.column(1), tokenizer_path, end_id)
            held.append((b.column(0).to_pylist(), lens, ids))
            total += len(ids)
            if total >= FILE_IDS:
                yield close()
                held, total, seq = [], 0, seq + 1
        if held:
            yield close()

    manifest = materialize(rows.mapInArrow(run, "path string, part int, seq int, n_docs long, n_ids long"), "manifest")
    # One row per file of up to FILE_IDS ids: the only rows that one task sorts.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as little-endian unsigned 32-bit
    integers, decoded from the files."""
    spark = manifest.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches):
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for keys, lens, ids in read_file(uri):
                    stops = np.cumsum(lens)
                    raw = ids.astype("<u4")
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": pa.array(keys, pa.int64()), "start": pa.array(start + stops - lens, pa.int64()),
                         "n_tokens": pa.array(lens, pa.int64()),
                         "ids": pa.array([raw[e - n:e].tobytes() for e, n in zip(stops, lens)], pa.binary())})
                    start += int(stops[-1])

    return (manifest.select("path", "start").repartition(parts, "path")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary"))


def digests(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    back = read(materialize(write(docs, tokenizer_path, end_id), "manifest"))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
