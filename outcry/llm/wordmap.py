"""Global distinct-word shuffle.

An expensive function of a word (BPE merges, segmentation scores) is evaluated
once per distinct word of the whole corpus and its answers are joined back to
every position:

1. ``explode_words``: documents, already split into words (array<string>), are
   written as chunks.  A chunk is a bounded run of documents of one input
   partition: its distinct words, numbered by falling frequency, plus for each
   document the positions as word numbers.  This is the exploded (document,
   position, word) relation with repeated words factored out.
2. ``answer_words``: the (chunk, number, word) rows are shuffled by ranges of
   words, so equal words of all chunks meet, beside those that share their
   prefixes; each distinct word is answered once and the answers go back keyed
   by (chunk, number).
3. ``reassemble``: documents and answers meet by chunk; the positions pick their
   answers in order.

A very frequent word costs one row per chunk, not one per occurrence, and the
ranges hold even shares of all (chunk, word) pairs, so no word or source makes a
hot task.  The words of a chunk and range travel together in a plain coding of a
few bytes beside the words, so that however many chunks and ranges there are,
what moves stays in proportion to the pairs.  Chunks have a bounded token count, so memory does not grow with the
input.  The chunk table is written to the shared checkpoint folder: a lost
executor re-reads it instead of re-splitting documents.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..session import at_release
from .memory import give_back, tidy
from .runtime import scratch_path

#: Tokens after which a chunk is closed (a single longer document is one chunk).
CHUNK_TOKENS = 2_700_000
#: (chunk, word) pairs per range of the distinct-word shuffle.
BUCKET_WORDS = 200_000
#: Words, evenly from all chunks, that the bounds of the ranges are taken from
#: (at least one of a chunk, up to this many chunks).
SAMPLE_WORDS = 100_000
#: Bytes from which a blob is compressed.
_COMPRESS = 512


def pack(t: pa.Table) -> bytes:
    """Arrow IPC stream, Zstandard-compressed."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def unpack(b: bytes) -> pa.Table:
    with pa.ipc.open_stream(b) as r:
        return r.read_all()


_INTS = {pa.int32(): b"i", pa.int64(): b"q"}


def lean(t: pa.Table) -> bytes:
    """A small table of 32- or 64-bit integers, binaries and lists of unsigned
    32-bit integers as its lengths and values alone."""
    kinds, out = b"", []
    for c in t.columns:
        c = c.combine_chunks()
        c = pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c
        if c.type in _INTS:
            kinds += _INTS[c.type]
            out.append(c.to_numpy().tobytes())
            continue
        offsets = np.frombuffer(c.buffers()[1], np.int64)[c.offset:c.offset + len(c) + 1] if len(c) else np.zeros(1, np.int64)
        out.append(np.diff(offsets).astype("<u4").tobytes())
        if pa.types.is_large_binary(c.type):
            kinds += b"b"
            out.append(c.buffers()[2][int(offsets[0]):int(offsets[-1])].to_pybytes() if len(c) and c.buffers()[2] else b"")
        else:
            kinds += b"l"
            out.append(c.flatten().to_numpy().astype("<u4").tobytes())
    raw = b"".join(out)
    packed = len(raw) >= _COMPRESS
    head = struct.pack("<BIB", packed, t.num_rows, len(kinds)) + kinds
    return head + (zstandard.ZstdCompressor(level=1).compress(raw) if packed else raw)


def fat(blob: bytes, names: list[str]) -> pa.Table:
    """The table that ``lean`` coded."""
    packed, n, k = struct.unpack_from("<BIB", blob)
    kinds, raw, at, columns = blob[6:6 + k], blob[6 + k:], 0, []
    if packed:
        raw = zstandard.ZstdDecompressor().decompress(raw)
    for kind in kinds:
        if kind in b"iq":
            kept = np.frombuffer(raw, "<i4" if kind == ord("i") else "<i8", n, at)
            columns.append(pa.array(kept))
            at += kept.nbytes
            continue
        sizes = np.frombuffer(raw, "<u4", n, at)
        offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        at += sizes.nbytes
        if kind == ord("b"):
            columns.append(pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(raw[at:at + int(offsets[-1])])]))
            at += int(offsets[-1])
        else:
            values = np.frombuffer(raw, "<u4", int(offsets[-1]), at)
            columns.append(pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(values)))
            at += values.nbytes
    return pa.table(columns, names=names)


def varint(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LEB128 bytes of non-negative codes, and the byte count of each."""
    codes = codes.astype(np.uint32)
    n = np.ones(len(codes), np.int64)
    for bits in (7, 14, 21, 28):
        n += codes >= np.uint32(1 << bits)
    ends = np.cumsum(n)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = ends - n
    for k in range(5):
        at = np.flatnonzero(n > k)
        if not len(at):
            break
        more = np.where(n[at] > k + 1, 0x80, 0).astype(np.uint8)
        out[starts[at] + k] = ((codes[at] >> np.uint32(7 * k)) & np.uint32(0x7F)).astype(np.uint8) | more
    return out, n


def unvarint(raw: np.ndarray) -> np.ndarray:
    """Inverse of ``varint`` over a whole byte array."""
    ends = np.flatnonzero(raw < 0x80)
    if not len(ends):
        return np.empty(0, np.int64)
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = ends - starts + 1
    out = np.zeros(len(ends), np.int64)
    for k in range(int(n.max())):
        at = np.flatnonzero(n > k)
        out[at] |= (raw[starts[at] + k] & 0x7F).astype(np.int64) << (7 * k)
    return out


_CHUNK_SCHEMA = "chunk long, part int, n_words long, doc binary, key {key}, payload binary"


def explode_words(docs: DataFrame, key: str, words: str) -> DataFrame:
    """Write the chunk table of ``docs`` (columns ``key`` and ``words``,
    array<string>) and return it: rows of part 0 hold a chunk's distinct words
    (Arrow IPC), rows of part 1 one document each (key, varint word numbers)."""
    key_type = docs.schema[key].dataType.simpleString()
    narrow = docs.select(F.col(key).alias("key"), F.col(words).alias("words"))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        chunk = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        tokens = 0
        for b in batches:
            words = b.column(1)
            flat = words.flatten()
            lens = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
            held.append((b.column(0), lens, flat.dictionary_encode()))
            tokens += len(flat)
            if tokens >= CHUNK_TOKENS:
                yield from close(chunk, held)
                chunk, held, tokens = chunk + 1, [], 0
        if held:
            yield from close(chunk, held)

    def close(chunk: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        coded = pa.chunked_array([c for _, _, c in held]).unify_dictionaries()
        word = coded.chunk(0).dictionary
        n_words = len(word)
        codes = [c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks]
        seen = np.zeros(n_words, np.int64)
        for c in codes:
            seen += np.bincount(c, minlength=n_words)
        order = np.argsort(-seen, kind="stable")
        rank = np.empty(n_words, np.int64)
        rank[order] = np.arange(n_words)
        for (keys, lens, _), c in zip(held, codes):
            raw, n = varint(rank[c])
            ends = np.concatenate(([0], np.cumsum(n)))
            stops = np.cumsum(lens)
            blobs = [raw[ends[s]:ends[e]].tobytes() for s, e in zip(stops - lens, stops)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * len(blobs), pa.int64()), pa.array([1] * len(blobs), pa.int32()),
                 pa.array([n_words] * len(blobs), pa.int64()), pa.array(blobs, pa.binary()),
                 keys, pa.nulls(len(blobs), pa.binary())],
                names=["chunk", "part", "n_words", "doc", "key", "payload"])
        payload = pack(pa.table({"word": word.take(pa.array(order))}))
        yield pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int64()), pa.array([0], pa.int32()), pa.array([n_words], pa.int64()),
             pa.nulls(1, pa.binary()), pa.nulls(1, held[0][0].type), pa.array([payload], pa.binary())],
            names=["chunk", "part", "n_words", "doc", "key", "payload"])
        del held[:], coded, codes
        give_back()

    # Bucketed by chunk: the documents need no second shuffle to meet their answers.
    spark = docs.sparkSession
    coded = narrow.mapInArrow(chunks, _CHUNK_SCHEMA.format(key=key_type))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), coded.rdd.getNumPartitions())
    name = "words_" + uuid.uuid4().hex
    (coded.write.partitionBy("part").bucketBy(min(buckets, 100_000), "chunk").option("compression", "zstd")
     .option("path", scratch_path(spark, name)).saveAsTable(name))
    at_release(lambda: spark.sql(f"DROP TABLE IF EXISTS {name}"))
    return spark.table(name)


def _bounds(words: DataFrame, buckets: int) -> list[bytes]:
    """Words that part all (chunk, word) pairs in ``buckets`` ranges of about
    equal size, from a bounded sample: they decide where work is done, not what
    comes out."""
    chunks = words.count()
    each, every = max(SAMPLE_WORDS // max(chunks, 1), 1), -(-chunks // SAMPLE_WORDS)

    def some(batches):
        for b in batches:
            for chunk, payload in zip(b.column("chunk").to_pylist(), b.column("payload").to_pylist()):
                # Words stand in the order of their frequency: an even choice has no bias in the alphabet.
                word = unpack(payload).column("word").combine_chunks()
                if len(word) and zlib.crc32(str(chunk).encode()) % every == 0:
                    at = np.linspace(0, len(word) - 1, min(each, len(word))).astype(np.int64)
                    yield pa.RecordBatch.from_pydict({
                        "word": word.take(pa.array(at)).cast(pa.binary()),
                        "weight": pa.array(np.full(len(at), len(word) / len(at)))})

    rows = sorted((bytes(r["word"]), r["weight"]) for r in words.mapInArrow(some, "word binary, weight double").collect())
    if not rows:
        return []
    upto = np.cumsum([w for _, w in rows])
    at = np.searchsorted(upto, upto[-1] * np.arange(1, buckets) / buckets)
    return sorted({rows[min(int(k), len(rows) - 1)][0] for k in at})


def answer_words(chunks: DataFrame, answer: Callable[[list[bytes]], pa.Table]) -> DataFrame:
    """(chunk, payload): for every chunk and range of words the word numbers
    with the columns of ``answer``, which gets distinct words in byte order.
    Its columns are 64-bit integers, binaries or lists of unsigned integers."""
    spark = chunks.sparkSession
    words = chunks.filter("part = 0").select("chunk", "n_words", "payload")
    pairs = words.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs // BUCKET_WORDS), 1)
    bounds = np.array(_bounds(words, buckets), dtype=object)

    def deal(batches):
        for b in batches:
            for chunk, payload in zip(b.column("chunk").to_pylist(), b.column("payload").to_pylist()):
                found = unpack(payload).column("word").chunks
                if not found:  # texts without any word
                    continue
                raw = pa.concat_arrays(found).cast(pa.large_binary())
                order = pc.sort_indices(raw)
                ordered = raw.take(order)
                number = order.to_numpy().astype(np.int32)
                cuts = np.searchsorted(ordered.to_numpy(zero_copy_only=False), bounds, side="right") if len(bounds) else []
                edges = np.concatenate(([0], cuts, [len(raw)])).astype(np.int64)
                for k in np.flatnonzero(np.diff(edges)):
                    lo, hi = int(edges[k]), int(edges[k + 1])
                    t = pa.table({"idx": pa.array(number[lo:hi]), "word": ordered.slice(lo, hi - lo)})
                    yield pa.RecordBatch.from_pydict(
                        {"bucket": pa.array([k], pa.int32()), "chunk": pa.array([chunk], pa.int64()),
                         "payload": pa.array([lean(t)], pa.binary())})

    def solve(t: pa.Table) -> pa.Table:
        parts = [fat(p, ["idx", "word"]) for p in t.column("payload").to_pylist()]
        word = pa.chunked_array([c for p in parts for c in p.column("word").chunks], type=pa.large_binary())
        coded = pa.concat_arrays(word.chunks).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        order = sorted(range(len(distinct)), key=distinct.__getitem__)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        answers = answer([distinct[i] for i in order])
        codes = back[coded.indices.to_numpy(zero_copy_only=False)]
        out, at = [], 0
        for p in parts:
            own = answers.take(pa.array(codes[at:at + p.num_rows]))
            at += p.num_rows
            out.append(lean(own.append_column("idx", p.column("idx"))))
        names = ",".join([*answers.column_names, "idx"])
        del parts, word, coded, distinct, answers
        give_back()
        return pa.table({"chunk": t.column("chunk"), "names": pa.array([names] * len(out)), "payload": pa.array(out, pa.binary())})

    return (words.mapInArrow(lambda batches: tidy(deal(batches)), "bucket int, chunk long, payload binary")
            .groupBy("bucket").applyInArrow(solve, "chunk long, names string, payload binary"))


def reassemble(chunks: DataFrame, answers: DataFrame,
               fold: Callable[[pa.Table, np.ndarray, np.ndarray], dict[str, pa.Array]],
               key: str, columns: str) -> DataFrame:
    """One row per document: ``fold(answers by word number, word numbers of a
    run of documents, tokens per document)`` gives the columns."""
    key_type = chunks.schema["key"].dataType.simpleString()
    names = [c.split()[0] for c in columns.split(", ")]
    docs = chunks.filter("part = 1").select("chunk", "key", "doc")
    schema = f"`{key}` {key_type}, {columns}"

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({key: left.column("key")} | fold(None, np.empty(0, np.int64), np.empty(0, np.int64)))
        parts = [fat(p, n.split(",")) for p, n in zip(right.column("payload").to_pylist(), right.column("names").to_pylist())]
        by_number = None
        if parts:
            whole = pa.concat_tables(parts).combine_chunks()
            idx = whole.column("idx").to_numpy()
            place = np.empty(len(idx), np.int64)
            place[idx] = np.arange(len(idx))
            by_number = whole.drop_columns(["idx"]).take(pa.array(place)).combine_chunks()
        out = []
        for run in left.combine_chunks().to_batches(max_chunksize=500):
            blobs = run.column("doc").to_pylist()
            raw = np.frombuffer(b"".join(blobs), np.uint8)
            size = np.fromiter((len(x) for x in blobs), np.int64, len(blobs))
            done = np.concatenate(([0], np.cumsum(raw < 0x80)))
            ends = np.cumsum(size)
            lens = done[ends] - done[ends - size]
            cols = fold(by_number, unvarint(raw), lens)
            out.append(pa.table({key: run.column("key")} | {n: cols[n] for n in names}))
        del parts, by_number
        give_back()
        return pa.concat_tables(out)

    return (docs.groupBy("chunk").cogroup(answers.groupBy("chunk"))
            .applyInArrow(join, schema))
