"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Texts are split by the vocabulary's pattern in the JVM; every distinct
pre-token of the corpus is merged once (``wordmap``); ids return to their
positions.  Decoding joins the token-byte table (fixed size: one row per id of
the vocabulary) to every id.

Defined results: a null text counts as empty and gives zero ids; repeated rows
and null or repeated keys give one output row each; extra columns are ignored;
an empty table gives an empty table.  Whole texts are encoded, whatever their
length.  Splitting follows the JVM's Unicode tables: characters assigned after
that Unicode version may be classed otherwise than by the tokenizer library.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import wordmap
from .memory import tidy
from .runtime import prepare, text_or_empty

#: White space as the tokenizer library sees it (the White_Space property).
_SPACE = r"\t\n\x0B\f\r\x85\p{Z}"
#: The split pattern of the rank files in Java syntax, with explicit white space.
JVM_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
               rf"| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def pretokens(text):
    """array<string>: the pattern's matches, whose concatenation is the text."""
    return F.regexp_extract_all(text_or_empty(text), F.lit(JVM_PATTERN), F.lit(0))


@functools.lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}


@functools.lru_cache(2)
def _merger(path: str):
    import tiktoken
    # Words arrive already split, so the library's own pattern is not used.
    return tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks(path), special_tokens={})


def _merge_words(path: str):
    def answer(words: list[bytes]) -> pa.Table:
        one = _merger(path)._core_bpe.encode_single_piece
        ids = [one(w) for w in words]
        return pa.table({"ids": pa.array(ids, pa.large_list(pa.uint32()))})
    return answer


def _ids_of(by_number: pa.Table | None, codes: np.ndarray, lens: np.ndarray) -> dict[str, pa.Array]:
    if not len(lens):
        return {"n_tokens": pa.array([], pa.int64()), "ids": pa.array([], pa.binary())}
    if by_number is None or not len(codes):
        return {"n_tokens": pa.array([0] * len(lens), pa.int64()), "ids": pa.array([b""] * len(lens), pa.binary())}
    picked = by_number.column("ids").combine_chunks()
    picked = (picked.chunk(0) if isinstance(picked, pa.ChunkedArray) else picked).take(pa.array(codes))
    flat = picked.flatten().to_numpy(zero_copy_only=False).astype("<u4")
    sizes = pc.list_value_length(picked).to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    stops = np.cumsum(lens)
    a, b = ends[stops - lens], ends[stops]
    return {"n_tokens": pa.array(b - a, pa.int64()),
            "ids": pa.array([flat[i:j].tobytes() for i, j in zip(a, b)], pa.binary())}


@functools.lru_cache(2)
def token_bytes(path: str) -> pa.Array:
    """The token-byte table: the bytes of id i at place i."""
    table = ranks(path)
    rows = [b""] * (max(table.values()) + 1)
    for token, i in table.items():
        rows[i] = token
    return pa.array(rows, pa.large_binary())


def decode_ids(flat: np.ndarray, path: str) -> tuple[bytes, np.ndarray]:
    """(joined bytes, offset of every id in them and the end)."""
    if not len(flat):
        return b"", np.zeros(1, np.int64)
    got = token_bytes(path).take(pa.array(flat))
    offsets = np.frombuffer(got.buffers()[1], np.int64)[:len(got) + 1]
    # Consecutive values of an Arrow binary array lie next to each other.
    return got.buffers()[2].to_pybytes()[:offsets[-1]], offsets


def _ids_and_bytes(path: str):
    def fold(by_number: pa.Table | None, codes: np.ndarray, lens: np.ndarray) -> dict[str, pa.Array]:
        out = _ids_of(by_number, codes, lens)
        flat = np.frombuffer(b"".join(out["ids"].to_pylist()), "<u4")
        joined, offsets = decode_ids(flat, path)
        stops = np.cumsum(out["n_tokens"].to_numpy(zero_copy_only=False))
        starts = np.concatenate(([0], stops[:-1])) if len(stops) else stops
        return out | {"decoded": pa.array([joined[offsets[i]:offsets[j]] for i, j in zip(starts, stops)], pa.binary())}
    return fold


def encode(docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(key, n_tokens, ids): ids as little-endian unsigned 32-bit integers; with
    ``decoded`` also their bytes, decoded in the same pass (one Python worker a
    task instead of two)."""
    prepare(docs.sparkSession)
    split = docs.select(F.col(key), pretokens(docs[text]).alias("words__"))
    chunks = wordmap.explode_words(split, key, "words__")
    answers = wordmap.answer_words(chunks, _merge_words(ranks_path))
    columns = "n_tokens long, ids binary"
    if decoded:
        return wordmap.reassemble(chunks, answers, _ids_and_bytes(ranks_path), key, columns + ", decoded binary")
    return wordmap.reassemble(chunks, answers, _ids_of, key, columns)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of each row's ``ids`` in order."""
    prepare(encoded.sparkSession)
    fields = encoded.schema
    names = fields.fieldNames()

    def run(batches):
        for b in batches:
            out = [decode_ids(np.frombuffer(ids or b"", "<u4"), ranks_path)[0]
                   for ids in b.column(names.index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())],
                                             names=[*names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", decoded binary"
    return encoded.mapInArrow(lambda batches: tidy(run(batches)), schema)


def digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """The registered query's columns, from the operator's ids and bytes."""
    both = encode(docs, ranks_path, decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
