"""Byte-level BPE, token counts and the distinct-word shuffle."""
import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from outcry.llm import bytebpe, tokencount, wordmap

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "key string, doc_id long, text string, words__ int, ids string"
TEXTS = [None, "", " ", "  a  b\n\n c\t", "it's we'll I'M they've", "naïve café — 東京 123 ١٢٣ ²", "🙂🙂  x \u0085y",
         "<|endoftext|> x", "a" * 3000, "word " * 4000, "same", "same", "\x1c\x1d mixed \x00"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(str(i), i, t, i, None) for i, t in enumerate(TEXTS)] + [(None, None, "no id", None, "x"), ("7", 7, TEXTS[7], 7, None)]
    return spark.createDataFrame(rows, SCHEMA)


def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library_and_round_trip(docs):
    lib = library()
    got = bytebpe.decode(bytebpe.encode(docs, RANKS), RANKS).collect()
    assert len(got) == docs.count()
    texts = {i: t or "" for i, t in enumerate(TEXTS)} | {None: "no id"}
    for r in got:
        want = lib.encode_ordinary(texts[r.doc_id])
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert bytes(r.decoded) == texts[r.doc_id].encode()


def test_digests_and_chunks_of_any_size(docs, monkeypatch):
    one = {tuple(r) for r in bytebpe.digests(docs, RANKS).collect()}
    monkeypatch.setattr(wordmap, "CHUNK_TOKENS", 3)
    monkeypatch.setattr(wordmap, "BUCKET_WORDS", 5)
    assert {tuple(r) for r in bytebpe.digests(docs, RANKS).collect()} == one
    ids = library().encode_ordinary(TEXTS[5])
    assert (5, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(TEXTS[5].encode()).hexdigest()) in one


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert bytebpe.digests(none, RANKS).count() == 0
    assert tokencount.token_counts(none, RANKS).count() == 0


def brute(word: bytes, pieces) -> tuple[int, int]:
    best = [(0, 0)] + [None] * len(word)  # (score, -pieces)
    for e in range(1, len(word) + 1):
        best[e] = max((best[s][0] + pieces[word[s:e]], best[s][1] - 1) for s in range(e)
                      if best[s] is not None and word[s:e] in pieces)
    return -best[-1][1], best[-1][0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("thea ingéo1."), min_size=1, max_size=9), min_size=1, max_size=8))
def test_forward_counts_equal_plain_dynamic_programming(words):
    pieces = tokencount.piece_scores(RANKS)
    raw = sorted({w.encode() for w in words})
    counts, scores = tokencount.forward_counts(raw, RANKS)
    assert list(zip(counts, scores)) == [brute(w, pieces) for w in raw]


def test_token_counts_per_document(docs):
    pieces = tokencount.piece_scores(RANKS)
    import regex
    split = regex.compile(public_tokenizers.PATTERN)
    for r in tokencount.token_counts(docs, RANKS).collect():
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        if len(text) > 2000 or "\x1c" in text:
            continue
        parts = [brute(m.group(0).encode(), pieces) for m in split.finditer(text)]
        assert (r.n_pretokens, r.n_tokens, r.score_micronats) == (len(parts), sum(n for n, _ in parts), sum(s for _, s in parts))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**31), max_size=50))
def test_varint_round_trip(codes):
    raw, n = wordmap.varint(np.array(codes, np.int64))
    assert n.sum() == len(raw) and wordmap.unvarint(raw).tolist() == codes


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(-2**31, 2**31 - 1), st.binary(max_size=9), st.lists(st.integers(0, 2**32 - 1), max_size=4),
                          st.integers(-2**63, 2**63 - 1)), max_size=80), st.integers(0, 5))
def test_lean_tables_round_trip(rows, skip):
    import pyarrow as pa
    a, b, c, d = zip(*rows) if rows else ((), (), (), ())
    t = pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.large_binary()), "c": pa.array(c, pa.large_list(pa.uint32())),
                  "d": pa.array(d, pa.int64())})
    for part in (t, t.slice(min(skip, len(rows)))):
        assert wordmap.fat(wordmap.lean(part), part.column_names).to_pydict() == part.to_pydict()


def test_what_the_words_move_grows_with_the_pairs(spark, monkeypatch):
    """Chunks and ranges both grow with the input, what moves for a pair does not."""
    import random
    from pyspark.sql import functions as F
    monkeypatch.setattr(wordmap, "CHUNK_TOKENS", 300)
    monkeypatch.setattr(wordmap, "BUCKET_WORDS", 300)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"  # a chunk ends between two batches
    before = spark.conf.get(setting)
    spark.conf.set(setting, "5")
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(1500)]
    seen, sizes = [], []

    def answer(words):
        import pyarrow as pa
        return pa.table({"q": pa.array([len(w) for w in words], pa.int64())})

    for n in (150, 600):
        docs = spark.createDataFrame([(i, rnd.choices(vocabulary, k=40)) for i in range(n)], "doc_id long, words array<string>").repartition(4)
        chunks = wordmap.explode_words(docs, "doc_id", "words")
        found = wordmap.answer_words(chunks, answer).cache()
        pairs = chunks.filter("part = 0").agg(F.sum("n_words")).first()[0]
        moved = found.agg(F.sum(F.octet_length("payload") + 40)).first()[0]
        seen.append(moved / pairs)
        sizes.append((found.count(), chunks.filter("part = 0").count()))
    spark.conf.set(setting, before)
    assert sizes[1][1] > 3 * sizes[0][1] and sizes[1][0] > 8 * sizes[0][0]  # rows grow faster than the input ...
    assert seen[1] < 4 * seen[0] and seen[1] < 80  # ... but what moves stays within a constant of the pairs


def test_ranges_of_words_are_in_order_and_whole(spark, monkeypatch):
    monkeypatch.setattr(wordmap, "BUCKET_WORDS", 40)
    monkeypatch.setattr(wordmap, "CHUNK_TOKENS", 100)
    import pyarrow as pa
    words = [f"{a}{b}{c}" for a in "xyz" for b in "abcdefg" for c in "pqrst"]
    docs = spark.createDataFrame([(i, words[i:i + 40] + ["x"] * 5) for i in range(60)], "doc_id long, words array<string>").repartition(3)
    chunks = wordmap.explode_words(docs, "doc_id", "words")
    bounds = wordmap._bounds(chunks.filter("part = 0").select("chunk", "n_words", "payload"), 8)
    assert bounds == sorted(set(bounds)) and 4 <= len(bounds) <= 7

    def answer(distinct):
        assert distinct == sorted(distinct)
        # The number of words of the range: shared by words that are neighbours.
        return pa.table({"q": pa.array([int.from_bytes(w[:3], "big") for w in distinct], pa.int64())})

    def fold(by_number, codes, lens):
        q = by_number.column("q").to_numpy()[codes] if len(codes) else np.empty(0, np.int64)
        stops = np.cumsum(lens)
        run = np.concatenate(([0], np.cumsum(q)))
        return {"total": pa.array(run[stops] - run[stops - lens], pa.int64())}

    got = {r.doc_id: r.total for r in wordmap.reassemble(chunks, wordmap.answer_words(chunks, answer), fold, "doc_id", "total long").collect()}
    value = lambda w: int.from_bytes(w.encode()[:3], "big")
    assert got == {i: sum(map(value, words[i:i + 40])) + 5 * value("x") for i in range(60)}
