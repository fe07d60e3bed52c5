"""Token files and WARC bundles."""
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from outcry.llm import files, tokenfile, warc

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=3000))
def test_simple8b_round_trip(ids):
    ids = np.array(ids, dtype=object).astype(np.uint64) if ids else np.empty(0, np.uint64)
    words, offsets = tokenfile.encode(ids)
    assert (tokenfile.decode(words, offsets, len(ids)) == ids).all()


def test_simple8b_blocks_decode_alone():
    ids = np.arange(5000, dtype=np.uint64) % 700
    words, offsets = tokenfile.encode(ids)
    lo, hi = int(offsets[2]), int(offsets[4])
    part = tokenfile.decode(words[lo:hi], offsets[2:4] - offsets[2], 2 * tokenfile.BLOCK)
    assert (part == ids[2 * tokenfile.BLOCK:4 * tokenfile.BLOCK]).all()
    assert len(words) * 8 < len(ids) * 2


def test_zeros_pack_many_to_a_word():
    words, _ = tokenfile.encode(np.zeros(1024, np.uint64))
    assert len(words) <= 6


TEXTS = ["It's THE end, isn't it?", None, "", "naïve Ünïcode ΣΑΣ ﬁ ½ ²", "a\tb\nc\r\nd   e f", "<|endoftext|> and <|x|>",
         "é combining ́x", "x" * 500, "1234 !!! ?! 's 't", "tie", "tie", "İstanbul ǅ ẞ", "\x0b\x0c\x1c\x1d z"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, t, 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[1], None, 1), (None, "no id", None, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start int").repartition(5)


def test_token_files_equal_the_library(docs, monkeypatch):
    lib = Tokenizer.from_file(WORD_BPE)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    want, at = [], 0
    for r in rows:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in tokenfile.digests(docs, WORD_BPE).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    monkeypatch.setattr(tokenfile, "FILE_IDS", 1)
    manifest = tokenfile.write(docs, WORD_BPE, 2)
    assert manifest.count() >= 1
    assert sorted((tuple(r)[:3] for r in tokenfile.read(manifest).collect()), key=lambda r: r[1]) == [w[:3] for w in want]


def test_tokenizer_cache_may_be_small(monkeypatch):
    monkeypatch.setattr(tokenfile, "CACHE", 2)
    lib = Tokenizer.from_file(WORD_BPE)
    for text in ["a b c d e f", "the cat sat", "a b the mat"]:
        ids, lens = tokenfile.tokenize([text, None], WORD_BPE, 2)
        assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids + [2, 2] and lens.tolist()[1] == 1


def test_token_files_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tokenfile.digests(none, WORD_BPE).count() == 0


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a", "<p>x</p>", "u"), (5, "http://b", "<p>x</p>", "u"), (3, None, "<p>x</p>", None), (7, "http://c", None, None),
            (8, "http://d\r\nX: y", "", None), (9, "http://e", "é\r\n\r\nWARC/1.1 ünique" * 3, None), (9, "http://e", "other", None),
            (None, "http://f", "<p>x</p>", None), (5, "http://b", "<p>x</p>", "u"), (12, "http://g", "long " * 300_000, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, id string")


def test_warc_round_trip(pages, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 300)
    got = sorted(map(tuple, warc.digests(pages).collect()), key=str)
    html = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    last = {}
    for p, h in html:
        if p is not None:
            last[h] = max(last.get(h, p), p)
    want = []
    for p, h in html:
        revisit = p is not None and p < last[h]
        want.append((p, len(h), warc.digest(h), "revisit" if revisit else "response", last[h] if revisit else None))
    assert got == sorted(want, key=str)


def test_warc_index_finds_single_records(pages, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 300)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 400)
    index = warc.write(pages)
    assert index.count() == pages.count() and index.select("path").distinct().count() > 1
    one = warc.fetch(index.filter("id = 9")).collect()
    assert {bytes(r.payload).decode() for r in one} == {"é\r\n\r\nWARC/1.1 ünique" * 3, "other"}


def test_warc_seek_table_is_a_skippable_frame(tmp_path):
    import struct
    uri = f"file:{tmp_path}/a.warc.zst"
    w = warc.BundleWriter(uri)
    rows = [x for i in range(3) for x in w.add(i, warc.build_record(i, "u", b"p" * i, None)) + w.flush()] + w.close()
    assert [r[3] for r in rows] == [0, 1, 2]
    raw = (tmp_path / "a.warc.zst").read_bytes()
    import io
    import zstandard
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw[:rows[-1][4] + rows[-1][5]]), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 3
    assert struct.unpack("<I", raw[-4:])[0] == 0x8F92EAB1
    assert [warc.parse_record(f)[1] for f in warc.frames(uri)] == [b"", b"p", b"pp"]
    with files.read(uri) as f:
        assert f.size() == len(raw)


def test_warc_of_an_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.digests(none).count() == 0
