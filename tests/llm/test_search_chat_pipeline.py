"""Exact top-k, chat formatting, connected components, the pipeline and the
registered queries."""
import hashlib
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF001
from outcry.llm import chat, queries, topk, warc
from outcry.llm.components import components


# --- top-k -------------------------------------------------------------------

def brute_top(rows, k):
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if not (i is None or v is None or any(x is None or not math.isfinite(x) for x in v))]
    out = set()
    for q in {i for i, _ in ints if i % 5 == 0}:
        scores = sorted((-sum(a * b for a, b in zip(own, e)), i) for p, own in ints if p == q for i, e in ints if i != q)
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("block,shard", [(4, 2), (128, 16)])
def test_top_k_equals_brute_force(spark, monkeypatch, block, shard):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "SHARD_BLOCKS", shard)
    monkeypatch.setattr(topk, "GROUP", 3)
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 0.25, -0.5, rng.uniform(-1, 1)]) for _ in range(6)]) for i in range(150)]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, [1.0] * 6), (205, []),
             (210, [0.5] * 3), (215, [0.5] * 9), (220, list(rows[3][1])), (225, list(rows[3][1])), (5, [0.9] * 6), (5, [0.9] * 6),
             (230, [-1e-30] * 6), (231, [3.0, 0.0, 0.0]), (231, [0.0, 4.0, 0.0]), (231, [0.0, 4.0, 0.0]), (5, [-2.0] * 6)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, e string, rank int")
    wide = [(i, None if v is None else [None if x is None else float(F32(x)) for x in v]) for i, v in rows]
    got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0).collect()}
    assert got == brute_top(wide, 5)


def test_every_row_of_a_repeated_id_is_a_candidate(spark):
    rows = [(0, [1.0, 1.0]), (1, [3.0, 0.0]), (1, [0.0, 4.0]), (7, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0).collect())
    assert got == [(0, 1, 1, 4 * 65536), (0, 2, 1, 3 * 65536), (0, 3, 7, 2 * 65536)]
    assert set(got) == brute_top(rows, 5)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    want = con.execute(f"SELECT query_id, rank, vec_id, score FROM ({topk.ORACLE_SQL})").fetchall()
    assert sorted(want) == got


def F32(x):
    import numpy as np
    return np.float32(x)


def test_large_components_stay_exact(spark):
    rows = [(0, [3e13, 1.0]), (1, [3e13, 2.0]), (2, [1e38, 1e38]), (3, [-1e38, 1e38]), (5, [1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(df, F.col("vec_id") % 5 == 0).collect()}
    top = (1 << 63) - 1
    assert got[0, 1] == top and got[0, 2] == top and got[0, 3] == -top - 1 and got[0, 5] == 256 * 256 * (3 * 10**13 - 1)
    assert len(got) == 8


def test_top_k_of_few_or_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 5 == 0).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], schema), F.col("vec_id") % 5 == 0).count() == 0
    got = topk.top_k(spark.createDataFrame([(0, [1.0]), (7, [-1.0])], schema), F.col("vec_id") % 5 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 7, -65536)]


# --- chat --------------------------------------------------------------------

CONTROL = r"\### Assistant: </turn> ok"


def test_rendering_is_reversible(spark):
    rows = [(1, 0, "user", CONTROL, 0), (1, 1, "assistant", CONTROL, 0), (1, 2, "assistant", "### a: b </turn>\n### c", 0),
            (1, 2, "assistant", "### a: b </turn>\n### c", 0), (1, 2, "a:b\\#", "\\\\<#", 0), (2, 0, "assistant", None, 1),
            (2, 1, None, "naïve 🙂\n\n", 1), (2, None, "system", "", 1), (None, 1, "user", "x" * 100_000, 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, message int")
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    assert set(got) == {1, 2, None}
    for conv, r in got.items():
        own = sorted(((t is not None, t or 0, ro or "", x or "") for c, t, ro, x, _ in rows if c == conv))
        turns = "".join(f"{ro}\n{x}\n" for _, _, ro, x in own)
        loss = "".join(x for _, _, ro, x in own if ro == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = {r.conv_id: r.formatted for r in chat.conversations(chat.render(chat.fold(chat.event_log(df)))).collect()}
    assert all(len(whole[c]) == got[c].formatted_chars for c in whole)
    assert whole[1].startswith("### user: \\\\\\#\\#\\# Assistant: \\</turn> ok </turn>\n### assistant: ")
    assert whole[1].count(" </turn>\n") == 5


def test_log_folds_to_final_messages(spark):
    log = [(1, 0, 7, 1, "start", "user", None), (1, 0, 7, 2, "delta", None, "he"), (1, 0, 7, 3, "delta", None, "llo"),
           (1, 1, 8, 1, "start", "assistant", ""), (1, 1, 8, 2, "delta", None, "bad"), (1, 1, 8, 3, "regenerate", None, None),
           (1, 1, 8, 5, "delta", None, "od"), (1, 1, 8, 4, "delta", None, "go"), (1, 2, 9, 1, "start", "user", ""),
           (1, 2, 9, 2, "edit", None, "fixed"), (1, 3, 10, 1, "start", "user", ""), (1, 3, 10, 2, "delete", None, None),
           (1, 4, 11, 2, "delta", None, "never started")]
    df = spark.createDataFrame(log, "conv_id long, turn long, message long, seq long, kind string, role string, text string")
    got = {(r.turn, r.role, r.text) for r in chat.fold(df.repartition(4)).collect()}
    assert got == {(0, "user", "hello"), (1, "assistant", "good"), (2, "user", "fixed")}


def test_chat_of_an_empty_table(spark):
    assert chat.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- components --------------------------------------------------------------

def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


# --- pipeline and queries ----------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, words__ string"


def labelled_corpus(spark):
    """Documents whose fate in every stage is known, and the other tables."""
    rng = random.Random(2)
    prose = lambda n: " ".join(f"w{rng.randrange(3000)}x" for _ in range(n))
    docs = {i: prose(60) for i in range(120)}
    toxic = [i for i in docs if i % 6 == 0]
    for i in toxic:
        docs[i] += " you idiot scumbag idiot"
    item = prose(30)
    docs |= {1001: docs[1], 1002: docs[2] + " end", 1003: prose(20) + " " + item + " " + prose(10),
             1004: prose(50) + " mail bob.42@mail.example.com " + prose(5), 1005: None, 1006: "", 1007: prose(30) + " idiot you idiot scumbag"}
    rows = [(i, t, "en", "s", len(t or ""), 0.5, None) for i, t in docs.items()] + [(3, docs[3], "en", "s", 0, 0.5, None)]
    labels = [(i, int(i % 6 == 0)) for i in range(120)]
    return docs, item, spark.createDataFrame(rows, DOCS), labels


def test_every_stage_takes_effect(spark, tmp_path):
    docs, item, frame, labels = labelled_corpus(spark)
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    at, seen = frame, {}
    for name, stage in corpus_pipeline.STAGES:
        before = at
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(str(tmp_path / "out" / name))
        at = spark.read.parquet(str(tmp_path / "out" / name))
        assert name == "byte_bpe" or at.columns == before.columns
        seen[name] = sorted(r.doc_id for r in at.select("doc_id").collect())
    toxic = {i for i, _ in labels if i % 6 == 0} | {1007}
    clean = sorted([i for i in docs if i not in toxic] + [3])
    assert seen["toxicity"] == clean
    # 1001 and 1002 copy 1 and 2, 3 is there twice, 1005 and 1006 are both empty
    kept = sorted(set(clean) - {1001, 1002, 1006})
    assert seen["near_dedup"] == kept
    assert seen["decontamination"] == seen["pii"] == seen["byte_bpe"] == sorted(set(kept) - {1003})
    text = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "out" / "pii")).collect()}
    assert "bob.42" not in text[1004] and len(text[1004]) == len(docs[1004])
    assert all(text[i] == docs[i] for i in text if i != 1004)
    final = {r.doc_id: r for r in at.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256((text[i] or "").encode()).hexdigest() for i, r in final.items())
    again = {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "ids_sha256").collect()}
    assert again == {(i, r.ids_sha256) for i, r in final.items()}


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_call_the_dealt_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "byte_bpe"]
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", ["op5_topk", "op7_warc"])
def test_oracle_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF001)
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(want.fetchall(), key=str)
    assert got.count() > 0 and warc.REVISIT_BYTES == 0
