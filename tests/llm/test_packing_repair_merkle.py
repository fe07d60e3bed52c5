"""Packing, conversation repair and the Merkle manifest against plain versions."""
import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from outcry.llm import merkle, packing, queries, turnrepair as tr

BYTE_BPE = queries.BYTE_BPE


# ------------------------------------------------------------------ op11
ODD = ["a   b", "  lead", "trail ", "trail  ", "a \n b", "x\n\n y\n z", "don't can'T we'll I'm 's 12 345 ½²", "<|endoftext|> a<|endoftext|>b",
       "naïve é é 日本 語　x  y  z", "\r\n a\t b\x0b c\x1c d\x85 e", "", " ", "\n", " \n ", "𝟘𝟙 Ⅷ ① ٣", None, "tie", "tie"]


def library_ids(text):
    return Tokenizer.from_file(BYTE_BPE).encode(text or "", add_special_tokens=False).ids + [1]


def test_ids_equal_the_library():
    rnd = random.Random(3)
    signs = "ab Z1'\n\t .,!é½ 　日s t"
    texts = ODD + ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30))) for _ in range(2000)]
    texts += [s * 30_000 for s in ("x", " ", "ab", "日本", "!")]
    # Every assigned code point beside letters, digits, blanks and itself.
    chars = [chr(c) for c in itertools.chain(range(0xD800), range(0xE000, 0x32000), range(0xE0000, 0xE0200), range(0x10FFF0, 0x110000))]
    texts += ["".join(f"a{c}a 1{c}1 {c} {c}{c}!{c}\n{c} \u0301{c}|" for c in chars[k:k + 50]) for k in range(0, len(chars), 50)]
    lib = Tokenizer.from_file(BYTE_BPE)
    got = packing.tokenize(pa.array(texts), BYTE_BPE, 1)
    for t, g in zip(texts, got):
        assert np.frombuffer(g, "<u4").tolist() == lib.encode(t or "", add_special_tokens=False).ids + [1], repr(t)[:80]
    assert packing.tokenize(pa.array([], pa.string()), BYTE_BPE, 1) == []
    assert packing.tokenize(pa.array([None], pa.string()), BYTE_BPE, 1) == [b"\1\0\0\0"]


def check_packed(rows, docs, room):
    """``docs``: multiset of (doc_id, ids); ``rows``: pieces with ids."""
    by_sequence = defaultdict(list)
    for r in rows:
        assert r.length * 4 == len(r.ids) and r.length > 0
        by_sequence[r.sequence_id].append(r)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= room
        padding += 0 if at & (at - 1) == 0 else room - at
    assert padding == 0
    pieces = defaultdict(list)
    for r in rows:
        pieces[(r.doc_id, r.doc_tokens)].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    want = defaultdict(list)
    for d, ids in docs:
        want[(d, len(ids))].append(ids)
    assert pieces.keys() == want.keys()
    for key, all_ids in want.items():
        covered = sorted((s + k, x) for s, ids in pieces[key] for k, x in enumerate(ids))
        assert covered == sorted((k, x) for ids in all_ids for k, x in enumerate(ids))


@pytest.mark.parametrize("room,most,merge", [(2048, 64, 16), (32, 3, 2), (16, 1, 2)])
def test_packing_covers_every_id_without_padding(spark, monkeypatch, room, most, merge):
    for name, value in (("WINDOW", room), ("OPEN", most), ("MERGE", merge)):
        monkeypatch.setattr(packing, name, value)
    rnd = random.Random(room)
    texts = ODD + [" ".join(rnd.choice("the cat sat on a mat of words".split()) for _ in range(rnd.randint(0, 90))) for _ in range(60)]
    texts.append("long words " * 4000)
    rows = [(None if i % 11 == 5 else i % 40, t, i, i, "x") for i, t in enumerate(texts)]
    rows += rows[:3]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long, part long, ids string").repartition(7)
    got = packing.pack(docs, BYTE_BPE, 1).collect()
    check_packed(got, [(r[0], library_ids(r[1])) for r in rows], room)
    again = packing.digests(docs, BYTE_BPE).collect()
    assert sorted((r.length, r.ids_crc32) for r in again) == sorted((r.length, zlib.crc32(r.ids)) for r in got)


def test_packing_of_an_empty_table(spark):
    assert packing.digests(spark.createDataFrame([], "doc_id long, text string"), BYTE_BPE).count() == 0


def test_open_windows_are_bounded_and_emitted_ones_full():
    rnd = random.Random(1)
    packer, done = packing.Packer(100, 4), []
    for i in range(2000):
        n = rnd.randint(1, 250)
        packer.add((i, 0, n, b"\0" * 4 * n))
        assert len(packer.windows) <= 4
        done += packer.take()
    assert all(sum(len(p[3]) for p in w) == 400 for w in done)
    left = packer.leftovers()
    assert len(left) <= 4
    sizes = [sum(len(p[3]) for p in w) // 4 for w in packing.filled(left, 100)]
    assert all(s == 100 or s & (s - 1) == 0 for s in sizes) and sizes == sorted(sizes, reverse=True)


# ------------------------------------------------------------------ op12
def plain_repair(rows):
    """One conversation: (turn, role, text) after damage, in order."""
    seen, n, faults = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for turn, role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        kind = ("blank" if not visible else "duplicate" if (role, text) in seen else
                "truncated" if visible[-1] not in ".!?" else None)
        seen.add((role, text))
        faults.append(kind)
        if kind:
            n[kind] += 1
    turns = [t for t, _, _ in rows if t is not None]
    n["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    n["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    def insertions(cells):
        for _ in range(3):
            for last, (cost, audit, out) in list(cells.items()):
                for c, name in (("u", "user"), ("a", "assistant")):
                    if c in follow[last]:
                        cells[c] = min(cells.get(c, (10**9, "", ())), (cost + 5, audit + "I", (*out, (name, ""))))
        return cells

    cells = insertions({"": (0, "", ())})
    for (turn, role, text), kind in zip(rows, faults):
        new = {}

        def offer(state, value):
            new[state] = min(new.get(state, value), value)

        for last, (cost, audit, out) in cells.items():
            offer(last, (cost + 2, audit + "D", out))
            if kind not in ("blank", "duplicate"):
                more = 5 if kind == "truncated" else 0
                if role and role[0] in follow[last]:
                    offer(role[0], (cost + more, audit + "K", (*out, (role, text))))
                for c, name in (("u", "user"), ("a", "assistant")):
                    if c in follow[last]:
                        offer(c, (cost + 1 + more, audit + "R", (*out, (name, text))))
        cells = insertions(new)
    cost, audit, out = min(cells[s] for s in ("", "a") if s in cells)
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return n | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}


def plain_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm = zlib.crc32(key.encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        out[conv]
        if harm == 1:
            text = ""
        if harm == 2:
            text = re.sub(r"[.!?]", "", text)
        if harm == 4:
            role = "user"
        if harm:
            out[conv] += [(turn, role, text)] * (2 if harm == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest())
    return {c: sorted(v, key=order) for c, v in out.items()}


def conversation_rows(rnd, convs, turns):
    texts = ["Hi.", "Yes!", "No?", "cut off", " ", "", "\t\n", "a b. ", "é", "odd.\xa0", None, "Hi."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "usher"]
    rows = []
    for c in range(convs):
        conv = None if c == 3 else c
        for t in range(rnd.randint(1, turns)):
            rows.append((conv, None if rnd.random() < .05 else t + rnd.randint(0, 1) * (rnd.random() < .2), rnd.choice(roles[:3 if c % 2 else 9]), rnd.choice(texts)))
    return rows


def repaired(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, cost int")
    return {r.conv_id: r.asDict() for r in tr.digests(df.repartition(parts)).collect()}


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_repair_equals_a_plain_programme(spark, monkeypatch, block):
    monkeypatch.setattr(tr, "BLOCK", block)
    rnd = random.Random(block)
    rows = conversation_rows(rnd, 60, 14) + [(77, t, rnd.choice(["user", "assistant"]), f"t{t % 50}.") for t in range(300)]
    rows += [(78, t, "user", f"u{t}.") for t in range(120)]
    rows += rows[:4]
    want = {c: plain_repair(v) for c, v in plain_damage(rows).items()}
    got = repaired(spark, rows)
    assert got.keys() == want.keys()
    for c in want:
        assert {k: got[c][k] for k in want[c]} == want[c], c


def test_repair_survives_hash_collisions(monkeypatch):
    rnd = random.Random(9)
    rows = [[(t, rnd.choice(["user", "assistant", "system"]), f"{rnd.randint(0, 9)}.") for t in range(40)] for _ in range(40)]

    def audit(conv):
        seen, cells = set(), tr.inserted(tr.started(0))
        for _, role, text in conv:
            cells = tr.stepped(cells, role[:1], (role, text) in seen, False)
            seen.add((role, text))
        return tr.best(cells)

    true = [audit(r) for r in rows]
    assert true == [(w["cost"], w["audit"]) for w in map(plain_repair, rows)]
    monkeypatch.setattr(tr, "_MASK", 7)
    assert [audit(r) for r in rows] == true


def test_comparison_of_linked_audits():
    rnd = random.Random(4)
    nodes = [(tr.Node(None, ""), "")]
    for _ in range(400):
        n, text = rnd.choice(nodes)
        piece = rnd.choice("DIKR") if rnd.random() < .8 else "".join(rnd.choices("DK", k=3))
        nodes.append((tr.Node(n, piece), text + piece))
    for _ in range(4000):
        (a, x), (b, y) = rnd.choice(nodes), rnd.choice(nodes)
        assert a.text() == x and tr.compare(a, b) == (x > y) - (x < y)


def test_repair_of_an_empty_table_and_lost_rows(spark):
    assert tr.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repaired(spark, [(lost, 0, "user", "Hi.")])[lost]
    assert got["audit"] == "" and got["repaired_sha256"] == hashlib.sha256(b"").hexdigest() and got["gaps"] == got["cost"] == 0


def test_repaired_messages(spark):
    conv = next(c for c in range(1000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in range(4)))
    rows = [(conv, t, r, x) for t, (r, x) in enumerate([("system", "Be brief."), ("user", "Hi."), ("user", "There?"), ("assistant", "Yes.")])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    damaged = tr.materialize(tr.damaged(df), "d")
    chosen = tr.audits(tr.blocks(tr.faults(damaged)))
    assert chosen.first().audit == "KDKK"
    lines = [(r.edit, r.role, r.text) for r in tr.repaired(damaged, chosen).orderBy("place").collect()]
    assert lines == [("K", "system", "Be brief."), ("K", "user", "There?"), ("K", "assistant", "Yes.")]


# ------------------------------------------------------------------ op13
def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_merkle(rows):
    """rows of (doc_id, source, lang, n_chars, text) to sorted result rows."""
    def leaf(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(leaves):
        """(root, siblings of each leaf per level as (left, right))"""
        paths, levels = [[] for _ in leaves], [list(leaves)]
        while len(levels[-1]) > 1:
            n = levels[-1]
            levels.append([sha("".join(n[i:i + 16])) for i in range(0, len(n), 16)])
        for i, p in enumerate(paths):
            for n in levels[:-1]:
                a = i // 16 * 16
                p.append(("".join(n[a:i]), "".join(n[i + 1:a + 16])))
                i //= 16
        return levels[-1][0], paths

    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = [tree([g[2] for g in sorted(groups[s], key=lambda g: g[:3])]) for s in names]
    root, high = tree([s[0] for s in subs])
    out = []
    for name, (subroot, paths), above in zip(names, subs, high):
        for (_, _, own, r), path in zip(sorted(groups[name], key=lambda g: g[:3]), paths):
            path = path + above
            h = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                h = leaf((*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4])))
            for left, right in path:
                h = sha(left + h + right)
            out.append((r[0], own, subroot, root, sha("".join(a + b for a, b in path)), h, h == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def merkle_rows(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, "
                               "slots string, size int").repartition(5)
    return sorted((tuple(r[c] for c in COLUMNS) for r in merkle.digests(df).collect()), key=str)


def test_merkle_equals_a_plain_tree(spark):
    rnd = random.Random(5)
    sources = ["a", "b", "Ä", "", None, "long/" * 9] + [f"s{i}" for i in range(20)]
    ids = rnd.sample(range(-(1 << 62), 1 << 62), 60) + list(range(0, 700, 2)) + [-(1 << 63), (1 << 63) - 1, 63, 64, 65]
    rows = [(i, rnd.choice(sources), rnd.choice(["en", None]), rnd.choice([None, 3]), rnd.choice(["Text", "äÖ", "", None, "low", "X" * 5000])) for i in ids]
    rows += [(i, "a", "en", 1, f"Hot {i}") for i in range(1000, 1300)]
    rows += [(None, s, None, None, t) for s in ("a", None) for t in ("N", "N", "M", None)]
    rows += [(1001, "a", "en", 1, "Hot 1001")] * 3 + [(1001, "a", "en", 1, f"Other {k}") for k in range(3)]
    assert merkle_rows(spark, rows) == plain_merkle(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17])
def test_merkle_of_small_tables(spark, n):
    rows = [(i, "one", "en", 1, f"Text {i}") for i in range(n)]
    assert merkle_rows(spark, rows) == (plain_merkle(rows) if n else [])


def test_merkle_bitmap_ranks(spark):
    rnd = random.Random(6)
    keys = [rnd.choice([rnd.randrange(-(1 << 63), 1 << 63), rnd.randrange(300), rnd.randrange(1 << 40)]) for _ in range(600)]
    keys += keys[:50]
    df = spark.createDataFrame([(str(i % 3), k) for i, k in enumerate(keys)], "g string, k long")
    groups = defaultdict(list)
    for i, k in enumerate(keys):
        groups[str(i % 3)].append(k)
    for r in merkle.ranked(df, "g", "k").collect():
        own = groups[r.g]
        assert (r["rank"], r["same"], r["size"]) == (sum(x < r.k for x in own), own.count(r.k), len(own))


@pytest.mark.parametrize("name", ["op12_turn_repair", "op13_merkle"])
def test_queries_equal_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = queries.QUERIES[name](spark, sf)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in got.select(*names).collect())
