"""Near-duplicates by order MinHash, verified by banded alignment.

Texts are sequences of lower-cased words (runs of letters, digits and marks)
and k-mers are runs of five words.  The j-th occurrence of a k-mer carries the
label j.  For each of ``SKETCHES`` hash functions the ``PICKS`` smallest
labelled k-mers are chosen and kept in text order; their hash is a bucket, so a
shared bucket means shared k-mers in the same order (edit similarity, not only
set overlap).

Documents that share a bucket are candidates.  A pair is similar if an
alignment of its labelled k-mer sequences that preserves order matches M of
them with M / (n1 + n2 - M) >= 0.8.  Such an alignment stays within a band
around the diagonal, so only matches in the band are chained.

Large groups: equal texts become one node before any candidate is built.  In a
bucket every node is first tested against the smallest one; the links found
contract the group, and only pairs of nodes that are still in different classes
are tested afterwards.  In buckets of up to ``SMALL`` nodes these pairs are
listed.  In larger ones the nodes outside the bucket's largest class meet all
its nodes in blocks of about ``BLOCK``: the numbers of common k-mers of two
blocks are one matrix product, an upper bound of the alignment, and only pairs
that reach the threshold are aligned.  Of the links of two blocks a spanning
forest is kept, so neither pairs nor links of a group are listed one by one,
and no candidate is dropped.

Defined results: null text counts as empty.  Texts without any word are equal
only to identical texts; texts of fewer than five words are one k-mer.  Rows
that share a doc_id are one document.  A row without doc_id gets class null.
Extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .memory import tidy
from .runtime import WORD_GAP, materialize, prepare, text_or_empty

K = 5
SKETCHES = 16
PICKS = 3
SIMILARITY = 0.8
SMALL = 16
BLOCK = 256

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (multiply, xor-shift)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmers(words: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the five-word runs of consecutive documents, and their count
    per document.  A document of 1-4 words has one k-mer, padded."""
    n = np.where(lens > 0, np.maximum(lens - K + 1, 1), 0)
    ends, stops = np.cumsum(n), np.cumsum(lens)
    first = np.repeat(stops - lens, n) + np.arange(int(n.sum())) - np.repeat(ends - n, n)
    last = np.repeat(stops, n)
    wide = words.astype(np.int64).view(np.uint64) if len(words) else np.empty(0, np.uint64)
    h = np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(K):
            at = first + k
            inside = at < last
            w = np.where(inside, wide[np.minimum(at, max(len(wide) - 1, 0))] + np.uint64(1), np.uint64(0))
            h = _mix(h * _MIX + w + np.uint64(k + 1))
    return h, n


def labelled(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """k-mer hash combined with its occurrence number within its document."""
    doc = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    with np.errstate(over="ignore"):
        own = _mix(h + doc * _MIX)
    order = np.argsort(own, kind="stable")
    srt = own[order]
    new = np.ones(len(srt), bool)
    new[1:] = srt[1:] != srt[:-1]
    at = np.arange(len(srt))
    run = at - np.maximum.accumulate(np.where(new, at, 0))
    nth = np.empty(len(srt), np.uint64)
    nth[order] = run.astype(np.uint64)
    with np.errstate(over="ignore"):
        return np.where(nth > 0, _mix(h + nth * np.uint64(0xD6E8FEB86659FD93)), h)


def sketches(words: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Bucket keys, one row per document with at least one word."""
    h, n = kmers(words, lens)
    lab = labelled(h, n)
    has = n > 0
    size = n[has]
    starts = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size)), size)
    keys = np.empty((len(size), SKETCHES), np.int64)
    if not len(size):
        return keys
    with np.errstate(over="ignore"):
        for j in range(SKETCHES):
            v = _mix(lab * np.uint64(2 * j + 1) + np.uint64(j + 1) * _MIX)
            np.minimum(v, _MAX - np.uint64(1), out=v)
            picked = np.full((PICKS, len(size)), np.iinfo(np.int64).max)
            for p in range(PICKS):
                low = np.minimum.reduceat(v, starts)
                at = np.flatnonzero(v == low[owner])
                real = at[v[at] != _MAX]
                doc, one = np.unique(owner[real], return_index=True)
                picked[p, doc] = real[one]
                v[picked[p, doc]] = _MAX
            picked.sort(axis=0)
            key = np.full(len(size), j + 1, np.uint64)
            for p in range(PICKS):
                some = picked[p] < len(h)
                part = np.where(some, h[np.minimum(picked[p], len(h) - 1)], np.uint64(7))
                key = _mix(key * _MIX + part)
            keys[:, j] = key.view(np.int64)
    return keys


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Order-preserving alignment similarity of two word sequences, or 0.0 as
    soon as it cannot reach ``least``."""
    h, n = kmers(np.concatenate([a, b]), np.array([len(a), len(b)]))
    x = labelled(h, n)
    x, y = x[:n[0]], x[n[0]:]
    n1, n2 = len(x), len(y)
    if not n1 or not n2:
        return 0.0
    need = int(np.ceil(least / (1 + least) * (n1 + n2) - 1e-9))
    if min(n1, n2) < need:
        return 0.0
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if len(i) < need:
        return 0.0
    # At most n1 - need k-mers of one side and n2 - need of the other are unmatched.
    inside = (i - j <= n1 - need) & (j - i <= n2 - need)
    i, j = i[inside], j[inside]
    j = j[np.argsort(i)]
    if len(j) > 1 and not np.all(j[1:] > j[:-1]):
        tails: list[int] = []
        for q in j.tolist():
            k = bisect_left(tails, q)
            if k == len(tails):
                tails.append(q)
            else:
                tails[k] = q
        m = len(tails)
    else:
        m = len(j)
    sim = m / (n1 + n2 - m)
    return sim if sim >= least else 0.0


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return (col.flatten().to_numpy(zero_copy_only=False),
            np.diff(col.offsets.to_numpy()) if not col.null_count else
            np.array([0 if x is None else len(x) for x in col.to_pylist()]))


def _sketch_batches(batches):
    for b in batches:
        words, lens = _lists(b.column(2))
        keys = sketches(words, lens)
        has = lens > 0
        offsets = np.concatenate(([0], np.cumsum(np.where(has, SKETCHES, 0)))).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(lens, pa.int32()),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel(), pa.int64()))],
            names=["doc_id", "text_key", "n_words", "keys"])


def _verify_batches(batches):
    for b in batches:
        u, v = b.column(0).to_pylist(), b.column(1).to_pylist()
        (wa, la), (wb, lb) = _lists(b.column(2)), _lists(b.column(3))
        ea, eb = np.cumsum(la), np.cumsum(lb)
        sim = [similarity(wa[ea[r] - la[r]:ea[r]], wb[eb[r] - lb[r]:eb[r]]) for r in range(len(u))]
        keep = [r for r in range(len(u)) if sim[r] > 0]
        yield pa.RecordBatch.from_pydict({"u": pa.array([u[r] for r in keep], pa.int64()),
                                          "v": pa.array([v[r] for r in keep], pa.int64()),
                                          "similarity": pa.array([sim[r] for r in keep], pa.float64())})


def _normal(text):
    """Lower-cased words joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), WORD_GAP, " "))


def _word_ids(normal):
    return F.when(F.col(normal) == "", F.array().cast("array<int>")).otherwise(
        F.transform(F.split(F.col(normal), " "), lambda w: F.hash(w)))


def _classed(nodes: DataFrame, column: str, roots: DataFrame, out: str) -> DataFrame:
    """Adds the class of node ``column``: its root, or itself."""
    r = roots.select(F.col("node").alias(column), F.col("root").alias("root__"))
    return nodes.join(r, column, "left").withColumn(out, F.coalesce("root__", column)).drop("root__")


def _labelled_rows(col: pa.Array) -> list[np.ndarray]:
    """Labelled k-mers of each word list, in text order."""
    words, lens = _lists(col)
    h, n = kmers(words, lens)
    x, ends = labelled(h, n), np.cumsum(n)
    return [x[e - k:e] for e, k in zip(ends, n)]


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """(left, right) counts of common labelled k-mers, by products of incidence
    matrices over the k-mers that both sides have."""
    a = np.concatenate(left) if left else np.empty(0, np.uint64)
    b = np.concatenate(right) if right else np.empty(0, np.uint64)
    both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    rows = [np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (left, right)]
    places = [np.searchsorted(both, v) for v in (a, b)]
    real = [(p < len(both)) & (both[np.minimum(p, len(both) - 1)] == v) if len(both) else np.zeros(len(v), bool)
            for p, v in zip(places, (a, b))]
    for lo in range(0, len(both), 8192):
        hi = min(lo + 8192, len(both))
        dense = []
        for side, n in ((0, len(left)), (1, len(right))):
            at = real[side] & (places[side] >= lo) & (places[side] < hi)
            m = np.zeros((n, hi - lo), np.float32)
            m[rows[side][at], places[side][at] - lo] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def _block_batches(batches):
    """Each row is a pair of blocks of one bucket.  Pairs of nodes in different
    classes are tested; of the links only a spanning forest is returned."""
    for b in batches:
        for r in range(b.num_rows):
            left, right = b.column(0)[r].values, b.column(1)[r].values
            nodes = [x.field("node").to_pylist() for x in (left, right)]
            classes = [x.field("class").to_numpy(zero_copy_only=False) for x in (left, right)]
            words = [_lists(x.field("words")) for x in (left, right)]
            stops = [np.cumsum(n) for _, n in words]
            kmer = [_labelled_rows(x.field("words")) for x in (left, right)]
            sizes = [np.array([len(k) for k in x]) for x in kmer]
            m = _common(*kmer)
            total = sizes[0][:, None] + sizes[1][None, :]
            may = (m >= SIMILARITY * (total - m) - 1e-3) & (classes[0][:, None] != classes[1][None, :])
            root: dict[int, int] = {}

            def find(x):
                while root.setdefault(x, x) != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            u, v, s = [], [], []
            for i, j in zip(*np.nonzero(may)):
                a, c = find(int(classes[0][i])), find(int(classes[1][j]))
                if a == c:
                    continue
                (wa, na), (wb, nb) = words
                sim = similarity(wa[stops[0][i] - na[i]:stops[0][i]], wb[stops[1][j] - nb[j]:stops[1][j]])
                if sim > 0:
                    root[max(a, c)] = min(a, c)
                    u.append(min(nodes[0][i], nodes[1][j]))
                    v.append(max(nodes[0][i], nodes[1][j]))
                    s.append(sim)
            yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()),
                                              "similarity": pa.array(s, pa.float64())})


def _test_blocks(left: DataFrame, seqs: DataFrame) -> DataFrame:
    """Links between nodes of different classes in the buckets of ``left``
    (key, node, members, class), found block by block: nodes outside the largest
    class of a bucket against all its nodes."""
    main = (left.groupBy("key", "class").agg(F.count("*").alias("n"))
            .groupBy("key").agg(F.max_by("class", F.struct("n", "class")).alias("main")))
    rows = (left.join(main, "key").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
            .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
            .join(seqs, "node"))
    member = F.collect_list(F.struct("node", "class", "words"))
    every = rows.groupBy("key", "block").agg(member.alias("right"))
    outside = (rows.filter("class <> main").groupBy("key", F.col("block").alias("own"), "blocks").agg(member.alias("left"))
               .select("key", "left", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")))
    return (outside.join(every, ["key", "block"]).select("left", "right")
            .mapInArrow(lambda batches: tidy(_block_batches(batches)), "u long, v long, similarity double"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((doc_id, class_id), links): every document with the smallest doc_id of
    its class, and verified links (u, v, similarity) that join the classes;
    texts are named by the smallest doc_id that has them."""
    spark = docs.sparkSession
    prepare(spark)
    rows = (docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(docs[text]).alias("text__"))
            .withColumn("normal__", _normal(F.col("text__"))))
    # Equal word sequences are one text; without any word, only equal texts are.
    text_key = F.when(F.col("normal__") == "", F.concat(F.lit("-"), F.md5("text__"))).otherwise(F.md5("normal__"))
    one_pass = rows.select("doc_id", text_key.alias("text_key"), _word_ids("normal__").alias("words")).mapInArrow(
        lambda batches: tidy(_sketch_batches(batches)), "doc_id long, text_key string, n_words int, keys array<long>")
    sketched = materialize(one_pass, "omh")

    # Equal texts become one node, named by the smallest doc_id.
    nodes = materialize(
        sketched.groupBy("text_key").agg(F.min("doc_id").alias("node"), F.max("n_words").alias("n_words"),
                                         F.max("keys").alias("keys")), "nodes")
    buckets = (nodes.filter("node IS NOT NULL").select("node", "n_words", F.explode("keys").alias("key")))
    shared = (buckets.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last"),
                                         F.min_by("n_words", "node").alias("lead_words"), F.count("*").alias("members"))
              .filter("lead < last"))
    members = materialize(buckets.join(shared, "key").drop("last"), "members")

    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    seqs = materialize(
        rows.join(wanted, "doc_id", "left_semi").select(F.col("doc_id").alias("node"), _word_ids("normal__").alias("words"))
        .distinct(), "sequences")

    # Different texts of one doc_id belong together as they are.
    member = sketched.join(nodes.select("text_key", "node"), "text_key").select("doc_id", "node")
    several = (member.filter("doc_id IS NOT NULL").groupBy("doc_id")
               .agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi"))
    same_id = (member.join(several, "doc_id").filter("node <> lo")
               .select(F.col("node").alias("u"), F.col("lo").alias("v")).distinct())

    def length_ok(a, b):
        k = lambda c: F.greatest(c - K + 1, F.lit(1))
        return F.least(k(a), k(b)) >= SIMILARITY * F.greatest(k(a), k(b)) - F.lit(1e-9)

    def verify(pairs: DataFrame) -> DataFrame:
        a = seqs.select(F.col("node").alias("u"), F.col("words").alias("a"))
        b = seqs.select(F.col("node").alias("v"), F.col("words").alias("b"))
        return materialize(pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b")
                           .mapInArrow(lambda batches: tidy(_verify_batches(batches)), "u long, v long, similarity double"), "links")

    tested = materialize(
        members.filter((F.col("node") != F.col("lead")) & length_ok(F.col("n_words"), F.col("lead_words")))
        .select(F.col("lead").alias("u"), F.col("node").alias("v")).distinct(), "pairs")
    links = verify(tested)
    roots = materialize(components(same_id.union(links.select("u", "v"))), "roots")

    def still_open(some: DataFrame) -> DataFrame:
        """The rows of buckets whose nodes are in different classes."""
        now = _classed(some.select("key", "node", "n_words", "members"), "node", roots, "class")
        spans = now.groupBy("key").agg(F.min("class").alias("c1"), F.max("class").alias("c2")).filter("c1 < c2")
        return now.join(spans.select("key"), "key", "left_semi")

    # Small buckets: every pair of nodes in different classes.
    left = still_open(members.filter(F.col("members") <= SMALL))
    other = left.select("key", F.col("node").alias("node2"), F.col("n_words").alias("words2"), F.col("class").alias("class2"))
    pairs = materialize(
        left.join(other, "key")
        .filter((F.col("node") < F.col("node2")) & (F.col("class") != F.col("class2"))
                & length_ok(F.col("n_words"), F.col("words2")))
        .select(F.col("node").alias("u"), F.col("node2").alias("v")).distinct().join(tested, ["u", "v"], "left_anti"), "pairs")
    links = links.union(verify(pairs))
    roots = materialize(components(same_id.union(links.select("u", "v"))), "roots")
    # Large buckets: first each node in its largest one, then all that are left.
    large = members.filter(F.col("members") > SMALL).select("key", "node", "n_words", "members")
    for one_bucket in (True, False):
        left = materialize(still_open(large), "open")
        if left.isEmpty():
            break
        if one_bucket:
            chosen = left.groupBy("node").agg(F.max_by("key", F.struct("members", "key")).alias("key"))
            left = left.join(chosen, ["node", "key"], "left_semi")
        links = links.union(materialize(_test_blocks(left, seqs), "links"))
        roots = materialize(components(same_id.union(links.select("u", "v"))), "roots")
    classes = (_classed(member, "node", roots, "class_id")
               .select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id")))
    return classes, links


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, class_size): one row per input row."""
    found, _ = near_duplicates(docs, doc_id, text)
    found = materialize(found, "classes")
    sizes = found.filter("class_id IS NOT NULL").groupBy("class_id").agg(F.countDistinct("doc_id").alias("class_size"))
    return found.join(sizes, "class_id", "left").select(
        F.col("doc_id").alias(doc_id), "class_id", F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the row(s) of its smallest doc_id,
    reduced to one.  Rows without doc_id stay."""
    found, _ = near_duplicates(docs, doc_id, text)
    heads = found.filter("doc_id = class_id").select(F.col("doc_id").alias(doc_id)).distinct()
    named = docs.filter(F.col(doc_id).isNotNull()).join(heads, doc_id, "left_semi")
    return named.dropDuplicates([doc_id]).select(docs.columns).union(
        docs.filter(F.col(doc_id).isNull()))
