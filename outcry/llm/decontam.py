"""Benchmark decontamination by SimHash of item-sized windows.  DataFrame
operations only.

Texts and items are sequences of lower-cased words (runs of letters, digits and
marks), shingles are five words.  A shingle that occurs in d items has weight
1000 div d, any other 1000.  A window is a run of as many words as an item has.

1. A window can only reach the bar with an item if the shingles that it shares
   with items of its length, in any order, weigh enough against its own and the
   least such item's total.  The positions of all items' shingles in a text are
   joined once; running sums over them give the shared and the total weight of
   the window that starts at each of them (one that starts before shares no
   more) and of the last window.  Windows are laid where these suffice: for items
   of up to 31 shingles at every such position, for longer ones at the best of
   each run of a 16th of their length.  Windows are also laid where a shared
   shingle has its own offset in an item.  Equal windows are kept once.
2. Every window and item gets ``FINGERPRINTS`` 64-bit SimHashes of its
   shingles, each voting with the root of its weight times its count: the angle
   follows the squares of the votes, the verified similarity the weights.
3. Multi-index Hamming search: a fingerprint is four blocks of 16 bits; two
   fingerprints within ``RADIUS`` = 15 bits agree on some block up to 3 bits
   (pigeonhole).  Items are indexed under all 697 block values at distance 0-3,
   windows look up their four values, so every item within the radius is met;
   farther ones are cut by their exact distance.
4. Candidates are verified by the exact weighted similarity of the shingle
   multisets: sum of weight * min(count) over sum of weight * max(count), at
   least ``SIMILARITY``.

Work on texts is per text, not per row: rows of equal text share one search.
Every whole text and every item takes part.

Defined results: null texts and texts or items without words leak nothing; an
item of fewer than five words is one shingle of all its words; equal rows of
items or documents give equal results, one per (document row, item_id); extra
columns are ignored; empty tables give no leaks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from .runtime import WORD_GAP, materialize, prepare, text_or_empty

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 15
BLOCKS = 4
BITS = 16
FINGERPRINTS = 2
#: Bit masks of at most RADIUS div BLOCKS set bits.
NEAR = [m for m in range(1 << BITS) if bin(m).count("1") <= RADIUS // BLOCKS]


def _words(text):
    """array<long>: hashes of the words."""
    normal = F.trim(F.regexp_replace(F.lower(text_or_empty(text)), WORD_GAP, " "))
    return F.when(normal == "", F.array().cast("array<bigint>")).otherwise(
        F.transform(F.split(normal, " "), lambda w: F.xxhash64(w)))


def _shingle(words, at, size: int):
    return F.xxhash64(F.lit(size), *[F.get(words, at + k) for k in range(size)])


def _shingles(words, n):
    """array<long> of a word array with n >= 1 words."""
    whole = F.transform(F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))),
                        lambda i: _shingle(words, i, SHINGLE))
    short = reduce(lambda rest, k: F.when(n == k, F.array(_shingle(words, F.lit(0), k))).otherwise(rest),
                   range(1, SHINGLE), whole)
    return short


def _counted(frame: DataFrame, key: str, weights: DataFrame) -> DataFrame:
    """(key, total, bag): the weighted shingle multiset of each word array."""
    rows = frame.select(key, F.explode(_shingles(F.col("words"), F.size("words"))).alias("s"))
    counts = rows.groupBy(key, "s").agg(F.count("*").alias("c")).join(weights, "s", "left")
    w = F.coalesce("w", F.lit(1000).cast("long"))
    return counts.groupBy(key).agg(F.sum(F.col("c") * w).alias("total"),
                                   F.collect_list(F.struct("s", "c", w.alias("w"))).alias("bag"))


def _fingerprint(bag, seed: int):
    """64-bit SimHash of a weighted bag."""
    # The root is held to 1/1024: votes are summed as whole numbers, in any order.
    vote = lambda x: F.round(F.sqrt(x["c"] * x["w"]) * 1024).cast("long")
    hashed = F.transform(bag, lambda x: F.struct(F.xxhash64(F.lit(seed), x["s"]).alias("h"), vote(x).alias("m")))

    def bit(b):
        lean = F.aggregate(hashed, F.lit(0).cast("long"),
                           lambda acc, x: acc + F.when(F.getbit(x["h"], b) == 1, x["m"]).otherwise(-x["m"]))
        return F.when(lean > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(bit(b)))


def _blocks(fingerprints):
    """array of (fingerprint number, block number, block value, fingerprint)."""
    return F.flatten(F.transform(fingerprints, lambda f, k: F.transform(
        F.sequence(F.lit(0), F.lit(BLOCKS - 1)),
        lambda b: F.struct(k.alias("k"), b.alias("b"),
                           F.call_function("shiftrightunsigned", f, b * BITS).bitwiseAND((1 << BITS) - 1)
                           .cast("int").alias("value"), f.alias("print")))))


def _printed(frame: DataFrame) -> DataFrame:
    return frame.withColumn("prints", F.array(*[_fingerprint(F.col("bag"), k) for k in range(FINGERPRINTS)]))


def _shared_starts(met: DataFrame, weights: DataFrame, heavy: DataFrame) -> DataFrame:
    """(text_key, length, n, start): where a window of n words can be similar to
    an item of n words.  ``met``: (text_key, length, p, s), the positions of
    items' shingles in texts; ``heavy``: (s, n, least), the lengths of the items
    that hold a shingle and the least total of an item of that length."""
    span = F.greatest(F.col("n") - SHINGLE, F.lit(0))
    own = met.join(heavy, "s").select("text_key", "length", "n", "least", "p", "s")
    asked = own.select("text_key", "length", "n", "least").distinct()
    weighed = met.join(weights, "s").select("text_key", "p", "s", "w")
    zero = F.lit(0).cast("long")
    points = (asked.join(weighed, "text_key")
              .join(own.select("text_key", "n", "p", "s", F.lit(1).alias("shares")), ["text_key", "n", "p", "s"], "left")
              .select(*asked.columns, "p", F.when(F.col("shares") == 1, F.col("w")).otherwise(zero).alias("own"),
                      (F.lit(1000) - F.col("w")).alias("lack")))
    last = asked.select("*", F.greatest(F.col("length") - F.col("n"), F.lit(0)).cast("int").alias("p"), zero.alias("own"), zero.alias("lack"))
    points = points.unionByName(last).groupBy(*asked.columns, "p").agg(F.sum("own").alias("own"), F.sum("lack").alias("lack"))
    inside = Window.partitionBy("text_key", "n")
    so_far = points.withColumn("upto", F.struct(F.sum("own").over(inside.orderBy("p")).alias("own"),
                                                F.sum("lack").over(inside.orderBy("p")).alias("lack")))
    # The sums up to a window's last shingle are those of the last point not behind it.
    marks = so_far.select("text_key", "n", F.col("p").alias("at"), F.lit(0).alias("kind"), "upto", F.lit(None).cast("int").alias("p"))
    ends = so_far.select("text_key", "n", (F.col("p") + span).alias("at"), F.lit(1).alias("kind"),
                         F.lit(None).cast(so_far.schema["upto"].dataType).alias("upto"), "p")
    reach = (marks.unionByName(ends).withColumn("end", F.last("upto", ignorenulls=True).over(inside.orderBy("at", "kind")))
             .filter("kind = 1").select("text_key", "n", "p", "end"))
    shingles = F.greatest(F.least("n", "length") - SHINGLE, F.lit(0)) + 1
    shared = F.col("end.own") - F.col("upto.own") + F.col("own")
    total = shingles * 1000 - (F.col("end.lack") - F.col("upto.lack") + F.col("lack"))
    enough = (F.col("shared") >= SIMILARITY * F.col("least")) & (
        (1 + SIMILARITY) * F.col("shared") >= SIMILARITY * (F.greatest("total", "shared") + F.col("least")) - 1e-6)
    run = F.floor(F.col("p") / F.greatest(F.floor(span / 16), F.lit(1)))
    return (so_far.join(reach, ["text_key", "n", "p"]).withColumn("shared", shared).withColumn("total", total)
            .filter(enough).groupBy("text_key", "length", "n", run.alias("run"))
            .agg(F.max(F.struct("shared", (-F.col("p")).alias("back")))["back"].alias("back"))
            .select("text_key", "length", "n", (-F.col("back")).alias("start")))


def text_leaks(docs: DataFrame, items: DataFrame, text: str = "text",
               item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(text_key, item_id, similarity, start_word, n_words): per distinct text
    (md5) and similar item the best window, the first among equals."""
    prepare(docs.sparkSession)
    item = materialize(
        items.select(F.col(item_id).alias("item"), _words(items[item_text]).alias("words"))
        .filter("size(words) > 0").distinct().withColumn("row", F.xxhash64("item", "words")), "items")
    n = F.size("words")
    laid = item.select("item", n.alias("n"), F.posexplode(_shingles(F.col("words"), n)).alias("at", "s"))
    weights = laid.groupBy("s").agg(F.floor(F.lit(1000) / F.countDistinct("item")).alias("w")).withColumn(
        "w", F.greatest("w", F.lit(1).cast("long")))
    weights = materialize(weights, "weights")
    seeds = materialize(laid.select("s", "at", "n").distinct(), "seeds")
    sizes = sorted(r[0] for r in item.select(F.least(n, F.lit(SHINGLE)).alias("k")).distinct().collect())

    counted = materialize(_counted(item, "row", weights), "items")
    least = item.select("row", n.alias("n")).join(counted, "row").groupBy("n").agg(F.min("total").alias("least"))
    heavy = materialize(laid.select("s", "n").distinct().join(least, "n"), "heavy")

    texts = docs.select(F.md5(text_or_empty(docs[text])).alias("text_key"), text_or_empty(docs[text]).alias("text__"))
    words = texts.select("text_key", _words(F.col("text__")).alias("words"))
    # Outer, and cut by its place below: a filter on the words would split every text twice.
    at = words.select("text_key", "words", F.explode_outer(
        F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1))).alias("p"))
    here = reduce(lambda a, b: a.unionByName(b), [
        at.filter(F.col("p") <= F.size("words") - k).select(
            "text_key", "p", F.size("words").alias("length"), _shingle(F.col("words"), F.col("p"), k).alias("s"))
        for k in sizes]) if sizes else at.limit(0).select("text_key", "p", F.lit(0).alias("length"), F.lit(0).cast("long").alias("s"))
    # Equal texts meet the items' shingles at the same places: once from here on.
    met = materialize(materialize(here.join(weights.select("s"), "s"), "met").distinct(), "met")
    aligned = met.join(seeds, "s").select("text_key", "length", "n", (F.col("p") - F.col("at")).alias("start"))
    windows = (aligned.unionByName(_shared_starts(met, weights, heavy))
               .select("text_key", F.greatest(F.least("start", F.col("length") - F.col("n")), F.lit(0)).alias("start"), "n")
               .groupBy("text_key").agg(F.collect_set(F.struct("start", "n")).alias("laid")))
    windows = materialize(windows, "laid")
    once = (texts.join(windows.select("text_key"), "text_key", "left_semi")
            .groupBy("text_key").agg(F.first("text__").alias("text__")))
    cut = (once.join(windows, "text_key").select("text_key", _words(F.col("text__")).alias("whole"), "laid")
           .select("text_key", "whole", F.explode("laid").alias("x"))
           .select("text_key", "x.start", F.slice("whole", F.col("x.start") + 1, F.col("x.n")).alias("words")))
    window = materialize(cut.withColumn("window", F.md5(F.concat_ws(" ", F.col("words").cast("array<string>")))), "windows")

    distinct = window.groupBy("window").agg(F.first("words").alias("words"))
    printed = materialize(_printed(_counted(distinct, "window", weights)), "prints")
    own = _printed(counted).join(item.select("row", "item"), "row")
    own = materialize(own.select("row", "item", F.col("total").alias("total_i"), F.col("bag").alias("bag_i"),
                                 F.col("prints").alias("prints_i")), "prints")
    index = (own.select("row", F.explode(_blocks(F.col("prints_i"))).alias("x"))
             .select("row", "x.k", "x.b", F.col("x.print").alias("print_i"), "x.value", F.explode(F.lit(NEAR)).alias("mask"))
             .select("row", "k", "b", "print_i", F.col("value").bitwiseXOR(F.col("mask")).alias("value")))
    probe = (printed.select("window", F.explode(_blocks(F.col("prints"))).alias("x"))
             .select("window", "x.k", "x.b", "x.value", "x.print"))
    # The index is many times its table: never broadcast on an estimate.
    near = (probe.join(index.hint("merge"), ["k", "b", "value"])
            .filter(F.bit_count(F.col("print").bitwiseXOR(F.col("print_i"))) <= RADIUS)
            .select("window", "row").distinct())
    common = F.aggregate("bag", F.lit(0).cast("long"), lambda acc, x: acc + x["w"] * F.least(
        x["c"], F.coalesce(F.element_at(F.col("counts_i"), x["s"]), F.lit(0).cast("long"))))
    verified = (near.join(own, "row").join(printed, "window")
                .withColumn("counts_i", F.map_from_entries(F.transform("bag_i", lambda x: F.struct(x["s"], x["c"]))))
                .withColumn("common", common)
                .withColumn("similarity", F.col("common") / (F.col("total") + F.col("total_i") - F.col("common")))
                .filter(F.col("similarity") >= SIMILARITY)
                .groupBy("window", "item").agg(F.max("similarity").alias("similarity")))
    best = (verified.join(window.select("text_key", "start", "window", F.size("words").alias("n_words")), "window")
            .groupBy("text_key", "item")
            .agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words")).alias("best")))
    return best.select("text_key", F.col("item").alias("item_id"), "best.similarity",
                       (-F.col("best.back")).alias("start_word"), "best.n_words")


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
          item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words) per document row."""
    found = materialize(text_leaks(docs, items, text, item_id, item_text), "leaks")
    keyed = docs.select(F.col(doc_id), F.md5(text_or_empty(docs[text])).alias("text_key"))
    return keyed.join(found, "text_key").drop("text_key")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a leaked item."""
    found = materialize(text_leaks(docs, items, text, item_id, item_text).select("text_key").distinct(), "leaks")
    keyed = docs.withColumn("text_key__", F.md5(text_or_empty(docs[text])))
    return keyed.join(found.withColumnRenamed("text_key", "text_key__"), "text_key__", "left_anti").select(docs.columns)
