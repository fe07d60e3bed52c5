"""Catalog maintenance E2-E10, actor key A4, ranking F1/F2/F4 on small frames."""
import pytest
from pyspark.sql import functions as F

from outcry.functions.keys import actor_key, norm_key
from outcry.operators import catalog as E
from outcry.operators import ranking as R

PROVIDERS = [("acme", "Acme", 100), ("globex", "Globex", 200)]


def test_norm_key_equates_spellings(spark):
    r = spark.range(1).select(norm_key(F.lit("Model-One-4.6")).alias("a"),
                              norm_key(F.lit("model-one-4-6")).alias("b")).first()
    assert r.a == r.b == "modelone46"


def test_actor_key_sha256(spark):
    r = spark.range(1).select(actor_key(F.lit(""), F.lit("192.168.1.1")).alias("k"),
                              actor_key(F.lit(None).cast("string")).alias("d")).first()
    assert r.k == "c5eb5a4cc76a5cdb16e79864b9ccd26c3553f0c396d0a21bafb7be71c1efcd8c"
    assert len(r.d) == 64


def feed(spark, rows):
    return spark.createDataFrame(rows, "pos long, id string, name string")


def test_parse_feed_rules(spark):
    f = feed(spark, [(1, "acme/widget-1", "Acme: Widget 1"), (2, "acme/widget-1:free", "Acme: Widget 1 free"),
                     (3, "noslash", "X"), (4, "unknown/thing", "Thing"), (5, "globex/gadget", "Gadget")])
    parsed = E.parse_feed(f).orderBy("pos").collect()
    assert [r.pos for r in parsed] == [1, 4, 5]
    assert parsed[0].display_name == "Widget 1" and parsed[2].display_name == "Gadget"
    mapped = E.map_provider(E.parse_feed(f), E.provider_table(spark, PROVIDERS)).orderBy("pos").collect()
    assert [(r.pos, r.provider) for r in mapped] == [(1, "Acme"), (5, "Globex")]


def test_merge_new_only_first_by_key_sort_order(spark):
    f = feed(spark, [(1, "acme/a-1", "Acme: A 1"), (2, "acme/a.1", "Acme: A dup"), (3, "acme/b-2", "B 2"),
                     (4, "globex/c-3", "C"), (5, "acme/old", "Old"), (6, "globex/a1", "dup across")])
    cat = spark.createDataFrame([("o.l.d", "Old", "Acme", 7)],
                                "entity_id string, display_name string, provider string, sort_order int")
    new = E.new_entities(f, cat, E.provider_table(spark, PROVIDERS)).orderBy("pos").collect()
    assert [(r.slug, r.sort_order) for r in new] == [("a-1", 101), ("b-2", 102), ("c-3", 201)]
    merged = E.merge_catalog(cat, E.new_entities(f, cat, E.provider_table(spark, PROVIDERS)))
    assert merged.count() == 4 and merged.where("added").count() == 3


def test_resolve_alias_first_match_wins(spark):
    df = spark.createDataFrame([("x-large-4-6",), ("x-small-4-5",), ("other",)], "raw string")
    rules = [("*large*4*6*", "big"), ("*4*", "any-four")]
    out = {r.raw: r.entity_id for r in E.resolve_alias(df, "raw", rules).collect()}
    assert out == {"x-large-4-6": "big", "x-small-4-5": "any-four"}


def status(spark, rows):
    return spark.createDataFrame(
        rows, "entity_id string, display_name string, provider string, sort_order int, "
              "n_signals long, score double, status string, z_score double, baseline_mean double")


def test_rank_by_score_unscored_last(spark):
    s = status(spark, [("a", "A", "p", 1, 3, 2.0, "dumb", 0.0, 1.0), ("b", "B", "p", 2, 1, 5.0, "genius", 0.0, 1.0),
                       ("c", "C", "p", 3, 2, 3.0, "normal", 0.0, 1.0), ("d", "D", "p", 4, 9, 0.0, "unknown", 0.0, None),
                       ("e", "E", "p", 5, 4, 0.0, "unknown", 0.0, None)])
    desc = [r.entity_id for r in R.rank_by_score(s, "desc").orderBy("rank").collect()]
    asc = [r.entity_id for r in R.rank_by_score(s, "asc").orderBy("rank").collect()]
    assert desc == ["b", "c", "a", "d", "e"]
    assert asc == ["a", "c", "b", "e", "d"]
    by_name = [r.entity_id for r in R.rank_by_name(s, "desc").orderBy("rank").collect()]
    assert by_name == ["e", "d", "c", "b", "a"]


def test_top_peers(spark):
    s = status(spark, [("a", "A", "p", 1, 3, 2.0, "dumb", 0.0, 1.0), ("b", "B", "p", 2, 1, 0.0, "unknown", 0.0, None),
                       ("c", "C", "p", 3, 0, 1.0, "braindead", 0.0, 1.0), ("d", "D", "p", 4, 2, 1.5, "dumb", 0.0, 1.0)])
    assert [r.entity_id for r in R.top_peers(s, "a").orderBy("rank").collect()] == ["d", "b"]
    assert [r.entity_id for r in R.first_peers(s, None).orderBy("rank").collect()] == ["a", "b", "d"]


def test_search(spark):
    s = status(spark, [("x1", "Alpha", "web", 1, 0, 0.0, "unknown", 0.0, None),
                       ("y2", "Beta", "shop", 2, 0, 0.0, "unknown", 0.0, None)])
    assert R.search_entities(s, "ALP").count() == 1
    assert R.search_entities(s, "SHOP").count() == 1
    assert R.search_entities(s, "").count() == 2


@pytest.mark.parametrize("n", [1, 7, 50])
def test_ordered_rank_is_dense_and_total(spark, n):
    df = spark.range(n).select(((F.col("id") * 37) % n).alias("k"), (F.col("id") % 3).alias("g"))
    out = R.ordered_rank(df, [F.col("k").asc()], partition_by=["g"]).collect()
    by_g = {}
    for r in out:
        by_g.setdefault(r.g, []).append((r.k, r.rank))
    for g, items in by_g.items():
        items.sort()
        assert [rk for _, rk in items] == list(range(1, len(items) + 1))


# ------------------------------------------------------------------ dated catalog
def _dated_rows(cat):
    iso = lambda t: t and t.strftime("%m-%d")
    return sorted((r.entity_id, r.sort_order, iso(r.valid_from), iso(r.valid_to), r.merge_id) for r in cat.collect())


def test_dated_merges_keep_births(spark):
    at = lambda d: F.to_timestamp(F.lit(f"2024-05-{d:02d} 00:00:00"))
    plain = spark.createDataFrame([("old", "Old", "Acme", 7), ("ever", "Ever", "Acme", 8)],
                                  "entity_id string, display_name string, provider string, sort_order int")
    born = plain.withColumn("valid_from", F.when(F.col("entity_id") == "old", at(1)))
    new = lambda *slugs: spark.createDataFrame([(s, s.title(), "Acme", 100 + i) for i, s in enumerate(slugs)],
                                               "slug string, display_name string, provider string, sort_order int")
    first = E.merge_dated(E.dated_catalog(born), new("a", "old", "a"), at(6), 1)
    assert _dated_rows(first) == [("a", 100, "05-06", None, 1), ("ever", 8, None, None, 0), ("old", 7, "05-01", None, 0)]
    assert _dated_rows(E.merge_dated(first, new("zzz"), at(9), 1)) == _dated_rows(first)  # repeated merge
    gone = spark.createDataFrame([("a",), ("unheard",)], "entity_id string")
    second = E.merge_dated(first, new("b"), at(13), 2, retire=gone)
    assert ("a", 100, "05-06", "05-13", 1) in _dated_rows(second) and ("b", 100, "05-13", None, 2) in _dated_rows(second)
    third = E.merge_dated(second, new("a"), at(20), 3)
    assert [r for r in _dated_rows(third) if r[0] == "a"] == [("a", 100, "05-06", "05-13", 1), ("a", 100, "05-20", None, 3)]
    names = lambda d: sorted(r.entity_id for r in E.catalog_at(third, at(d)).collect())
    assert names(1) == ["ever", "old"] and names(10) == ["a", "ever", "old"]
    assert names(14) == ["b", "ever", "old"] and names(25) == ["a", "b", "ever", "old"]
    assert E.merge_catalog(born, new("c")).where("entity_id = 'old'").first().valid_from is not None


# ------------------------------------------------------------------ rules table
def _plain_rules(ids, rules):
    import re
    out = {}
    for i in ids:
        hits = []
        for rule, pattern, entity in rules:
            for alt in (pattern or "").split("|") if pattern is not None and entity is not None else []:
                regex = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in alt)
                if re.fullmatch(regex, i, re.S):
                    hits.append((rule, entity))
        if hits:
            out[i] = min(hits)[1]
    return out


def test_rules_table_equals_trying_every_rule(spark):
    import random
    rnd = random.Random(7)
    words = ["alpha", "beta", "ga", "x", "4.6", "$1", "a+b", "[z]", "(q", "\\d", "é", "日本語", "a b", "^", "-", "/"]
    pick = lambda n: "".join(rnd.choice(words) for _ in range(rnd.randint(0, n)))
    ids = sorted({pick(4) for _ in range(300)} | {"", "a\nb-alpha", "alpha\n"})
    rules = []
    for k in range(1000):
        alts = []
        for _ in range(rnd.randint(1, 2)):
            parts = [rnd.choice(["*", "?", "*", pick(2), pick(2)]) for _ in range(rnd.randint(1, 4))]
            alts.append("".join(parts))
        rules.append((rnd.randint(0, 3000), "|".join(alts), f"e{k}"))
    rules += [(1, None, "never"), (0, "alpha", None), (5000, "*", "rest")]
    rules = [r for r in rules if r[0] or r[2] is None]
    df = spark.createDataFrame([(i, "was") for i in ids] + [(ids[3], "again"), (None, "none")], "raw string, entity_id string")
    table = spark.createDataFrame(rules, "rule int, pattern string, entity_id string").repartition(4)
    got = E.resolve_by_rules(df, "raw", table)
    assert got.columns == ["raw", "entity_id"]
    want = _plain_rules(ids, rules)
    assert len(want) == len(ids)  # the last rule takes the rest
    rows = got.collect()
    assert {r.raw: r.entity_id for r in rows} == want and len(rows) == len(ids) + 1
    some = table.where("pattern <> '*'").where("length(pattern) > 6")
    few = [r for r in rules if r[1] and r[1] != "*" and len(r[1]) > 6]
    assert {r.raw: r.entity_id for r in E.resolve_by_rules(df, "raw", some).collect()} == _plain_rules(ids, few)
    assert E.resolve_by_rules(df, "raw", table.limit(0)).count() == 0


def test_rules_equal_the_literal_form(spark):
    rules = [("*large*4*6*", "big"), ("*4*|*five*", "any"), ("s?all*", "small")]
    df = spark.createDataFrame([(v,) for v in ("x-large-4-6", "x-4", "fives", "small", "other", "smal")], "raw string")
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rules)], "rule int, pattern string, entity_id string")
    pairs = lambda d: sorted((r.raw, r.entity_id) for r in d.collect())
    assert pairs(E.resolve_by_rules(df, "raw", table)) == pairs(E.resolve_alias(df, "raw", rules))
