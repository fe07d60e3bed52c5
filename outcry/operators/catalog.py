"""Catalog maintenance (weekly merge): parse feed ids (E2), provider allow-list
(E3), normalised key (E4), new-only (E5), first-by-key (E6), sort order (E7),
add-only merge (E8), completeness check (E9) and alias resolution (E10).

Order: E2 -> E3 -> E5 -> E6 -> E7 -> E8.  A feed row is ``pos, id, name``.

* E6 picks the first row per key with ``min(struct(pos, ...))`` — an
  aggregate with map-side partial combine, so one key holding a third of the
  feed does not land whole in one task (a window would).
* E7's per-provider running count uses the distributed ``ordered_rank``.
* The provider map is joined by the strategy Spark picks for its measured size;
  a few alias rules compile to one CASE expression (first match wins), a table
  of rules is met by an equi-join on fragments of the ids.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outcry.functions.keys import norm_key
from outcry.operators.ranking import ordered_rank

DEFAULT_SORT_BASE = 9000


def provider_table(spark: SparkSession, providers: list[tuple[str, str, int]]) -> DataFrame:
    """(feed prefix, provider name, sort base) rows as a DataFrame."""
    schema = T.StructType([T.StructField("provider_key", T.StringType()),
                           T.StructField("provider", T.StringType()),
                           T.StructField("sort_base", T.IntegerType())])
    return spark.createDataFrame(providers, schema)


def parse_feed(feed: DataFrame) -> DataFrame:
    """Drop tagged ids (containing ':') and ids without '/'; split on the
    first '/'; the display name is the text after the first ': ' if any."""
    slash = F.instr("id", "/")
    colon = F.instr("name", ": ")
    return (feed.where((F.instr("id", ":") == 0) & (slash > 0))
                .select("pos",
                        F.expr("substring(id, 1, instr(id, '/') - 1)").alias("provider_key"),
                        F.expr("substring(id, instr(id, '/') + 1)").alias("slug"),
                        F.when(colon > 0, F.expr("substring(name, instr(name, ': ') + 2)"))
                         .otherwise(F.col("name")).alias("display_name")))


def map_provider(parsed: DataFrame, providers: DataFrame) -> DataFrame:
    """Keep rows whose provider prefix is allowed; rename the provider.
    Spark picks the join by the measured size of the allow-list."""
    return parsed.join(providers, "provider_key", "inner")


def with_norm_key(df: DataFrame, col: str = "slug", out: str = "norm") -> DataFrame:
    """E4."""
    return df.withColumn(out, norm_key(col))


def new_only(parsed: DataFrame, catalog: DataFrame) -> DataFrame:
    """E5: rows whose normalised key is not in the catalog already."""
    known = catalog.select(norm_key("entity_id").alias("norm"))
    return with_norm_key(parsed).join(known, "norm", "left_anti")


def first_by_key(parsed: DataFrame) -> DataFrame:
    """First valid row (feed order) per normalised key, across providers."""
    df = parsed if "norm" in parsed.columns else with_norm_key(parsed)
    cols = [c for c in df.columns if c not in ("pos", "norm")]
    first = F.min(F.struct("pos", *cols)).alias("_first")
    return df.groupBy("norm").agg(first).select("norm", "_first.*")


def assign_sort_order(new: DataFrame) -> DataFrame:
    """Provider base + running count per provider in feed order."""
    ranked = ordered_rank(new, [F.col("pos").asc()], "_seq", partition_by=["provider"])
    return ranked.withColumn(
        "sort_order",
        (F.coalesce(F.col("sort_base"), F.lit(DEFAULT_SORT_BASE)) + F.col("_seq")).cast("int")
    ).drop("_seq")


def new_entities(feed: DataFrame, catalog: DataFrame, providers: DataFrame) -> DataFrame:
    """E2 -> E3 -> E5 -> E6 -> E7: rows to add, with their sort order."""
    parsed = map_provider(parse_feed(feed), providers)
    return assign_sort_order(first_by_key(new_only(parsed, catalog)))


def merge_catalog(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """Add-only merge (insert-or-ignore by id); ``added`` marks new rows.
    A catalog with ``valid_from`` keeps it; added rows get that of ``new``, if
    it has one."""
    dated = ["valid_from"] if "valid_from" in catalog.columns else []
    columns = ["entity_id", "display_name", "provider", "sort_order", *dated]
    born = F.col("valid_from") if "valid_from" in new.columns else F.lit(None)
    adds = (new.withColumn("entity_id", F.col("slug"))
               .select(*columns[:4], *[born.cast(catalog.schema[c].dataType).alias(c) for c in dated])
               .join(catalog.select("entity_id"), "entity_id", "left_anti"))
    return (catalog.select(*columns, F.lit(False).alias("added"))
                   .unionByName(adds.withColumn("added", F.lit(True))))


# ------------------------------------------------------------------ dated catalog
#: A dated catalog: the rows of an id are its versions; the one without
#: ``valid_to`` is current.  ``merge_id`` names the merge that wrote the row.
DATED = ["entity_id", "display_name", "provider", "sort_order", "valid_from", "valid_to", "merge_id"]


def dated_catalog(catalog: DataFrame, merge_id: int = 0) -> DataFrame:
    """A plain catalog as the first state of a dated one: its entities exist
    from their ``valid_from`` on, or have always existed."""
    born = F.col("valid_from") if "valid_from" in catalog.columns else F.lit(None)
    return catalog.select(*DATED[:4], born.cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"),
                          F.lit(merge_id).cast("long").alias("merge_id"))


def merge_dated(catalog: DataFrame, new: DataFrame, at: Column, merge_id: int, retire: DataFrame | None = None) -> DataFrame:
    """E8, dated: insert-or-ignore of ``new`` (slug, display_name, provider,
    sort_order) by id.  An added entity is born ``at`` the merge; every other
    row, births included, stays as it is.  ``retire`` (entity_id) closes the
    current rows of ids that left; an id that comes back gets a new row.  A
    merge whose ``merge_id`` the catalog has already changes nothing."""
    done = catalog.where(F.col("merge_id") >= F.lit(merge_id)).limit(1).select(F.lit(True).alias("_done"))
    kept = catalog
    if retire is not None:
        gone = retire.select("entity_id").distinct().withColumn("_gone", F.lit(True))
        closes = F.col("_gone") & F.col("valid_to").isNull() & F.col("_done").isNull()
        kept = (catalog.join(gone, "entity_id", "left").join(done, F.lit(True), "left")
                .withColumn("valid_to", F.when(closes, at).otherwise(F.col("valid_to"))).select(*DATED))
    current = kept.where(F.col("valid_to").isNull()).select("entity_id")
    first = new.groupBy(F.col("slug").alias("entity_id")).agg(F.min(F.struct("sort_order", "display_name", "provider")).alias("_f"))
    adds = (first.join(current, "entity_id", "left_anti").join(done, F.lit(True), "left_anti")
            .select("entity_id", "_f.display_name", "_f.provider", "_f.sort_order", at.cast("timestamp").alias("valid_from"),
                    F.lit(None).cast("timestamp").alias("valid_to"), F.lit(merge_id).cast("long").alias("merge_id")))
    return kept.select(*DATED).unionByName(adds)


def catalog_at(catalog: DataFrame, at: Column) -> DataFrame:
    """The entities of a dated catalog that exist at a time, with their birth."""
    return (catalog.where((F.col("valid_from").isNull() | (F.col("valid_from") <= at))
                          & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
            .select(*DATED[:4], "valid_from"))


def catalog_check(expected: DataFrame, catalog: DataFrame, min_rows: int) -> DataFrame:
    """One ``summary`` row, also when nothing is missing, and one ``missing``
    row per expected id without a catalog entry; every row carries the catalog
    row count, whether it meets ``min_rows`` and the number of missing ids.  Ids
    are compared by their normalised key (E4), so spelling variants match."""
    n = catalog.agg(F.count(F.lit(1)).cast("long").alias("n")).scalar()
    known = catalog.select(norm_key("entity_id").alias("_norm"))
    missing = (expected.select("entity_id").distinct().withColumn("_norm", norm_key("entity_id"))
               .join(known, "_norm", "left_anti").select("entity_id"))
    counted = missing.agg(F.count(F.lit(1)).cast("long").alias("missing_rows"))
    listed = missing.select(F.lit("missing").alias("kind"), "entity_id", counted.scalar().alias("missing_rows"))
    return (counted.select(F.lit("summary").alias("kind"), F.lit(None).cast("string").alias("entity_id"), "missing_rows")
            .unionByName(listed)
            .select("kind", "entity_id", n.alias("catalog_rows"), (n >= F.lit(min_rows)).alias("meets_min"), "missing_rows"))


# ------------------------------------------------------------------ alias rules
#: Characters of the fragments that candidates share with a rule.
GRAM = 3


def glob_to_regex(glob: str) -> str:
    """Shell-style glob (``*``, ``?``) to an anchored Java regex."""
    out = []
    for ch in glob:
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        else:
            out.append(re.escape(ch))
    return "^" + "".join(out) + "$"


def resolve_alias(df: DataFrame, raw_col: str, rules: list[tuple[str, str]],
                  out: str = "entity_id") -> DataFrame:
    """Raw id -> entity by ordered glob rules (each rule may hold
    alternatives separated by '|'); first match wins; no match -> dropped."""
    expr = None
    for pattern, entity in rules:
        cond = None
        for alt in pattern.split("|"):
            c = F.col(raw_col).rlike(glob_to_regex(alt))
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(entity)) if expr is None else expr.when(cond, F.lit(entity))
    return df.withColumn(out, expr).where(F.col(out).isNotNull())


def compiled_rules(rules: DataFrame) -> DataFrame:
    """Rules (rule, pattern, entity_id) as one row per alternative of a
    pattern: (rule, entity_id, regex, anchor).  ``anchor`` is the first ``GRAM``
    characters of the alternative's longest literal run, which every match
    contains; null if all its runs are shorter.  Of the characters of a glob
    only ``*`` and ``?`` are special."""
    alt = (rules.where(F.col("pattern").isNotNull() & F.col("entity_id").isNotNull())
           .select("rule", "entity_id", F.explode(F.split("pattern", r"\|", -1)).alias("glob")))
    runs = F.transform(F.split("glob", r"[*?]", -1), lambda r: F.struct(F.length(r).alias("n"), r.alias("run")))
    longest = F.array_max(runs)
    regex = F.regexp_replace(F.regexp_replace(F.regexp_replace("glob", r"([^*?\p{L}\p{N}\s])", r"\\$1"), r"\*", ".*"), r"\?", ".")
    return alt.select("rule", "entity_id", F.concat(F.lit("(?s)^"), regex, F.lit(r"\z")).alias("regex"),
                      F.when(longest["n"] >= GRAM, F.substr(longest["run"], F.lit(1), F.lit(GRAM))).alias("anchor"))


def resolve_by_rules(df: DataFrame, raw_col: str, rules: DataFrame, out: str = "entity_id") -> DataFrame:
    """J10/E10 with the rules as a table (rule, pattern, entity_id): the match
    of the smallest ``rule`` wins (of equal rules the least entity), rows
    without a match are dropped.

    Distinct ids only are matched.  An id meets the rules whose anchor is one of
    its fragments (an equi-join, whatever the number of rules); the rules without
    an anchor, such as ``*`` or ``a?b``, are tried on every id by a join that
    Spark broadcasts by their size.  The regex then decides, and the first rule
    is an aggregate with partial combine, so an id that a third of all rows hold
    costs one match."""
    ids = df.select(F.col(raw_col).alias("_raw")).where(F.col(raw_col).isNotNull()).distinct()
    table = compiled_rules(rules)
    places = F.sequence(F.lit(1), F.length("_raw") - F.lit(GRAM - 1))
    grams = F.when(F.length("_raw") >= GRAM, F.array_distinct(F.transform(places, lambda i: F.substr(F.col("_raw"), i, F.lit(GRAM)))))
    anchored = (ids.select("_raw", F.explode(grams).alias("anchor"))
                .join(table.where(F.col("anchor").isNotNull()), "anchor").select("_raw", "rule", "entity_id", "regex"))
    matches = F.expr("_raw RLIKE regex")
    loose = ids.join(table.where(F.col("anchor").isNull()).drop("anchor"), matches).select("_raw", "rule", "entity_id")
    found = anchored.where(matches).select("_raw", "rule", "entity_id").unionByName(loose)
    first = found.groupBy("_raw").agg(F.min(F.struct("rule", "entity_id"))["entity_id"].alias(out))
    columns = [c for c in df.columns if c != out]
    return df.select(*columns).join(first, F.col(raw_col) == F.col("_raw")).drop("_raw")
