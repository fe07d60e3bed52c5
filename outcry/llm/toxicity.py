"""Toxicity by Levenshtein automata over a lexicon trie.

``fit`` learns a lexicon from a bounded sample of labelled texts (``SAMPLE_TOXIC``
and ``SAMPLE_CLEAN`` rows, smallest hash of doc_id first): words that are far
more frequent in toxic texts, beyond what chance gives among so many words, and
stems, prefixes that many such words share (compounds).  At most ``TERMS`` entries are kept.

The lexicon is a trie; intersected with the Levenshtein automaton of the word
being read it is one automaton whose states are sets of (trie node, edits).
States and transitions are made when first met and kept, so a word costs a few
dictionary look-ups and most words die after some letters.  Terms of 5-7
letters allow one edit, longer ones two, shorter ones none; a stem must match
exactly and leaves the rest of the word free.  An edit at the first letter often
makes another word ("trash", "crash"): a word that is near only by such an edit
is spared if the labelled sample shows it in clean texts and not far more often
in toxic ones.

Every hit is scored in its context window (``WINDOW`` words on each side): hits
in quotation marks or near a word of reporting count as quotation, the others
as abuse, more so next to a second person.  Six features of the whole text enter a logistic model fitted on the same sample.

Defined results: null and empty texts get the score of a text without hits;
ties and repeated rows score alike; a lexicon without terms (no toxic label in
the sample) scores 0.0 everywhere; rows with null labels are not learned from;
extra columns pass through; empty tables give empty tables.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .memory import tidy
from .runtime import materialize, prepare, text_or_empty

SAMPLE_TOXIC = 5_000
SAMPLE_CLEAN = 10_000
TERMS = 500
SUPPORT = 3
ODDS = 8.0
GAIN = 2.0
CLEAR = 100.0
STEM_WORDS = 4
WINDOW = 8

WORD = re.compile(r"[^\W_]+")
#: Opening marks and what closes them; straight marks are told by their neighbours.
_CLOSES = {"“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "‚": "‘’", "‹": "›", "›": "‹", '"': '"'}
_MARKS = re.compile("[\n\"“”„«»‘’‚‹›]")
_REPORT = frozenset("said says called calls wrote quoted quote word term slur dit écrit mot sagte schrieb nannte wort "
                    "dijo escribió llamó palabra".split())
_SECOND = frozenset("you your yours u ur du dich dir dein ihr euch tu te toi vous tú usted eres".split())


class Model(NamedTuple):
    """terms: (text, is_stem, weight 0..1); coefficients: bias and features;
    spared: words near a term by their first letter that are no hits."""
    terms: tuple[tuple[str, bool, float], ...]
    coefficients: tuple[float, ...]
    spared: tuple[str, ...] = ()


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class Automaton:
    """Intersection of the lexicon trie with the Levenshtein automaton.  ``match``
    takes the first letter as right unless ``free``; ``near`` lets it be edited
    in words that are not ``spared``."""

    KEEP_STATES = 100_000
    KEEP_WORDS = 200_000

    def __init__(self, terms, spared=(), free: bool = False):
        self.free = free
        self.spared = frozenset(spared)
        self.plain = self if free else Automaton(terms, free=True)
        self.children: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.room: list[int] = [0]  # most edits of any term below
        for i, (text, is_stem, _) in enumerate(terms):
            node, limit = 0, 0 if is_stem else edits_allowed(text)
            self.room[0] = max(self.room[0], limit)
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                    self.stem.append(-1)
                    self.room.append(0)
                node = self.children[node][c]
                self.room[node] = max(self.room[node], limit)
            (self.stem if is_stem else self.term)[node] = i
        self.limit = [0 if s else edits_allowed(t) for t, s, _ in terms]
        self.alphabet = {c for ch in self.children for c in ch}
        self._reset()

    def trim(self) -> None:
        """Forgets states and words when they are many."""
        if len(self.sets) > self.KEEP_STATES or len(self.words) > self.KEEP_WORDS:
            self._reset()
        if self.plain is not self:
            self.plain.trim()

    def _reset(self):
        self.ids: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.stems: list[int] = []
        self.words: dict[str, tuple[int, int] | None] = {}
        self.hits: set[str] = set()
        self.start = self._state({0: 0})

    def _state(self, edits: dict[int, int]) -> int:
        # Skipping a letter of the term is an edit that reads nothing.
        todo = list(edits)
        while todo:
            node = todo.pop()
            if not node and not self.free:  # the first letter is taken as right
                continue
            e = edits[node] + 1
            for child in self.children[node].values():
                if e <= self.room[child] and e < edits.get(child, 9):
                    edits[child] = e
                    todo.append(child)
        key = tuple(sorted(edits.items()))
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ends = [(e, self.term[n]) for n, e in key if self.term[n] >= 0 and e <= self.limit[self.term[n]]]
            self.accepts.append((min(ends)[1], min(ends)[0]) if ends else None)
            self.stems.append(max((self.stem[n] for n, e in key if e == 0), default=-1))
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        out: dict[int, int] = {}
        for node, e in self.sets[state]:
            for letter, child in self.children[node].items():
                cost = e if letter == c else e + 1 if node or self.free else 9
                if cost <= self.room[child] and cost < out.get(child, 9):
                    out[child] = cost
            if (node or self.free) and e + 1 <= self.room[node] and e + 1 < out.get(node, 9):
                out[node] = e + 1
        return self._state(out) if out else -1

    def match(self, word: str) -> tuple[int, int] | None:
        """(term number, edits) of the closest term, else of a stem, else None."""
        if word in self.words:
            return self.words[word]
        state, stem = self.start, -1
        for c in word:
            if c not in self.alphabet:
                c = "\0"
            nxt = self.moves[state].get(c)
            if nxt is None:
                nxt = self._move(state, c)
                self.moves[state][c] = nxt
            state = nxt
            if state < 0:
                break
            if self.stems[state] >= 0:
                stem = self.stems[state]
        found = self.accepts[state] if state >= 0 else None
        if found is None and stem >= 0:
            found = (stem, 0)
        self.words[word] = found
        if found is not None:
            self.hits.add(word)
        return found

    def near(self, word: str) -> tuple[int, int] | None:
        """``match``, or else the closest term by an edit at the first letter."""
        loose = self.plain.match(word)
        return loose and (self.match(word) or (None if word in self.spared else loose))

    def front(self, words) -> set[str]:
        """The distinct words that are near a term only by an edit at the first letter."""
        return {w for w in set(words) if self.plain.match(w) is not None and self.match(w) is None}

    def matches(self, words: list[str]) -> dict[str, tuple[int, int]]:
        """The distinct words that are near a term, with their matches."""
        distinct = set(words)
        for w in distinct.difference(self.plain.words):
            self.plain.match(w)
        return {w: found for w in distinct & self.plain.hits if (found := self.near(w)) is not None}


FEATURES = 6


def quotations(low: str) -> list[tuple[int, int]]:
    """The quoted spans of a text.  A mark that opens is paired with one that
    closes it on the same line; marks without a partner quote nothing.  A straight
    mark opens before a character and behind none, and closes behind one (5" and
    6" open nothing); an apostrophe between letters is no mark."""
    out, opened = [], None
    for m in _MARKS.finditer(low):
        at, c = m.start(), m.group()
        before, behind = low[at - 1:at] if at else "", low[at + 1:at + 2]
        if c == "\n":
            opened = None
        elif c == "’" and before.isalpha() and behind.isalpha():
            continue
        elif opened is not None and c in _CLOSES[low[opened]] and (c != '"' or before.strip()):
            out.append((opened, at))
            opened = None
        elif opened is None and c in _CLOSES and behind.strip() and (c != '"' or not before.isalnum()):
            opened = at
    return out


def features(text: str | None, automaton: Automaton, terms) -> list[float]:
    """Largest abusive window score; abusive mass of exact, misspelled and stem
    hits; quoted mass; hits per 100 words."""
    low = (text or "").lower()
    words = WORD.findall(low)
    automaton.trim()
    known = automaton.matches(words)
    if not known:
        return [0.0] * FEATURES
    spans = [m.span() for m in WORD.finditer(low)]
    hits = [i for i, w in enumerate(words) if w in known]
    said = quotations(low)
    begins = [b for b, _ in said]
    at_quote = np.searchsorted(begins, [spans[i][0] for i in hits], side="right") - 1
    score = np.zeros(len(hits))
    quoted = np.zeros(len(hits), bool)
    kind = np.zeros(len(hits), int)
    for k, i in enumerate(hits):
        term, edits = known[words[i]]
        near = words[max(0, i - WINDOW):i + WINDOW + 1]
        inside = at_quote[k] >= 0 and spans[i][0] < said[at_quote[k]][1]
        quoted[k] = inside or not _REPORT.isdisjoint(near)
        kind[k] = 2 if terms[term][1] else min(edits, 1)
        score[k] = terms[term][2] * (1.0, 0.6, 0.4)[edits] * (1.0 if _SECOND.isdisjoint(near) else 1.25)
    own = np.where(quoted, 0.0, score)
    run = np.concatenate(([0.0], np.cumsum(own)))
    at = np.array(hits)
    lo, hi = np.searchsorted(at, at - WINDOW), np.searchsorted(at, at + WINDOW, side="right")
    best = float(np.max(run[hi] - run[lo]))
    return [min(best, 3.0), *(float(np.log1p(own[kind == k].sum())) for k in range(3)),
            float(np.log1p(score[quoted].sum())), min(100.0 * len(hits) / len(words), 10.0)]


def _least_hash(seed: int):
    return F.array_min(F.transform("h", lambda x: F.xxhash64(F.lit(seed), x)))


def _one_of_copies(sample: DataFrame) -> DataFrame:
    """(text__, toxic) with one text of most groups of near copies, so that the
    words of a copied text do not count as often as it was copied: texts that
    share a minimum hash of their word triples, for three hash functions."""
    words = F.split(F.lower("text__"), r"[^\p{L}\p{N}\p{M}]+")
    sign = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0))),
                       lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    signed = sample.withColumn("w", words).withColumn("h", sign)
    signed = signed.select("id__", "text__", "toxic", *[_least_hash(k).alias(f"s{k}") for k in range(3)])
    for k in range(3):
        rest = [c for c in signed.columns if c != f"s{k}"]
        signed = signed.groupBy(f"s{k}").agg(F.min(F.struct(*rest)).alias("r")).select("r.*")
    return signed.select("text__", "toxic")


def _gain(a, b, n_toxic: int, n_clean: int):
    """Log-likelihood ratio of the toxic and clean text counts against chance."""
    share = n_toxic / (n_toxic + n_clean)
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    return 2 * (part(a, (a + b) * share) + part(b, (a + b) * (1 - share)))


def _lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> tuple:
    """Terms and stems of the sample (text__, toxic)."""
    words = F.filter(F.array_distinct(F.split(F.lower("text__"), r"[^\p{L}\p{N}\p{M}]+")),
                     lambda w: F.length(w).between(3, 40))
    stems_of = lambda w: F.transform(F.sequence(F.lit(4), F.least(F.length(w) - 1, F.lit(8))),
                                     lambda k: F.concat(F.substr(w, F.lit(1), k), F.lit("*")))
    per_text = sample.select("toxic", words.alias("words"))
    entries = F.array_distinct(F.concat("words", F.flatten(F.transform(
        F.filter("words", lambda w: F.length(w) > 4), stems_of))))
    # Texts, not occurrences, are counted: a long text has no more weight than another.
    counts = (per_text.select("toxic", F.explode(entries).alias("w")).groupBy("w")
              .agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
              .withColumn("odds", (F.col("a") / n_toxic) / ((F.col("b") + 0.5) / n_clean))
              .withColumn("gain", _gain(F.col("a"), F.col("b"), n_toxic, n_clean))
              .filter(F.col("a") >= SUPPORT))
    counts = materialize(counts, "entries")
    # Of n chance entries about exp(-gain / 2) * n reach a gain: the more are tried, the higher the bar.
    bar = GAIN + 2 * math.log(max(counts.count(), 1))
    counts = counts.filter((F.col("odds") >= ODDS) & (F.col("gain") >= bar))
    terms = counts.filter("NOT endswith(w, '*')").select("w", "gain", "odds", F.lit(False).alias("stem"))
    # A stem joins several words, none of which explains it alone.
    toxic_words = (per_text.filter("toxic = 1").select(F.explode("words").alias("word")).filter("length(word) > 4")
                   .groupBy("word").agg(F.count("*").alias("n")).select("n", F.explode(stems_of(F.col("word"))).alias("w"))
                   .groupBy("w").agg(F.count("*").alias("words"), F.max("n").alias("most")))
    stems = (counts.filter("endswith(w, '*')").join(toxic_words, "w")
             .filter((F.col("words") >= STEM_WORDS) & (F.col("most") <= 0.6 * F.col("a")))
             .select(F.expr("left(w, length(w) - 1)").alias("w"), "gain", "odds", F.lit(True).alias("stem")))
    rows = [r for part in (stems, terms) for r in part.orderBy(F.desc("gain"), "w").limit(4 * TERMS).collect()]
    rows.sort(key=lambda r: (-r["gain"], len(r["w"]), r["w"], r["stem"]))
    kept, roots = [], []
    for r in rows:  # of stems that begin alike the most telling one stays
        if r["stem"]:
            if any(r["w"].startswith(x["w"]) or x["w"].startswith(r["w"]) for x in roots):
                continue
            roots.append(r)
        kept.append(r)
    # A word says no more than a stem of it that is as clear.
    clear = tuple(x["w"] for x in roots if x["odds"] >= CLEAR)
    kept = [r for r in kept if r["stem"] or not r["w"].startswith(clear)]
    return tuple((r["w"], r["stem"], min(float(np.log(r["odds"])), 8.0) / 8.0) for r in kept[:TERMS])


def _spared(sample: DataFrame, terms, n_toxic: int, n_clean: int) -> tuple[str, ...]:
    """The words near a term by their first letter that clean texts of the
    sample (text__, toxic) hold and toxic ones not ``ODDS`` times as often."""
    def fronts(batches):
        automaton = Automaton(terms)
        for b in batches:
            word, toxic = [], []
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                automaton.trim()
                some = automaton.front(WORD.findall(text.lower()))
                word += some
                toxic += [label] * len(some)
            yield pa.RecordBatch.from_pydict({"w": pa.array(word, pa.string()), "toxic": pa.array(toxic, pa.int32())})

    odds = (F.col("a") / n_toxic) / ((F.col("b") + 0.5) / n_clean)
    rows = (sample.mapInArrow(lambda batches: tidy(fronts(batches)), "w string, toxic int").groupBy("w")
            .agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
            .filter((F.col("b") > 0) & (odds < ODDS)).select("w").collect())
    return tuple(sorted(r["w"] for r in rows))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Weighted ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    penalty = np.full(len(beta), ridge * len(x) / 100)
    penalty[0] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.max(np.abs(step)) < 1e-8:
            break
    return tuple(float(b) for b in beta)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        toxic: str = "toxic") -> Model:
    """Model from the labelled rows of ``docs`` that are not held out
    (crc32 of doc_id as text, modulo 5, is not 0)."""
    spark = docs.sparkSession
    prepare(spark)
    usable = labels.select(F.col(doc_id).cast("long").alias("id__"), F.col(toxic).cast("int").alias("toxic")).filter(
        F.col("toxic").isin(0, 1) & (F.crc32(F.col("id__").cast("string")) % 5 != 0))
    totals = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    some = [usable.filter(F.col("toxic") == t).orderBy(F.xxhash64("id__"), "id__").limit(n)
            for t, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    # At most SAMPLE_TOXIC + SAMPLE_CLEAN rows of 12 bytes.
    sample = (docs.select(F.col(doc_id).cast("long").alias("id__"), text_or_empty(docs[text]).alias("text__"))
              .join(F.broadcast(some[0].union(some[1])), "id__"))
    sample = materialize(_one_of_copies(sample.select("id__", "text__", "toxic")), "labelled")
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return Model((), (0.0,) * (1 + FEATURES))
    terms = _lexicon(sample, n[1], n[0])
    if not terms:
        return Model((), (0.0,) * (1 + FEATURES))

    spared = _spared(sample, terms, n[1], n[0])

    def measured(batches):
        automaton = Automaton(terms, spared)
        for b in batches:
            rows = [features(t, automaton, terms) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {"x": pa.array(rows, pa.list_(pa.float64())), "toxic": b.column(1).cast(pa.int32())})

    rows = sample.mapInArrow(lambda batches: tidy(measured(batches)), "x array<double>, toxic int").toPandas()
    y = rows["toxic"].to_numpy(float)
    weight = np.where(y == 1, totals[1] / n[1], totals[0] / n[0])
    order = np.lexsort(np.array(rows["x"].tolist()).T)
    x = np.array(rows["x"].tolist())[order]
    return Model(terms, _logistic(x, y[order], (weight / weight.mean())[order]), spared)


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the added column of scores between 0 and 1."""
    prepare(docs.sparkSession)
    names = docs.columns
    place = names.index(text)
    terms, beta, spared = model
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{column}` double"

    def run(batches):
        automaton = Automaton(terms, spared)
        for b in batches:
            if terms:
                x = np.array([features(t, automaton, terms) for t in b.column(place).to_pylist()]).reshape(-1, FEATURES)
                s = 1 / (1 + np.exp(-np.clip(beta[0] + x @ np.array(beta[1:]), -30, 30)))
            else:
                s = np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*names, column])

    return docs.mapInArrow(lambda batches: tidy(run(batches)), schema)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = fit(docs, labels)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more."""
    return score(docs, fit(docs, labels), column="score__").filter("score__ < 0.5").drop("score__")
