"""Token counts under a unigram vocabulary by trie-shared dynamic programming.

Every distinct pre-token of the corpus enters a trie; the forward score of a
trie node (best log-probability of any segmentation of that prefix, and its
number of pieces) is computed once, however many words share the prefix (the
trie is cut into ranges of words; only the path to a bound is in two), and the
counts stored at a word's terminal node are joined back to its occurrences
(``wordmap``).  The trie is walked in byte order of the words, so only the
current path is held: a word re-uses the scores of the prefix it shares with
the word before it.

Pieces are the byte strings of a rank file; piece r has the fixed-point score
round(1e6 * ln(1 / ((r + 1) * H))) with H the harmonic number of the vocabulary
size (a Zipf law over ranks).  All 256 single bytes are pieces, so every text
has a segmentation.  Ties go to fewer pieces, then to the longer last piece.

Defined results: null text counts as empty: zero pre-tokens, tokens and score.
Repeated rows and null keys give one row each; extra columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

import functools
import math
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import wordmap
from .bytebpe import pretokens, ranks
from .runtime import prepare


@functools.lru_cache(2)
def piece_scores(path: str) -> dict[bytes, int]:
    table = ranks(path)
    h = math.fsum(1 / (r + 1) for r in table.values())
    return {p: round(-1e6 * math.log((r + 1) * h)) for p, r in table.items()}


@functools.lru_cache(2)
def _reversed_trie(path: str) -> dict:
    """Pieces by their bytes from last to first; the score is under key -1."""
    root: dict = {}
    for piece, score in piece_scores(path).items():
        node = root
        for c in reversed(piece):
            node = node.setdefault(c, {})
        node[-1] = score
    return root


def forward_counts(words: list[bytes], path: str) -> tuple[list[int], list[int]]:
    """(pieces, score) of each word; words in byte order share prefixes."""
    root = _reversed_trie(path)
    score, count = [0], [0]  # by depth on the current trie path
    before = b""
    counts, scores = [], []
    for w in words:
        shared = len(os.path.commonprefix((before, w)))
        del score[shared + 1:], count[shared + 1:]
        for end in range(shared + 1, len(w) + 1):
            best, pieces = None, 0
            node, start = root, end
            while start > 0:
                node = node.get(w[start - 1])
                if node is None:
                    break
                start -= 1
                own = node.get(-1)
                if own is not None:
                    s, n = score[start] + own, count[start] + 1
                    if best is None or s > best or s == best and n <= pieces:
                        best, pieces = s, n
            score.append(best)
            count.append(pieces)
        counts.append(count[len(w)])
        scores.append(score[len(w)])
        before = w
    return counts, scores


def _answer(path: str):
    def answer(words: list[bytes]) -> pa.Table:
        counts, scores = forward_counts(words, path)
        return pa.table({"n": pa.array(counts, pa.int64()), "s": pa.array(scores, pa.int64())})
    return answer


def _sums(by_number: pa.Table | None, codes: np.ndarray, lens: np.ndarray) -> dict[str, pa.Array]:
    out = {"n_pretokens": pa.array(lens, pa.int64())}
    stops = np.cumsum(lens)
    for name, col in (("n_tokens", "n"), ("score_micronats", "s")):
        if by_number is None or not len(codes):
            out[name] = pa.array(np.zeros(len(lens), np.int64))
            continue
        run = np.concatenate(([0], np.cumsum(by_number.column(col).to_numpy()[codes])))
        out[name] = pa.array(run[stops] - run[stops - lens], pa.int64())
    return out


def token_counts(docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_pretokens, n_tokens, score_micronats) per document."""
    prepare(docs.sparkSession)
    split = docs.select(F.col(key), pretokens(docs[text]).alias("words__"))
    chunks = wordmap.explode_words(split, key, "words__")
    answers = wordmap.answer_words(chunks, _answer(ranks_path))
    return wordmap.reassemble(chunks, answers, _sums, key,
                              "n_pretokens long, n_tokens long, score_micronats long")
