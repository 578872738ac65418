"""Correction of damaged tokens by search in a lexicon under the noisy channel.

The lexicon is a trie; a node holds the row of cheapest edit costs of its prefix against all prefixes of the token.
Nodes are opened cheapest first. Edits never cost less than nothing, so the least of a row, less the best prior below
the node, bounds every word there: the first words that come out are the best of all, and the rest is never walked.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A lexicon travels to all tasks: words at most (about 100 bytes each).
MOST_WORDS = 200_000
#: Nats by which the best word must lead the second.
MARGIN = 1.5
ALPHA = 0.25
# Bounds of the rates of matches, substitutions, insertions and deletions, and their counts before anything was seen.
LOW, HIGH, BEFORE = {"M": 0.5, "S": 1e-4, "I": 1e-4, "D": 1e-4}, {"M": 0.99, "S": 0.3, "I": 0.2, "D": 0.2}, {"M": 90, "S": 5, "I": 3, "D": 2}


class EditCosts:
    """Costs in nats of a match, of reading o for t, of an added o and of a lost t, from counts (op, true_ch, obs_ch) -> n; smoothed, never negative."""

    def __init__(self, counts: dict[tuple[str, str | None, str | None], int] | None = None, alpha: float = ALPHA):
        self.counts, self.alpha = dict(counts or {}), alpha
        total = {k: sum(n for (op, _, _), n in self.counts.items() if op == k) for k in "MSID"}
        total = total if sum(total.values()) else BEFORE
        self.rate = {k: min(HIGH[k], max(LOW[k], n / sum(total.values()))) for k, n in total.items()}
        letters = set("abcdefghijklmnopqrstuvwxyz0123456789-_ ")
        self.within: dict = {}
        for (op, t, o), n in self.counts.items():
            if op != "M":
                self.within[op, t if op == "S" else None] = self.within.get((op, t if op == "S" else None), 0) + n
                letters |= {x for x in (t, o) if x is not None}
        self.size = max(16, len(letters))
        self.match = -math.log(self.rate["M"])
        self.known: dict = {}

    def of(self, op: str, t: str | None, o: str | None) -> float:
        if op == "S" and t == o:
            return self.match
        found = self.known.get((op, t, o))
        if found is None:
            share = (self.counts.get((op, t, o), 0) + self.alpha) / (self.within.get((op, t if op == "S" else None), 0) + self.alpha * self.size)
            found = self.known[op, t, o] = -math.log(self.rate[op] * share)
        return found

    def first(self, token: str) -> list[float]:
        """The row of the empty prefix: all letters were added."""
        row = [0.0]
        for o in token:
            row.append(row[-1] + self.of("I", None, o))
        return row

    def step(self, row: list[float], t: str, token: str) -> list[float]:
        """The row of a prefix that is longer by t."""
        lost = self.of("D", t, None)
        new = [row[0] + lost]
        for j, o in enumerate(token, 1):
            new.append(min(row[j - 1] + self.of("S", t, o), row[j] + lost, new[-1] + self.of("I", None, o)))
        return new

    def cost(self, word: str, token: str) -> float:
        row = self.first(token)
        for t in word:
            row = self.step(row, t, token)
        return row[-1]


class Lexicon:
    """Words with log priors as a trie: a node is (children by letter, best prior below, word's prior or None)."""

    def __init__(self, priors: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.best: list[float] = [-math.inf]
        self.prior: list[float | None] = [None]
        for word, prior in priors.items():
            at = 0
            self.best[0] = max(self.best[0], prior)
            for letter in word:
                nxt = self.children[at].get(letter)
                if nxt is None:
                    nxt = self.children[at][letter] = len(self.children)
                    self.children.append({})
                    self.best.append(-math.inf)
                    self.prior.append(None)
                at = nxt
                self.best[at] = max(self.best[at], prior)
            self.prior[at] = prior

    def search(self, token: str, costs: EditCosts, n: int = 2) -> list[tuple[float, str]]:
        """The n words with the highest log probability of token and word together, ties by the word: [(log probability, word)]."""
        order, row = count(), costs.first(token)
        heap: list = [(min(row) - self.best[0], 0, "", next(order), 0, row)]
        out: list[tuple[float, str]] = []
        while heap and len(out) < n:
            bound, done, prefix, _, at, row = heapq.heappop(heap)
            if done:
                out.append((-bound, prefix))
                continue
            if self.prior[at] is not None:
                heapq.heappush(heap, (row[-1] - self.prior[at], 1, prefix, next(order), at, None))
            for letter, child in self.children[at].items():
                below = costs.step(row, letter, token)
                heapq.heappush(heap, (min(below) - self.best[child], 0, prefix + letter, next(order), child, below))
        return out


def priors(counts: dict[str, int], alpha: float = 1.0) -> dict[str, float]:
    """Log shares of words, each seen alpha times more than it was."""
    total = sum(counts.values()) + alpha * len(counts)
    return {w: math.log((n + alpha) / total) for w, n in counts.items()}


def correct(tokens: DataFrame, raw: str, words: DataFrame, counts: dict | None = None, margin: float = MARGIN) -> DataFrame:
    """(raw, word, log_p, lead): the best word of the lexicon (word, n) for every distinct token, if it leads the second by margin nats; lower case throughout.

    Tokens repeat: each distinct one is searched once, in Arrow batches. The lexicon is counted first and refused beyond
    MOST_WORDS. Null tokens and tokens without a clear word are left out.
    """
    listed = words.select(F.lower("word").alias("word"), "n").where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    rows = listed.limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"a lexicon of more than {MOST_WORDS} words doesn't travel to the tasks")
    shares, known = priors({r.word: r.n for r in rows}), dict(counts or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, costs = Lexicon(shares), EditCosts(known)
        for batch in batches:
            out = []
            for token in batch.column(0).to_pylist():
                best = lexicon.search(token.lower(), costs)
                if best and (len(best) == 1 or best[0][0] - best[1][0] >= margin):
                    out.append((token, best[0][1], best[0][0], best[0][0] - best[1][0] if len(best) > 1 else None))
            columns = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64(), pa.float64()))], ["raw", "word", "log_p", "lead"])

    return tokens.select(F.col(raw).alias("raw")).where("raw is not null").distinct().mapInArrow(run, "raw string, word string, log_p double, lead double")
