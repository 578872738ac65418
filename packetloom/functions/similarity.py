"""Similarity of strings: what SQL has no function for runs in Arrow batches."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("op", "true_ch", "obs_ch")]))


def sequence_ratio(a: str | None, b: str | None) -> float | None:
    return None if a is None or b is None else SequenceMatcher(None, a, b, autojunk=False).ratio()


def alignment(true: str, observed: str) -> list[tuple[str, str | None, str | None]]:
    """Cheapest edit script from true to observed: M match, S substitution, I insertion, D deletion; in that preference from the end, S before D before I."""
    n, m = len(true), len(observed)
    cost = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (true[i - 1] != observed[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    script, i, j = [], n, m
    while i or j:
        if i and j and true[i - 1] == observed[j - 1] and cost[i][j] == cost[i - 1][j - 1]:
            script.append(("M", true[i - 1], observed[j - 1]))
            i, j = i - 1, j - 1
        elif i and j and cost[i][j] == cost[i - 1][j - 1] + 1:
            script.append(("S", true[i - 1], observed[j - 1]))
            i, j = i - 1, j - 1
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            script.append(("D", true[i - 1], None))
            i -= 1
        else:
            script.append(("I", None, observed[j - 1]))
            j -= 1
    return script[::-1]


@F.pandas_udf(T.DoubleType())
def sequence_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([sequence_ratio(x, y) for x, y in zip(a, b)])


@F.pandas_udf(OPS)
def alignment_udf(true: pd.Series, observed: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or o is None else [{"op": k, "true_ch": x, "obs_ch": y} for k, x, y in alignment(t, o)] for t, o in zip(true, observed)])


@F.pandas_udf(T.StringType())
def fold_accents(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    import unicodedata

    return pd.Series([None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in text])


def compact(text: Column) -> Column:
    """Letters and digits of the lower-cased text."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def error_rate(expected: Column, observed: Column) -> Column:
    """Edits per letter of expected, at most 1; 1 where either is blank."""
    blank = F.coalesce((F.trim(expected) == "") | (F.trim(observed) == ""), F.lit(True))
    return F.when(blank, F.lit(1.0)).otherwise(F.least(F.levenshtein(expected, observed) / F.length(expected), F.lit(1.0)))


class EditDistances:
    """Edit distances of a text to many known ones at once: their bit vectors (Myers, Hyyrö) lie side by side in one integer, a spare bit after each."""

    def __init__(self, known: list[str]):
        self.fields, self.first, self.all, at = [], 0, 0, 0
        self.places: dict[str, int] = {}
        for text in known:
            self.fields.append((at, len(text)))
            if text:
                self.first |= 1 << at
            self.all |= ((1 << len(text)) - 1) << at
            for i, letter in enumerate(text):
                self.places[letter] = self.places.get(letter, 0) | 1 << at + i
            at += len(text) + 1

    def __call__(self, text: str) -> list[int]:
        every, first, places = self.all, self.first, self.places
        up, down = every, 0
        for letter in text:
            eq = places.get(letter, 0)
            v = eq | down
            h = ((eq & up) + up ^ up | eq) & every
            rise = (down | every ^ (h | up)) << 1 | first
            fall = (up & h) << 1
            up = (fall | every ^ (v | rise) & every) & every
            down = rise & v
        return [len(text) + (up >> at & (1 << n) - 1).bit_count() - (down >> at & (1 << n) - 1).bit_count() for at, n in self.fields]


def channel_log_probability(observed: str, candidate: str, counts: dict[tuple[str, str | None, str | None], int], alpha: float = 0.25) -> float:
    """Log probability of observed given candidate: smoothed rates of the operations on the cheapest alignment.

    counts: (op, true_ch, obs_ch) -> n. Operation rates are clamped; letters within an operation share alpha each over
    the letters seen or expected. Without counts, a prior of 100 operations (90 M, 5 S, 3 I, 2 D) holds.
    """
    by_op = {k: 0 for k in "MSID"}
    for (op, _, _), n in counts.items():
        by_op[op] += n
    if not sum(by_op.values()):
        by_op = {"M": 90, "S": 5, "I": 3, "D": 2}
    total = sum(by_op.values())
    low, high = {"M": 0.5, "S": 1e-4, "I": 1e-4, "D": 1e-4}, {"M": 0.99, "S": 0.3, "I": 0.2, "D": 0.2}
    rate = {k: min(high[k], max(low[k], by_op[k] / total)) for k in by_op}
    letters = set("abcdefghijklmnopqrstuvwxyz0123456789-_ ")
    rows: dict[str | None, int] = {}
    for (op, t, o), n in counts.items():
        if op == "S":
            rows[t] = rows.get(t, 0) + n
            letters |= {t, o}
        elif op in "ID":
            letters.add(o if op == "I" else t)
    size = max(16, len(letters))
    log = 0.0
    for op, t, o in alignment(candidate, observed):
        if op == "M":
            log += math.log(rate["M"])
            continue
        within = rows.get(t, 0) if op == "S" else by_op[op]
        log += math.log(rate[op] * (counts.get((op, t, o), 0) + alpha) / (within + alpha * size))
    return log
