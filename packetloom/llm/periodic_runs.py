"""Periodic runs of words by harmonic grid probing.

A run of period p with at least 2p words holds two neighbouring points of the grid 0, p, 2p, ...: only pairs of equal
words at jp and (j+1)p can lie in one, n/p pairs for a period and n ln n in all. Pairs that survive are extended: a few
words to both sides for all of them at a time, then chunk by chunk for the rest. Periods are taken in blocks from P to
2P-1, so that multiples of a run's period come after it: their grid points within the run are skipped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, give_back

#: Fixed value: a run has at least so many words.
LEAST = 12
#: Words by which all survivors of a block are extended at once, to both sides: every run's matches number so many at least.
NEAR = LEAST // 2
#: Grid points that are probed at a time.
PROBES = 1 << 20
#: First chunk of an extension; it doubles up to the last.
CHUNKS = 32, 1 << 16


def grid(first: int, end: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) of the grid pairs of n words for periods from first to end - 1, some at a time, by period and place."""
    while first < end:
        last, points = first + 1, (n - 1) // first
        while last < end and points + (n - 1) // last <= PROBES:
            points += (n - 1) // last
            last += 1
        periods = np.arange(first, last)
        each = (n - 1) // periods
        period = np.repeat(periods, each)
        start = np.cumsum(each) - each
        yield (np.arange(len(period)) - np.repeat(start, each)) * period, period
        first = last


def matches(words: np.ndarray, at: int, period: int, step: int) -> int:
    """How many places from at on, in direction step, hold the word that stands a period later: compared in growing chunks."""
    n, found, size = len(words) - period, 0, CHUNKS[0]
    while True:
        if step > 0:
            lo, hi = at + found, min(at + found + size, n)
        else:
            lo, hi = max(at - found - size + 1, 0), at - found + 1
        if hi <= lo:
            return found
        unlike = np.nonzero(words[lo:hi] != words[lo + period : hi + period])[0]
        if len(unlike):
            return found + (int(unlike[0]) if step > 0 else hi - lo - 1 - int(unlike[-1]))
        found += hi - lo
        size = min(2 * size, CHUNKS[1])


def near(words: np.ndarray, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which pairs have NEAR matching neighbours in a row, themselves included."""
    n = len(words)
    row, ahead, behind = np.ones(len(at), np.int64), np.ones(len(at), bool), np.ones(len(at), bool)
    for k in range(1, NEAR):
        right, left = at + k, at - k
        ahead &= right + period < n
        behind &= left >= 0
        ahead[ahead] = words[right[ahead]] == words[right[ahead] + period[ahead]]
        behind[behind] = words[left[behind]] == words[left[behind] + period[behind]]
        row += ahead
        row += behind
    return row >= NEAR


def find(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period. words: equal numbers for equal words.

    A stretch of matches at distance p whose words already form a run is that run again, at a multiple of its period:
    the two have the same ends.
    """
    n = len(words)
    runs, known, first = [], set(), 1
    #: by place: the run that was found there last
    cover = np.full(n, -1, np.int64)
    by_run: list[int] = []
    while 2 * first <= n:
        end = min(2 * first, n // 2 + 1)
        for at, period in grid(first, end, n):
            alike = np.nonzero(words[at] == words[at + period])[0]
            at, period = at[alike], period[alike]
            if by_run and len(at):
                inside = cover[at]
                inside[inside != cover[at + period]] = -1
                fresh = (inside < 0) | (period % np.array(by_run)[inside] != 0)
                at, period = at[fresh], period[fresh]
            survive = near(words, at, period)
            done, of = -1, 0
            for i, p in zip(at[survive].tolist(), period[survive].tolist()):
                if p == of and i < done:
                    continue
                start, stop = i + 1 - matches(words, i, p, -1), i + matches(words, i, p, 1)
                of, done = p, stop
                length = stop - start + p
                if length >= max(LEAST, 2 * p) and (start, length) not in known:
                    known.add((start, length))
                    runs.append((start, length, p))
                    cover[start : start + length] = len(by_run)
                    by_run.append(p)
        first *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal for equal words."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def repeated(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) > 0


def plant(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The rewriting of the contract: in a tenth of the documents, by their ids, the words from some place on are made periodic. Null ids: as they are."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


RUNS = "array<struct<start:long,length:long,period:long>>"


def detect_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False) -> DataFrame:
    """doc_id, n_words, runs, collapsed: one row per row of docs.

    runs: stretches of consecutive words with smallest period q (words q apart are equal) and at least max(12, 2q)
    words that no neighbouring word extends, by start, then period. collapsed: the text's words without those that any
    run holds after its first q words, joined by one space. planted: rewrite the words first as plant() says. Null,
    empty and white texts have no words and no runs; ids may be null or repeat; other columns aren't read; an empty
    table gives no rows. Nothing is shuffled; a task holds one batch of texts.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = pa.struct([(f, pa.int64()) for f in ("start", "length", "period")])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(fields)), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                words = (text or b"").split()
                if planted:
                    words = plant(words, doc_id)
                runs = find(numbered(words))
                kept = words
                if runs:
                    drop = repeated(len(words), runs).tolist()
                    kept = [w for w, gone in zip(words, drop) if not gone]
                rows.append((doc_id, len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], b" ".join(kept).decode()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        give_back()

    return docs.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """Per row of detect_runs(): number of runs, the longest (ties: smallest start, then period), SHA-256 of the runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = found.withColumn("top", longest)
    start, length, period = -F.col("top.start"), F.col("top.length"), -F.col("top.period")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * `top`.length div -`top`.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
