"""Exact ranked search with dual-sorted wavelet trees, one per shard of documents.

A shard joins the postings of all its terms, each term's by falling impact, into one sequence of document numbers and
stores it as a wavelet tree: every level splits the numbers by their next bit and keeps the order within a node. So a
node holds each term's postings of a stretch of documents, strongest first: the heads of the query terms' ranges add
up to a bound for all documents below. Search opens the nodes with the highest bounds first; a leaf's bound is its
score. A shard is done when no open node can reach the twentieth best score.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, give_back, materialize

#: A shard ends at so many documents or postings.
SHARD_DOCS = 8192
SHARD_POSTINGS = 1 << 21
#: Queries are answered in blocks of at most so many bytes of text (or one query); a block's terms travel to all tasks.
BLOCK_BYTES = 4 << 20
#: Nodes that are opened at a time.
BATCH = 64
#: Scores are merged in so many groups per query first, so that no task sorts the winners of all shards.
MERGE_GROUPS = 64
#: Fixed values of the score: impacts are below 2^20.
IMPACT_BITS = 20
_PIECE = 1 << 20
_LETTERS = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32 for i in range(256))
_IS_LETTER = np.frombuffer(_LETTERS, np.uint8) != 32
INDEX = "ids array<long>, terms binary, sizes binary, impacts binary, bits binary"


def count_terms(text: bytes) -> int:
    """Number of terms of a UTF-8 text, repeats included."""
    inside = _IS_LETTER[np.frombuffer(text, np.uint8)]
    return int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(inside[0]) if len(inside) else 0


def terms_of(text: bytes) -> Counter:
    """Terms of a UTF-8 text with their numbers of occurrences; long texts are cut between terms, so little is held at a time."""
    text, found, at = text.translate(_LETTERS), Counter(), 0
    while at < len(text):
        end = len(text) if len(text) - at <= _PIECE else text.find(b" ", at + _PIECE)
        end = len(text) if end < 0 else end
        found.update(text[at:end].split())
        at = end
    return found


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Builder:
    """Gathers the documents of a shard."""

    def __init__(self, n_docs: int, n_terms: int, most_docs: int = SHARD_DOCS, most_postings: int = SHARD_POSTINGS):
        self.n_docs, self.n_terms, self.most_docs, self.most_postings = n_docs, n_terms, most_docs, most_postings
        self.clear()

    def clear(self) -> None:
        self.vocabulary: dict = defaultdict(count().__next__)
        self.ids, self.m = [], []
        self.term, self.tf, self.held = array("i"), array("q"), array("i")

    def add(self, doc_id: int | None, text: bytes) -> None:
        """One document; those without terms aren't part of any list."""
        found = terms_of(text)
        if found:
            self.ids.append(doc_id)
            self.m.append(100 - 25 + 25 * sum(found.values()) * self.n_docs // self.n_terms)
            self.term.extend(map(self.vocabulary.__getitem__, found))
            self.tf.extend(found.values())
            self.held.append(len(found))

    def full(self) -> bool:
        return len(self.ids) >= self.most_docs or len(self.term) >= self.most_postings

    def row(self) -> dict:
        """The shard: documents numbered by ascending id (null last), lists by falling impact, levels of bits, zeros of a level first."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        levels = max(1, (len(order) - 1).bit_length())
        held = np.array(self.held)
        tf, m = np.array(self.tf), np.array(self.m, np.int64)
        key = np.array(self.term, np.int64) << IMPACT_BITS
        key = ((key | ((1 << IMPACT_BITS) - 1 - impacts(tf, np.repeat(m, held)))) << levels) | np.repeat(place, held)
        key.sort()
        strength = ((1 << IMPACT_BITS) - 1 - ((key >> levels) & ((1 << IMPACT_BITS) - 1))).astype(np.int32)
        numbers, bits = key & ((1 << levels) - 1), []
        for level in range(levels):
            bit = (numbers >> (levels - 1 - level)) & 1 == 1
            bits.append(np.packbits(bit, bitorder="little").tobytes())
            numbers = np.concatenate([numbers[~bit], numbers[bit]])
        sizes = np.bincount(np.array(self.term), minlength=len(self.vocabulary)).astype(np.int32)
        return {"ids": [self.ids[i] for i in order], "terms": b" ".join(self.vocabulary), "sizes": sizes.tobytes(), "impacts": strength.tobytes(), "bits": b"".join(bits)}


class Tree:
    """A shard's wavelet tree in memory."""

    def __init__(self, n_docs: int, strength: bytes, bits: bytes):
        top = np.frombuffer(strength, np.int32)
        n, self.levels = len(top), max(1, (n_docs - 1).bit_length())
        wide = (n >> 6) + 1
        packed = np.frombuffer(bits, np.uint8).reshape(self.levels, -1)
        padded = np.zeros((self.levels, wide * 8), np.uint8)
        padded[:, : packed.shape[1]] = packed
        self.words = padded.view("<u8")
        before = np.cumsum(np.bitwise_count(self.words), axis=1, dtype=np.int32)
        self.zeros = n - before[:, -1].astype(np.int64)
        self.before = np.zeros_like(before)
        self.before[:, 1:] = before[:, :-1]
        self.strength = np.empty((self.levels + 1, n), np.int32)
        self.strength[0] = top
        for level in range(self.levels):
            bit, here = np.unpackbits(packed[level], count=n, bitorder="little").view(bool), self.strength[level]
            zeros = self.zeros[level]
            self.strength[level + 1, :zeros], self.strength[level + 1, zeros:] = here[~bit], here[bit]

    def ones(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ones of a level before a place."""
        word = at >> 6
        rest = self.words[level, word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[level, word] + np.bitwise_count(rest).astype(np.int64)

    def best(self, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, document numbers) of the k best with scores above 0 and not below least, for ranges of the sequence with their weights."""
        scores = numbers = np.zeros(0, np.int64)
        opened = count()
        heap = [(-int((self.strength[0][lo].astype(np.int64) * weight).sum()), next(opened), 0, 0, (lo, hi, weight), 0, len(lo))] if len(lo) else []
        while heap:
            take = []
            while heap and len(take) < BATCH:
                if -heap[0][0] < max(least, 1):
                    heap.clear()
                else:
                    take.append(heapq.heappop(heap))
            if not take:
                break
            sizes = np.array([b - a for *_, a, b in take])
            node = np.repeat(np.arange(len(take)), sizes)
            level = np.array([x[2] for x in take])[node]
            lo, hi, weight = (np.concatenate([x[4][i][x[5] : x[6]] for x in take]) for i in range(3))
            lo_ones, hi_ones = self.ones(level, lo), self.ones(level, hi)
            zeros = self.zeros[level]
            found = []
            for side, new_lo, new_hi in ((0, lo - lo_ones, hi - hi_ones), (1, zeros + lo_ones, zeros + hi_ones)):
                at = np.nonzero(new_hi > new_lo)[0]
                if not len(at):
                    continue
                new_lo, new_hi, w, of = new_lo[at], new_hi[at], weight[at], node[at]
                start = np.nonzero(np.diff(of, prepend=-1))[0]
                bound = np.add.reduceat(self.strength[level[at] + 1, new_lo].astype(np.int64) * w, start)
                end = np.append(start[1:], len(at)).tolist()
                for b, s, e, parent in zip(bound.tolist(), start.tolist(), end, of[start].tolist()):
                    if b >= max(least, 1):
                        below, prefix = take[parent][2] + 1, 2 * take[parent][3] + side
                        if below == self.levels:
                            found.append((b, prefix))
                        else:
                            heapq.heappush(heap, (-b, next(opened), below, prefix, (new_lo, new_hi, w), s, e))
            if found:
                fresh = np.array(found, np.int64)
                scores, numbers = np.concatenate([scores, fresh[:, 0]]), np.concatenate([numbers, fresh[:, 1]])
                keep = np.lexsort((numbers, -scores))[:k]
                scores, numbers = scores[keep], numbers[keep]
                if len(scores) == k:
                    least = max(least, int(scores[-1]))
        return scores, numbers


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms with repeats, of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = terms = 0
        for batch in batches:
            for text in as_bytes(batch.column("text")):
                n = count_terms(text) if text else 0
                held, terms = held + (n > 0), terms + n
        yield pa.RecordBatch.from_pydict({"held": [held], "terms": [terms]})

    sums = docs.select("text").mapInArrow(run, "held long, terms long").agg(F.sum("held"), F.sum("terms")).first()
    return sums[0] or 0, sums[1] or 0


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS) -> tuple[DataFrame, int]:
    """(one row per shard, number of documents with a term), the shards in a table of the shared folder.

    Every task cuts its own rows into shards: texts aren't shuffled; small splits are read together so that shards are
    full however the input is split. Null and term-free texts are part of no shard; rows that share an id are documents
    of their own; null ids are kept, last in order; other columns aren't read. An empty table gives no shards.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n_docs, n_terms = corpus_size(docs)
    schema = pa.schema([("ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("terms", "sizes", "impacts", "bits")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Builder(n_docs, n_terms, shard_docs)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                if text:
                    shard.add(doc_id, text)
                if shard.full():
                    yield pa.RecordBatch.from_pylist([shard.row()], schema)
                    shard.clear()
        if shard.ids:
            yield pa.RecordBatch.from_pylist([shard.row()], schema)
        shard.clear()
        give_back()

    parts = max(math.ceil(n_docs / shard_docs), docs.sparkSession.sparkContext.defaultParallelism)
    return materialize(docs.coalesce(parts).mapInArrow(run, INDEX), "lexical-index"), n_docs


def document_frequencies(index: DataFrame, wanted: set[bytes]) -> Counter:
    """Documents that hold each wanted term: sums of list lengths; only dictionaries are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for terms, sizes in zip(batch.column("terms").to_pylist(), batch.column("sizes").to_pylist()):
                for term, n in zip(terms.split(), np.frombuffer(sizes, np.int32).tolist()):
                    if term in wanted:
                        total[term] += n
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(total), pa.binary()), "n": pa.array(total.values(), pa.int64())})

    rows = index.select("terms", "sizes").mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return Counter({bytes(r.term): r.n for r in rows.collect()})  # the block's terms at most


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def answer(index: DataFrame, n_docs: int, queries: list[tuple[int | None, bytes]], k: int) -> DataFrame:
    """item_id, rank, doc_id, score of one block of queries."""
    asked = [terms_of(text) for _, text in queries]
    held = document_frequencies(index, set().union(*asked))
    #: term: [(query, weight times its occurrences there)]
    uses: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    for q, terms in enumerate(asked):
        for term, n in terms.items():
            if held[term]:
                uses[term].append((q, n * weight(held[term], n_docs)))
    uses, items = dict(uses), [item for item, _ in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, list[tuple[int, bool, int]]] = defaultdict(list)
        for batch in batches:
            for i in range(batch.num_rows):
                terms, sizes, ids = batch.column("terms")[i].as_py().split(), batch.column("sizes")[i].as_py(), batch.column("ids")[i].values
                ends = np.cumsum(np.frombuffer(sizes, np.int32), dtype=np.int64).tolist()
                ranges = defaultdict(list)
                for t, term in enumerate(terms):
                    for q, w in uses.get(term, ()):
                        ranges[q].append((ends[t - 1] if t else 0, ends[t], w))
                if not ranges:
                    continue
                tree = Tree(len(ids), batch.column("impacts")[i].as_py(), batch.column("bits")[i].as_py())
                for q, r in ranges.items():
                    best = top[q]
                    found = tree.best(*np.array(r, np.int64).T.copy(), k, -best[-1][0] if len(best) == k else 1)
                    for score, at in zip(*(x.tolist() for x in found)):
                        doc_id = ids[at].as_py()
                        best.append((-score, doc_id is None, doc_id or 0))
                    best.sort()
                    del best[k:]
                del tree
        rows = [(q, items[q], None if none else doc_id, -score) for q, best in top.items() for score, none, doc_id in best]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 4, ["query", "item_id", "doc_id", "score"])
        give_back()

    rows = index.mapInArrow(run, "query long, item_id long, doc_id long, score long").withColumn("part", F.spark_partition_id() % MERGE_GROUPS)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("rank") <= k)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    return rows.select("item_id", "rank", "doc_id", "score")


def search(index: DataFrame, n_docs: int, queries: DataFrame, item_col: str = "item_id", text_col: str = "text", k: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k highest scores above 0 of every query, ties to the smaller doc_id (null last).

    Queries are read in blocks of bounded size. Null and term-free queries give no rows; queries that share an id are
    each answered; rows that share id and score are ranked in any order.
    """
    queries = queries.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    answers, block, size = [], [], 0
    for row in queries.toLocalIterator():
        text = row.text.encode()
        if block and size + len(text) > block_bytes:
            answers.append(answer(index, n_docs, block, k))
            block, size = [], 0
        block.append((row.item, text))
        size += len(text)
    answers.append(answer(index, n_docs, block, k))
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out


def rank(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The k best documents of each query: build_index() and search()."""
    index, n_docs = build_index(docs)
    return search(index, n_docs, queries, k=k)


#: DuckDB SQL for op11.
ORACLE = r"""
WITH abc AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, up, low), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents, abc),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (
  SELECT item_id, term, count(*) AS uses FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, up, low), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark, abc) GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id, CAST(sum(uses * CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // terms))))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN lengths USING (doc_id), corpus GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
