"""Approximate nearest neighbours by additive quantisation.

A vector is coded as the sum of one codeword from each of several full-dimensional codebooks. The codebooks start as
residual k-means and are refitted by least squares over codes found by beam search; rows are encoded by the same beam
search. A row keeps its codes and the squared norm of its reconstruction. Queries score rows by table lookups (inner
products of the query with all codewords, summed by code) and the best of each block are reranked by the exact measure
on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bound of the training sample, in vectors.
TRAIN_ROWS = 10_000
BOOKS, WORDS, BEAM = 16, 64, 8
#: Rows and queries in a block; a pair of blocks is one unit of work. Of a row block, each query reranks this share.
ROW_BLOCK, QUERY_BLOCK, RERANK = 8192, 2048, 0.08
TOP = 20
QUERY_EVERY = 20


class Codebooks:
    """books: float64 [M, K, D]."""

    def __init__(self, books: np.ndarray):
        self.books = books
        self.flat = books.reshape(-1, books.shape[2]).astype(np.float32)
        self.norms = (books**2).sum(2)
        self.cross = np.einsum("ikd,jld->ijkl", books, books)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes [n, M] that lessen the squared error, by beam search over the books in order."""
        m, k, _ = self.books.shape
        out = []
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024]
            n = len(part)
            ip = (part.astype(np.float32) @ self.flat.T).reshape(n, m, k).astype(np.float64)
            codes = np.zeros((n, 1, m), np.int64)
            err = np.zeros((n, 1))
            for b in range(m):
                grow = err[:, :, None] + self.norms[b][None, None, :] - 2 * ip[:, b][:, None, :]
                for a in range(b):
                    grow += 2 * self.cross[a, b][codes[:, :, a]]
                flat = grow.reshape(n, -1)
                keep = min(beam if b < m - 1 else 1, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                err = np.take_along_axis(flat, best, 1)
                codes = np.take_along_axis(codes, (best // k)[:, :, None], 1)
                codes[:, :, b] = best % k
            out.append(codes[:, 0])
        return np.concatenate(out).astype(np.uint8) if out else np.zeros((0, m), np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[b][codes[:, b]] for b in range(len(self.books)))


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 2, seed: int = 5) -> Codebooks:
    """Residual k-means, then rounds of beam-search codes and least-squares codewords."""
    rng = np.random.default_rng(seed)
    words = max(1, min(words, len(x), 256))
    left, made = x.copy(), []
    for _ in range(books):
        centres = left[rng.choice(len(left), words, replace=False)]
        for _ in range(8):
            near = ((centres**2).sum(1)[None] - 2 * left @ centres.T).argmin(1)
            count = np.bincount(near, minlength=words)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, left)
            centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        left -= centres[((centres**2).sum(1)[None] - 2 * left @ centres.T).argmin(1)]
        made.append(centres)
    found = Codebooks(np.stack(made))
    for _ in range(rounds):
        codes = found.encode(x).astype(np.int64)
        size = books * words
        where = codes + np.arange(books) * words
        gram, right = np.zeros((size, size)), np.zeros((size, x.shape[1]))
        for b in range(books):
            np.add.at(right, where[:, b], x)
            for a in range(books):
                np.add.at(gram, (where[:, a], where[:, b]), 1.0)
        flat = np.linalg.solve(gram + 1e-3 * np.eye(size), right + 1e-3 * found.books.reshape(size, -1))
        found = Codebooks(flat.reshape(books, words, -1))
    return found


def usable(vector: str):
    """Not null or empty, of finite components, and not all zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", query_every: int = QUERY_EVERY, top: int = TOP, train_rows: int = TRAIN_ROWS, rerank: float = RERANK, repeats: bool = False) -> DataFrame:
    """The top rows by inner product of every row whose id is divisible by query_every: query_id, rank, vec_id, score.

    Every row is indexed; ids that are null take no part, nor do vectors that are null, empty, zero or have null or
    non-finite components, nor vectors whose length isn't the most frequent one. A query never finds its own row. Rows
    repeated under one id count once, the first by content; with repeats they are rows of their own: each is found, by
    its namesakes, too, and each has its own ranks as a query. Ties go to the smaller vec_id. With fewer rows than top, all are returned; an empty table gives no rows. Other columns aren't read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull()).where(usable("v"))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = dims["d"], dims["count"]
    rows = rows.where(F.size("v") == d)
    if not repeats:
        rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    spot = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30))  # not by id alone: rows may share it
    sample = rows.where(spot < int((1 << 30) * min(1.0, 1.1 * train_rows / n)) + 1).limit(train_rows)
    got = sample.toPandas().sort_values("vec_id")
    book = spark.sparkContext.broadcast(train(np.array(got["v"].tolist(), dtype=np.float64)).books) if len(got) else None
    if book is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of rows: numbers of the rows (unique, written once with them), ids, vectors, codes, norms."""
        books = Codebooks(book.value)
        number = TaskContext.get().partitionId() << 33

        def block(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            rows = np.arange(number, number + len(ids), dtype=np.int64)
            number += len(ids)
            codes = books.encode(x)
            norms = (books.decode(codes) ** 2).sum(1).astype(np.float32)
            cells = [rows.tobytes(), ids.tobytes(), x.tobytes(), codes.tobytes(), norms.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], names=["rows", "ids", "x", "codes", "norms"])

        ids, xs, held = [], [], 0
        for b in batches:
            ids.append(np.array(b.column(0), dtype=np.int64))
            xs.append(np.array(b.column(1).flatten(), dtype=np.float64).reshape(-1, d))
            held += len(ids[-1])
            if held >= ROW_BLOCK:
                i, x = np.concatenate(ids), np.concatenate(xs)
                for at in range(0, held - held % ROW_BLOCK, ROW_BLOCK):
                    yield block(i[at : at + ROW_BLOCK], x[at : at + ROW_BLOCK])
                at = held - held % ROW_BLOCK
                ids, xs, held = [i[at:]], [x[at:]], held - at
        if held:
            yield block(np.concatenate(ids), np.concatenate(xs))

    # as many partitions as there are full blocks: how the input was split doesn't make blocks smaller
    index = materialize(rows.repartition(-(-n // ROW_BLOCK)).mapInArrow(pack, "rows binary, ids binary, x binary, codes binary, norms binary"), "aq-index")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of the queries among the rows."""
        for b in batches:
            for rows, ids, x in zip(*(c.to_pylist() for c in b.columns)):
                r, i, x = np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(x).reshape(-1, d)
                keep = i % query_every == 0
                r, i, x = r[keep], i[keep], x[keep]
                for at in range(0, len(i), QUERY_BLOCK):
                    cells = [c[at : at + QUERY_BLOCK].tobytes() for c in (r, i, x)]
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], names=["q_rows", "q_ids", "q"])

    queries = materialize(index.select("rows", "ids", "x").mapInArrow(pick, "q_rows binary, q_ids binary, q binary"), "aq-queries")
    out_schema = "query_row long, query_id long, vec_id long, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = book.value.astype(np.float32)
        for b in batches:
            for q_rows, q_ids, q, rows, ids, x, codes in zip(*(c.to_pylist() for c in b.columns)):
                q_rows, q_ids, rows, ids = (np.frombuffer(c, np.int64) for c in (q_rows, q_ids, rows, ids))
                q, x = np.frombuffer(q).reshape(-1, d), np.frombuffer(x).reshape(-1, d)
                codes = np.frombuffer(codes, np.uint8).reshape(len(ids), -1)
                take = min(len(ids), max(8 * top, int(rerank * len(ids))))
                found: list[list[np.ndarray]] = [[], [], [], []]
                for at in range(0, len(q), 256):
                    qs = q[at : at + 256]
                    lut = np.einsum("mkd,qd->mkq", books, qs.astype(np.float32), optimize=True)
                    approx = lut[0][codes[:, 0]]
                    for m in range(1, len(books)):
                        approx += lut[m][codes[:, m]]
                    approx = np.ascontiguousarray(approx.T)
                    near = np.argpartition(-approx, take - 1, axis=1)[:, :take] if take < len(ids) else np.tile(np.arange(len(ids)), (len(qs), 1))
                    for k, (one, c) in enumerate(zip(qs, near)):
                        exact = (x[c] * one).sum(1)
                        exact[rows[c] == q_rows[at + k]] = -np.inf
                        best = np.lexsort((ids[c], -exact))[:top]
                        best = best[exact[best] > -np.inf]
                        for cell, got in zip(found, (np.full(len(best), q_rows[at + k]), np.full(len(best), q_ids[at + k]), ids[c][best], exact[best])):
                            cell.append(got)
                if found[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f)) for f in found], names=["query_row", "query_id", "vec_id", "score"])

    # a stated query set against all rows, block by block
    pairs = queries.crossJoin(index.select("rows", "ids", "x", "codes"))
    near = pairs.mapInArrow(score, out_schema)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
