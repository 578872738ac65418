"""Exact deduplication by Grace hashing.

Records are partitioned by a digest of their normalised content. A bucket is worked on with an open-addressing table
that compares complete content; what doesn't fit goes to spill files, dealt by the next bits of the digest, and each of
those is worked on in turn. Every task first merges the copies among its own rows, so that of a text which a third of
all rows share only one record per task is shuffled; the row ids stay where they were read.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialize

#: Bytes of distinct content that a bucket's table may hold before the rest is spilled.
TABLE_BYTES = 64 << 20
FAN_OUT_BITS = 4
DIGEST_BITS = 256


def normalise(text: bytes | None) -> bytes:
    """Every run of white space becomes one space; null counts as empty."""
    if not text:
        return b""
    words = text.split()
    if not words:
        return b" "
    body = b" ".join(words)
    return (b" " if text[:1].isspace() else b"") + body + (b" " if text[-1:].isspace() else b"")


class Table:
    """Open addressing with linear probing over distinct contents; equality compares the complete content."""

    def __init__(self, size: int = 1024):
        self.slots: list[int] = [-1] * size
        self.hashes: list[int] = []
        self.digests: list[bytes] = []
        self.contents: list[bytes] = []
        self.values: list = []
        self.bytes = 0

    def find(self, h: int, content: bytes) -> tuple[int, int]:
        """(entry or -1, slot)."""
        mask = len(self.slots) - 1
        at = h & mask
        while (e := self.slots[at]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e, at
            at = (at + 1) & mask
        return -1, at

    def add(self, at: int, h: int, digest: bytes, content: bytes, value) -> None:
        self.slots[at] = len(self.contents)
        self.digests.append(digest)
        self.hashes.append(h)
        self.contents.append(content)
        self.values.append(value)
        self.bytes += len(content) + 64
        if 2 * len(self.contents) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            mask = len(self.slots) - 1
            for e, other in enumerate(self.hashes):
                at = other & mask
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = e


def _spilled(file) -> Iterator[tuple[bytes, bytes, object]]:
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            break
    file.close()


def grace(records: Iterable[tuple[bytes, bytes, object]], new: Callable, merge: Callable, table_bytes: int = TABLE_BYTES, level: int = 0) -> Iterator[tuple[bytes, bytes, object]]:
    """Of records (digest, content, payload), one (digest, content, value) per distinct content.

    new(payload) starts a value, merge(value, payload) adds to it. Records whose content the table already holds are
    merged at once, however full it is, so a hot content never spills; others spill by FAN_OUT_BITS of the digest.
    Past the digest's last bits (contents with one digest) the table is allowed to grow.
    """
    table, files = Table(), {}
    shift = DIGEST_BITS - FAN_OUT_BITS * (level + 1)
    for digest, content, payload in records:
        whole = int.from_bytes(digest, "big")
        h = whole & 0x7FFFFFFFFFFFFFFF
        e, at = table.find(h, content)
        if e >= 0:
            merge(table.values[e], payload)
        elif table.bytes < table_bytes or shift < 64:
            table.add(at, h, digest, content, new(payload))
        else:
            part = whole >> shift & (1 << FAN_OUT_BITS) - 1
            if part not in files:
                files[part] = tempfile.TemporaryFile()  # noqa: SIM115  has no name: it goes with the task, however that ends
            pickle.dump((digest, content, payload), files[part], pickle.HIGHEST_PROTOCOL)
    for e, content in enumerate(table.contents):
        yield table.digests[e], content, table.values[e]
    del table
    for part in sorted(files):
        yield from grace(_spilled(files.pop(part)), new, merge, table_bytes, level + 1)


def _chunks(rows: Iterator[tuple], schema: pa.Schema, limit: int = 16 << 20, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) * (8 if isinstance(x, list) else 1) for x in row if isinstance(x, (bytes, list)))
        if size >= limit or len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after every run of white space became one space; null counts as empty. The row with
    the smallest doc_id of a group stays (null ids last); of repeated rows with that id exactly one stays. Only the two
    named columns are read, so others, whatever their names, don't matter. An empty table gives no rows; very long texts
    are compared whole.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    local_schema = pa.schema([("rep_key", pa.int64()), ("h", pa.int64()), ("sha", pa.binary()), ("ids", pa.list_(pa.int64())), ("content", pa.binary())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for b in batches:
                for i, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1))):
                    content = normalise(t)
                    yield hashlib.sha256(content).digest(), content, i

        def out():
            key = TaskContext.get().partitionId() << 33
            for n, (sha, content, ids) in enumerate(grace(records(), lambda i: [i], lambda v, i: v.append(i), table_bytes)):
                ids.sort(key=lambda i: (i is None, i or 0))
                yield key + n, int.from_bytes(sha[:8], "big", signed=True), sha, ids, content

        yield from _chunks(out(), local_schema)

    found = materialize(docs.mapInArrow(local, "rep_key long, h long, sha binary, ids array<long>, content binary"), "exact-local")
    reps = found.select("rep_key", "h", "sha", F.col("ids")[0].alias("first_id"), F.size("ids").cast("long").alias("n"), "content").repartition("h")
    merged_schema = pa.schema([("rep_key", pa.int64()), ("keep_id", pa.int64()), ("win_key", pa.int64()), ("group_size", pa.int64())])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for b in batches:
                for key, _, sha, first, n, content in zip(*(c.to_pylist() for c in b.columns)):
                    yield sha, content, (key, first, n)

        def out():
            for _, _, members in grace(records(), lambda p: [p], lambda v, p: v.append(p), table_bytes):
                win, keep, _ = min(members, key=lambda p: (p[1] is None, p[1] or 0, p[0]))
                size = sum(p[2] for p in members)
                for key, _, _ in members:
                    yield key, keep, win, size

        yield from _chunks(out(), merged_schema)

    merged = reps.mapInArrow(whole, "rep_key long, keep_id long, win_key long, group_size long")
    return (
        found.select("rep_key", "ids", F.lower(F.hex("sha")).alias("text_sha256")).join(merged, "rep_key")
        .select("*", F.posexplode("ids").alias("pos", "doc_id"))
        .select("doc_id", "keep_id", "group_size", ((F.col("pos") == 0) & (F.col("rep_key") == F.col("win_key"))).alias("kept"), "text_sha256")
    )
