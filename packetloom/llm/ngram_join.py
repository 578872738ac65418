"""Exact n-gram Jaccard join by T-occurrence search (DivideSkip).

A document is the set of its distinct five-word shingles, as 64-bit hashes; documents with one set are one class. Of a
set of n, a partner at Jaccard 3/4 must hold at least T = ceil(3n/4) shingles, and so one of any n - T + 1 of them.

1. Suspects. The first n - T + 1 shingles by hash are shuffled, one per shingle and task; sets none of whose are in
   another set have no partner. Most documents end here.
2. Counts. All shingles of the suspects are counted over the suspects. Sets of which fewer than T shingles are in another
   set have no partner. The rest keep their shared shingles, each with its count (HOT and above are one class).
3. Blocks. With rare shingles first, the short lists of a set are those of its first n - T + 1 shingles; the lists of the
   others are never merged. Sorted runs of short-list postings are merged by shingle; members of a list whose sizes
   allow a link are chained (not paired), and the components of these chains are blocks that no link leaves.
4. Search. Within a block every set merges its shortest inverted lists and counts; its longest ones are only probed, as
   bits of the candidates that can still reach T; what reaches the overlap that 3/4 of the union needs is linked. Every
   link between two sets is found once and counted at both, by the rows that the other set has; pairs are neither kept
   nor sent. Blocks above BLOCK_SETS sets are worked on as pairs of parts: no task holds more than two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, drop, give_back, materialize

WORDS = 5
#: Similarity as a fraction: 75 / 100.
NUM, DEN = 3, 4
#: Counts from here on are one class. A task that meets a shingle as often sends its count, not its postings.
HOT = 64
BLOCK_SETS = 4096
#: Lists that more than one in LONG sets of a block are on are probed, not merged.
LONG = 16
BROADCAST_IDS = 1 << 20
#: Rows of a batch whose texts are held as Python objects at a time.
SLICE = 512
_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WORDS)], dtype=np.uint64)


class Shingler:
    """Shingle sets of texts. Words are hashed as they come: a memo of hashes takes longer than hashing, and memory."""

    def __init__(self, words: int = WORDS):
        self.words = words

    def word_hashes(self, text: bytes) -> np.ndarray:
        # on bytes: A-Z and ASCII white space only
        return np.array(list(map(xxhash.xxh64_intdigest, text.lower().split())), np.uint64)

    def shingles(self, text: bytes | None) -> np.ndarray:
        """The sorted distinct shingle hashes of a text; with fewer words, one of them all; without words none."""
        h = self.word_hashes(text) if text else np.zeros(0, np.uint64)
        k = min(self.words, len(h))
        if not k:
            return h
        n = len(h) - k + 1
        mixed = np.full(n, k, np.uint64)
        for i in range(k):
            mixed = (mixed ^ h[i : i + n]) * _MULTIPLIERS[i]
            mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed)


def set_key(shingles: np.ndarray) -> int:
    """64-bit fingerprint of a set (two sets of one size out of N get the same with probability N * N / 2 ** 65)."""
    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63)


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1 if n else 0


def needed_overlap(n: int, m: np.ndarray) -> np.ndarray:
    """Least intersections of a set of n with sets of m at Jaccard NUM / DEN: (DEN + NUM) * overlap >= NUM * (n + m)."""
    return -(-NUM * (n + m) // (DEN + NUM))


def linked(sets: list[np.ndarray], sizes: list[int] | None = None, part: list[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(x, those before x in the search that x links with at Jaccard NUM / DEN): every link once.

    sizes: of the whole sets, where `sets` leaves out shingles that no other set holds. part: with two parts, only pairs
    across are looked for. Sets come sorted; they are taken by size, so that each meets only smaller ones, and T for a
    set of n is ceil(NUM * n / DEN). Lists of more than a LONG-th of the sets are long ones.
    """
    sizes = np.array([len(s) for s in sets] if sizes is None else sizes, np.int64)
    order = np.lexsort((np.arange(len(sets)), sizes))
    order = order[[len(sets[i]) > 0 for i in order]] if len(order) else order
    if len(order) < 2:
        return
    size, side = sizes[order], None if part is None else np.array(part)[order]
    many = [len(sets[i]) for i in order]
    owner = np.repeat(np.arange(len(order)), many)
    _, run, length = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    much = length > max(16, len(order) // LONG)
    # the long lists as bits by set: probing them is a count of common bits
    column = np.cumsum(much) - 1
    bits = np.zeros((len(order), -(-max(1, int(much.sum())) // 64)), np.uint64)
    m, c = owner[much[run]], column[run[much[run]]]
    np.bitwise_or.at(bits, (m, c // 64), np.uint64(1) << (c % 64).astype(np.uint64))
    longest = np.bincount(m, minlength=len(order))
    # the short ones as runs of places; an entry's own place is preceded by those of the smaller sets that hold it
    short, of = run[~much[run]], owner[~much[run]]
    o = np.lexsort((of, short))
    held, short = of[o], short[o]
    begins = np.concatenate([[0], np.cumsum(np.bincount(short, minlength=len(length)))])
    at = np.empty(len(o), np.int64)
    at[o] = np.arange(len(o))
    before = at - begins[short[at]]
    cuts = np.searchsorted(of, np.arange(len(order) + 1))
    oldest = np.searchsorted(DEN * size, NUM * size)  # sets before are too small
    for x in range(1, len(order)):
        first, n = oldest[x], int(size[x])
        if first >= x:
            continue
        ends, reach = at[cuts[x] : cuts[x + 1]], before[cuts[x] : cuts[x + 1]]
        ends, reach = ends[reach > 0], reach[reach > 0]
        total = int(reach.sum())
        if not total and not longest[x]:
            continue
        place = np.repeat(ends - np.cumsum(reach), reach) + np.arange(total)
        have = np.bincount(held[place], minlength=x)[first:x]
        need = needed_overlap(n, size[first:x])
        ok = have + longest[x] >= need
        if side is not None:
            ok &= side[first:x] != side[x]
        y = np.nonzero(ok)[0]
        if longest[x] and len(y):
            y = y[have[y] + np.bitwise_count(bits[y + first] & bits[x]).sum(1, dtype=np.int64) >= need[y]]
        if len(y):
            yield int(order[x]), order[y + first]


def t_occurrence(sets: list[np.ndarray], sizes: list[int] | None = None, part: list[int] | None = None) -> list[tuple[int, int]]:
    """All links (i, j) at Jaccard NUM / DEN; arguments as for linked()."""
    return [(y, x) for x, ys in linked(sets, sizes, part) for y in ys.tolist()]


def count_links(sets: list[np.ndarray], sizes: list[int], copies: np.ndarray, part: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each set the smallest that links reach, and how many rows its links lead to (copies: rows of each set). Pairs aren't kept."""
    label, rows = np.arange(len(sets)), np.zeros(len(sets), np.int64)
    for x, ys in linked(sets, sizes, part):
        rows[x] += copies[ys].sum()
        rows[ys] += copies[x]
        met = np.unique(np.append(label[ys], label[x]))
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
    return label, rows


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that edges (a, b) reach."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, root[a], root[b])
        np.minimum.at(low, root[b], root[a])
        while not np.array_equal(up := low[low], low):
            low = up
        low = low[root]
        if np.array_equal(low, root):
            return root
        root = low


def _sets_of(batches: Iterator[pa.RecordBatch], words: int, id_at: int = 0, text_at: int = 1):
    shingler = Shingler(words)
    for b in batches:
        for at in range(0, len(b), SLICE):
            part = b.slice(at, SLICE)
            for i, t in zip(part.column(id_at).to_pylist(), part.column(text_at).cast(pa.binary()).to_pylist()):
                yield i, shingler.shingles(t)


def _pack(s: np.ndarray, d: np.ndarray, buckets: int):
    """Postings (shingle, place) dealt by shingle: (bucket, sorted shingles, their places within `used`, used)."""
    b = (s % np.uint64(buckets)).astype(np.int64)
    o = np.lexsort((s, b))
    s, d, b = s[o], d[o], b[o]
    cuts = np.searchsorted(b, np.arange(buckets + 1))
    for x in range(buckets):
        lo, hi = cuts[x], cuts[x + 1]
        if hi > lo:
            used, place = np.unique(d[lo:hi], return_inverse=True)
            yield x, s[lo:hi], place.astype(np.uint32), used


def _merged(cells: list[list[bytes]], most: int = 0):
    """The runs of a bucket, merged by shingle: shingles, places, and keys and sizes by place. In turn for ranges of shingles
    of about `most` postings (a shingle's are never parted), or all at once: what is worked on at a time is small beside the runs."""
    runs = [(np.frombuffer(c[0], np.uint64), np.frombuffer(c[1], np.uint32)) for c in cells]
    first = np.cumsum([0] + [len(c[2]) // 8 for c in cells])
    k = np.concatenate([np.frombuffer(c[2], np.int64) for c in cells])
    n = np.concatenate([np.frombuffer(c[3], np.uint32) for c in cells])
    ranges = -(-sum(len(s) for s, _ in runs) // most) if most else 1
    bounds = np.array([(x << 64) // ranges for x in range(1, ranges)], np.uint64)  # hashes are even
    cuts = [[0, *np.searchsorted(s, bounds).tolist(), len(s)] for s, _ in runs]
    for x in range(ranges):
        mine = [(s[c[x] : c[x + 1]], d[c[x] : c[x + 1]].astype(np.int64) + f) for (s, d), c, f in zip(runs, cuts, first)]
        s, d = (np.concatenate(y) for y in zip(*mine))
        if len(s):
            o = np.argsort(s, kind="stable")
            yield s[o], d[o], k, n


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[bytes]]]:
    runs: dict[int, list[list[bytes]]] = {}
    for b in batches:
        for bucket, *cells in zip(*(c.to_pylist() for c in b.columns)):
            runs.setdefault(bucket, []).append(cells)
    for bucket in sorted(runs):
        yield runs.pop(bucket)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(schema), schema.types)], schema=schema)


_KEYED = pa.schema([("bucket", pa.int32()), ("s", pa.binary()), ("d", pa.binary()), ("k", pa.binary()), ("n", pa.binary())])
_KEYED_DDL = "bucket int, s binary, d binary, k binary, n binary"
_SETS = pa.schema([("k", pa.int64()), ("n", pa.int64()), ("s", pa.binary()), ("c", pa.binary())])
_SETS_DDL = "k long, n long, s binary, c binary"
#: Many sets' shingles in one row: keys, sizes, how many shingles each has here, the shingles and their counts.
_PACKED = pa.schema([("dest", pa.int32()), ("k", pa.binary()), ("n", pa.binary()), ("m", pa.binary()), ("s", pa.binary()), ("c", pa.binary())])
_PACKED_DDL = "dest int, k binary, n binary, m binary, s binary, c binary"
#: Postings that a task works on at a time.
_CHUNK = 400_000
#: Rows of an Arrow batch: a row of postings is long.
BATCH_ROWS = 128


_TOLD = pa.schema([("dest", pa.int32()), ("k", pa.binary())])


def _told(docs: DataFrame, words: int, buckets: int) -> DataFrame:
    """(dest, k): packed keys of the sets that share one of their first shingles by hash with another set, dealt by key; a
    row for each bucket of shingles and each of keys. A key is told by each bucket that has a shared shingle of it, but by
    the chunk alone that has its partner, too."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[int, int] = {}
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            s = np.concatenate(held)
            d = np.repeat(np.arange(len(held)), [len(h) for h in held])
            k = np.array(list(keys), np.int64)
            o = np.argsort(s, kind="stable")
            s, d = s[o], d[o]
            same = np.zeros(len(s), bool)
            same[1:] = s[1:] == s[:-1]
            known = np.zeros(len(k), bool)  # shared within this chunk already
            known[d[same]] = True
            known[d[np.nonzero(same)[0] - 1]] = True
            s, d = s[~same], d[~same]  # one posting of each shingle tells the other chunks
            for x, run, place, used in _pack(s, d, buckets):
                yield _rows([(x, run.tobytes(), place.tobytes(), k[used].tobytes(), known[used].tobytes())], _KEYED)
            at = k[known]
            for x in range(buckets):
                if len(mine := at[at % buckets == x]):
                    yield _rows([(x, b"", b"", mine.tobytes(), None)], _KEYED)
            keys.clear(), held.clear()

        size = 0
        for _, s in _sets_of(batches, words):
            if len(s) and (k := set_key(s)) not in keys:
                keys[k] = len(s)
                held.append(s[: prefix_length(len(s))])
                size += len(held[-1])
                if size > _CHUNK:
                    yield from flush()
                    size = 0
        yield from flush()
        give_back()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells in _by_bucket(batches):
            told = [np.frombuffer(c[2], np.int64) for c in cells if c[3] is None]
            cells = [[*c[:3], np.frombuffer(c[3], bool).astype(np.uint32).tobytes()] for c in cells if c[3] is not None]
            for s, d, k, known in _merged(cells, _CHUNK) if cells else ():
                head = np.ones(len(s), bool)
                head[1:] = s[1:] != s[:-1]
                starts, run = np.nonzero(head)[0], np.cumsum(head) - 1
                of = k[d]
                several = np.minimum.reduceat(of, starts) != np.maximum.reduceat(of, starts)
                told.append(np.unique(of[several[run] & (known[d] == 0)]))
            keys = np.unique(np.concatenate(told))
            dest = keys % buckets
            o = np.argsort(dest, kind="stable")
            keys, cuts = keys[o], np.searchsorted(dest[o], np.arange(buckets + 1))
            rows = [(x, keys[lo:hi].tobytes()) for x, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]
            if rows:
                yield _rows(rows, _TOLD)
        give_back()

    return docs.mapInArrow(heads, _KEYED_DDL).repartitionById(buckets, "bucket").mapInArrow(shared, "dest int, k binary")


def _suspects(docs: DataFrame, words: int, buckets: int) -> DataFrame:
    """k of the sets that share one of their first shingles by hash with another set."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.zeros(0, np.int64)
        for b in batches:
            keys = np.unique(np.concatenate([keys, *(np.frombuffer(x, np.int64) for x in b.column(1).to_pylist())]))
        for at in range(0, len(keys), _CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + _CHUNK])], names=["k"])

    return _told(docs, words, buckets).repartitionById(buckets, "dest").mapInArrow(unpacked, "k long")


def _shared_sets(docs: DataFrame, wanted: DataFrame, words: int, buckets: int, hot: int) -> DataFrame:
    """(k, n, s, c): of the wanted sets those with T shared shingles; s the shared shingles, sorted, c their counts up to hot."""
    narrow = F.broadcast if wanted.count() <= BROADCAST_IDS else (lambda df: df)
    chosen = docs.join(narrow(wanted.select("rep", F.col("k").alias("want"))), docs["doc_id"].eqNullSafe(F.col("rep"))).select("doc_id", "text", "want")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        keys: list[int] = []
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            s = np.concatenate(held)
            d = np.repeat(np.arange(len(held)), [len(h) for h in held])
            k, n = np.array(keys, np.int64), np.array([len(h) for h in held], np.uint32)
            values, at, count = np.unique(s, return_inverse=True, return_counts=True)
            much = count[at] >= hot
            # postings of what is hot here go straight to their sets; only the count is sent to the others
            ms, md = s[much], d[much]
            cuts = np.searchsorted(md, np.arange(len(held) + 1)).tolist()
            rows = [
                (int(k[i] % buckets), ms[lo:hi].tobytes(), np.full(hi - lo, hot, np.uint8).tobytes(), int(k[i]).to_bytes(8, "little", signed=True), int(n[i]).to_bytes(8, "little"))
                for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo
            ]
            for x in range(0, len(rows), 5000):
                yield _rows(rows[x : x + 5000], _KEYED)
            hs, hc = values[count >= hot], count[count >= hot]
            hb = (hs % np.uint64(buckets)).astype(np.int64)
            for x in np.unique(hb).tolist():
                yield _rows([(x, hs[hb == x].tobytes(), hc[hb == x].astype(np.uint32).tobytes(), b"", b"")], _KEYED)
            for x, run, place, used in _pack(s[~much], d[~much], buckets):
                yield _rows([(x, run.tobytes(), place.tobytes(), k[used].tobytes(), n[used].tobytes())], _KEYED)
            keys.clear(), held.clear()

        size = 0
        for b in (whole.slice(at, SLICE) for whole in batches for at in range(0, len(whole), SLICE)):
            for t, want in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                s = shingler.shingles(t)
                if len(s) and set_key(s) == want:
                    keys.append(want)
                    held.append(s)
                    size += len(s)
                    if size > _CHUNK:
                        yield from flush()
                        size = 0
        yield from flush()
        give_back()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells in _by_bucket(batches):
            # what went straight to its set is dealt by key like the rest
            rows = []
            direct: dict[int, list[tuple]] = {}
            for ds, dc, dk, dn in cells:
                if len(dk) == 8 and len(dn) == 8:
                    key = int.from_bytes(dk, "little", signed=True)
                    direct.setdefault(key % buckets, []).append((dk, dn[:4], len(dc).to_bytes(4, "little"), ds, dc))
            for dest, parts in direct.items():
                parts.sort(key=lambda x: int.from_bytes(x[0], "little", signed=True))
                rows.append((dest, *(b"".join(x) for x in zip(*parts))))
            much = [c for c in cells if not c[2]]
            plain = [c for c in cells if c[2] and not (len(c[2]) == 8 and len(c[3]) == 8)]
            if not plain:
                if rows:
                    yield _rows(rows, _PACKED)
                continue
            for s, d, k, n in _merged(plain, _CHUNK):
                o = np.lexsort((k[d], s))
                s, d = s[o], d[o]
                new = np.ones(len(s), bool)
                new[1:] = (s[1:] != s[:-1]) | (k[d[1:]] != k[d[:-1]])
                s, d = s[new], d[new]  # rows that repeat an id are one set
                values, at, count = np.unique(s, return_inverse=True, return_counts=True)
                if much and len(values):
                    hs, hc = np.concatenate([np.frombuffer(c[0], np.uint64) for c in much]), np.concatenate([np.frombuffer(c[1], np.uint32) for c in much])
                    place = np.minimum(np.searchsorted(values, hs), len(values) - 1)
                    hit = values[place] == hs
                    np.add.at(count, place[hit], hc[hit])
                keep = count[at] >= 2
                s, d, c = s[keep], d[keep], np.minimum(count[at[keep]], hot).astype(np.uint8)
                of = k[d]
                o = np.lexsort((of, of % buckets))
                s, d, c, of = s[o], d[o], c[o], of[o]
                head = np.ones(len(of), bool)
                head[1:] = of[1:] != of[:-1]
                starts = np.nonzero(head)[0]
                lengths = np.diff(np.append(starts, len(of)))
                dest = of[starts] % buckets
                for x in np.unique(dest).tolist():
                    lo, hi = np.searchsorted(dest, [x, x + 1])
                    first, last = starts[lo], starts[hi - 1] + lengths[hi - 1]
                    mine = starts[lo:hi]
                    rows.append((x, of[mine].tobytes(), n[d[mine]].astype(np.uint32).tobytes(), lengths[lo:hi].astype(np.uint32).tobytes(), s[first:last].tobytes(), c[first:last].tobytes()))
            if rows:
                yield _rows(rows, _PACKED)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: list[tuple] = []
        for b in batches:
            for k, n, m, s, c in zip(*(x.to_pylist() for x in b.columns[1:])):
                cells.append((np.frombuffer(k, np.int64), np.frombuffer(n, np.uint32), np.frombuffer(m, np.uint32), np.frombuffer(s, np.uint64), np.frombuffer(c, np.uint8)))
        # some of the sets at a time, whole ones, by their keys; each row's keys are sorted
        turns = -(-sum(len(x[3]) for x in cells) // _CHUNK)
        bounds = [(x << 64) // turns - (1 << 63) for x in range(turns)] + [1 << 63]
        for low, high in zip(bounds, bounds[1:]):
            parts = []
            for k, n, m, s, c in cells:
                lo = int(np.searchsorted(k, low))
                hi = len(k) if high == 1 << 63 else int(np.searchsorted(k, high))
                if hi > lo:
                    begin, many = int(m[:lo].sum()), m[lo:hi]
                    end = begin + int(many.sum())
                    parts.append((np.repeat(k[lo:hi], many), np.repeat(n[lo:hi], many), s[begin:end], c[begin:end]))
            if not parts:
                continue
            k, n, s, c = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            o = np.lexsort((s, k))
            k, n, s, c = k[o], n[o], s[o], c[o]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
            k, n, s, c = k[new], n[new], s[new], c[new]
            starts = np.nonzero(np.append(True, k[1:] != k[:-1]))[0]
            rows = []
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(k)]):
                if hi - lo >= -(-NUM * int(n[lo]) // DEN):
                    rows.append((int(k[lo]), int(n[lo]), s[lo:hi].tobytes(), c[lo:hi].tobytes()))
            if rows:
                yield _rows(rows, _SETS)
        give_back()

    return chosen.mapInArrow(whole, _KEYED_DDL).repartitionById(buckets, "bucket").mapInArrow(counted, _PACKED_DDL).repartitionById(buckets, "dest").mapInArrow(gathered, _SETS_DDL)


def _blocks(sets: DataFrame, buckets: int) -> DataFrame:
    """(node, component): blocks of sets that a chain of short lists connects."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int] = []
        sizes: list[int] = []
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                k, n = np.array(keys, np.int64), np.array(sizes, np.uint32)
                for x, run, place, used in _pack(np.concatenate(held), np.repeat(np.arange(len(held)), [len(h) for h in held]), buckets):
                    yield _rows([(x, run.tobytes(), place.tobytes(), k[used].tobytes(), n[used].tobytes())], _KEYED)
                keys.clear(), sizes.clear(), held.clear()

        size = 0
        for b in batches:
            for k, n, s, c in zip(*(x.to_pylist() for x in b.columns)):
                s, c = np.frombuffer(s, np.uint64), np.frombuffer(c, np.uint8)
                keys.append(k)
                sizes.append(n)
                # shingles that no other set holds come first and are left out
                held.append(s[np.lexsort((s, c))][: prefix_length(n) - (n - len(s))])
                size += len(held[-1])
                if size > _CHUNK:
                    yield from flush()
                    size = 0
        yield from flush()

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chain the members of each list by size; tie each chain's members to its smallest."""
        for cells in _by_bucket(batches):
            s, d, k, n = next(_merged(cells))
            n = n.astype(np.int64)
            o = np.lexsort((k[d], n[d], s))
            s, d = s[o], d[o]
            a, b = d[:-1], d[1:]
            ok = (s[1:] == s[:-1]) & (k[a] != k[b]) & (DEN * n[a] >= NUM * n[b])
            keys, place = np.unique(np.concatenate([k[a][ok], k[b][ok]]), return_inverse=True)
            root = roots(len(keys), place[: ok.sum()], place[ok.sum() :])
            away = root != np.arange(len(keys))
            if away.any():
                yield pa.RecordBatch.from_arrays([pa.array(keys[away]), pa.array(keys[root[away]])], names=["a", "b"])

    edges = sets.mapInArrow(heads, _KEYED_DDL).repartitionById(buckets, "bucket").mapInArrow(chains, "a long, b long")
    return connected_components(edges, "ngram-blocks")


def _links(sets: DataFrame, blocks: DataFrame, copies: DataFrame, block_sets: int) -> DataFrame:
    """(a, b, links), block by block: edges (a, b) that connect all that is connected, and how many rows links lead to from set a (b null)."""
    sizes = blocks.groupBy("component").agg(F.ceil(F.count("*") / block_sets).cast("int").alias("parts"))
    members = sets.join(blocks.join(sizes, "component"), F.col("k") == F.col("node")).select("k", "n", "s", F.col("component").alias("block"), "parts")
    members = members.join(copies.select(F.col("k").alias("of"), "copies"), F.col("k") == F.col("of")).drop("of")
    part = F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")
    pairs = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(part, o).alias("i"), F.greatest(part, o).alias("j")))
    )
    dealt = members.withColumn("p", part).withColumn("pair", F.explode(pairs)).select("block", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "p", "k", "n", "s", "copies")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict[int, tuple]] = {}
        for b in batches:
            for block, i, j, p, k, n, s, w in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault((block, i, j), {})[k] = (p, n, s, w)
        a, c, links = [], [], []
        for key in sorted(held):
            group = held.pop(key)
            keys = sorted(group)
            parts, sizes, shared, copies = zip(*(group[k] for k in keys))
            label, rows = count_links([np.frombuffer(s, np.uint64) for s in shared], list(sizes), np.array(copies, np.int64), list(parts) if key[1] != key[2] else None)
            for x, (y, r) in enumerate(zip(label.tolist(), rows.tolist())):
                if x != y:  # to the smallest, so that few rounds join the blocks
                    a.append(keys[x])
                    c.append(keys[y])
                    links.append(None)
                if r:
                    a.append(keys[x])
                    c.append(None)
                    links.append(r)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, c, links)], names=["a", "b", "links"])

    return dealt.repartition("block", "i", "j").mapInArrow(verify, "a long, b long, links long")


def _grouped(docs: DataFrame, words: int, hot: int, block_sets: int) -> tuple[DataFrame, DataFrame]:
    """From (doc_id, text): a row per row (doc_id, k of its set, n shingles, hash of its text), and a row per set (key, group, component_id, n_links)."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    meta_schema = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("n", pa.int64()), ("text_hash", pa.int64())])

    def meta(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in (whole.slice(at, SLICE) for whole in batches for at in range(0, len(whole), SLICE)):
            sets = [shingler.shingles(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(set_key, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), b.column(2)], schema=meta_schema)

    rows = materialize(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(meta, "doc_id long, k long, n long, text_hash long"), "ngram-keys", batch_rows=BATCH_ROWS)
    suspects = _suspects(docs, words, buckets)
    reps = rows.groupBy("k").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    wanted = materialize(reps.join(suspects, "k"), "ngram-wanted", batch_rows=BATCH_ROWS)
    sets = materialize(_shared_sets(docs, wanted, words, buckets, hot), "ngram-shared", batch_rows=BATCH_ROWS)
    found = materialize(_links(sets, _blocks(sets, buckets), wanted, block_sets), "ngram-found", batch_rows=BATCH_ROWS)
    groups = connected_components(found.where("b is not null").select("a", "b"), "ngram-links")
    linked_rows = found.where("b is null").groupBy(F.col("a").alias("linked")).agg(F.sum("links").alias("links"))
    # smallest id of each component: by set first, so a group of copies is one row here
    labelled = reps.join(groups, F.col("k") == F.col("node"), "left").select("k", "rep", "copies", F.coalesce("component", "k").alias("g"))
    lowest = labelled.groupBy("g").agg(F.min("rep").alias("component_id"))
    counted = labelled.join(lowest, "g").join(linked_rows, F.col("k") == F.col("linked"), "left")
    by_key = materialize(counted.select(F.col("k").alias("key"), F.col("g").alias("group"), "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "ngram-lowest")
    drop(sets, found)
    return rows, by_key


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, hot: int = HOT, block_sets: int = BLOCK_SETS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), n_links (how many other rows are at Jaccard NUM / DEN, equal sets included).

    A-Z is lower-cased; words are [^\\x20\\x09-\\x0D]+. A set holds the distinct shingles of that many words; with fewer
    words, the whole sequence is one; null, empty and blank texts have empty sets, link with nothing and keep their own
    id. Rows whose doc_id is null get the smallest id of their component like others, null if it has none. Rows that
    share a doc_id are told apart by their sets and linked through them. Texts are read whole; other columns aren't read;
    an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, by_key = _grouped(docs, words, hot, block_sets)
    return (
        rows.join(by_key, F.col("k") == F.col("key"))
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(F.col("n") == 0, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"))
    )


def keep_first(docs: DataFrame, words: int = WORDS, hot: int = HOT, block_sets: int = BLOCK_SETS) -> DataFrame:
    """One row of docs for each group: the one with the smallest doc_id (null ids last; of rows that share an id, the one with the smallest hash of its text).

    Rows without words are groups of their own, as often as they are repeated; of other rows that are repeated whole one stays.
    """
    columns = docs.columns
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, by_key = _grouped(own, words, hot, block_sets)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("x")
    worded = rows.where("n > 0").join(by_key, F.col("k") == F.col("key")).groupBy("group").agg(first).select(F.col("x.doc_id").alias("stay_id"), F.col("x.text_hash").alias("stay_hash"))
    blank = rows.where("n = 0").select(F.col("doc_id").alias("stay_id"), F.col("text_hash").alias("stay_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("stay_id")) & (F.col("text_hash") == F.col("stay_hash"))
    repeats = worded.join(rows.groupBy("doc_id", "text_hash").count().where("count > 1"), same, "left_semi").withColumn("often", F.lit(True))
    stay = worded.unionByName(blank).distinct().join(repeats.select(F.col("stay_id").alias("r_id"), F.col("stay_hash").alias("r_hash"), "often"), F.col("stay_id").eqNullSafe(F.col("r_id")) & (F.col("stay_hash") == F.col("r_hash")), "left")
    stay = materialize(stay.select("stay_id", "stay_hash", F.coalesce("often", F.lit(False)).alias("often")), "ngram-stay")
    hashed = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"].cast("string")).alias("text_hash"))
    kept = hashed.join(stay, same)
    if stay.where("often").isEmpty():
        return kept.select("row.*")
    once = kept.where("often").groupBy("stay_id", "stay_hash").agg(F.first("row").alias("row"))
    return kept.where("not often").select("row.*").unionByName(once.select("row.*"))
