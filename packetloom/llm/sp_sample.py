"""SentencePiece encoding and decoding: segmentations sampled without replacement by Gumbel top-k.

The pieces of a model span a lattice over a text; a path has the weight exp(sum of ALPHA * score). Pieces never hold a
space mark after another letter, so a text's lattice is a chain of small lattices, one for each stretch of spaces and
the letters after them. A best-first (A*) search over nodes "this path up to stretch i, there none of these choices,
free afterwards" pops them by perturbed weight: a node's Gumbel is truncated at its parent's, its log mass comes from the
chain's exact sums, and the node that is popped yields the next sampled path. So the k paths are distinct and follow
sampling without replacement. The (k+1)-th perturbed weight is the threshold that gives each path its inclusion score.

A stretch's choice is its best path or else drawn from the end backwards: forward sums tell, for each place, what all
paths to it weigh and what those other than the best one weigh, so a draw among "all but the best" or "all but these"
is a walk of as many steps as pieces, at any length, without subtracting weights. Texts are worked on together: numpy
does the sums of all new stretches of one length and a step of all draws at a time. Long stretches and those with
letters that no piece writes are worked on one by one (Lattice).
"""

from __future__ import annotations

import functools
import gc
import hashlib
import math
import re
from array import array
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, trim

ALPHA = 0.004
SAMPLES = 2
#: Stretches that a worker remembers.
MEMO = 400_000
#: Longest stretch that is worked on with others, and the cells of their tables; longer ones are worked on one by one.
TABLE_LETTERS, CELLS = 40, 1 << 19
#: Letters of texts that are worked on together.
BATCH_LETTERS = 1 << 21
#: After so many of these, freed memory is returned to the system.
TRIM_EVERY = 4
#: Stretches of up to so many letters are summed in logs if a share of theirs is below TINY.
LOG_LETTERS = 256
#: Weights below this may underflow on the way: such stretches are worked on one by one.
TINY = 1e-250
SCALE = 1e100
PRIME = 0x9E3779B97F4A7C15
#: Slots of the table of beginnings of pieces: several times as many as a vocabulary has.
SLOTS, SLOT_SHIFT = 1 << 18, 46
STRETCH = re.compile(" +[^ ]*")
NEVER = -math.inf


def default_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Pieces of a model: ids and log weights of the written ones, ids of the bytes."""

    def __init__(self, model: bytes, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids: dict[str, int] = {}
        self.weight: dict[str, float] = {}
        self.text: list[str | None] = []
        self.bytes: dict[int, int] = {}
        self.byte_of: dict[int, int] = {}
        n = sp.get_piece_size()
        plain = [sp.get_score(i) for i in range(n) if sp.get_score(i) > -1e8]
        floor = min(plain, default=0.0) - 10  # runs of space marks have no score of their own; unknown letters pay the same
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.byte_of[i] = int(piece[3:5], 16)
            if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.text.append(None)
                continue
            text = piece.replace("▁", " ")
            self.text.append(text)
            self.ids[text] = i
            self.weight[text] = alpha * max(sp.get_score(i), floor)
        self.unknown = alpha * floor
        self.unknown_share = math.exp(self.unknown)
        self.longest = max(map(len, self.ids), default=1)
        self.unknown_id = sp.unk_id()
        # for many stretches at once: every beginning of a piece by a hash of its letters, sorted; share 0 if it's no piece itself
        table: dict[int, tuple[int, float, int]] = {}
        for text in self.ids:
            h = 0
            for size, letter in enumerate(text, 1):
                h = (h * PRIME + ord(letter) + 1) & 0xFFFFFFFFFFFFFFFF
                part = text[:size]
                table[h] = size, math.exp(self.weight[part]) if part in self.ids else 0.0, self.ids.get(part, -1)
        if 2 * len(table) > SLOTS:
            raise ValueError("more beginnings of pieces than SLOTS are meant for")
        # open addressing: the leading bits of a multiple of the hash tell the slot, the next free one holds it
        self.slots = np.zeros(SLOTS, np.uint64)
        self.lengths, self.shares, self.numbers = np.zeros(SLOTS, np.int8), np.zeros(SLOTS), np.zeros(SLOTS, np.int32)
        for h, (size, share, number) in table.items():
            at = (h * PRIME & 0xFFFFFFFFFFFFFFFF) >> SLOT_SHIFT
            while self.slots[at]:
                at = (at + 1) % SLOTS
            self.slots[at], self.lengths[at], self.shares[at], self.numbers[at] = h, size, share, number
        #: slots of the first letters' hashes
        self.first = self.find(np.arange(1 << 10).astype(np.uint64))
        # pieces from their last letter: [children by letter, log weight or None, its exponential]
        self.back: list = [{}, None, 0.0]
        for text, w in self.weight.items():
            node = self.back
            for letter in reversed(text):
                node = node[0].setdefault(letter, [{}, None, 0.0])
            node[1:] = w, math.exp(w)
        written = [bytes([self.byte_of[i]]) if i in self.byte_of else (self.text[i] or "").encode("utf-8", "surrogatepass") for i in range(n)]
        self.byte_sizes = np.array([len(x) for x in written])
        self.byte_starts = np.cumsum(self.byte_sizes) - self.byte_sizes
        self.byte_text = np.frombuffer(b"".join(written), np.uint8)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The slots of hashes; an empty one for those that aren't there."""
        at = ((h * np.uint64(PRIME)) >> np.uint64(SLOT_SHIFT)).view(np.int64)
        held = self.slots[at]
        other = np.nonzero(held != h)[0]
        other = other[held[other] != 0]
        while len(other):
            at[other] = (at[other] + 1) % SLOTS
            held = self.slots[at[other]]
            other = other[(held != h[other]) & (held != 0)]
        return at

    def fallback(self, letter: str) -> tuple[int, ...]:
        """The ids of a letter that no piece writes: its bytes, or the unknown piece in a model without bytes."""
        return tuple(self.bytes[b] for b in letter.encode()) if self.bytes else (self.unknown_id,)

    def decode_array(self, ids: np.ndarray) -> bytes:
        """decode() of an array, in UTF-8: the bytes of all pieces, one after the other."""
        if not len(ids):
            return b""
        sizes = self.byte_sizes[ids]
        out = self.byte_text[np.repeat(self.byte_starts[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())].tobytes()[1:]
        try:
            out.decode()
            return out
        except UnicodeDecodeError:
            return out.decode("utf-8", "replace").encode()

    def decode(self, ids) -> str:
        """The text of ids, without the space that encoding puts before it. Bytes are joined; broken ones become U+FFFD."""
        try:
            return "".join(map(self.text.__getitem__, ids))[1:]
        except TypeError:  # bytes among them
            pass
        parts: list[str] = []
        held = bytearray()
        for i in ids:
            text = self.text[i]
            if text is None:
                if i in self.byte_of:
                    held.append(self.byte_of[i])
                continue
            if held:
                parts.append(held.decode("utf-8", "replace"))
                held.clear()
            parts.append(text)
        if held:
            parts.append(held.decode("utf-8", "replace"))
        return "".join(parts)[1:]


class Together:
    """Forward sums of stretches of one length; a column per stretch in every array.

    `best` and `others`: by place, the weight of the best path to it and of all other paths; `last`: where the best one's
    last piece starts. `fine` is false for stretches whose weights are TINY or less: Lattice does those.
    """

    def __init__(self, vocabulary: Vocabulary, stretches: list[str]):
        self.vocabulary = vocabulary
        n, length = len(stretches), len(stretches[0])
        letters = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length).T
        codes = letters.astype(np.uint64) + np.uint64(1)
        self.others, self.best, self.last = np.zeros((length + 1, n)), np.zeros((length + 1, n)), np.zeros((length + 1, n), np.int64)
        self.length, self.reach = length, min(length, vocabulary.longest)
        #: id and weight of the piece from a place on, by its size; a letter that no piece writes has minus its code and 2
        self.piece, self.share = np.zeros((length, self.reach + 1, n), np.int32), np.zeros((length, self.reach + 1, n))
        others, best, last = self.others, self.best, self.last
        best[0] = 1.0
        prime, plain = np.uint64(PRIME), bool(codes.max() < len(vocabulary.first))
        for start in range(length):
            alive, h = np.arange(n), codes[start]
            for size in range(1, min(self.reach, length - start) + 1):
                if size == 1:
                    at = vocabulary.first[h.astype(np.int64)] if plain else vocabulary.find(h)
                else:
                    h = h * prime
                    h += codes[start + size - 1][alive]
                    at = vocabulary.find(h)
                hit = vocabulary.lengths[at] == size
                if size == 1:
                    w = np.where(hit, vocabulary.shares[at], 0.0)
                    none = w == 0
                    w[none] = vocabulary.unknown_share
                    self.extend(start, size, slice(None), w, np.where(none, -2 - letters[start].astype(np.int64), vocabulary.numbers[at]))
                hit = np.nonzero(hit)[0]
                if not len(hit):
                    break
                if len(hit) < len(alive):
                    alive, h, at = alive[hit], h[hit], at[hit]
                if size > 1:
                    w = vocabulary.shares[at]
                    pieces = np.nonzero(w)[0]  # the others only begin longer ones
                    if len(pieces):
                        self.extend(start, size, alive[pieces], w[pieces], vocabulary.numbers[at[pieces]])
        self.fine = (best[length] > TINY) & ((others[length] > TINY) | (length == 1))

    def extend(self, start: int, size: int, rows: np.ndarray | slice, w: np.ndarray, number: np.ndarray) -> None:
        end, others, best = start + size, self.others, self.best
        b, o, was = best[start][rows] * w, others[start][rows] * w, best[end][rows]
        more = b > was
        o += np.minimum(b, was)
        others[end][rows] += o
        best[end][rows] = np.maximum(b, was)
        if isinstance(rows, slice):
            self.last[end][more] = start
        else:
            self.last[end][rows[more]] = start
        self.piece[start, size][rows], self.share[start, size][rows] = number, w

    def joined(self, path: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """From pieces by row, last ones first (-1: none): ids, row after row, and how many each row has."""
        ids = np.array(path[::-1]).T
        size = (ids != -1).sum(1)
        ids = ids[ids != -1]
        if (odd := np.nonzero(ids < 0)[0]).size:
            spelled = [self.vocabulary.fallback(chr(-2 - x)) for x in ids[odd].tolist()]
            many = np.ones(len(ids), np.int64)
            many[odd] = [len(x) for x in spelled]
            row = np.repeat(np.arange(len(size)), size)
            size = np.bincount(row, many, len(size)).astype(np.int64)
            ids = np.repeat(ids, many)
            ids[ids < 0] = list(chain.from_iterable(spelled))
        return ids, size

    def best_paths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the best paths, one after the other; how many each has; their log probabilities, and those of all others."""
        best, others = self.best[-1], self.others[-1]
        whole = best + others
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = np.where(others < 0.5 * whole, np.log1p(-others / whole), np.log(best / whole))
            rest = np.log(others / whole)
        rows, end, path = np.arange(len(best)), np.full(len(best), self.length), []
        while end.any():
            start = np.maximum(self.last[end, rows], end - self.reach)  # where all weights have vanished, no place is known
            path.append(np.where(end > 0, self.piece[start, end - start, rows], -1))
            end = np.where(end > 0, start, 0)
        return *self.joined(path), logs, rest

    def draw(self, rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each of rows a path other than the best, by its probability among those: ids, how many each has, log probabilities.

        From the end backwards: while what follows agrees with the best path, its last piece leads to "others" of its
        start, any other piece to all paths of its start. keys: 64 random bits for each draw.
        """
        n, places = len(rows), np.arange(len(rows))
        end, bound, weight = np.full(n, self.length), np.ones(n, bool), np.zeros(n)
        path, step = [], 0
        sizes = np.arange(1, self.reach + 1)[:, None]
        while len(places):
            r, e = rows[places], end[places]
            start = e - sizes
            inside = start >= 0
            start = np.maximum(start, 0)
            w = self.share[start, sizes, r] * inside
            last = self.last[e, r]
            kept = bound[places] & (start == last)
            mass = w * (self.others[start, r] + np.where(kept, 0.0, self.best[start, r]))
            upto = np.cumsum(mass, 0)
            at = (upto > uniform(keys[places], step) * upto[-1]).argmax(0)
            here = np.arange(len(places))
            start = start[at, here]
            weight[places] += np.log(w[at, here])
            ids = np.full(n, -1, np.int32)
            ids[places] = self.piece[start, at + 1, r]
            path.append(ids)
            bound[places] &= start == last
            end[places] = start
            places = places[start > 0]
            step += 1
        return *self.joined(path), np.minimum(0.0, weight - np.log(self.best[-1, rows] + self.others[-1, rows]))


def uniform(keys: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) from 64 random bits and a step."""
    x = keys + np.uint64((step + 1) * PRIME & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def log_sum(values: Iterable[float]) -> float:
    values = list(values)
    high = max(values, default=NEVER)
    return high if high == NEVER else high + math.log(sum([math.exp(v - high) for v in values]))


class Lattice:
    """One stretch of any length and letters: its sums, its best path, draws of others. A path is a tuple of ids."""

    __slots__ = ("vocabulary", "text", "total", "others", "last", "best", "best_log", "others_log")

    def __init__(self, vocabulary: Vocabulary, text: str):
        self.vocabulary, self.text = vocabulary, text
        n = len(text)
        #: by place, in logs: all paths to it, and all but the best; where the best one's last piece starts
        self.total, self.others, self.last = array("d", bytes(8 * (n + 1))), array("d", bytes(8 * (n + 1))), array("i", bytes(4 * (n + 1)))
        best = self.scaled_sums(n)
        if best is None:
            best = self.log_sums(n)
        path, end = [], n
        while end:
            path.append(self.piece(self.last[end], end))
            end = self.last[end]
        self.best = tuple(chain.from_iterable(reversed(path)))
        self.best_log, self.others_log = min(0.0, best - self.total[n]), self.others[n] - self.total[n]

    def log_sums(self, n: int) -> float:
        best = [0.0] + [NEVER] * n
        self.others[0] = NEVER
        for end in range(1, n + 1):
            each = [(best[start] + w, -start, self.others[start] + w) for start, w in self.starts(end)]
            best[end], at, _ = max(each)
            self.last[end] = -at
            self.others[end] = log_sum(chain((e[2] for e in each), (e[0] for e in each if e[1] != at)))
            self.total[end] = log_sum((best[end], self.others[end]))
        return best[n]

    def scaled_sums(self, n: int) -> float | None:
        """The same in numbers that share a scale, which follows the sum at the current place: one multiplication a piece.

        None if a share below TINY might be lost and the stretch is short enough for logs.
        """
        text, top, unknown, unknown_log, longest = self.text, self.vocabulary.back, self.vocabulary.unknown_share, self.vocabulary.unknown, self.vocabulary.longest
        others, best, logs = array("d", bytes(8 * (n + 1))), array("d", bytes(8 * (n + 1))), array("d", [0.0]) + array("d", bytes(8 * n))
        best[0], shift = 1.0, 0.0
        self.others[0] = NEVER
        for end in range(1, n + 1):
            o = b = 0.0
            log, at, start, node = NEVER, 0, end, top
            while True:
                node = node[0].get(text[start - 1]) if start and node else None
                if node is None and start < end:
                    break
                start -= 1
                w, share = (node[1], node[2]) if node is not None and node[1] is not None else (unknown_log, unknown) if start == end - 1 else (None, 0.0)
                if w is None:
                    continue
                if (after := logs[start] + w) >= log:  # of equal ones, that of the earliest start
                    o += others[start] * share + b
                    b, log, at = best[start] * share, after, start
                else:
                    o += (others[start] + best[start]) * share
            if 0 < o < TINY and n <= LOG_LETTERS:
                return None
            if not 1 / SCALE < o + b < SCALE:
                factor = 1 / (o + b)
                shift -= math.log(factor)
                o, b = o * factor, b * factor
                for i in range(max(0, end - longest), end):
                    others[i] *= factor
                    best[i] *= factor
            others[end], best[end], logs[end], self.last[end] = o, b, log, at
            self.total[end], self.others[end] = math.log(o + b) + shift, math.log(o) + shift if o else NEVER
        return logs[n]

    def piece(self, start: int, end: int) -> tuple[int, ...]:
        text = self.text[start:end]
        i = self.vocabulary.ids.get(text)
        return (i,) if i is not None else self.vocabulary.fallback(text)

    def starts(self, end: int) -> list[tuple[int, float]]:
        """Where a piece that ends at end may start, and its log weight."""
        text, node, start, found = self.text, self.vocabulary.back, end, []
        while start:
            node = node[0].get(text[start - 1])
            if node is None:
                break
            start -= 1
            if node[1] is not None:
                found.append((start, node[1]))
        if not found or found[0][0] != end - 1:
            found.insert(0, (end - 1, self.vocabulary.unknown))
        return found

    def paths(self) -> Iterator[tuple[tuple[int, ...], float]]:
        """All paths with their log probabilities, best first: A* from the end, with the exact sum of what may lie before as bound."""
        heap, total = [(0.0, 0, len(self.text), ())], self.total
        while heap:
            key, at, end, tail = heappop(heap)
            if end == 0:
                yield tail, min(0.0, -key)
                continue
            done = -key - total[end] + total[len(self.text)]
            for start, w in self.starts(end):
                heappush(heap, (-(done + w + total[start] - total[len(self.text)]), (at << 5 | end - start) & 0xFFFFFFFFFFFF, start, self.piece(start, end) + tail))

    def walk(self, rng: np.random.Generator, choices) -> tuple[tuple[int, ...], float]:
        """A path from the end backwards; choices(node, end) gives (start, log weight, next node, log mass beyond) of each piece."""
        node, end, log, pieces = 0, len(self.text), 0.0, []
        while end:
            each = choices(node, end)
            high = max(e[3] for e in each)
            shares = [math.exp(e[3] - high) for e in each]
            left = rng.random() * sum(shares)
            for e, share in zip(each, shares):
                if share:
                    start, w, following, _ = e
                    left -= share
                    if left < 0:
                        break
            pieces.append(self.piece(start, end))
            log += w
            node, end = following, start
        return tuple(chain.from_iterable(reversed(pieces))), min(0.0, log - self.total[-1])

    def draw_other(self, rng: np.random.Generator) -> tuple[tuple[int, ...], float]:
        """A path other than the best, by its probability among those. Node 0 follows the best path, node 1 has left it."""
        total, others = self.total, self.others

        def choices(node: int, end: int):
            for start, w in self.starts(end):
                if node or start != self.last[end]:
                    yield start, w, 1, w + total[start]
                else:
                    yield start, w, 0, w + others[start]

        return self.walk(rng, lambda node, end: list(choices(node, end)))

    def tree(self, excluded: Iterable[tuple[int, ...]]) -> tuple[list[dict[int, int]], list[float]]:
        """The excluded paths as a tree of tails, and the log mass that each node leaves to others, summed up from the leaves."""
        written, places = self.vocabulary.text, [len(self.text)]
        tree: list[dict[int, int]] = [{}]
        for path in excluded:
            cuts, at = [0], 0
            while at < len(path):
                piece = written[path[at]]
                at += 1 if piece is not None else len(self.vocabulary.fallback(self.text[cuts[-1]]))
                cuts.append(cuts[-1] + (len(piece) if piece is not None else 1))
            node = 0
            for start in reversed(cuts[:-1]):
                if start not in tree[node]:
                    tree[node][start] = len(tree)
                    tree.append({})
                    places.append(start)
                node = tree[node][start]
        free = [NEVER] * len(tree)
        for node in range(len(tree) - 1, -1, -1):
            if places[node]:
                free[node] = log_sum(w + (self.total[start] if (child := tree[node].get(start)) is None else free[child]) for start, w in self.starts(places[node]))
        return tree, free

    def remaining(self, excluded: Iterable[tuple[int, ...]]) -> float:
        """Log probability of all paths but these."""
        return min(0.0, self.tree(excluded)[1][0] - self.total[-1])

    def draw_but(self, rng: np.random.Generator, excluded: Iterable[tuple[int, ...]]) -> tuple[tuple[int, ...], float]:
        """A path that isn't one of excluded, by its probability among those; there must be one."""
        tree, free = self.tree(excluded)

        def choices(node: int | None, end: int):
            for start, w in self.starts(end):
                child = None if node is None else tree[node].get(start)
                yield start, w, child, w + (self.total[start] if child is None else free[child])

        return self.walk(rng, lambda node, end: list(choices(node, end)))


def larger(x: np.ndarray, n: int) -> np.ndarray:
    """x with room for n values and a quarter more; what is new is never touched before it is written."""
    out = np.empty(n + n // 4, x.dtype)
    out[: len(x)] = x
    return out


class Paths:
    """Many paths in a few arrays, each by its number: ids, log probability, that of all other paths of its stretch."""

    def __init__(self):
        self.n = self.used = 0
        self.ids, self.start, self.size, self.log, self.rest = np.zeros(1024, np.int32), np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024), np.zeros(1024)

    def __len__(self) -> int:
        return self.n

    def add(self, ids: np.ndarray, size: np.ndarray, log: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Numbers of new paths, whose ids stand one after the other."""
        first, last, used = self.n, self.n + len(size), self.used + len(ids)
        if last > len(self.start):
            for name in ("start", "size", "log", "rest"):
                setattr(self, name, larger(getattr(self, name), last))
        if used > len(self.ids):
            self.ids = larger(self.ids, used)
        self.ids[self.used : used] = ids
        self.start[first:last] = self.used + np.cumsum(size) - size
        self.size[first:last], self.log[first:last], self.rest[first:last] = size, log, rest
        self.n, self.used = last, used
        return np.arange(first, last)

    def cut(self, n: int) -> None:
        """Forget all paths from number n on."""
        if n < self.n:
            self.n, self.used = n, int(self.start[n])

    def join(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of paths, one after the other."""
        size = self.size[numbers]
        return self.ids[np.repeat(self.start[numbers] - (np.cumsum(size) - size), size) + np.arange(size.sum())]

    def one(self, number: int) -> tuple[int, ...]:
        return tuple(self.ids[self.start[number] : self.start[number] + self.size[number]].tolist())


def stretches_of(text: str) -> list[str]:
    """The stretches of a text, without the space that each begins with."""
    text = text.replace("▁", " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [x[1:] for x in STRETCH.findall(" " + text)]
    return text.split(" ")


class Spaced(list):
    """Words, each given with the space that its stretch begins with: the words themselves are kept once, as they are looked up."""

    def __getitem__(self, i) -> str:
        return " " + super().__getitem__(i)


class Sampler:
    """Samples of one worker. It remembers the best paths of stretches, up to MEMO of them."""

    def __init__(self, vocabulary: Vocabulary, memo: int = MEMO):
        self.vocabulary, self.memo = vocabulary, memo
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        #: number of a path -> its stretch, and whether it is worked on one by one
        self.stretch = Spaced()
        self.alone = np.zeros(0, bool)
        self.met = np.zeros(0, np.int64)
        self.paths = Paths()
        self.lattices: dict[str, Lattice] = {}

    def thin(self) -> None:
        """Forget the stretches met in one batch only; all, if that is less than half."""
        often = np.nonzero(self.met > 1)[0]
        texts, alone, paths = [self.stretch[x][1:] for x in often.tolist()], self.alone[often], self.paths
        self.forget()
        if 2 * len(texts) < self.memo:
            numbers = self.paths.add(paths.join(often), paths.size[often], paths.log[often], paths.rest[often])
            self.known, self.stretch, self.alone, self.met = dict(zip(texts, numbers.tolist())), Spaced(texts), alone, np.ones(len(texts), np.int64)

    def lattice(self, text: str) -> Lattice:
        """Kept for as long as one batch is worked on."""
        found = self.lattices.get(text)
        if found is None:
            found = self.lattices[text] = Lattice(self.vocabulary, text)
        return found

    def together(self, length: int) -> int:
        """How many stretches of a length are worked on at a time."""
        return max(1, CELLS // (length * (min(length, self.vocabulary.longest) + 1)))

    def codes(self, stretches: list[list[str]]) -> list[np.ndarray]:
        """The numbers of the best paths of stretches, list by list; those that aren't known are found, and stay known until the next call."""
        if len(self.known) + sum(map(len, stretches)) > 2 * self.memo:
            self.thin()
        every = list(chain.from_iterable(stretches))
        codes = np.fromiter(map(self.known.get, every, repeat(-1)), np.int64, len(every))
        missing = np.nonzero(codes < 0)[0]
        new = [every[x] for x in missing.tolist()]
        self.prepare(set(new))
        codes[missing] = list(map(self.known.__getitem__, new))
        out = np.split(codes, np.cumsum(list(map(len, stretches)))[:-1]) if stretches else []
        for c in out:
            self.met[c] += 1
        return out

    def prepare(self, stretches: Iterable[str]) -> None:
        """Find the best paths of new stretches, many at a time."""
        same: dict[int, list[str]] = {}
        single = []
        for x in stretches:
            same.setdefault(len(x) + 1, []).append(x) if len(x) < TABLE_LETTERS else single.append(x)
        parts: list[tuple] = []
        order: list[str] = []
        for length, each in same.items():
            many = self.together(length)
            for at in range(0, len(each), many):
                some = each[at : at + many]
                t = Together(self.vocabulary, [" " + x for x in some])
                ids, size, log, rest = t.best_paths()
                if not t.fine.all():
                    ids, size, log, rest = ids[np.repeat(t.fine, size)], size[t.fine], log[t.fine], rest[t.fine]
                    single += [x for x, ok in zip(some, t.fine.tolist()) if not ok]
                    some = [x for x, ok in zip(some, t.fine.tolist()) if ok]
                parts.append((ids, size, log, rest))
                order += some
        fine = len(order)
        for x in single:
            cell = self.lattice(" " + x)
            parts.append((np.array(cell.best, np.int32), np.array([len(cell.best)]), np.array([cell.best_log]), np.array([cell.others_log])))
            order.append(x)
        if order:
            numbers = self.paths.add(*(np.concatenate(p) for p in zip(*parts)))
            self.known |= zip(order, numbers.tolist())
            self.stretch += order
            self.alone = np.concatenate([self.alone, np.arange(len(order)) >= fine])
            self.met = np.concatenate([self.met, np.zeros(len(order), np.int64)])

    def draw(self, numbers: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """For each best path by number, the number of a drawn path other than it."""
        out = np.empty(len(numbers), np.int64)
        alone = self.alone[numbers]
        for at in np.nonzero(alone)[0].tolist():
            out[at] = self.keep(*self.lattice(self.stretch[numbers[at]]).draw_other(np.random.default_rng(int(keys[at]))))
        at = np.nonzero(~alone)[0]
        if len(at):
            distinct, place = np.unique(numbers[at], return_inverse=True)
            texts = [self.stretch[x] for x in distinct.tolist()]
            lengths = np.array([len(t) for t in texts])
            order = np.lexsort((distinct, lengths))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            place = rank[place]
            by = np.argsort(place, kind="stable")
            place, at = place[by], at[by]
            lo = 0
            while lo < len(order):
                length = lengths[order[lo]]
                hi = min(lo + self.together(int(length)), int(np.searchsorted(lengths[order], length, "right")))
                a, b = np.searchsorted(place, [lo, hi])
                t = Together(self.vocabulary, [texts[x] for x in order[lo:hi].tolist()])
                step = max(1, CELLS // (t.reach + 1))  # a frequent stretch may be drawn any number of times
                for x in range(a, b, step):
                    y = min(x + step, b)
                    ids, size, log = t.draw(place[x:y] - lo, keys[at[x:y]])
                    out[at[x:y]] = self.paths.add(ids, size, log, np.log1p(-np.exp(log)))
                lo = hi
        return out

    def keep(self, path: tuple[int, ...], log: float) -> int:
        return int(self.paths.add(np.array(path, np.int32), np.array([len(path)]), np.array([log]), np.log1p(-np.exp(np.array([log]))))[0])

    def remaining(self, code: int, excluded: list[int]) -> float:
        """Log probability of all paths of a stretch but those excluded: a difference where it is at least half of what it is taken from, else summed up."""
        whole = float(self.paths.rest[code]) if code in excluded else 0.0
        if whole == NEVER:
            return NEVER
        out = sum(math.exp(float(self.paths.log[x]) - whole) for x in excluded if x != code)
        if out <= 0.5:
            return whole + math.log1p(-out)
        return self.lattice(self.stretch[code]).remaining(map(self.paths.one, excluded))

    def search(self, codes: np.ndarray, k: int, seed: int):
        """The search over one text, whose stretches' best paths are codes. Yields what it needs drawn: numbers of best paths
        that others are to replace, with a key each, and gets their numbers. Returns [(numbers of the paths chosen, log
        probability, perturbed)], and the threshold."""
        paths, rng, n = self.paths, np.random.default_rng(seed), len(codes)
        best_log, others_log = paths.log[codes], paths.rest[codes]
        best_share = np.exp(best_log)

        def unlike(start: int) -> np.ndarray:
            """Stretches from start on whose choice, drawn without constraint, isn't the best."""
            return np.nonzero((rng.random(n - start) >= best_share[start:]) & (others_log[start:] > NEVER))[0] + start

        def split(path: np.ndarray, top: float, start: int, excluded: list[int], before: float) -> dict:
            """The sets of paths that part from path at start (its earlier choices excluded, too) or at a later stretch."""
            log, rest = paths.log[path[start:]], paths.rest[path[start:]]
            prefix = before + np.concatenate([[0.0], np.cumsum(log)[:-1]])
            mass = prefix + rest
            if excluded:
                mass[0] = before + self.remaining(int(codes[start]), [*excluded, int(path[start])])
            g = mass - np.log(np.exp(mass - top) - np.log(rng.random(n - start)))
            g[~np.isfinite(mass)] = NEVER
            return {"path": path, "start": start, "excluded": excluded, "prefix": prefix, "g": g}

        path = codes.copy()
        others = unlike(0)
        path[others] = yield codes[others], rng.integers(0, 1 << 64, len(others), np.uint64)
        total = float(paths.log[path].sum())
        # the perturbed maximum over all paths is a Gumbel at 0; the first path is where it is attained
        top = -math.log(-math.log(rng.random()))
        out = [(path, total, top)]
        nodes = [split(path, top, 0, [], 0.0)]
        while True:
            node = max(nodes, key=lambda x: x["g"].max())
            at = int(node["g"].argmax())
            top = float(node["g"][at])
            if top == NEVER or len(out) == k:
                return out, top
            node["g"][at] = NEVER
            i = node["start"] + at
            excluded = [int(node["path"][i])] + (node["excluded"] if at == 0 else [])
            path = np.concatenate([node["path"][:i], codes[i:]])
            others = unlike(i + 1) if i + 1 < n else np.zeros(0, np.int64)
            plain = excluded == [int(codes[i])]
            if plain:
                others = np.concatenate([[i], others])
            path[others] = yield codes[others], rng.integers(0, 1 << 64, len(others), np.uint64)
            if not plain:
                path[i] = self.keep(*self.lattice(self.stretch[codes[i]]).draw_but(rng, map(paths.one, excluded)))
            out.append((path, float(paths.log[path].sum()), top))
            nodes.append(split(path, top, i, excluded, float(node["prefix"][at])))

    def sample_all(self, texts: list[str], k: int, seeds: list[int]) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text up to k distinct paths: (ids, log probability, perturbed log probability, inclusion score)."""
        codes = self.codes([stretches_of(t) if t else [] for t in texts])
        mark = len(self.paths)
        running = {i: self.search(c, k, seed) for i, (c, seed) in enumerate(zip(codes, seeds)) if len(c)}
        found: dict[int, tuple] = {}
        drawn: dict[int, np.ndarray | None] = dict.fromkeys(running)
        while running:
            asked = []
            with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
                for i in list(running):
                    try:
                        asked.append((i, *running[i].send(drawn[i])))
                    except StopIteration as end:
                        found[i] = end.value
                        del running[i]
            if asked:
                got = self.draw(np.concatenate([a[1] for a in asked]), np.concatenate([a[2] for a in asked]))
                cuts = np.cumsum([len(a[1]) for a in asked])
                drawn = {a[0]: x for a, x in zip(asked, np.split(got, cuts[:-1]))}
        result = []
        for i in range(len(texts)):
            chosen, threshold = found.get(i, ([], NEVER))
            rows = [(np.zeros(0, np.int32), 0.0, 0.0, 1.0)] if not texts[i] else []
            for path, total, g in chosen:
                inclusion = 1.0 if threshold == NEVER else -math.expm1(-math.exp(min(700.0, total - threshold)))
                rows.append((self.paths.join(path), total, g, inclusion))
            result.append(rows)
        self.paths.cut(mark)
        self.lattices.clear()
        return result

    def sample(self, text: str, k: int, seed: int) -> list[tuple[np.ndarray, float, float, float]]:
        return self.sample_all([text], k, [seed])[0]


@functools.lru_cache(maxsize=1)
def sampler_for(model: bytes, alpha: float) -> Sampler:
    """One for the tasks of a worker."""
    return Sampler(Vocabulary(model, alpha))


def cuts(texts: pa.Array) -> list[tuple[int, int]]:
    """The rows in stretches of less than BATCH_LETTERS letters, or of one row: only one stretch's texts are Python strings at a time."""
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
    out, first, letters = [], 0, 0
    for row, size in enumerate(sizes):
        if row > first and letters + size >= BATCH_LETTERS:
            out.append((first, row))
            first, letters = row, 0
        letters += size
    return out + [(first, len(sizes))] if sizes else []


def row_seed(key: int | None, seed: int) -> int:
    return xxhash.xxh64_intdigest(b"null" if key is None else str(key).encode(), seed)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, samples: int = SAMPLES, alpha: float = ALPHA, seed: int = 0, with_ids: bool = True, packed: bool = False) -> DataFrame:
    """Per row of docs, up to samples distinct segmentations: doc_id, rank (by perturbed weight), n_pieces, log_prob, perturbed, inclusion, ids_sha256 (of little-endian 32-bit ids), round_trip (the ids decode to the text), ids if with_ids (packed: as little-endian 32-bit numbers in one binary value).

    Rows are seeded by their id: reruns agree, repeated rows get the same samples, null ids share a seed. Null and empty
    text give one empty segmentation; a text with fewer segmentations gives them all, with inclusion 1. The mark U+2581 in a
    text counts as a space, as the model has it. Texts are worked on whole; other columns aren't read; an empty
    table gives no rows. The model file is read on the driver and broadcast: its size is fixed.
    """
    with open(model_path or default_path(), "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = [("doc_id", pa.int64()), ("rank", pa.int32()), ("n_pieces", pa.int64()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64()), ("ids_sha256", pa.string()), ("round_trip", pa.bool_())]
    if with_ids:
        fields.append(("ids", pa.binary() if packed else pa.list_(pa.int32())))
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # no cycles are made here, and looking for them goes through all that the worker remembers
        try:
            yield from sampled(batches)
        finally:
            gc.enable()
        give_back()

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = sampler_for(sent.value, alpha)
        for b in batches:
            for part, (done, ahead) in enumerate(cuts(b.column(1)), 1):
                keys, some, rows = b.column(0)[done:ahead].to_pylist(), [t or "" for t in b.column(1)[done:ahead].to_pylist()], []
                for key, text, found in zip(keys, some, sampler.sample_all(some, samples, [row_seed(x, seed) for x in keys])):
                    plain = text.replace("▁", " ").encode()
                    for rank, (ids, log, g, inclusion) in enumerate(found, 1):
                        back = sampler.vocabulary.decode_array(ids) == plain
                        raw = ids.astype("<i4", copy=False).tobytes()
                        rows.append((key, rank, len(ids), log, g, inclusion, hashlib.sha256(raw).hexdigest(), back, raw if packed else ids))
                *columns, ids = zip(*rows)
                arrays = [pa.array(c, t) for c, t in zip(columns, schema.types)]
                if with_ids and packed:
                    arrays.append(pa.array(ids, pa.binary()))
                elif with_ids:
                    arrays.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(columns[2])]).astype(np.int32), np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)
                del some, rows, found, columns, ids, arrays  # else they stay beside the next ones
                if part % TRIM_EVERY == 0:
                    trim()
        sampler.forget()

    ddl = "doc_id long, rank int, n_pieces long, log_prob double, perturbed double, inclusion double, ids_sha256 string, round_trip boolean" + ((", ids binary" if packed else ", ids array<int>") if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ddl)
