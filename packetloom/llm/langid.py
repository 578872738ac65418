"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

The features are hashed n-grams of one to four characters of the lower-cased text (everything but letters is one
space), as relative frequencies times inverse document frequency. The weights are learned by follow-the-regularised-
leader with L1 and L2 penalties on a bounded sample of labelled documents; a temperature, fitted on a part of the
sample that the weights haven't seen, calibrates the probabilities. Because frequencies are relative, a document's
logits are the mean of table rows over its n-grams: prediction reads whole texts in vectorised batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back

#: Bound of the training sample, in documents per language, and of the number of languages.
TRAIN_PER_LANG = 1000
MOST_LANGS = 256
BITS = 18
ORDERS = 4
SCALE = 100.0
UNKNOWN = "und"


def held_out(key: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2; null ids aren't held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _letters() -> np.ndarray:
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            table[c] = c
    return table


class Grams:
    """Hashed n-grams of many texts at once."""

    def __init__(self):
        self.table = _letters()

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(characters, starts, ends): spaces don't repeat; each text is followed by ORDERS spaces that no other shares."""
        parts, starts, ends, at = [], [], [], 0
        gap = np.full(ORDERS, 32, np.uint32)
        for t in texts:
            c = self.table[np.frombuffer(t.lower().encode("utf-32-le", "replace"), np.uint32)]
            if len(c):
                keep = np.ones(len(c), bool)
                keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
                c = c[keep]
            parts += [c, gap]
            starts.append(at)
            ends.append(at + len(c))
            at += len(c) + ORDERS
        return np.concatenate(parts) if parts else gap[:0], np.array(starts, np.int64), np.array(ends, np.int64)

    @staticmethod
    def hashes(codes: np.ndarray) -> Iterator[np.ndarray]:
        """For n = 1, 2, ...: the bucket of the n-gram that begins at each place (the last n - 1 places are cut short)."""
        h = np.zeros(len(codes), np.uint64)
        for n in range(ORDERS):
            nxt = codes[n:].astype(np.uint64)
            h = (h[: len(nxt)] + nxt + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            yield (h >> np.uint64(64 - BITS)).astype(np.int64)

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, relative frequencies) of one text."""
        codes, _, ends = self.codes([text])
        n = int(ends[0])
        if not n:
            return np.zeros(0, np.int64), np.zeros(0)
        found, k = self.tally(codes, n)
        return found, k / k.sum()

    def tally(self, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, counts) of the n-grams that begin at the first n places."""
        return np.unique(np.concatenate([h[:n] for h in self.hashes(codes)]), return_counts=True)

    def packed(self, text: str) -> Packed | None:
        """What counts() tells of a text, in as few bytes as its numbers take; nothing for a text without characters."""
        codes, _, ends = self.codes([text])
        n = int(ends[0])
        if not n:
            return None
        found, k = self.tally(codes, n)
        return Packed(found.astype(np.min_scalar_type((1 << BITS) - 1)), k.astype(np.min_scalar_type(k.max())))


class Packed:
    """Buckets and counts of a text of the sample, which the driver holds through the training."""

    __slots__ = ("found", "k")

    def __init__(self, found: np.ndarray, k: np.ndarray):
        self.found, self.k = found, k

    def frequencies(self) -> tuple[np.ndarray, np.ndarray]:
        return self.found.astype(np.int64), self.k / np.float64(self.k.sum())


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.table, self.bias, self.temperature = langs, table, bias, temperature

    def predict(self, grams: Grams, texts: list[str]) -> tuple[list[str], list[float]]:
        codes, starts, ends = grams.codes(texts)
        pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        lettered = np.array([bool(len(codes[s:e]) and (codes[s:e] != 32).any()) for s, e in zip(starts, ends)], bool)
        if not len(self.langs) or not lettered.any():
            return pred, score
        logits = np.zeros((len(texts), len(self.langs)))
        # blocks of characters bound the memory, whatever a text's length
        block = 1 << 18
        for at in range(0, len(codes), block):
            piece = codes[at : at + block + ORDERS - 1]
            span = min(block, len(codes) - at)
            sums = np.zeros((span, len(self.langs)), np.float32)
            for h in grams.hashes(piece):
                m = min(span, len(h))
                sums[:m] += self.table[h[:m]]
            lo, hi = np.clip(starts - at, 0, span), np.clip(ends - at, 0, span)
            inside = np.nonzero(hi > lo)[0]
            if len(inside):
                cuts = np.stack([lo[inside], hi[inside]], 1).ravel()
                padded = np.vstack([sums, np.zeros((1, sums.shape[1]), np.float32)])
                logits[inside] += np.add.reduceat(padded, cuts, axis=0, dtype=np.float64)[::2]
        n = np.maximum(ends - starts, 1) * ORDERS
        z = (logits * SCALE / n[:, None] + self.bias) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        for i in np.nonzero(lettered)[0]:
            pred[i], score[i] = self.langs[best[i]], float(p[i, best[i]])
        return pred, score


def fit(rows: list[tuple[str, str]], epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, seed: int = 7) -> Model:
    """FTRL-proximal on (text, lang) rows; every fifth row is kept for the temperature."""
    langs = sorted({lang for _, lang in rows})
    grams, rng = Grams(), np.random.default_rng(seed)
    size, k = 1 << BITS, len(langs)
    index = {lang: i for i, lang in enumerate(langs)}
    seen = [x for x in ((grams.packed(t), index[lang]) for t, lang in rows) if x[0] is not None]
    del grams
    kept, learn = seen[::5], [x for i, x in enumerate(seen) if i % 5] or seen
    df = np.zeros(size)
    for x, _ in learn:
        df[x.found] += 1
    idf = np.log((1 + len(learn)) / (1 + df)) + 1
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))

    def weights(g: np.ndarray) -> np.ndarray:
        zg = z[g]
        return np.where(np.abs(zg) <= l1, 0.0, -(zg - np.sign(zg) * l1) / ((beta + np.sqrt(n[g])) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(learn)):
            (g, tf), y = learn[i][0].frequencies(), learn[i][1]
            g, x = np.append(g, size), np.append(SCALE * tf * idf[g], 1.0)
            w = weights(g)
            logit = x @ w
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1
            grad = x[:, None] * p
            step = (np.sqrt(n[g] + grad**2) - np.sqrt(n[g])) / alpha
            z[g] += grad - step * w
            n[g] += grad**2
    table, bias = np.empty((size, k), np.float32), weights(np.array([size]))[0]
    for at in range(0, size, 1 << 13):  # in blocks: the steps of weights() would hold the table many times over
        g = np.arange(at, min(size, at + (1 << 13)))
        table[g] = weights(g) * idf[g, None]
    del z, n
    temperature = 1.0
    if kept:
        logits = np.stack([SCALE * (tf @ table[g]) + bias for g, tf in (x.frequencies() for x, _ in kept)])
        ys = np.array([y for _, y in kept])

        def loss(t: float) -> float:
            a = logits / t
            a = a - a.max(1, keepdims=True)
            return float(np.mean(np.log(np.exp(a).sum(1)) - a[np.arange(len(ys)), ys]))

        temperature = min(np.geomspace(0.25, 8, 61), key=loss)
    return Model(langs, table, bias, float(temperature))


def train(docs: DataFrame, per_lang: int = TRAIN_PER_LANG, most_langs: int = MOST_LANGS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from rows that aren't held out and have a language: at most per_lang of each, chosen by a hash of the id.

    The most_langs most frequent languages are learned. Nothing but text and lang enters the model.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()
    if not found:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0)
    whole = 1 << 30
    share = F.create_map(*[x for r in found for x in (F.lit(r["lang"]), F.lit(min(whole, int(whole * per_lang / r["count"]) + 1)))])
    spot = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(whole))
    chosen = rows.where(spot < F.coalesce(share[F.col("lang")], F.lit(0))).limit(2 * per_lang * len(found))
    # in an order that does not depend on the partitions
    got = sorted(((r.id if r.id is not None else -1, r.text, r.lang) for r in chosen.toLocalIterator()), key=lambda r: (r[0], r[1], r[2]))
    model = fit([(t, lang) for _, t, lang in got])
    del got
    give_back()
    return model


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    Null text and text without a letter give und with score 0; so does every text when no labelled row could be learned
    from. Null ids aren't held out. Whole texts are read, in blocks; columns other than those named are not inputs;
    an empty table gives no rows. model: by train(docs) unless given; it is broadcast, its size is fixed (BITS).
    """
    model = model or train(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            pred, score = [], []
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end]) < 1 << 20):
                    chars += len(texts[end])
                    end += 1
                p, s = sent.value.predict(grams, texts[at:end])
                pred += p
                score += s
                at = end
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])
        del grams
        give_back()

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model | None = None, least: float = 0.5) -> DataFrame:
    """The rows of docs whose text has a language with score >= least; columns as in docs."""
    model = model or train(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in batches:
            keep = []
            for i in range(0, len(b), 256):
                p, s = sent.value.predict(grams, [t or "" for t in b.column(at)[i : i + 256].to_pylist()])
                keep += [x != UNKNOWN and y >= least for x, y in zip(p, s)]
            yield b.filter(pa.array(keep, pa.bool_()))
        del grams
        give_back()

    return docs.mapInArrow(run, docs.schema)
