"""Token counts with the whole-token shortcut.

Before any text is read, every vocabulary string is encoded alone; those that give one token are the whole-token set.
A text is cut into pre-tokens as the tokenizer's own pattern does; a pre-token of the set counts one without encoding,
and only the others are merged, each distinct one once per worker while a bounded memo holds it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies of this family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 1_000_000
LIMIT = 512


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def whole_tokens(tokenizer_json: str) -> list[str]:
    """The vocabulary strings that encode alone as exactly their one token (those that aren't whole UTF-8 can't be pre-tokens)."""
    from tokenizers import Tokenizer

    letters, ids, strings = byte_letters(), [], []
    for piece, i in json.loads(tokenizer_json)["model"]["vocab"].items():
        try:
            strings.append(bytes(letters[c] for c in piece).decode("utf-8"))
            ids.append(i)
        except (KeyError, UnicodeDecodeError):
            pass
    tokenizer = Tokenizer.from_str(tokenizer_json)
    return [s for s, i, e in zip(strings, ids, tokenizer.encode_batch(strings, add_special_tokens=False)) if e.ids == [i]]


class Counter:
    """Counts of one worker. Special strings inside a text are one token each, as the library's default has it."""

    def __init__(self, tokenizer_json: str, whole: list[str], memo: int = MEMO):
        import regex
        from tokenizers import Tokenizer

        class Pieces(dict):
            def __missing__(self, piece: str) -> int:
                n = len(tokenizer.encode(piece, add_special_tokens=False).ids)
                if len(self) < most:
                    self[piece] = n
                return n

        tokenizer = Tokenizer.from_str(tokenizer_json)
        most = len(whole) + memo
        self.pieces = Pieces.fromkeys(whole, 1)
        self.find = regex.compile(PATTERN).findall
        self.tokenizer = tokenizer
        special = [t["content"] for t in json.loads(tokenizer_json)["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def count(self, text: str) -> int:
        if self.special is None:
            return sum(map(self.pieces.__getitem__, self.find(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.pieces.__getitem__, self.find(p))) for p in parts)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null text counts as empty: no bytes, no tokens. Texts of any length are counted whole. Repeated rows are counted
    each; other columns aren't read; an empty table gives no rows. The vocabulary file is read on the driver and
    broadcast (its size is fixed), executors need no copy.
    """
    spark = docs.sparkSession
    with open(tokenizer_path or default_path(), encoding="utf-8") as f:
        tokenizer_json = f.read()
    sent = spark.sparkContext.broadcast((tokenizer_json, whole_tokens(tokenizer_json)))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for b in batches:
            counter = counter or Counter(*sent.value)
            texts = [t or b"" for t in as_bytes(b.column(1))]
            n = [counter.count(t.decode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], schema=schema)

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
