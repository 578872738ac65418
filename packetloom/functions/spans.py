"""Where patterns stand in a text, and algebra on such spans within a row."""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,text:string>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])


# How many matches are held as Python strings before they become Arrow ones.
HELD = 1 << 14


def _matches(texts: pa.Array, pattern: re.Pattern) -> pa.ListArray:
    """Per text its matches. Places are kept as plain integers: a batch of long texts has millions of them."""
    starts, ends, last, words, packed = array("i"), array("i"), array("i", [0]), [], []
    for t in texts:
        for m in pattern.finditer(t.as_py() or ""):
            starts.append(m.start())
            ends.append(m.end())
            words.append(m[0])
            if len(words) == HELD:
                packed.append(pa.array(words, pa.string()))
                words = []
        last.append(len(starts))
    said = pa.concat_arrays([*packed, pa.array(words, pa.string())])
    numbers = lambda a: pa.array(np.array(a, np.int32))
    return pa.ListArray.from_arrays(numbers(last), pa.StructArray.from_arrays([numbers(starts), numbers(ends), said], fields=list(_SPAN)))


def spans_of(text: Column, patterns: dict[str, str]) -> Column:
    """A struct with, per name, the matches of its pattern as an array of (start, end, text), in order; ends are exclusive, places count letters.

    Spark's functions give matches without their places, so the search runs in Arrow batches, all patterns in one call. Null texts have no spans.
    """
    compiled = {name: re.compile(p) for name, p in patterns.items()}
    schema = ", ".join(f"{name}: array<{SPAN}>" for name in patterns)

    @F.arrow_udf(f"struct<{schema}>")
    def find(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([_matches(texts, p) for p in compiled.values()], names=list(compiled))

    return find(text)


def within(spans: Column, lo: Column, hi: Column) -> Column:
    """The spans that lie wholly from lo to hi."""
    return F.filter(spans, lambda s: (s["start"] >= lo) & (s["end"] <= hi))


def any_within(spans: Column, lo: Column, hi: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] >= lo) & (s["end"] <= hi))
