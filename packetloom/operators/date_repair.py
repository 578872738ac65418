"""Dates with misread glyphs: a walk through confusable digits under the calendar, and votes of streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import similarity as S
from ..functions import text as X
from . import ranking

# The digits that a glyph may stand for, besides itself.
CONFUSABLE = {
    "0": "68", "1": "7", "3": "8", "5": "6", "6": "58", "7": "1", "8": "036", "A": "4", "B": "8", "D": "0", "G": "6", "I": "1", "O": "0", "Q": "0", "S": "5", "Z": "2", "l": "1", "|": "1",
}
GLYPHS = "[0-9" + "".join(c for c in CONFUSABLE if not c.isdigit()) + "]"
#: A label and a date of glyphs on one line; the label's last word as readers give it.
LABELLED = rf"(?m)([A-Za-z]{{3,12}}[ \t]+(?:Date|Cate|Dabe))[ \t]*:?[ \t]*({GLYPHS}{{4}}-{GLYPHS}{{2}}-{GLYPHS}{{2}})(?![0-9A-Za-z-])"
LABEL, LEAST_RATIO = "arrivaldate", 0.62
YEARS = tuple(str(y) for y in range(int(V.DATE_FROM[:4]), int(V.DATE_TO[:4]) + 1))
MONTHS, DAYS = tuple(f"{m:02d}" for m in range(1, 13)), tuple(f"{d:02d}" for d in range(1, 32))


def _may_be(glyphs: Column, digits: str, digits_for_digits: bool) -> Column:
    """Whether glyphs may be read as the digits; where digits don't stand for other digits, only letters do."""
    fit = F.lit(True)
    for i, d in enumerate(digits, 1):
        readers = [g for g, others in CONFUSABLE.items() if d in others and (digits_for_digits or not g.isdigit())]
        fit = fit & F.substring(glyphs, i, 1).isin(d, *readers)
    return fit


def readings(glyphs: Column) -> Column:
    """The dates, of those that the calendar and the plausible range hold, that a text of glyphs like 2O28-08-1l may show.

    Walked part by part: years, months and days that don't fit are cut before they are combined. Days' digits are taken
    as they stand.
    """
    part = lambda at, size, values, free: F.filter(F.array(*[F.when(_may_be(F.substring(glyphs, at, size), v, free), v) for v in values]), lambda v: v.isNotNull())
    years, months, days = part(1, 4, YEARS, True), part(6, 2, MONTHS, True), part(9, 2, DAYS, False)
    joined = lambda heads, tails: F.flatten(F.transform(heads, lambda h: F.transform(tails, lambda t: F.concat(h, F.lit("-"), t))))
    # the parts are bound before they are combined, so that none is computed for every head
    parts = F.array(F.struct(years.alias("y"), months.alias("m"), days.alias("d")))
    return F.filter(F.transform(parts, lambda p: joined(joined(p["y"], p["m"]), p["d"]))[0], X.plausible_date)


def reading_cost(glyphs: Column, date: Column) -> Column:
    """Different confusions that a reading needs, plus the year's and month's glyphs that it takes as they stand though it takes the like for another digit elsewhere: a reader's slips repeat."""
    seen = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.struct(F.substring(glyphs, i, F.lit(1)).alias("g"), F.substring(date, i, F.lit(1)).alias("d"), (i <= 7).alias("free")))
    slips = F.array_distinct(F.transform(F.filter(seen, lambda s: s["g"] != s["d"]), lambda s: F.struct(s["g"], s["d"])))
    taken = F.transform(slips, lambda s: s["g"])
    kept = F.filter(seen, lambda s: s["free"] & (s["g"] == s["d"]) & F.array_contains(taken, s["g"]))
    return F.size(slips) + F.size(kept)


def repaired(glyphs: Column) -> Column:
    """The one reading with the least cost, or null."""
    scored = F.sort_array(F.transform(readings(glyphs), lambda d: F.struct(reading_cost(glyphs, d).alias("cost"), d.alias("date"))))
    best = F.transform(F.array(scored), lambda s: F.when((F.size(s) == 1) | (F.get(s, F.lit(0))["cost"] < F.get(s, F.lit(1))["cost"]), F.get(s, F.lit(0))["date"]))
    return best[0]


def labelled_dates(streams: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, stream, glyphs): dates beside a label that is shaped like the arrival's, directives left out. Labels repeat: each distinct one is compared once."""
    found = F.regexp_extract_all(X.strip_injection(F.col("text")), F.lit(LABELLED), F.lit(0))
    rows = streams.select(*keys, "stream", F.explode(found).alias("_m")).select(*keys, "stream", F.regexp_extract("_m", LABELLED, 1).alias("label"), F.regexp_extract("_m", LABELLED, 2).alias("glyphs"))
    plain = F.regexp_replace(F.lower("label"), "[^a-z]", "")
    labels = rows.select("label").distinct().where(S.sequence_ratio_udf(plain, F.lit(LABEL)) >= LEAST_RATIO)
    return rows.join(labels, "label", "left_semi").select(*keys, "stream", "glyphs")


def repairs(seen: DataFrame) -> DataFrame:
    """(glyphs, arrival_date): distinct texts of glyphs that have one best reading. Exploded, not filtered: filters inferred from so deep an expression take minutes to plan."""
    return seen.select("glyphs").distinct().select("glyphs", F.explode(F.array_compact(F.array(repaired(F.col("glyphs"))))).alias("arrival_date"))


def arrival_by_votes(streams: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """(keys, arrival_date, votes): the date that most streams show, repaired, if at least `least` do and no other has as many. Distinct texts of glyphs are repaired once."""
    seen = labelled_dates(streams, keys)
    return ranking.consensus(seen.join(repairs(seen), "glyphs"), keys, "arrival_date", "stream", least).select(*keys, "arrival_date", "votes")
