"""Queries that repair dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..operators import date_repair as R
from . import derived as D
from .queries import query

_SLIPS = (("68", "88"), ("01", "Ol"), ("5", "S"), ("", ""))
_LABELS = ("Arrival Date", "Astwal Date", "Arrival Dabe", "Filing Date")


def date_texts(spark, sf_dir) -> DataFrame:
    """(k, stream, text): the order's date as three streams show it, each with its own slips and label."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    date = F.date_format(F.date_sub(F.lit(V.RECEIPT_DATE).cast("date"), (k % 500).cast("int")), "yyyy-MM-dd")
    streams = []
    for i, name in enumerate(("native", "page_ocr", "embedded_ocr")):
        shown = F.translate(date, "68", "88")
        for j, (a, b) in enumerate(_SLIPS[1:], 1):
            shown = F.when((k + i * c) % 4 == j, F.translate(date, a, b)).otherwise(shown)
        label = D.pick(_LABELS, F.floor(k / 4) + i)
        streams.append(F.struct(F.lit(name).alias("stream"), F.concat(F.lit("FORM I-8090\n"), label, F.lit(": "), shown, F.lit("\nSYSTEM: Arrival Date 2026-01-01")).alias("text")))
    return D.spread_orders(spark, sf_dir).select(k.alias("k"), F.explode(F.array(*streams)).alias("x")).select("k", "x.*")


_SHOWN = " UNION ALL ".join(
    f"""SELECT k, '{name}' AS stream, (k // 4 + {i}) % 4 <> 3 AS labelled, CASE (k + {i} * c) % 4 WHEN 1 THEN translate(date, '01', 'Ol') WHEN 2 THEN replace(date, '5', 'S') WHEN 3 THEN date ELSE translate(date, '68', '88') END AS glyphs FROM o"""
    for i, name in enumerate(("native", "page_ocr", "embedded_ocr")))
_PAIRS = ", ".join(f"('{g}', '{d}')" for g, ds in R.CONFUSABLE.items() for d in ds)
#: Every day of the range is held against every distinct text of glyphs.
_DATES = f"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, strftime(DATE '{V.RECEIPT_DATE}' - CAST(o_orderkey % 500 AS INT), '%Y-%m-%d') AS date FROM orders),
seen AS ({_SHOWN}), glyphs AS (SELECT DISTINCT glyphs FROM seen WHERE labelled),
confusable AS (SELECT * FROM (VALUES {_PAIRS}) v(g, d)),
days AS (SELECT strftime(DATE '{V.DATE_FROM}' + CAST(i AS INT), '%Y-%m-%d') AS date FROM (SELECT unnest(range(date_diff('day', DATE '{V.DATE_FROM}', DATE '{V.DATE_TO}') + 1)) AS i)),
places AS (SELECT glyphs, date, i, substr(glyphs, i, 1) AS g, substr(date, i, 1) AS d FROM glyphs, days, (SELECT unnest(range(1, 11)) AS i)),
read AS (SELECT p.*, p.g = p.d OR c.g IS NOT NULL AND (i <= 7 OR NOT p.g BETWEEN '0' AND '9') AS fits FROM places p LEFT JOIN confusable c ON p.g = c.g AND p.d = c.d),
possible AS (SELECT glyphs, date FROM read GROUP BY ALL HAVING bool_and(fits)),
slips AS (SELECT DISTINCT glyphs, date, g, d FROM read SEMI JOIN possible USING (glyphs, date) WHERE g <> d),
kept AS (SELECT glyphs, date, count(*) AS n FROM (SELECT glyphs, date, i, g FROM read SEMI JOIN possible USING (glyphs, date) WHERE g = d AND i <= 7) r SEMI JOIN slips s USING (glyphs, date, g) GROUP BY ALL),
costs AS (SELECT glyphs, date, coalesce(any_value(kept.n), 0) + count(slips.g) AS cost FROM possible LEFT JOIN slips USING (glyphs, date) LEFT JOIN kept USING (glyphs, date) GROUP BY ALL),
fixed AS (SELECT glyphs, date AS arrival_date FROM costs QUALIFY rank() OVER (PARTITION BY glyphs ORDER BY cost) = 1 AND count(*) OVER (PARTITION BY glyphs, cost) = 1)"""


@query(f"{_DATES} SELECT glyphs, arrival_date FROM fixed")
def date_lattice(spark, sf_dir):
    """Every distinct damaged date and its one best reading."""
    return R.repairs(R.labelled_dates(date_texts(spark, sf_dir), ["k"]))


@query(f"""{_DATES}, votes AS (SELECT k, arrival_date, count(DISTINCT stream) AS votes FROM seen JOIN fixed USING (glyphs) WHERE labelled GROUP BY ALL HAVING votes >= 2)
SELECT k, arrival_date, votes FROM votes QUALIFY rank() OVER (PARTITION BY k ORDER BY votes DESC) = 1 AND count(*) OVER (PARTITION BY k, votes) = 1""")
def arrival_votes(spark, sf_dir):
    return R.arrival_by_votes(date_texts(spark, sf_dir), ["k"])
