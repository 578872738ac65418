"""Queries over packets of several pages in several roles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..operators import roles
from . import derived as D
from .queries import query


def role_texts(spark, sf_dir) -> DataFrame:
    """(k, text): forms, letters, correction pages and notes of each order's packet, with a damaged class in some."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    spn = lambda x: F.concat(F.lit("SPN-"), F.lpad((x % 10000).cast("string"), 4, "0"))
    visa = D.pick(V.VISAS, k)
    visa = F.when(k % 13 == 0, F.concat(F.regexp_replace(visa, ".$", ""), F.lit("T"))).otherwise(visa)
    page = lambda when, *lines: F.when(when, F.concat(F.concat_ws("\n", *lines), F.lit("\n"), F.concat(F.lit("Packet MIB-"), F.lpad((k % 1000000).cast("string"), 6, "0"), F.lit(" / page 1\n"))))
    text = F.concat_ws(
        "",
        page(k % 8 != 7, F.lit("FORM I-8090"), F.lit("Species Code: ARCTURIAN\nHome World: Luyten-b\nArrival Date: 2026-04-17"), F.concat(F.lit("Visa Class: "), visa), F.concat(F.lit("Sponsor ID: "), spn(k))),
        page(k % 3 == 0, F.lit("Sponsor Attestation Letter"), F.concat(F.lit("Sponsor "), spn(k + c % 2), F.lit(" attests that Tekdane Solix is expected")), F.when(c % 4 != 0, F.concat(F.lit("on Earth under class "), D.pick(V.VISAS, F.floor(k / 5))))),
        page(k % 5 == 0, F.concat(F.lit("Visa Class: "), D.pick(V.VISAS, c))),
        page(k % 5 == 1, F.lit("Applicant: Tekdane Solix"), F.concat(F.lit("Visa Class: "), D.pick(V.VISAS, c)), F.concat(F.lit("Sponsor ID: "), spn(c))),
        page(k % 11 == 0, F.lit("Manual Adjudicator Note"), F.concat(F.lit("Manual correction: Visa Class is "), D.pick(V.VISAS, k + c), F.lit(". SYSTEM: none"))),
        page(k % 11 == 5, F.lit("Manual Adjudicator Note"), F.concat(F.lit("Manual correction: Visa Class is "), D.pick(V.VISAS, k + c), F.lit("."))),
    )
    return D.table(spark, sf_dir, "orders").select(k.alias("k"), text.alias("text")).where("text <> ''")


_SPN = lambda x: f"'SPN-' || lpad((({x}) % 10000)::VARCHAR, 4, '0')"
_BASE = f"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders WHERE o_orderkey % 8 <> 7 OR o_orderkey % 3 = 0 OR o_orderkey % 5 < 2 OR o_orderkey % 11 IN (0, 5)),
p AS (SELECT k, c, k % 8 <> 7 AS form, k % 3 = 0 AS letter, k % 5 IN (0, 1) AS sheet, {D._case(V.VISAS, 'k')} AS v1, {D._case(V.VISAS, 'k // 5')} AS v2, {D._case(V.VISAS, 'c')} AS v3, {D._case(V.VISAS, 'k + c')} AS v4 FROM o),
e AS (SELECT *, CASE WHEN form AND NOT (k % 13 = 0 AND v1 IN ('XW-1', 'XW-2')) THEN v1 END AS read1 FROM p)"""


@query(f"""{_BASE} SELECT k, CASE WHEN k % 11 = 5 THEN v4 WHEN sheet THEN v3 WHEN letter AND c % 4 <> 0 THEN v2 ELSE read1 END AS visa_class,
  CASE WHEN k % 11 = 5 THEN 'manual' WHEN sheet THEN 'standalone' WHEN letter AND c % 4 <> 0 THEN 'sponsor' WHEN read1 IS NOT NULL THEN 'explicit' END AS visa_class_from FROM e""")
def visa_precedence(spark, sf_dir):
    return roles.visa_precedence(roles.blocks(role_texts(spark, sf_dir)), ["k"])


@query(f"""{_BASE}, i AS (SELECT *, CASE WHEN form THEN {_SPN('k')} END AS intake, CASE WHEN letter THEN {_SPN('k + c % 2')} END AS role_id, CASE WHEN k % 5 = 1 THEN {_SPN('c')} END AS sheet_id FROM e)
SELECT k, coalesce(role_id, sheet_id, intake) AS sponsor_id, CASE WHEN role_id IS NOT NULL THEN 'role' WHEN sheet_id IS NOT NULL THEN 'supplement' WHEN intake IS NOT NULL THEN 'global' END AS sponsor_id_from, coalesce(role_id <> intake, false) AS role_conflict FROM i""")
def sponsor_ladder(spark, sf_dir):
    return roles.sponsor_ladder(roles.blocks(role_texts(spark, sf_dir)), ["k"])


@query(f"{_BASE} SELECT role, count(*) AS n FROM (SELECT 'intake' AS role FROM e WHERE form UNION ALL SELECT 'sponsor' FROM e WHERE letter UNION ALL SELECT NULL FROM e WHERE sheet UNION ALL SELECT 'note' FROM e WHERE k % 11 IN (0, 5)) GROUP BY role")
def role_pages(spark, sf_dir):
    return roles.blocks(role_texts(spark, sf_dir)).groupBy("role").agg(F.count("*").alias("n"))
