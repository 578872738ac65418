"""Fusing the readings of several streams into one evidence row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import text as X

PROTECTED = r"^native|manual"


def protected(source: Column) -> Column:
    """Values read natively or corrected by hand are never overwritten."""
    return F.coalesce(source.rlike(PROTECTED), F.lit(False))


def field_values(text: Column, field: str) -> Column:
    """A field's labelled values in a text, in order: closed fields in their vocabulary's spelling, plausible dates; others are dropped."""
    values = X.label_values(text, field)
    if field in ("species_code", "home_world", "visa_class", "declared_purpose", "fee_status"):
        known = F.create_map(*[F.lit(x) for v in (V.FEES if field == "fee_status" else V.vocabulary(field)) for x in (v.lower(), v)])
        return F.array_compact(F.transform(values, lambda x: known[F.lower(x)]))
    return F.filter(values, X.plausible_date) if field == "arrival_date" else values


def extract_fields(streams: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """(keys, stream, trust, field, value, pos): labelled values of each stream after directives are dropped."""
    clean = streams.withColumn("text", X.strip_injection(F.col("text")))

    def as_rows(field: str) -> Column:
        return F.transform(field_values(F.col("text"), field), lambda v, i: F.struct(F.lit(field).alias("field"), v.alias("value"), i.alias("pos")))

    found = F.concat(*[as_rows(field) for field in X.LABELS])
    return clean.select(*keys, "stream", "trust", F.explode(found).alias("x")).select(*keys, "stream", "trust", "x.*")


def fuse(candidates: DataFrame, key: str = "case_id", packet: str | None = None) -> DataFrame:
    """Per case and field: the value of the most trusted stream that has one, its source, how many streams agree, and conflicts.

    conflict: the anchor stream itself holds several values. untrusted_conflict: a less trusted stream disagrees.
    Rows: (key, stream, trust, field, value, pos). All aggregates are partial; a case is never gathered. Where several
    packets share a key, packet names their column: each packet's streams then count as their own, and of equally trusted
    ones the smallest packet's comes first.
    """
    keys, own = [key, "field"], [packet] if packet else []
    per = candidates.groupBy(*keys, *own, "stream", "trust").agg(F.min_by("value", "pos").alias("value"), (F.countDistinct("value") > 1).alias("several"))
    first = F.min(F.struct("trust", *own, "stream", "value", "several")).alias("x")
    fused = per.groupBy(*keys).agg(first, F.count("*").alias("streams"), F.count_distinct("value").alias("values"))
    return fused.select(*keys, F.col("x.value").alias("value"), F.col("x.stream").alias("source"), F.col("x.several").alias("conflict"), (F.col("values") > 1).alias("untrusted_conflict"), "streams")


def to_evidence(fused: DataFrame, key: str = "case_id") -> DataFrame:
    """One row per case (or other key): a column per field, sources of visa, arrival and fee, and the two conflict lists."""
    wide = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in V.DEFAULTS]
    sources = [F.max(F.when(F.col("field") == f, F.col("source"))).alias(s) for f, s in (("visa_class", "visa_source"), ("arrival_date", "arrival_source"), ("fee_status", "fee_source"))]
    lists = [F.array_sort(F.collect_set(F.when(F.col(c), F.col("field")))).alias(n) for c, n in (("conflict", "conflicts"), ("untrusted_conflict", "untrusted_conflicts"))]
    return fused.groupBy(key).agg(*wide, *sources, *lists)


def fill_missing(current: Column, source: Column, ladder: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """(value, source): a missing and unprotected value takes the first non-null of the ladder, with that step's name."""
    open_ = X.missing_for_fill(current) & ~protected(source)
    value, name = F.coalesce(*[v for _, v in ladder]), F.coalesce(*[F.when(v.isNotNull(), F.lit(n)) for n, v in ladder])
    take = open_ & value.isNotNull()
    return F.when(take, value).otherwise(current), F.when(take, name).otherwise(source)


def apply_corrections(df: DataFrame, text: str) -> DataFrame:
    """Manual corrections in a text column, the last one per field, overwrite fields whose vocabulary or format allows the value."""
    found = X.corrections(X.strip_injection(F.coalesce(F.col(text), F.lit(""))))
    out = df.withColumn("_c", found)

    def of(field: str) -> Column:
        return F.filter("_c", lambda s: s["field"] == field)

    for field in V.DEFAULTS:
        mine = of(field)
        value = F.when(F.size(mine) > 0, F.element_at(mine, -1)["value"])
        if field in ("species_code", "home_world", "visa_class", "declared_purpose", "fee_status"):
            ok = value.isin(*(V.FEES if field == "fee_status" else V.vocabulary(field)))
        elif field == "arrival_date":
            ok = X.plausible_date(value)
        elif field == "sponsor_id":
            ok = value.rlike("^SPN-[0-9]{4}$")
        else:
            ok = value.isNotNull()
        out = out.withColumn(field, F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.col(field)))
    return out.drop("_c")


def merge_flags(df: DataFrame, more: str, finding: str = "finding") -> DataFrame:
    """Union of allowed flags; nothing is added under an approval, nor conflicts of identity or sponsor where the biometrics are illegible."""
    illegible = F.array_contains("risk_flags", "illegible_biometrics") | F.array_contains(more, "illegible_biometrics")
    blocked = F.when(illegible, F.array(F.lit("identity_conflict"), F.lit("sponsor_mismatch"))).otherwise(F.array().cast("array<string>"))
    known = F.array(*[F.lit(f) for f in V.FLAGS])
    added = F.array_except(F.array_intersect(more, known), blocked)
    return df.withColumn("risk_flags", F.when(F.col(finding).eqNullSafe("APPROVED"), F.col("risk_flags")).otherwise(F.array_sort(F.array_union("risk_flags", added))))


def role_relations(df: DataFrame) -> DataFrame:
    """Flags that follow from the names in the roles intake, registry, biometric, sponsor and correction (columns, null if unseen).

    Intake against registry is an identity conflict, but illegible where they are two edits apart and no scan was seen.
    Where intake and registry agree, a sponsor letter or its correction for someone else is a sponsor mismatch. A redacted
    intake against a correction is an identity conflict, too.
    """
    c = F.col
    low = lambda x: F.lower(F.col(x))
    differ = low("intake") != low("registry")
    near = (F.levenshtein(low("intake"), low("registry")) <= 2) & c("biometric").isNull()
    off = F.lit(False)
    identity = F.coalesce(differ & ~near, off) | F.coalesce(X.damaged(c("intake")) & c("correction").isNotNull() & (low("intake") != low("correction")), off)
    mismatch = F.coalesce(~differ, off) & (F.coalesce(low("sponsor") != low("registry"), off) | F.coalesce(low("correction") != low("registry"), off))
    flags = [F.when(identity, "identity_conflict"), F.when(mismatch, "sponsor_mismatch"), F.when(F.coalesce(differ & near, off) & ~identity, "illegible_biometrics")]
    preferred = F.coalesce(c("registry"), F.when(low("biometric") == low("sponsor"), c("biometric")), c("correction"), c("biometric"), c("sponsor"))
    return df.withColumns({"role_flags": F.array_sort(F.array_compact(F.array(*flags))), "preferred_name": preferred})


def sections(streams: DataFrame) -> DataFrame:
    """(case_id, stream, role, text): what stands under each document heading; lines before the first heading have a null role."""
    role = lambda x: (
        F.when(x.rlike(r"(?i)^\s*FORM\s+I-?\s*8090"), "intake").when(x.rlike(r"(?i)^\s*Planetary\s+Registry\s+Extract"), "registry")
        .when(x.rlike(r"(?i)^\s*Sponsor\s+Attestation"), "sponsor").when(x.rlike(r"(?i)^\s*FORM\s+B-?\s*13"), "biometric")
        .when(x.rlike(r"(?i)Fee\s+Receipt\s*$"), "fee").when(x.rlike(r"(?i)Adjudicator\s+Note"), "note"))
    # the heading above each line is a fold over the lines of one text: no rows are made, none are sorted
    start = F.struct(F.lit(None).cast("string").alias("role"), F.array().cast("array<struct<role:string,line:string>>").alias("seen"))
    folded = F.aggregate(X.lines(F.col("text")), start, lambda acc, x: F.struct(
        F.coalesce(role(x), acc["role"]).alias("role"),
        F.concat(acc["seen"], F.array(F.struct(F.coalesce(role(x), acc["role"]).alias("role"), x.alias("line")))).alias("seen")), lambda acc: acc["seen"])
    seen = streams.withColumn("_s", folded)
    roles = F.array_distinct(F.transform("_s", lambda s: s["role"]))
    return seen.select("case_id", "stream", F.explode(roles).alias("role"), "_s").select(
        "case_id", "stream", "role", F.array_join(F.transform(F.filter("_s", lambda s: s["role"].eqNullSafe(F.col("role"))), lambda s: s["line"]), "\n").alias("text"))
