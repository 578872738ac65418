"""What the parts of a packet say in their roles: blocks by heading, and precedence among their assertions."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import text as X

# Headings by role, as the documents print them, and the labels of a form's fields.
HEADINGS = {
    "intake": r"FORM\s+I-?\s*8090", "registry": r"Planetary\s+Registry\s+Extract", "sponsor": r"Sponsor\s+Attestation", "biometric": r"FORM\s+B-?\s*13",
    "fee": r"(?:MIB\s+)?Fee\s+Receipt\s*$", "note": r"Manual\s+Adjudicator\s+Note",
}
DOMAIN_LABELS = r"(?im)^\s*(?:Applicant|Species|Home\s+World|Sponsor\s+ID|Arrival\s+Date|Declared\s+Purpose|Fee\s+Status)\b"
VISA_LINE = r"(?im)^\s*Visa(?:\s+Class)?\s*:?\s*([A-Z0-9-]{3,10})\s*$"
CLASS_OF_LETTER = r"(?i)(?:Visa\s+Class\s*:?\s*|class\s+)([A-Z]+-[0-9])\b"
MANUAL_VISA = r"(?i)Manual\s+correction\s*:\s*visa\s+class\s+is\s+([A-Z]+-[0-9])\b"
ROLE_SPONSOR = r"(?i)\bSponsor\s+S[PH][NIM1]-?([0-9]{4})\s+attests\b"
LABELLED_SPONSOR = r"(?i)Spons?\w{0,5}\s+(?:ID|1D|IU|D)\s*:?[ \t]*S[PH][NIM1]-?([0-9]{4})"
ANY_SPONSOR = r"\bSPN-([0-9]{4})\b"
#: A page without a heading and with so many labels at most corrects single fields.
CORRECTION_LABELS = 3
#: Order of precedence; a kind decides if all its assertions agree.
VISA_ORDER, SPONSOR_ORDER = ("manual", "standalone", "sponsor", "explicit"), ("role", "supplement", "global")


@F.udtf(returnType="page: int, role: string, block: string")
class RoleBlocks:
    """The parts of a text: pages end with their footer lines, blocks begin at headings; what stands before a page's first heading has no role. Blank parts are left out."""

    def __init__(self):
        self.footer = re.compile(X.FOOTER)
        self.headings = {role: re.compile(r"(?i)^\s*" + p) for role, p in HEADINGS.items()}

    def eval(self, text: str) -> Iterator[tuple[int, str | None, str]]:
        page, role, lines = 1, None, []
        for line in (text or "").splitlines():
            if self.footer.match(line):
                yield from self.part(page, role, lines)
                page, role, lines = page + 1, None, []
                continue
            found = next((r for r, p in self.headings.items() if p.match(line)), None)
            if found:
                yield from self.part(page, role, lines)
                role, lines = found, []
            lines.append(line)
        yield from self.part(page, role, lines)

    @staticmethod
    def part(page: int, role: str | None, lines: list[str]) -> Iterator[tuple[int, str | None, str]]:
        if any(x.strip() for x in lines):
            yield page, role, "\n".join(lines)


def blocks(streams: DataFrame) -> DataFrame:
    """streams (with text) beside each of their blocks: page, role, block. Directive lines are dropped first; texts without a block are left out."""
    clean = streams.withColumn("text", X.strip_injection(F.coalesce("text", F.lit(""))))
    return clean.lateralJoin(RoleBlocks(F.col("text").outer())).drop("text")


def nearest_visa(raw: Column) -> Column:
    """The only visa class at most one edit away from a token, letters and digits alone; null if there is none or the nearest are two."""
    plain = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    d = [F.levenshtein(plain(raw), F.lit(re.sub("[^A-Z0-9]", "", v))) for v in V.VISAS]
    least = F.least(*d)
    near = F.filter(F.array(*[F.when((x == least) & (least <= 1), v) for x, v in zip(d, V.VISAS)]), lambda v: v.isNotNull())
    return F.when(F.size(near) == 1, near[0])


def decided(found: DataFrame, keys: list[str], order: tuple[str, ...], name: str, *more: Column) -> DataFrame:
    """(keys, name, <name>_from, more aggregates): the value of the first kind in order whose assertions (keys, kind, value) all agree; null without one. One partial aggregate: sets hold two values at most."""
    kinds = {k: (F.min(F.when(F.col("kind") == k, F.col("value"))).alias(f"_a_{k}"), F.max(F.when(F.col("kind") == k, F.col("value"))).alias(f"_b_{k}")) for k in order}
    least = found.groupBy(*keys).agg(*[x for pair in kinds.values() for x in pair], *more)
    agreed = {k: F.col(f"_a_{k}") == F.col(f"_b_{k}") for k in order}
    return least.select(*keys, F.coalesce(*[F.when(ok, F.col(f"_a_{k}")) for k, ok in agreed.items()]).alias(name), F.coalesce(*[F.when(ok, k) for k, ok in agreed.items()]).alias(f"{name}_from"), *least.columns[len(keys) + 2 * len(order) :])


def _of(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def _assertions(parts: DataFrame, keys: list[str], *lists: Column) -> DataFrame:
    said = F.filter(F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<struct<kind:string,value:string>>")) for x in lists])), lambda s: s["value"].isNotNull())
    return parts.select(*keys, F.explode_outer(said).alias("_s")).select(*keys, "_s.kind", "_s.value")


def correction_page(block: Column) -> Column:
    return F.col("role").isNull() & (F.regexp_count(block, F.lit(DOMAIN_LABELS)) <= CORRECTION_LABELS)


def visa_precedence(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, visa_class, visa_class_from) from blocks(): a manual correction, else a correction page, else the sponsor's letter, else labelled lines, glyphs repaired; each only if it names one class."""
    block, none = F.col("block"), F.lit(None)
    known = lambda values: F.filter(F.transform(values, F.upper), lambda v: v.isin(*V.VISAS))
    exact = lambda pattern: known(F.regexp_extract_all(block, F.lit(pattern), F.lit(1)))
    lines = exact(VISA_LINE)
    hits = X.vocabulary_hits(block, V.VISAS)
    letter = F.array_distinct(F.concat(exact(CLASS_OF_LETTER), F.when(F.size(hits) == 1, hits).otherwise(F.array().cast("array<string>"))))
    read = F.transform(F.regexp_extract_all(block, F.lit(VISA_LINE), F.lit(1)), nearest_visa)
    return decided(_assertions(
        parts, keys, _of("manual", exact(MANUAL_VISA)), F.when(correction_page(block) & (F.size(F.array_distinct(lines)) == 1), _of("standalone", lines)).otherwise(none),
        F.when(F.col("role") == "sponsor", _of("sponsor", letter)).otherwise(none), _of("explicit", read),
    ), keys, VISA_ORDER, "visa_class")


def sponsor_ladder(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sponsor_id, sponsor_id_from, role_conflict) from blocks(): the id that attests in the letter, else that of correction pages, else the only labelled one. role_conflict: letter and intake form each name one id, and not the same."""
    block, none = F.col("block"), F.lit(None)
    ids = lambda pattern: F.transform(F.regexp_extract_all(block, F.lit(pattern), F.lit(1)), lambda d: F.concat(F.lit("SPN-"), d))
    role = F.when(F.col("role") == "sponsor", _of("role", ids(ROLE_SPONSOR))).otherwise(none)
    intake = F.when(F.col("role") == "intake", _of("intake", ids(LABELLED_SPONSOR))).otherwise(none)
    said = _assertions(parts, keys, role, intake, F.when(correction_page(block), _of("supplement", ids(ANY_SPONSOR))).otherwise(none), _of("global", ids(LABELLED_SPONSOR)))
    low, high = (lambda k, f=f: f(F.when(F.col("kind") == k, F.col("value"))) for f in (F.min, F.max))
    one = (low("role") == high("role")) & (low("intake") == high("intake"))
    return decided(said, keys, SPONSOR_ORDER, "sponsor_id", F.coalesce(one & (low("role") != low("intake")), F.lit(False)).alias("role_conflict"))
