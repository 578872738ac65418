"""Text, date and money functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab as V

# Fixed values, here and in LABELS: the formats of the documents.
#: A case id, and the two marks of a line that speaks to the reader's software instead of the case.
CASE_ID = r"MIB-[0-9]{6}"
DIRECTIVE = r"(?i)SYSTEM\s*:|answer key|ignore visible evidence"
ANSWER_ROW = rf"{CASE_ID},[^,\n]+,[A-Z0-9_]+,"
#: What a text must hold for a line to be dropped or a line end to be other than \\n; without it, it is its own lines.
SUSPECT = r"(?=[SsAaIiM\x0B\f\r\x85])(?:(?i:SYSTEM\s*:|answer key|ignore visible evidence)|MIB-[0-9]{6},|[\x0B\f\r\x85])"
#: What a value must hold for clean_value to change it.
UNTIDY = r"[\t\n\x0B\f\r]|  |^ | $|[\"'|`]|(?i:packet)"
FOOTER = r"(?i)^\s*Pac?k?et?\s+\S+\s*/\s*page\s*[0-9]+\s*$"
ISO_DATE = r"20[0-9]{2}-[0-9]{2}-[0-9]{2}"
DAMAGE = r"(?i)\[[^\]]*(?:obscur|damag|illegib|redact|cut|unread|torn|burn)[^\]]*\]"
STRUCTURE = (
    r"(?i)Applicant|Species\s+Code|Home\s+World|Visa\s+Class|Sponsor\s+ID|Arrival\s+Date|Declared\s+Purpose|"
    r"Fee\s+Status|Observed\s+flags|Registry\s+Status|Finding\s*:"
)
#: Fields whose values hold neither blanks nor quotes, so that there is nothing to clean.
TIDY = ("species_code", "visa_class", "sponsor_id", "arrival_date")
LABELS = {
    "applicant_name": ("Applicant Name|Applicant|Registry Name", r"[^\n]+?"),
    "species_code": (r"Species\s+Code", r"[A-Z0-9_]+"),
    "home_world": (r"Home\s+World", r"[^\n]+?"),
    "visa_class": (r"Visa\s+Class", r"[A-Z0-9-]+"),
    "sponsor_id": (r"Sponsor\s+(?:ID|1D|I0|lD)", r"SPN-[0-9]{4}"),
    "arrival_date": (r"Arrival\s+Date", r"[0-9]{4}-[0-9]{2}-[0-9]{2}|UNREADABLE|N/?A|MISSING"),
    "declared_purpose": ("Declared Purpose|Purpose", r"[^\n]+?"),
    "fee_status": (r"Fee\s+Status", r"[A-Za-z\[\] ]+?"),
}


def lines(text: Column) -> Column:
    return F.split(text, r"\R")


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_value(text: Column) -> Column:
    """A field's value: squeezed, cut before page chrome, without quotes and bars at its ends."""
    cut = F.regexp_replace(squeeze(text), r"(?i)\s*Packet\s+\S+\s*/\s*page.*$", "")
    return F.when(~text.rlike(UNTIDY), text).otherwise(F.regexp_replace(cut, r"^[\"'|` ]+|[\"'|` ]+$", ""))


def is_injected(line: Column) -> Column:
    return line.rlike(DIRECTIVE) | line.rlike(ANSWER_ROW)


def plain(text: Column) -> Column:
    """No line is to be dropped and no line ends in other ways than \\n: the text is its lines as they stand."""
    return ~(text.rlike(SUSPECT) | text.contains("\u2028") | text.contains("\u2029"))


def strip_injection(text: Column) -> Column:
    """The text without the lines that are directives or rows of an answer key."""
    return F.when(plain(text), text).otherwise(F.array_join(F.filter(lines(text), lambda x: ~is_injected(x)), "\n"))


def injection_heavy(text: Column) -> Column:
    """At least 40 % of the lines are dropped, or some are and under 80 letters stay."""
    dropped = F.size(F.filter(lines(text), is_injected))
    left = F.length(F.regexp_replace(strip_injection(text), r"^\s+|\s+$", ""))
    heavy = (dropped / F.greatest(F.size(lines(text)), F.lit(1)) >= 0.4) | ((dropped > 0) & (left < 80))
    return F.when(plain(text), F.lit(False)).otherwise(heavy)


def structure_hits(text: Column) -> Column:
    """How often structural labels occur."""
    return F.regexp_count(text, F.lit(STRUCTURE))


def logical_pages(text: Column) -> Column:
    """Pages of a text: each ends with its footer line; without footers, blank lines part them. Empty ones are left out."""
    marked = F.array_join(F.transform(lines(text), lambda x: F.when(x.rlike(FOOTER), F.concat(x, F.lit("\f"))).otherwise(x)), "\n")
    has = F.exists(lines(text), lambda x: x.rlike(FOOTER))
    pages = F.when(has, F.split(marked, "\f")).otherwise(F.split(text, r"\n\s*\n"))
    return F.filter(F.transform(pages, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def label_values(text: Column, field: str) -> Column:
    """Cleaned values after a field's label at line starts, in order; a value ends at two spaces or at its line's end."""
    labels, value = LABELS[field]
    found = F.regexp_extract_all(text, F.lit(rf"(?im)^[ \t]*(?:{labels})(?:[ \t]*:[ \t]*|[ \t]+|[ \t]*\n[ \t]*)({value})(?:[ \t]{{2,}}|[ \t]*$)"), F.lit(1))
    return found if field in TIDY else F.filter(F.transform(found, clean_value), lambda x: x != "")


def windows_after(text: Column, label: str, radius: int) -> Column:
    """The texts of up to radius letters after each place where label (a literal, any case) ends; they may overlap."""
    parts = F.split(text, f"(?i){label}")
    tail = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.substring(F.array_join(F.slice(parts, i, F.size(parts)), label), 1, radius))
    return F.when(F.size(parts) > 1, tail).otherwise(F.array().cast("array<string>"))


def ngrams(line: Column, most: int = 3) -> Column:
    """Runs of one to most words of a line, by length then place."""
    words = F.filter(F.split(line, r"\s+"), lambda w: w != "")

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
        return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.concat(*[runs(n) for n in range(1, most + 1)])


def valid_date(text: Column) -> Column:
    """An ISO date that the calendar has."""
    return F.coalesce(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def plausible_date(text: Column) -> Column:
    return valid_date(text) & text.between(V.DATE_FROM, V.DATE_TO)


def iso_dates(text: Column) -> Column:
    """Plausible dates on lines that are neither footers nor directives, in order, repeats kept."""
    fit = F.filter(lines(text), lambda x: ~x.rlike(FOOTER) & ~is_injected(x) & ~x.rlike(rf"^\s*(?:Case ID\s*:?\s*)?{CASE_ID}"))
    return F.filter(F.flatten(F.transform(fit, lambda x: F.regexp_extract_all(x, F.lit(ISO_DATE), F.lit(0)))), plausible_date)


def unique_of(values: Column) -> Column:
    """The value if there is exactly one distinct one, else null."""
    distinct = F.array_distinct(values)
    return F.when(F.size(distinct) == 1, F.element_at(distinct, 1))


def repair_year(text: Column) -> Column:
    """Date glyphs: the year 2028 was 2026, and then the month 08 was 06."""
    return F.regexp_replace(F.regexp_replace(text, r"\b2028-08-", "2026-06-"), r"\b2028-", "2026-")


def money_cents(text: Column) -> Column:
    """Cents of the first amount like $809.00; null without one."""
    whole, part = F.regexp_extract(text, r"\$\s*([0-9]{1,12})(?:\.([0-9]{2}))?", 1), F.regexp_extract(text, r"\$\s*([0-9]{1,12})(?:\.([0-9]{2}))?", 2)
    return F.when(whole != "", whole.cast("long") * 100 + F.when(part == "", 0).otherwise(part.cast("long")))


def normalise_visa(text: Column) -> Column:
    """Dashes of all kinds become hyphens, and dots or underscores between a visa's letters and digit, too."""
    dashed = F.regexp_replace(F.upper(text), "[‐-―−]", "-")
    return F.regexp_replace(dashed, r"\b(XW|DIP|MED|TRANSIT)\s*[._ -]\s*([0-9])\b", "$1-$2")


def vocabulary_hits(text: Column, values: tuple[str, ...]) -> Column:
    """The values of a vocabulary that a text holds as whole words (any case), sorted."""
    hits = [F.when(text.rlike("(?i)(?<![A-Za-z0-9_-])" + "".join("\\" + c if not c.isalnum() else c for c in v) + "(?![A-Za-z0-9_-])"), F.lit(v)) for v in sorted(values)]
    return F.array_compact(F.array(*hits))


def flag_atoms(text: Column, values: tuple[str, ...] = V.FLAGS) -> Column:
    """Allowed flags in a list parted by commas, bars or semicolons; spaces and hyphens count as underscores; sorted."""
    atoms = F.transform(F.split(F.lower(text), r"[,|;]"), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"[\s-]+", "_"), "_+", "_"))
    return F.sort_array(F.array_distinct(F.filter(atoms, lambda x: x.isin(*values))))


def finding_of(text: Column) -> Column:
    """The last finding that isn't crossed out, else the last; null without one. Directive lines don't count."""
    fit = F.filter(lines(text), lambda x: x.rlike(r"(?i)\bFinding\s*:") & ~is_injected(x))
    said = F.transform(fit, lambda x: F.struct(
        F.regexp_replace(F.upper(F.regexp_extract(x, r"(?i)Finding\s*:\s*(APPROVED|DENIED|NEEDS[ _-]*REVIEW)", 1)), "[ _-]+", "_").alias("v"),
        x.rlike(r"(?i)superseded|crossed out|void").alias("crossed")))
    said = F.filter(said, lambda s: s["v"] != "")
    open_ = F.filter(said, lambda s: ~s["crossed"])
    found = F.when(F.size(open_) > 0, F.element_at(open_, -1)["v"]).when(F.size(said) > 0, F.element_at(said, -1)["v"])
    return F.when(text.rlike(r"(?i)\bFinding\s*:"), found)


def corrections(text: Column) -> Column:
    """Manual corrections as (field, value) structs in order: "Manual correction: Visa Class is XW-1."."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)Manual correction:\s*([A-Za-z ]+?) is ([^\n]+?)\.(?:\s|$)"), F.lit(0))
    return F.transform(found, lambda x: F.struct(
        F.regexp_replace(F.lower(F.regexp_extract(x, r"(?i)correction:\s*([A-Za-z ]+?) is ", 1)), " ", "_").alias("field"),
        F.regexp_extract(x, r"(?i) is ([^\n]+?)\.(?:\s|$)", 1).alias("value")))


def damaged(text: Column) -> Column:
    return F.coalesce(text.rlike(DAMAGE), F.lit(False))


# The six different notions of a missing value (they are not interchangeable).
def missing_by_policy(field: str, value: Column) -> Column:
    return F.coalesce(value, F.lit(V.DEFAULTS[field])) == V.DEFAULTS[field]


def missing_for_gate(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin("", "unknown", "n/a", "none", "null", "1900-01-01", "spn-0000") | damaged(value), F.lit(True))


def missing_for_channel(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin("", "unknown", "none") | damaged(value), F.lit(True))


def missing_for_fill(value: Column) -> Column:
    return F.coalesce(value.isin("", "unknown"), F.lit(True))


def missing_for_imputer(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin("", "unknown", "none", "n/a", "null"), F.lit(True))


def missing_for_rotation(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin("", "unknown", "n/a", "none", "null", "1900-01-01", "spn-0000"), F.lit(True))
