"""The escalation chain: costlier readings only for the packets that still need them, then flags that come late.

Stages are data: a gate over the packet's state, an engine that reads, and the columns that change. An engine is a
function from the content column to a text column; outside the gate it gets null, so rows stay where they are: no join,
no shuffle, and the engine's work is that of the gated rows. Later stages see what the earlier ones left.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import text as X
from ..sources.files import ENOUGH_HITS
from . import rules
from .fusion import field_values, protected

Engine = Callable[[Column], Column]

FIELDS = tuple(V.DEFAULTS)
CLOSED = ("species_code", "home_world", "visa_class", "declared_purpose", "fee_status")
# The line of observed flags, how it says that there are none, and headings of notes as readers misread them.
OBSERVED = r"(?im)^[ \t]*observ\w{0,4}\s+flags?[ \t]*[:\-]?[ \t]*([^\n]*)$"
OBSERVED_NONE = r"(?i)^\s*(?:none|n/?a|null|clear)\b"
NOTE_HEADING = r"(?im)^\s*(?:manual\s+)?adjudicator\s+(?:note|nore|nate|stamp)\b"
FEE_WORD = r"(?i)\bfee\b"
ROLE_HEADINGS = {"biometric": r"(?i)FORM\s+B-?\s*13", "fee": r"(?i)Fee\s+Receipt", "intake": r"(?i)FORM\s+I-?\s*8090", "registry": r"(?i)Planetary\s+Registry\s+Extract"}
SEVERE, CHANNEL_EDITS = 3, 2


@dataclass(frozen=True)
class Stage:
    """Rows where gate holds take the new values.

    With an engine, `_read` holds what it read there (directives dropped), `_flags` the flags told, `_all` all values of each
    field, `_got` the first ones of the fields in change. `_once` holds what once gives there: a value that several changes use.
    """

    name: str
    gate: Column
    change: dict[str, Column] = field(default_factory=dict)
    engine: str | None = None
    once: Column | None = None


@dataclass(frozen=True)
class Override:
    """Where `when` holds, the flags become these."""

    name: str
    when: Column
    flags: Column


def _empty() -> Column:
    return F.array().cast("array<string>")


def apart(holds: Column) -> Column:
    """The condition, and its projection is compiled in pieces: as one method of over 8,000 bytes the JVM would only interpret it."""
    return F.exists(F.array(holds), lambda x: x)


def _fence(value: Column) -> Column:
    """The value, in a projection that the optimizer doesn't merge with those around it: nine stages written into each other would grow beyond bounds.

    Not for structs: their fields are pushed below the fence one by one, and each works out the whole struct again. Arrays stay whole.
    """
    return F.when(apart(F.rand(0) >= 0), value)


def texts_of(*names: str) -> Column:
    """The texts of these readings, in order, one after the other; all of them without names."""
    return F.array_join(F.map_values("texts"), "\n") if not names else F.concat_ws("\n", *[F.col("texts")[n] for n in names])


def _held(*values: Column) -> Column:
    """These different values without nulls. Not by array_compact, under which nothing is compiled."""
    return F.array_except(F.array(*values), F.array(F.lit(None).cast("string")))


def open_fields() -> Column:
    """How many fields are missing."""
    return sum((X.missing_for_gate(F.col(f)).cast("int") for f in FIELDS[1:]), X.missing_for_gate(F.col(FIELDS[0])).cast("int"))


def undecoded(text: Column, name: str) -> Column:
    """The field is missing although its label stands in the text: what follows wasn't decoded."""
    return X.missing_for_gate(F.col(name)) & text.rlike(rf"(?im)^[ \t]*(?:{X.LABELS[name][0]})") & (F.size(field_values(text, name)) == 0)


def flags_undecoded(text: Column) -> Column:
    said = F.regexp_extract(text, OBSERVED, 1)
    return (F.size("risk_flags") == 0) & text.rlike(OBSERVED) & ~said.rlike(OBSERVED_NONE) & (F.size(X.flag_atoms(said)) == 0)


def _filled(names: tuple[str, ...], source: str) -> dict[str, Column]:
    """Missing fields that nobody protects take what was read, under this source."""
    takes = {n: X.missing_for_gate(F.col(n)) & F.col(f"_got.{n}").isNotNull() & ~protected(F.col(f"sources.{n}")) for n in names}
    sources = F.struct(*[(F.when(takes[n], F.lit(source)).otherwise(F.col(f"sources.{n}")) if n in takes else F.col(f"sources.{n}")).alias(n) for n in FIELDS])
    return {n: F.when(t, F.col(f"_got.{n}")).otherwise(F.col(n)) for n, t in takes.items()} | {"sources": sources}


def _flags_read() -> dict[str, Column]:
    said = F.regexp_extract("_read", OBSERVED, 1)
    atoms = F.coalesce("_flags", _empty())
    told = F.coalesce((F.size(atoms) > 0) | (F.col("_read").rlike(OBSERVED) & said.rlike(OBSERVED_NONE)), F.lit(False))
    return {"risk_flags": F.sort_array(F.array_union("risk_flags", atoms)), "observed_flags_seen": F.col("observed_flags_seen") | told}


def _disagreeing() -> Column:
    """Fields that were found before and of which the text has another value."""
    return _held(*[F.when((F.col(f"_got.{f}") != F.col(f)) & ~X.missing_for_gate(F.col(f)), F.lit(f)) for f in FIELDS])


def _several() -> Column:
    """Fields that are missing and of which the text has several values."""
    return _held(*[F.when(_differ(f) & X.missing_for_gate(F.col(f)), F.lit(f)) for f in FIELDS])


def _values(text: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """All values of each field in a text, null for others than these."""
    return F.array(*[field_values(text, f) if f in fields else F.lit(None).cast("array<string>") for f in FIELDS])


def _all(name: str) -> Column:
    return F.get("_all", F.lit(FIELDS.index(name)))


def _differ(name: str) -> Column:
    """The text has several values of a field."""
    return (F.size(_all(name)) > 1) & (F.size(F.array_distinct(_all(name))) > 1)


def _agreed_sponsor(filled: dict[str, Column]) -> dict[str, Column]:
    """A sponsor that the engine reads and an earlier reading has, too, outweighs another one that nobody protects."""
    mine = F.col("_got.sponsor_id")
    take = F.coalesce(F.array_contains(X.label_values(texts_of(), "sponsor_id"), mine) & (mine != F.col("sponsor_id")) & ~protected(F.col("sources.sponsor_id")), F.lit(False))
    sources = filled["sources"].withField("sponsor_id", F.when(take, "consensus").otherwise(filled["sources"]["sponsor_id"]))
    return filled | {"sponsor_id": F.when(take, mine).otherwise(filled["sponsor_id"]), "sources": sources}


def _channel_open(name: str) -> Column:
    return X.missing_for_channel(F.col(name)) & ~protected(F.col(f"sources.{name}"))


def _nearest() -> Column:
    """Of each closed field that is still open, the vocabulary's value near what all readings print after the label, if that is one value."""
    def nearest(field: str) -> Column:
        def near(raw: Column) -> Column:
            scored = F.sort_array(F.array(*[F.struct(F.levenshtein(F.lower(raw), F.lit(v.lower())).alias("d"), F.lit(v).alias("v")) for v in V.vocabulary(field)]))
            return F.when((scored[0]["d"] <= CHANNEL_EDITS) & (scored[0]["d"] < scored[1]["d"]), scored[0]["v"])

        printed = F.array_distinct(F.flatten(F.transform(F.map_values("texts"), lambda text: X.label_values(text, field))))
        return X.unique_of(F.array_compact(F.transform(printed, near)))

    return F.array(*[F.when(_channel_open(f), nearest(f)) for f in CLOSED])


def _by_channel() -> dict[str, Column]:
    """Closed fields still open take the value that `_nearest` found."""
    values = {f: F.get("_once", F.lit(i)) for i, f in enumerate(CLOSED)}
    takes = {f: values[f].isNotNull() for f in CLOSED}
    sources = F.struct(*[(F.when(takes[f], "channel").otherwise(F.col(f"sources.{f}")) if f in takes else F.col(f"sources.{f}")).alias(f) for f in FIELDS])
    return {f: F.when(takes[f], values[f]).otherwise(F.col(f)) for f in CLOSED} | {"sources": sources}


def default_stages() -> list[Stage]:
    """The nine stages in order; a stage whose engine isn't given is left out."""
    c = F.col
    seen = texts_of("native", "page_ocr", "embedded_ocr")
    native = F.lower(F.coalesce(c("texts")["native"], F.lit("")))
    thin = ~(native.contains("fee status") & native.contains("visa class")) | (X.structure_hits(native) < ENOUGH_HITS)
    ocr = texts_of("page_ocr", "embedded_ocr")
    more = texts_of("page_ocr", "embedded_ocr", "threshold_ocr")
    critical = F.array(*[F.lit(f) for f in FIELDS])
    inner = (F.size("conflicts") + F.size("untrusted_conflicts") > 0) & (F.size(F.array_intersect(F.array_union("conflicts", "untrusted_conflicts"), critical)) > 0)
    some_open = _channel_open(CLOSED[0])
    for f in CLOSED[1:]:
        some_open = some_open | _channel_open(f)
    read_page = _filled(FIELDS, "page_ocr") | _flags_read() | {
        "finding": F.coalesce("finding", X.finding_of(c("_read"))),
        "conflicts": F.sort_array(F.array_union("conflicts", F.coalesce(_several(), _empty()))),
        "untrusted_conflicts": F.sort_array(F.array_union("untrusted_conflicts", F.coalesce(_disagreeing(), _empty()))),
    }
    absent = {"fee_status": rules.absent_fee(c("fee_status"), F.lit(False)), "fee_imputed": F.lit(True), "sources": c("sources").withField("fee_status", F.lit("absent"))}
    return [
        Stage("page", thin, read_page, "page_ocr"),
        Stage("threshold", undecoded(ocr, "visa_class") | undecoded(ocr, "declared_purpose") | flags_undecoded(ocr), _filled(("visa_class", "declared_purpose"), "threshold_ocr") | _flags_read(), "threshold_ocr"),
        Stage("best", undecoded(more, "declared_purpose") | flags_undecoded(more), _filled(("declared_purpose",), "best_ocr") | _flags_read(), "best_ocr"),
        Stage("neural", (open_fields() > 0) | inner, _agreed_sponsor(_filled(FIELDS, "neural_ocr")) | _flags_read(), "neural_ocr"),
        Stage("embedded", open_fields() >= SEVERE, _filled(FIELDS, "embedded_neural_ocr") | {"finding": F.coalesce("finding", X.finding_of(c("_read")))}, "embedded_neural_ocr"),
        Stage("channel", some_open, _by_channel(), once=_nearest()),
        Stage("absent_fee", X.missing_for_fill(c("fee_status")) & ~texts_of().rlike(FEE_WORD), absent),
        Stage("legibility", ~c("observed_flags_seen"), _flags_read() | {"illegible": F.coalesce(F.trim(F.lower("_read")) == "illegible", F.lit(False))}, "legibility"),
        Stage("note", c("finding").isNull() & (seen.rlike(NOTE_HEADING) | texts_of("threshold_ocr", "best_ocr").rlike(NOTE_HEADING)), {"finding": X.finding_of(c("_read"))}, "note"),
    ]


def start(packets: DataFrame, engine: Engine, content: str = "content") -> DataFrame:
    """packets with the state that the stages read and change, after the native reading.

    Added: the eight fields (null where nothing was found), sources (a struct, by field), risk_flags, observed_flags_seen,
    finding, conflicts, untrusted_conflicts, fee_imputed, illegible, texts (a map, by reading), stages (names, in order),
    injection_heavy and trusted_text_chars. Columns of these names are replaced; null contents read as empty texts.
    """
    raw = F.coalesce(engine(F.col(content)), F.lit(""))
    df = packets.withColumn("_raw", _fence(raw)).withColumn("_read", _fence(X.strip_injection(F.col("_raw")))).withColumns({"_all": _fence(_values(F.col("_read"))), "_flags": _fence(X.flag_atoms(F.regexp_extract("_read", OBSERVED, 1)))})
    first = {f: F.get(_all(f), F.lit(0)) for f in FIELDS}
    said = F.regexp_extract("_read", OBSERVED, 1)
    several = _held(*[F.when(_differ(f), F.lit(f)) for f in FIELDS])
    df = df.withColumns(first | {
        "sources": F.struct(*[F.when(first[f].isNotNull(), "native").alias(f) for f in FIELDS]),
        "risk_flags": F.col("_flags"), "observed_flags_seen": (F.size("_flags") > 0) | (F.col("_read").rlike(OBSERVED) & said.rlike(OBSERVED_NONE)),
        "finding": X.finding_of(F.col("_read")), "conflicts": F.sort_array(several), "untrusted_conflicts": _empty(),
        "fee_imputed": F.lit(False), "illegible": F.lit(False), "texts": F.create_map(F.lit("native"), F.col("_read")), "stages": _empty(),
        "injection_heavy": X.injection_heavy(F.col("_raw")), "trusted_text_chars": F.length("_read"),
    })
    return df.drop("_raw", "_read", "_all", "_flags")


def escalate(state: DataFrame, engines: dict[str, Engine], stages: list[Stage] | None = None, content: str = "content", counts: Observation | None = None) -> DataFrame:
    """The state after all stages. counts, if given, holds after an action how many packets there were (`packets`) and how many each stage took.

    An engine that reads nothing (null or blank) leaves a packet as it was, but for its entry in stages.
    """
    stages = [s for s in (default_stages() if stages is None else stages) if s.engine is None or s.engine in engines]
    for s in stages:
        gated = state.withColumn("_gate", _fence(F.coalesce(s.gate, F.lit(False))))
        read = F.lit(None).cast("string")
        if s.engine:
            read = engines[s.engine](F.when(F.col("_gate"), F.col(content)))
        gated = gated.withColumn("_text", read).withColumn("_read", F.when(F.col("_gate") & (F.trim("_text") != ""), X.strip_injection(F.col("_text"))))
        if s.engine:
            used, some = tuple(f for f in FIELDS if f in s.change), F.col("_read").isNotNull()
            flags = X.flag_atoms(F.regexp_extract("_read", OBSERVED, 1))
            gated = gated.withColumns({"_all": _fence(F.when(some, _values(F.col("_read"), used))), "_flags": _fence(F.when(some, flags))})
            if used:
                gated = gated.withColumn("_got", F.struct(*[F.get(_all(f), F.lit(0)).alias(f) for f in used]))
        if s.once is not None:
            gated = gated.withColumn("_once", _fence(F.when(F.col("_gate"), s.once)))
        takes = F.col("_read").isNotNull() if s.engine else F.col("_gate")
        change = {n: F.when(takes, v).otherwise(F.col(n)) for n, v in s.change.items()}
        if "sources" in s.change:  # field by field, as what reads one field needn't make the others
            change["sources"] = F.struct(*[F.when(takes, s.change["sources"][f]).otherwise(F.col(f"sources.{f}")).alias(f) for f in FIELDS])
        if s.engine:
            change["texts"] = F.when(takes, F.map_concat("texts", F.create_map(F.lit(s.engine), F.col("_read")))).otherwise(F.col("texts"))
        change["stages"] = F.when(apart(F.col("_gate")), F.array_append("stages", F.lit(s.name))).otherwise(F.col("stages"))
        state = gated.withColumns(change).drop("_gate", "_text", "_read", "_all", "_flags", "_got", "_once")
    if counts is not None:
        state = state.observe(counts, F.count(F.lit(1)).alias("packets"), *[F.count_if(F.array_contains("stages", s.name)).alias(s.name) for s in stages])
    return state


def evidence(state: DataFrame) -> DataFrame:
    """The state with the columns that the rules read besides: sources by role, three sources, observed_none."""
    state, body = state.withColumn("_body", _fence(texts_of())), F.col("_body")
    roles = [F.when(F.col("finding").isNotNull(), F.lit("adjudicator")), *[F.when(body.rlike(p), F.lit(r)) for r, p in ROLE_HEADINGS.items()]]
    df = state.withColumns({
        "sources_seen": _held(*roles), "visa_source": F.col("sources.visa_class"), "arrival_source": F.col("sources.arrival_date"), "fee_source": F.col("sources.fee_status"),
        "observed_none": F.col("observed_flags_seen") & (F.size("risk_flags") == 0), "stages": _fence(F.col("stages")), "biometric_seen": body.rlike(ROLE_HEADINGS["biometric"]),
    })
    df = df.drop("_body")
    return df if "positive_waiver_seen" in df.columns else df.withColumn("positive_waiver_seen", F.lit(False))


#: Marks of the visual detectors and of damage, each a boolean column; absent or null ones say nothing.
MARKS = ("embargo_triangle", "red_seal", "occluded_red_seal", "damage_illegible", "portrait_obscured", "review_asserted", "raster_damage")


def default_overrides() -> list[list[Override]]:
    """Groups in order; of a group the first that holds applies, and later groups see its flags."""
    c, flags = F.col, F.col("risk_flags")
    is_ = lambda *names: flags == F.array(*[F.lit(n) for n in names])
    plus = lambda name: F.array_sort(F.array_union(flags, F.array(F.lit(name))))
    none, unseen = F.size(flags) == 0, ~c("observed_flags_seen")
    legible = ~F.array_contains(flags, "illegible_biometrics")
    return [
        [Override("embargo_subtype", is_("biohazard_red") & unseen & c("embargo_triangle"), F.array(F.lit("planetary_embargo")))],
        [
            Override("approved_note", c("finding") == "APPROVED", _empty()),
            Override("red_seal", none & unseen & c("red_seal"), F.array(F.lit("biohazard_red"), F.lit("illegible_biometrics"))),
            Override("occluded_seal", none & unseen & c("occluded_red_seal"), F.array(F.lit("biohazard_red"))),
            Override("illegible", c("illegible"), plus("illegible_biometrics")),
            Override("damage", c("damage_illegible"), plus("illegible_biometrics")),
            Override("portrait", none & c("portrait_obscured"), F.array(F.lit("illegible_biometrics"))),
            Override("review_asserted", c("review_asserted") & ~rules.some(flags, V.REVIEW_ONLY), plus("illegible_biometrics")),
        ],
        [Override("raster", legible & unseen & ~F.array_contains("overrides", "occluded_seal") & (is_("planetary_embargo") | is_("biohazard_red")) & c("raster_damage"), plus("illegible_biometrics"))],
    ]


def apply_overrides(df: DataFrame, groups: list[list[Override]] | None = None) -> DataFrame:
    """risk_flags after the overrides, and their names in `overrides`; then the decision is made again where a disqualifying flag came late."""
    df = df.withColumns({m: F.coalesce(F.col(m), F.lit(False)) if m in df.columns else F.lit(False) for m in (*MARKS, "illegible")} | {"overrides": _empty()})
    for group in default_overrides() if groups is None else groups:
        hit = F.coalesce(*[F.when(o.when, F.lit(i)) for i, o in enumerate(group)])
        of = lambda values: F.coalesce(*[F.when(F.col("_hit") == i, v) for i, v in enumerate(values)])
        df = df.withColumn("_hit", _fence(hit)).withColumns({
            "risk_flags": F.coalesce(of([o.flags for o in group]), F.col("risk_flags")),
            "overrides": F.when(F.col("_hit").isNotNull(), F.array_append("overrides", of([F.lit(o.name) for o in group]))).otherwise(F.col("overrides")),
        }).drop("_hit")
    return rules.reconcile_late_flags(df)


def resolve(packets: DataFrame, engines: dict[str, Engine], content: str = "content", counts: Observation | None = None) -> DataFrame:
    """The whole chain: native reading, stages, decision, late flags. engines needs `native`; other columns of packets stay."""
    state = escalate(start(packets, engines["native"], content), engines, None, content, counts)
    return apply_overrides(rules.adjudicate(evidence(state)))
