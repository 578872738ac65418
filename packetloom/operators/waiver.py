"""Fee evidence from text: waiver codes, signed authorisations, and the ledger of a receipt.

Labels, cues and case ids become sorted intervals of their text; what holds for a label is said about the intervals in
a window around it. Each stream is judged on its own, and the first one in order of trust that says something decides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as X
from . import rules

# What is looked for, as the documents print it and as readers misread it.
PATTERNS = {
    "label": r"(?i)\bw[ao0][il1]v[ae]?r\s*c[o0]d[e3]\b",
    "case": r"\bMIB-\d{6}\b",
    "header": r"(?i)\bMIB\s*Fee\s*Receipt\b|\bFee\s*Receipt\b",
    "cue": r"(?i)\bAmount\b|\bFee\s*Status\b|\$\s*0\.00",
    "authorised": r"(?i)\b(?:hard\s*ship\s+waiv(?:er|ed)|waiv(?:er|ed)\s+authori[sz]ation|authori[sz]ation\s+to\s+waive(?:\s+fee)?|fee\s+waiv(?:er|ed)\s+authori[sz]ation)\b",
    "signed": r"(?i)\b(?:signed|signature|/s/|officer\s+sign|manual\s+correction)\b",
}
CODE = r"^[\s:.\-_'\"`|\]\[,“”‘’´]*([A-Za-z0-9][A-Za-z0-9\-_/]{0,28})"
DIP_SHAPE = r"^D[I1L]P-?W[A4][I1L]?V(?:ER|E|R)?$"
NULL_CODES = ("N/A", "NA", "NONE", "NULL", "-", "UNKNOWN", "N-A")
NOT_CODES = ("status", "fee", "amount", "case", "id")
STATUS = r"(?i)\bFee\s+Status\b\s*[:\n ]+\s*(paid|unpaid|waived|unknown)\b"
AMOUNT = r"(?i)\bAmount\b\s*[:\n ]+\s*\$?\s*([0-9]+)(?:\.([0-9]{2}))?"
FEE_UNKNOWN = r"(?is)Finding\s*:?\s*NEEDS[_ ]REVIEW.{0,220}?Reason\s*:?\s*Fee\s+status\s+unknown\b"
FEE_UNKNOWN_REASON = r"(?is)Reason\s*:?\s*Fee\s+status\s+unknown\b"
# Windows in letters before and after a label's start (foreign ids), its start and end (cues), an authorisation; a code's distance; a receipt's length.
FOREIGN, NEAR_LABEL, NEAR_AUTHORISATION, TAIL, RECEIPT = (350, 220), (280, 40), (200, 200), 160, 900
CODE_EDITS, CODE_SHARE, CODE_MARGIN = 3, 0.45, 0.5


def minus_edits(token: Column, code: str) -> Column:
    return -F.levenshtein(F.lower(token), F.lit(code.lower())).cast("double")


def waiver_code(raw: Column, score: Callable[[Column, str], Column] = minus_edits) -> Column:
    """DIP-WAIVER, N/A or null for a token beside the label: by spelling, by shape, else the better scored of the two codes that is near enough.

    DIP-WAIVER must lead by a margin and look like itself. score(token, code) may be that of a noisy channel.
    """
    token = F.replace(F.regexp_replace(F.upper(F.trim(raw)), "[_–—]", "-"), F.lit(" "), F.lit(""))
    shape = F.translate(token, "01|", "OII")
    d = {c: F.levenshtein(F.lower(token), F.lit(c.lower())) for c in ("DIP-WAIVER", "N/A")}
    fit = {c: F.when(~((x / F.greatest(F.length(token), F.lit(len(c))) > CODE_SHARE) & (x > CODE_EDITS)), score(token, c)) for c, x in d.items()}
    dip, none = fit["DIP-WAIVER"], fit["N/A"]
    looks = (token.contains("W") | token.contains("V")) & (F.levenshtein(F.substring(shape, 1, 3), F.lit("DIP")) <= 1)
    ahead = dip.isNotNull() & (none.isNull() | (dip >= none))
    return (
        F.when(token.isNull() | (token == ""), None).when(token.isin(*NULL_CODES), "N/A")
        .when((token == "DIP-WAIVER") | shape.rlike(DIP_SHAPE), "DIP-WAIVER")
        .when(ahead, F.when((none.isNull() | (dip - none > CODE_MARGIN)) & looks, "DIP-WAIVER")).when(none.isNotNull(), "N/A")
    )


def names_case(text: Column, case_id: Column) -> Column:
    """Whether a text names its case; texts of cases without a proper id do."""
    return ~F.coalesce(case_id.rlike(r"^MIB-[0-9]{6}$"), F.lit(False)) | text.contains(case_id)


def evidence(streams: DataFrame, text: str = "text", case: str = "case_id", score: Callable[[Column, str], Column] = minus_edits) -> DataFrame:
    """streams with code, implies_waived, via, raw, label_start, label_end: what each text (without directives) says of a waiver.

    A label counts if a code follows it, the receipt's heading stands in the text or a fee cue near it, and the case ids
    around it aren't all of other cases. Without such labels, a signed authorisation beside a fee cue implies a waiver.
    A text with both a waiver and its denial says nothing, nor does one that doesn't name its case. Null: nothing.
    """
    c, start = F.col, lambda s: s["start"]
    found = streams.withColumn("_t", F.when(names_case(c(text), F.coalesce(c(case), F.lit(""))), c(text)))
    # exploding one struct keeps the search from being repeated for every column that reads it
    found = found.withColumn("_x", F.explode(F.array(S.spans_of(c("_t"), PATTERNS))))
    x, headed = (lambda n: c("_x")[n]), F.size(c("_x")["header"]) > 0

    def foreign(s: Column) -> Column:
        ids = S.within(x("case"), start(s) - FOREIGN[0], start(s) + FOREIGN[1])
        proper = F.coalesce(c(case).rlike(r"^MIB-[0-9]{6}$"), F.lit(False))
        return proper & (F.size(ids) > 0) & ~F.exists(ids, lambda i: i["text"] == c(case))

    def paid_for(s: Column, near: tuple[int, int]) -> Column:
        lo, hi = start(s) - near[0], s["end"] + near[1]
        return headed | S.any_within(x("header"), lo, hi) | S.any_within(x("cue"), lo, hi)

    fit = F.filter(x("label"), lambda s: ~foreign(s) & paid_for(s, NEAR_LABEL))
    read = F.transform(fit, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.regexp_extract(F.substring(c("_t"), s["end"] + 1, F.lit(TAIL)), CODE, 1).alias("raw")))
    read = F.filter(read, lambda s: (s["raw"] != "") & ~F.lower(s["raw"]).isin(*NOT_CODES))
    hit = lambda s, code, raw, via: F.struct(code.alias("code"), (code != "N/A").alias("implies_waived"), F.lit(via).alias("via"), raw.alias("raw"), s["start"].alias("label_start"), s["end"].alias("label_end"))
    coded = F.filter(F.transform(read, lambda s: hit(s, waiver_code(s["raw"], score), s["raw"], "waiver_code")), lambda h: h["code"].isNotNull())
    allowed = F.filter(x("authorised"), lambda s: S.any_within(x("signed"), start(s) - NEAR_AUTHORISATION[0], s["end"] + NEAR_AUTHORISATION[1]) & paid_for(s, NEAR_AUTHORISATION) & ~foreign(s))
    granted = F.transform(allowed, lambda s: hit(s, F.lit("HARDSHIP-AUTH"), s["text"], "hardship_auth"))
    found = found.withColumn("_h", coded).withColumn("_h", F.when(F.size("_h") > 0, c("_h")).otherwise(granted))
    both = F.size(F.array_distinct(F.transform("_h", lambda h: h["implies_waived"]))) > 1
    first = F.when(~both, F.get("_h", F.lit(0)))
    return found.withColumn("_f", first).select(*streams.columns, "_f.code", F.coalesce("_f.implies_waived", F.lit(False)).alias("implies_waived"), "_f.via", "_f.raw", "_f.label_start", "_f.label_end")


def first_in_trust(df: DataFrame, keys: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """Per key the given columns of the row that comes first: one partial aggregate."""
    x = F.min(F.struct(*order, *columns)).alias("_x")
    return df.groupBy(*keys).agg(x).select(*keys, *[F.col(f"_x.{n}") for n in columns])


def clean(streams: DataFrame) -> DataFrame:
    return streams.withColumn("text", X.strip_injection(F.col("text")))


def waiver_gate(packets: DataFrame, streams: DataFrame, key: str = "case_id") -> DataFrame:
    """packets with fee_status and fee_source after the waivers that their streams (key, case_id, stream, trust, text) show, and positive_waiver_seen.

    The most trusted stream with a waiver decides. Fees corrected by hand stay. Packets without streams stay as they are.
    """
    shown = evidence(clean(streams)).where("implies_waived")
    first = first_in_trust(shown, [key], ["stream", "via"], ["trust"]).withColumnsRenamed({"stream": "_stream", "via": "_via"})
    by_hand = F.coalesce(F.col("fee_source").contains("manual"), F.lit(False))
    take = F.col("_stream").isNotNull() & ~by_hand & ~F.col("fee_status").eqNullSafe("waived")
    out = packets.join(first, key, "left")
    return out.withColumns({
        "fee_status": F.when(take, "waived").otherwise(F.col("fee_status")),
        "fee_source": F.when(take, F.concat_ws(":", F.lit("waiver"), "_stream", "_via")).otherwise(F.col("fee_source")),
        "positive_waiver_seen": F.col("_stream").isNotNull(),
    }).drop("_stream", "_via")


def receipts(streams: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, stream, trust, place, status, cents, code): what stands within a receipt's length after each heading; the text names its case."""
    named = clean(streams).where(names_case(F.col("text"), F.coalesce("case_id", F.lit(""))))
    heads = named.withColumn("_h", F.explode(S.spans_of(F.col("text"), {"header": PATTERNS["header"]})["header"]))
    part = heads.select(key, "stream", "trust", F.lit("").alias("case_id_"), F.col("_h.start").alias("place"), F.substring("text", F.col("_h.start") + 1, F.lit(RECEIPT)).alias("window"))
    read = evidence(part, "window", "case_id_")
    whole, part = F.regexp_extract("window", AMOUNT, 1), F.regexp_extract("window", AMOUNT, 2)
    cents = F.when(whole != "", F.expr("try_cast(regexp_extract(window, '%s', 1) as bigint)" % AMOUNT.replace("\\", "\\\\")) * 100 + F.when(part == "", 0).otherwise(part.cast("long")))
    return read.select(key, "stream", "trust", "place", F.lower(F.regexp_extract("window", STATUS, 1)).alias("status"), cents.alias("cents"), "code")


def ledger_gate(packets: DataFrame, streams: DataFrame, key: str = "case_id") -> DataFrame:
    """packets with fee_status and fee_source after what their receipts say as a whole: status, amount and code together.

    A note that the fee is unknown comes first; fees corrected by hand stay; then the first telling receipt in order of
    trust and place decides. visa_class and finding are read from packets.
    """
    c = F.col
    noted = clean(streams).where(names_case(c("text"), F.coalesce("case_id", F.lit(""))))
    noted = noted.select(key, "stream", "trust", c("text").rlike(FEE_UNKNOWN).alias("_sure"), c("text").rlike(FEE_UNKNOWN_REASON).alias("_reason")).where("_sure or _reason")
    noted = noted.groupBy(key).agg(F.min(F.when(c("_sure"), F.struct("trust", "stream"))).alias("_sure"), F.min(F.when(c("_reason"), F.struct("trust", "stream"))).alias("_reason"))
    told = receipts(streams, key).where("status <> '' and cents is not null and code is not null")
    told = told.join(packets.select(key, c("visa_class").alias("_visa")), key)
    told = told.withColumn("value", rules.fee_ledger(c("status"), c("cents"), c("code"), F.coalesce(F.upper("_visa"), F.lit("")))).where("value is not null")
    first = first_in_trust(told, [key], ["stream", "value"], ["trust", "place"]).withColumnsRenamed({"stream": "_stream", "value": "_value"})
    out = packets.join(noted, key, "left").join(first, key, "left")
    note = F.least(c("_sure"), F.when(c("finding") == "NEEDS_REVIEW", c("_reason")))
    by_hand = F.coalesce(c("fee_source").contains("manual"), F.lit(False))
    take = ~by_hand & c("_value").isNotNull()
    return out.withColumns({
        "fee_status": F.when(note.isNotNull(), "unknown").when(take, c("_value")).otherwise(c("fee_status")),
        "fee_source": F.when(note.isNotNull(), F.concat_ws(":", F.lit("manual_note"), note["stream"])).when(take, F.concat_ws(":", F.lit("ledger"), "_stream")).otherwise(c("fee_source")),
    }).drop("_sure", "_reason", "_stream", "_value")
