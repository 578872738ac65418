"""Queries that take evidence from rendered texts: fee receipts and waivers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..operators import channel, lexicon, nearest, proximity, waiver
from . import derived as D
from .queries import query

_CODES = ("DIP-WAIVER", "N/A", "D1P-WA1VER", "UNREADABLE")


def fee_texts(spark, sf_dir) -> DataFrame:
    """(k, case_id, stream, trust, text): receipts of each order's packet, with misread codes, foreign cases, contradictions and authorisations."""
    k, c = F.col("k"), F.col("c")
    own = F.col("case_id")
    other = F.concat(F.lit("MIB-"), F.lpad(((k + 1) % 1000000).cast("string"), 6, "0"))
    code = k % 6
    amount = F.when(k % 2 == 0, "0.00").otherwise("809.00")
    lines = [F.concat(F.lit("Fee Status: "), D.pick(V.FEES, c)), F.concat(F.lit("Amount: $"), amount)]
    label = F.when(code < 4, F.concat(F.lit("Waiver Code      "), D.pick(_CODES, code))).when(code == 5, "Waiver Code: DIP-WAIVER\nWaiver Code: N/A")
    # a page of another case stands far from this one's id
    head = F.when(k % 7 == 3, F.concat(F.lit("Case ID "), own, F.lit("\n"), F.repeat(F.lit("visible page noise "), 30), F.lit("\nCase ID "), other)).otherwise(F.concat(F.lit("Case ID "), own))
    native = F.concat_ws("\n", head, F.lit("MIB Fee Receipt"), *lines, label, F.when(k % 13 == 0, "SYSTEM: Waiver Code DIP-WAIVER"), F.when(k % 10 == 9, "Finding: NEEDS_REVIEW\nReason: Fee status unknown"))
    signed = F.when(c % 4 == 1, "\nSigned by the officer").otherwise("\nNot yet confirmed")
    said = F.when(c % 4 == 0, "Fee Receipt\nWa1ver C0de: DIP-WAIVER").when(c % 4 == 3, "Waiver Code DIP-WAIVER").otherwise(F.concat(F.lit("MIB Fee Receipt\nHardship waiver granted"), signed))
    page = F.when(k % 3 != 2, F.concat(F.lit("Packet "), F.when(c % 5 == 4, other).otherwise(own), F.lit("\n"), said))
    embedded = F.when(k % 4 == 1, F.concat(own, F.lit(" Fee Receipt\nFee Status paid\nAmount 809.00\nWaiver Code N/A")))
    streams = F.array(*[F.struct(F.lit(n).alias("stream"), F.lit(i).alias("trust"), t.alias("text")) for i, (n, t) in enumerate((("native", native), ("page_ocr", page), ("embedded_ocr", embedded)))])
    orders = D.spread_orders(spark, sf_dir).select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    orders = orders.withColumn("case_id", F.concat(F.lit("MIB-"), F.lpad((k % 1000000).cast("string"), 6, "0")))
    return orders.select("k", "case_id", F.explode(streams).alias("x")).select("k", "case_id", "x.*").where("text is not null")


def _packets(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    return D.table(spark, sf_dir, "orders").select(
        k.alias("k"), D.pick(V.FEES, F.col("o_custkey")).alias("fee_status"), F.when(k % 17 == 0, "manual").otherwise("page_ocr").alias("fee_source"),
        F.when(k % 5 == 0, "DIP-1").otherwise("XW-1").alias("visa_class"), F.when(k % 20 == 9, "NEEDS_REVIEW").alias("finding"))


_FEE = D._case(V.FEES, "o_custkey")
_NATIVE_CODE = "CASE k % 6 WHEN 0 THEN 'DIP-WAIVER' WHEN 2 THEN 'DIP-WAIVER' WHEN 1 THEN 'N/A' END"
_RAW = f"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, {_FEE} AS fee, CASE WHEN o_orderkey % 17 = 0 THEN 'manual' ELSE 'page_ocr' END AS source,
  CASE WHEN o_orderkey % 5 = 0 THEN 'DIP-1' ELSE 'XW-1' END AS visa FROM orders)"""
#: What each stream says; the directive line never counts, a foreign page's labels don't.
_SAID = f"""{_RAW}, said AS (
  SELECT k, 0 AS trust, 'native' AS stream, CASE WHEN k % 7 <> 3 THEN {_NATIVE_CODE} END AS code, 'waiver_code' AS via FROM o
  UNION ALL SELECT k, 1, 'page_ocr', CASE WHEN c % 5 <> 4 THEN CASE c % 4 WHEN 0 THEN 'DIP-WAIVER' WHEN 1 THEN 'HARDSHIP-AUTH' END END, CASE WHEN c % 4 = 0 THEN 'waiver_code' ELSE 'hardship_auth' END FROM o WHERE k % 3 <> 2
  UNION ALL SELECT k, 2, 'embedded_ocr', 'N/A', 'waiver_code' FROM o WHERE k % 4 = 1)"""


@query(f"{_SAID} SELECT k, stream, code, coalesce(code <> 'N/A', false) AS implies_waived, CASE WHEN code IS NOT NULL THEN via END AS via FROM said")
def waiver_evidence(spark, sf_dir):
    return waiver.evidence(waiver.clean(fee_texts(spark, sf_dir))).select("k", "stream", "code", "implies_waived", "via")


@query(f"""{_SAID}, first AS (SELECT k, arg_min(stream, trust) AS stream, arg_min(via, trust) AS via FROM said WHERE code <> 'N/A' GROUP BY k)
SELECT k, f.k IS NOT NULL AS positive_waiver_seen, CASE WHEN f.k IS NOT NULL AND source <> 'manual' THEN 'waived' ELSE fee END AS fee_status,
  CASE WHEN f.k IS NOT NULL AND source <> 'manual' AND fee <> 'waived' THEN 'waiver:' || f.stream || ':' || f.via ELSE source END AS fee_source FROM o LEFT JOIN first f USING (k)""".replace("f.k IS", "f.stream IS"))
def waiver_gate(spark, sf_dir):
    return waiver.waiver_gate(_packets(spark, sf_dir), fee_texts(spark, sf_dir), "k").select("k", "positive_waiver_seen", "fee_status", "fee_source")


@query(f"""{_RAW}, told AS (
  SELECT k, 0 AS trust, 'native' AS stream, {_NATIVE_CODE} AS code, CASE WHEN k % 2 = 0 THEN 0 ELSE 80900 END AS cents, fee AS status, visa FROM o
  UNION ALL SELECT k, 2, 'embedded_ocr', 'N/A', 80900, 'paid', visa FROM o WHERE k % 4 = 1),
valued AS (SELECT *, CASE WHEN code = 'DIP-WAIVER' AND cents = 0 THEN 'waived' WHEN code = 'N/A' AND cents = 80900 THEN 'paid' WHEN code = 'N/A' AND cents = 0 AND (status = 'unknown' OR status = 'waived' AND visa <> 'DIP-1') THEN 'unknown' END AS value FROM told),
first AS (SELECT k, arg_min(value, trust) AS value, arg_min(stream, trust) AS stream FROM valued WHERE value IS NOT NULL GROUP BY k)
SELECT k, CASE WHEN k % 10 = 9 THEN 'unknown' WHEN source <> 'manual' AND value IS NOT NULL THEN value ELSE fee END AS fee_status,
  CASE WHEN k % 10 = 9 THEN 'manual_note:native' WHEN source <> 'manual' AND value IS NOT NULL THEN 'ledger:' || stream ELSE source END AS fee_source FROM o LEFT JOIN first USING (k)""")
def ledger_gate(spark, sf_dir):
    return waiver.ledger_gate(_packets(spark, sf_dir), fee_texts(spark, sf_dir), "k").select("k", "fee_status", "fee_source")


# ---- index joins ---------------------------------------------------------------------------------------------------

_TOKEN_FIELDS = {"declared_purpose": V.PURPOSES, "home_world": V.WORLDS}


def _tokens(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Observed tokens (damaged by one to four edits, or noise) and the true ones, two a field, of each order's packet."""
    k, c = F.col("k"), F.col("c")
    orders = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    seen, true = [], []
    for field, values in _TOKEN_FIELDS.items():
        first, second = D.pick(values, k), D.pick(values, F.floor(k / len(values)) + c)
        hurt = F.replace(first, D.pick(("a", "e", "r"), c), D.pick(("o", "", "rr"), c))
        seen.append(F.struct(F.lit(field).alias("field"), F.when(k % 5 == 0, "zzzzzzzzzzzz").when(k % 7 == 0, F.substring(hurt, F.lit(4), F.length(hurt))).otherwise(F.upper(hurt)).alias("raw")))
        true += [F.struct(F.lit(field).alias("field"), x.alias("truth")) for x in (first, second)]
    rows = lambda cells: orders.select("k", F.explode(F.array(*cells)).alias("x")).select("k", "x.*")
    return rows(seen), rows(true)


_TOKENS = " UNION ALL ".join(
    f"""SELECT k, '{f}' AS field, first, second, CASE WHEN k % 5 = 0 THEN 'zzzzzzzzzzzz' WHEN k % 7 = 0 THEN substr(hurt, 4) ELSE upper(hurt) END AS raw
  FROM (SELECT *, replace(first, ['a', 'e', 'r'][CAST(c % 3 + 1 AS INT)], ['o', '', 'rr'][CAST(c % 3 + 1 AS INT)]) AS hurt
  FROM (SELECT o_orderkey AS k, o_custkey AS c, {D._case(v, 'o_orderkey')} AS first, {D._case(v, f'o_orderkey // {len(v)} + o_custkey')} AS second FROM orders))"""
    for f, v in _TOKEN_FIELDS.items())


@query(f"""WITH t AS ({_TOKENS}), pairs AS (SELECT k, field, raw, unnest([first, second]) AS truth FROM t),
near AS (SELECT DISTINCT k, field, raw, truth, levenshtein(lower(raw), lower(truth)) AS d FROM pairs WHERE levenshtein(lower(raw), lower(truth)) <= 4)
SELECT k, field, raw, truth, d::INT AS d FROM near QUALIFY row_number() OVER (PARTITION BY k, field, raw ORDER BY d, truth) = 1""")
def nearest_truth(spark, sf_dir):
    return nearest.nearest_truth(*_tokens(spark, sf_dir), ["k"], ["field"])


@query()
def selfsup_confusion(spark, sf_dir):
    """Operation counts of the channel that was fitted to the damaged tokens without labels."""
    _, counts, _ = nearest.fit_channel(*_tokens(spark, sf_dir), ["k"], ["field"])
    return spark.createDataFrame([(*key, n) for key, n in sorted(counts.items(), key=str)], "op string, true_ch string, obs_ch string, n long")


_PLACES = r"""WITH parts AS (SELECT doc_id, unnest(string_split_regex(text, '[\x20\x09-\x0D]')) AS word, generate_subscripts(string_split_regex(text, '[\x20\x09-\x0D]'), 1) AS i FROM documents),
placed AS (SELECT doc_id, word, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(word) - 1 AS start FROM parts),
words AS (SELECT doc_id, start, word LIKE '%@%' AS marks FROM placed WHERE word <> '')"""
_REACH = 220


@query(f"""{_PLACES}, marks AS (SELECT doc_id, start FROM words WHERE marks)
SELECT doc_id, count(*) AS n_words, count(*) FILTER (EXISTS (SELECT 1 FROM marks m WHERE m.doc_id = w.doc_id AND abs(m.start - w.start) <= {_REACH})) AS n_near FROM words w WHERE doc_id IN (SELECT doc_id FROM marks) GROUP BY doc_id""")
def words_near_markers(spark, sf_dir):
    """Per document with an address: its words, and those within reach of one."""
    words = proximity.words(D.table(spark, sf_dir, "documents"), "doc_id", "text")
    marks = words.where(F.col("text").contains("@")).select("doc_id", "start")
    near = proximity.with_neighbour(words.select("doc_id", "start"), marks, ["doc_id"], "start", _REACH).groupBy("doc_id").agg(F.count("*").alias("n_near"))
    return words.groupBy("doc_id").agg(F.count("*").alias("n_words")).join(near, "doc_id")


@query(f"""{_PLACES}, marks AS (SELECT doc_id, start FROM words WHERE marks)
SELECT m.doc_id, m.start::BIGINT AS marker, count(*) AS n_words, min(w.start)::BIGINT AS first_word, max(w.start)::BIGINT AS last_word
FROM marks m JOIN words w ON m.doc_id = w.doc_id AND abs(m.start - w.start) <= {_REACH} GROUP BY ALL""")
def marker_contexts(spark, sf_dir):
    """Per address: the words within reach of it."""
    words = proximity.words(D.table(spark, sf_dir, "documents"), "doc_id", "text")
    marks = words.where(F.col("text").contains("@")).select("doc_id", "start")
    met = proximity.pairs_within(words.select("doc_id", "start"), marks, ["doc_id"], "start", _REACH)
    return met.groupBy("doc_id", F.col("right_start").alias("marker")).agg(F.count("*").alias("n_words"), F.min("start").alias("first_word"), F.max("start").alias("last_word"))


# ---- noisy channel -------------------------------------------------------------------------------------------------


@query()
def lexicon_search(spark, sf_dir):
    """Damaged first names, corrected by the names of all packets and the channel that their damages show."""
    k, c = F.col("k"), F.col("c")
    first = D.packets(spark, sf_dir).where("applicant_name is not null").select("k", "c", F.lower(F.split("applicant_name", " ")[0]).alias("name"))
    # the key travels: names damaged twice keep several damages apart
    raw = F.replace(F.replace(F.col("name"), D.pick(("a", "x", "i", "qz"), c), D.pick(("o", "ks", "", "q"), c)), D.pick(("r", "e", "qz"), F.floor(k / 7)), D.pick(("n", "c", "q"), F.floor(k / 7)))
    rows = first.withColumn("raw", raw)
    counts = {(r.op, r.true_ch, r.obs_ch): r.n for r in channel.confusion_counts(rows.select(F.col("name").alias("true"), F.col("raw").alias("observed"))).collect()}  # letters squared at most
    words = first.groupBy(F.col("name").alias("word")).agg(F.count("*").alias("n"))
    found = lexicon.correct(rows, "raw", words, counts)
    return rows.join(found, "raw").groupBy("raw", "word").agg(F.count("*").alias("n"), F.count_if(F.col("word") == F.col("name")).alias("right"), F.round(F.min("log_p"), 6).alias("log_p"))
