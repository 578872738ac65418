"""Near-duplicate lines: an exact set-similarity join of token sets (DataFrame functions only).

A line is the set of its distinct words, each a long: the class of the word's frequency in the high bits, a hash below,
so that sorting a set puts rare words first. Lines of one set are one class. If two sets of n and m words have Jaccard
3/4, they share o = ceil(3(n + m)/7) words, and the first of these stands among the first n - o + 1 and m - o + 1. Words
of class HOT_CLASS and above are too frequent to be a key: if the first common word is one, so is the second, which
stands among the first n - o + 2 and m - o + 2, and the two are one key.

1. Neighbours. Each posting of a word that isn't rare (LONG_CLASS) is held against the earliest of its key and the two
   before it: candidates are linear in the postings, however large a group of like lines is. Verified ones beat their
   later line, which needs no other partner.
2. Search. Postings of one key are joined where at least one line isn't beaten yet, sizes and positions allow the overlap
   and the signatures differ in no more bits than the sets may in words (a word flips one of 128 bits, so what differs
   is a lower bound). What passes is verified on the whole sets.

A line that matches an earlier one is removed. Words are counted over all rows; the order knows, per bucket of
2 ** SKETCH_BITS word hashes, the count of the bucket's most frequent word: a table of fixed size (a byte a bucket) in
which rare words stay rare however many share a bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, give_back, materialize

SKETCH_BITS = 17
BROADCAST_ROWS = 200_000
#: Bits of a word's hash below the 7 bits of its class.
HASH_BITS = 56
#: Words of this class (2 ** 16 occurrences) and above are keys in twos only.
HOT_CLASS = 32
#: Words below this class (16 occurrences) have short lists, whose lines are all joined in the search; others meet their neighbours first.
LONG_CLASS = 8
#: Lines held against each posting besides the earliest of its key.
NEIGHBOURS = 2
#: Sizes and positions are kept up to here; a longer line counts as this long, its positions as 0, which only loosens filters.
LONGEST = 0xFFFF


def words(line: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a line in lower case; empty strings may stand between."""
    for mark in "\t\n\x0b\x0c\r":
        line = F.replace(line, F.lit(mark), F.lit(" "))
    return F.split(F.lower(line), " ")


def word_hash(word: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(word), 64 - HASH_BITS)


def bucket(h: Column) -> Column:
    return h.bitwiseAND((1 << SKETCH_BITS) - 1)


def frequency_classes(texts: DataFrame) -> str:
    """Per bucket, comma-joined, twice the logarithm of the count of its most frequent word."""
    found = texts.select(F.explode(words(F.col("text"))).alias("w")).where("w <> ''")
    counts = found.groupBy(word_hash(F.col("w")).alias("h")).count()
    most = counts.groupBy(bucket(F.col("h")).cast("int").alias("b")).agg(F.least(F.lit(127), F.floor(2 * F.log2(F.max("count") + 1))).cast("byte").alias("c")).toArrow()
    classes = np.zeros(1 << SKETCH_BITS, np.uint8)
    classes[most["b"].to_numpy()] = most["c"].to_numpy()
    out = ",".join(map(str, classes.tolist()))
    give_back()
    return out


def ordered_set(line: Column, classes: str) -> Column:
    """The distinct words of a line as sorted longs, rare ones first."""
    table = F.split(F.lit(classes), ",").cast("array<byte>")  # a constant: it is folded once
    nothing = F.shiftrightunsigned(F.xxhash64(F.lit("")), 64 - HASH_BITS)
    hashes = F.array_remove(F.array_distinct(F.transform(words(line), word_hash)), nothing)
    # without nulls, arrays of longs are sorted as such
    of = lambda h: F.shiftleft(F.coalesce(F.get(table, bucket(h)), F.lit(0).cast("byte")).cast("long"), HASH_BITS)
    return F.sort_array(F.transform(hashes, lambda h: of(h).bitwiseOR(h)))


def prefix_length(n: Column) -> Column:
    """How many of the first words any partner's window may reach."""
    return n - F.ceil(n * 3 / 4).cast("int") + 1


def parity(words: Column, high: bool) -> Column:
    """64 bits, each flipped by the words of its number: by all words, or (high) by those whose seventh bit is set."""
    flips = lambda w: F.shiftright(w, 6).bitwiseAND(1) if high else F.lit(1).cast("long")
    return F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: acc.bitwiseXOR(F.call_function("shiftleft", flips(w), w.bitwiseAND(63).cast("int"))))


def needed(n: Column, m: Column) -> Column:
    """Least overlap of sets of n and m at Jaccard 3/4."""
    return F.ceil((n + m) * 3 / 7)


def _lines(docs: DataFrame) -> DataFrame:
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    return docs.select("doc_id", F.xxhash64("text").alias("row_key"), F.posexplode(split).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def _keys(words: Column, n: Column) -> tuple[Column, Column, Column]:
    """(how many words of the prefix are below LONG_CLASS, single keys: 31 bits of each word of the prefix that isn't hot; pairs: (key, place of the first) of the hot words of a prefix longer by one)."""
    is_hot = lambda w: w >= (HOT_CLASS << HASH_BITS)
    head = F.slice(words, F.lit(1), prefix_length(n) + 1)
    has_hot = is_hot(F.element_at(head, -1))  # they come last
    prefix = F.slice(words, F.lit(1), prefix_length(n))
    single = F.transform(F.when(has_hot, F.filter(prefix, lambda w: ~is_hot(w))).otherwise(prefix), lambda w: w.bitwiseAND(0x7FFFFFFF).cast("int"))
    hot = F.filter(head, is_hot)
    cold = F.size(head) - F.size(hot)
    pairs = F.flatten(F.transform(hot, lambda w, i: F.transform(F.slice(hot, i + 2, F.size(hot)), lambda v: F.struct(F.xxhash64(w, v).bitwiseAND(0x7FFFFFFF).cast("int").alias("key"), (cold + i).cast("int").alias("i")))))
    rare = F.size(F.filter(prefix, lambda w: w < (LONG_CLASS << HASH_BITS)))
    return rare, single, F.when(has_hot, pairs)


def _postings(firsts: DataFrame, *columns: str, rare: bool = True) -> DataFrame:
    """key, sid, ni and further columns: a row for each key of a class (but for those below LONG_CLASS, if not rare). ni holds, from high to low bits: line number (31), beaten (1, if firsts has it), size and position (16 each)."""
    flag = F.col("beaten").cast("long") if "beaten" in firsts.columns else F.lit(0).cast("long")
    line = F.shiftleft(F.col("place.line_no").cast("long"), 33)
    n = F.least(F.col("n"), F.lit(LONGEST)).cast("long")
    place = lambda i: F.when(F.col("n") < LONGEST, F.col(i)).otherwise(0).cast("long")
    shared = [line.bitwiseOR(F.shiftleft(flag, 32)).bitwiseOR(F.shiftleft(n, 16)).alias("fn"), *columns]
    skip = F.lit(0) if rare else F.col("rare")
    alone = firsts.where("n > 2").select("sid", "n", *shared, skip.alias("skip"), F.posexplode(F.slice("single", skip + 1, F.size("single"))).alias("i", "key")).withColumn("i", F.col("i") + F.col("skip")).drop("skip")
    pairs = firsts.where("n > 2 and pairs is not null").select("sid", "n", *shared, F.explode("pairs").alias("x")).select("*", F.col("x.i").alias("i"), F.col("x.key").alias("key")).drop("x")
    both = alone.unionByName(pairs)
    return both.select("key", "sid", F.col("fn").bitwiseOR(place("i")).alias("ni"), *columns)


def _size(ni: Column) -> Column:
    return F.shiftright(ni, 16).bitwiseAND(LONGEST)


def _fits(x: Column, y: Column) -> Column:
    """Whether sizes and positions of two postings of one key leave room for the overlap."""
    n, m, i, j = _size(x), _size(y), x.bitwiseAND(LONGEST), y.bitwiseAND(LONGEST)
    o = needed(n, m)
    return (n * 4 >= m * 3) & (m * 4 >= n * 3) & (i <= n - o) & (j <= m - o)


def _differ(p: Column, q: Column, r: Column, s: Column) -> Column:
    """Bits in which the signatures (p, q) and (r, s) differ: of all words, and of those with the seventh bit set."""
    every, high = p.bitwiseXOR(r), q.bitwiseXOR(s)
    return F.bit_count(high) + F.bit_count(every.bitwiseXOR(high))


def _room(x: Column, y: Column) -> Column:
    """In how many words sets at Jaccard 3/4 may differ, by two postings."""
    n, m = _size(x), _size(y)
    return n + m - 2 * needed(n, m)


def _neighbours(firsts: DataFrame) -> DataFrame:
    """(a, b): classes whose postings stand beside each other or beside the earliest of their key, and whose signatures allow a match."""
    w = Window.partitionBy("key").orderBy(F.col("first_doc").asc_nulls_first(), "ni")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    other = lambda c: [F.first(c).over(so_far), *(F.lag(c, k).over(w) for k in range(1, NEIGHBOURS + 1))]
    sides = [F.struct(s.alias("b"), x.alias("y"), p.alias("r"), q.alias("s")) for s, x, p, q in zip(other("sid"), other("ni"), other("p"), other("q"))]
    near = _postings(firsts.withColumn("first_doc", F.col("place.doc_id")), "first_doc", "p", "q", rare=False).select("sid", "ni", "p", "q", *[s.alias(f"s{k}") for k, s in enumerate(sides)])
    near = near.select(F.col("sid").alias("a"), F.col("ni").alias("x"), "p", "q", F.explode(F.array(*[F.col(f"s{k}") for k in range(len(sides))])).alias("o"))
    room = _room(F.col("x"), F.col("o.y"))
    near = near.where(
        F.col("o.b").isNotNull() & (F.col("o.b") != F.col("a")) & _fits(F.col("x"), F.col("o.y")) & (_differ(F.col("p"), F.col("q"), F.col("o.r"), F.col("o.s")) <= room)
    )
    return near.select(F.least("a", "o.b").alias("a"), F.greatest("a", "o.b").alias("b")).distinct()


def _search(firsts: DataFrame) -> DataFrame:
    """(a, b): classes that share a key, of which one isn't beaten, and whose sizes, positions and signatures allow a match."""
    posted = _postings(firsts, "p", "q")
    a = posted.select("key", F.col("sid").alias("a"), F.col("ni").alias("x"), F.col("p").alias("pa"), F.col("q").alias("qa"))
    b = posted.select("key", F.col("sid").alias("b"), F.col("ni").alias("y"), F.col("p").alias("pb"), F.col("q").alias("qb"))
    x, y = F.col("x"), F.col("y")
    room = _room(x, y)
    open_ = F.shiftright(x.bitwiseAND(y), 32).bitwiseAND(1) == 0
    close = a.join(b, "key").where(
        (F.col("a") < F.col("b")) & open_ & _fits(x, y) & (_differ(F.col("pa"), F.col("qa"), F.col("pb"), F.col("qb")) <= room)
    )
    return close.select("a", "b").distinct()


def _beaten(docs: DataFrame, firsts: DataFrame, pairs: DataFrame, classes: str) -> DataFrame:
    """sid of the later class of each pair (a, b) whose whole sets have Jaccard 3/4; the sets are read again where they first stand."""
    asked = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
    asked = materialize(firsts.select("sid", "place").join(asked, "sid").select("sid", "place", F.col("place.doc_id").alias("first_doc"), F.col("place.line_no").alias("first_line"), F.col("place.row_key").alias("first_key")), "line-asked")
    narrow = F.broadcast if asked.count() <= BROADCAST_ROWS else (lambda df: df)
    where_docs = asked.select(F.col("first_doc").alias("d")).distinct()
    some = docs.join(narrow(where_docs), docs["doc_id"].eqNullSafe(F.col("d")), "left_semi")
    here = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("line_no") == F.col("first_line")) & F.col("row_key").eqNullSafe(F.col("first_key"))
    # the table of classes is in the plans of two queries without shuffles only: plans are logged anew at each of their stages
    found = materialize(_lines(some).join(narrow(asked), here).select("sid", "place", "line").dropDuplicates(["sid"]), "line-found")
    whole = materialize(found.select("sid", "place", ordered_set(F.col("line"), classes).alias("words")), "line-whole")
    left = whole.select(F.col("sid").alias("a"), F.col("place").alias("place_a"), F.col("words").alias("words_a"))
    right = whole.select(F.col("sid").alias("b"), F.col("place").alias("place_b"), F.col("words").alias("words_b"))
    both = pairs.join(left, "a").join(right, "b").where(F.size(F.array_intersect("words_a", "words_b")) >= needed(F.size("words_a"), F.size("words_b")))
    beaten = materialize(both.select(F.when(F.col("place_a") > F.col("place_b"), F.col("a")).otherwise(F.col("b")).alias("beaten_sid")).distinct(), "line-beaten")
    drop(asked, found, whole)
    return beaten


def matched_lines(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, row_key, line_no) of the lines to remove, row_key being the hash of the row's text; and the tables that it reads."""
    classes = frequency_classes(docs.select("text").where("text is not null"))
    lines = _lines(docs).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    sets = lines.select("doc_id", "row_key", "line_no", ordered_set(F.col("line"), classes).alias("words"))
    n = F.size("words")
    rare, single, pairs = _keys(F.col("words"), n)
    sets = sets.select(
        "doc_id", "row_key", "line_no", F.xxhash64("words").alias("sid"), n.alias("n"), F.when(n > 2, rare).alias("rare"), F.when(n > 2, single).alias("single"), F.when(n > 2, pairs).alias("pairs"),
        F.when(n > 2, parity(F.col("words"), False)).alias("p"), F.when(n > 2, parity(F.col("words"), True)).alias("q"),
    )
    sets = materialize(sets, "lines")
    # a class by its earliest line; the other columns are equal in all of its lines
    place = F.struct("doc_id", "line_no", "row_key")
    firsts = sets.groupBy("sid").agg(F.min(F.struct(place.alias("place"), "n", "rare", "single", "pairs", "p", "q")).alias("x"), F.count("*").alias("lines")).select("sid", "x.*", "lines")
    firsts = materialize(firsts, "line-classes")
    near = materialize(_neighbours(firsts), "line-near")
    first_beaten = _beaten(docs, firsts, near, classes)
    small = F.broadcast if first_beaten.count() <= BROADCAST_ROWS else (lambda df: df)
    marked = lambda by: firsts.join(by, F.col("sid") == F.col("beaten_sid"), "left").withColumn("beaten", F.col("beaten_sid").isNotNull())
    found = materialize(_search(marked(small(first_beaten))).join(near, ["a", "b"], "left_anti"), "line-pairs")
    then_beaten = _beaten(docs, firsts, found, classes)
    rule = marked(first_beaten.union(then_beaten).distinct()).where("beaten or lines > 1").select(F.col("sid").alias("rule_sid"), F.col("place").alias("first_place"), "beaten")
    judged = sets.select("doc_id", "row_key", "line_no", "sid").join(rule, F.col("sid") == F.col("rule_sid"))
    gone = judged.where(F.col("beaten") | (F.struct("doc_id", "line_no", "row_key") != F.col("first_place"))).select("doc_id", "row_key", "line_no")
    return gone, [sets, firsts, near, found, first_beaten, then_beaten]


def _removed(docs: DataFrame) -> DataFrame:
    """gone_id, gone_key, gone (line numbers), copy (of rows that are repeated whole, the row of the first), for rows that lose lines or are repeated."""
    lines, read = matched_lines(docs)
    gone = lines.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set("line_no")).alias("gone")).withColumn("first_row", F.lit(None).cast("long"))
    repeated = docs.select("doc_id", F.xxhash64("text").alias("row_key"), "row_no").groupBy("doc_id", "row_key").agg(F.min("row_no").alias("first_row"), F.count("*").alias("rows")).where("rows > 1")
    both = gone.unionByName(repeated.select("doc_id", "row_key", F.lit(None).cast("array<int>").alias("gone"), "first_row"))
    both = both.groupBy("doc_id", "row_key").agg(F.max("gone").alias("gone"), F.max("first_row").alias("first_row"))
    table = materialize(both.select(F.col("doc_id").alias("gone_id"), F.col("row_key").alias("gone_key"), "gone", "first_row"), "line-gone")
    drop(*read)
    return table


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, row_no: a number of the row that rereading the same files gives again."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row_no"))


def _gone(text: Column, row_no: Column) -> Column:
    """The numbers of a row's lines that go: of a later copy of a whole row, all that have a word."""
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i + 1))
    return F.when(row_no > F.col("first_row"), F.array_compact(numbered)).otherwise(F.col("gone"))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_removed, removed (numbers of removed lines from 1, comma-joined).

    Lines end at LF; words are [^\\x20\\x09-\\x0D]+ in lower case; Jaccard is that of the sets of words. Blank
    lines never match. A line is removed if an earlier line (smaller doc_id, null ids first; then smaller line number;
    of rows that share an id, then by a hash of their texts) is at least 3/4 like it, whether that one stays or not. Of
    rows that are repeated whole, the first as the files are read is the earliest, and the others lose all lines that
    have a word. Null text is one blank line. Texts of any length are read whole; other columns aren't read; an empty
    table gives no rows.
    """
    source = _source(docs, id_col, text_col)
    gone = _removed(source)
    rows = source.select("doc_id", "text", "row_no", F.xxhash64("text").alias("row_key"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    joined = _with_gone(rows, F.col("doc_id"), F.col("row_key"), gone).withColumn("out", _gone(F.col("text"), F.col("row_no")))
    return joined.select("doc_id", "n_lines", F.coalesce(F.size("out"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("out", ","), F.lit("")).alias("removed"))


def _with_gone(rows: DataFrame, doc_id: Column, row_key: Column, gone: DataFrame) -> DataFrame:
    return rows.join(gone, doc_id.eqNullSafe(F.col("gone_id")) & row_key.eqNullSafe(F.col("gone_key")), "left")


def without_matches(docs: DataFrame) -> DataFrame:
    """The rows of docs, all of them, with matched lines taken out of text (and n_chars, if there is one, counted anew).

    Null ids and texts, blank lines and repeated rows are treated as in removed_lines(); null texts stay null; columns
    may have any names; an empty table gives no rows.
    """
    gone = _removed(_source(docs, "doc_id", "text"))
    # a row travels as a struct of its own columns, so that no names clash with those joined in
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("line_row"), F.monotonically_increasing_id().alias("line_row_no"))
    text = F.col("line_row")["text"]
    joined = _with_gone(rows, F.col("line_row")["doc_id"].cast("long"), F.xxhash64(text.cast("string")), gone).withColumn("line_out", _gone(text.cast("string"), F.col("line_row_no")))
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("line_out", i + 1)), "\n")
    columns = {c: F.col("line_row")[c] for c in docs.columns}
    columns["text"] = F.when(F.col("line_out").isNull(), text).otherwise(kept)
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("line_out").isNull(), columns["n_chars"]).otherwise(F.length(kept)).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[columns[c].alias(c) for c in docs.columns])


#: DuckDB SQL for op10: the join by all common words.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no
  FROM documents),
sets AS (
  SELECT doc_id, line_no,
         list_sort(list_distinct(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+'))) AS words
  FROM lines),
classes AS (
  SELECT words, len(words) AS n, min({'d': doc_id, 'l': line_no}) AS place, row_number() OVER (ORDER BY words) AS sid
  FROM sets WHERE len(words) > 0 GROUP BY words),
tokens AS (SELECT sid, n, unnest(words) AS w FROM classes),
pairs AS (
  SELECT a.sid AS a, b.sid AS b FROM tokens a JOIN tokens b ON a.w = b.w AND a.sid < b.sid AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n
  GROUP BY a.sid, b.sid, a.n, b.n HAVING 7 * count(*) >= 3 * (a.n + b.n)),
beaten AS (
  SELECT DISTINCT CASE WHEN x.place > y.place THEN x.sid ELSE y.sid END AS sid
  FROM pairs JOIN classes x ON x.sid = a JOIN classes y ON y.sid = b),
gone AS (
  SELECT s.doc_id, s.line_no FROM sets s JOIN classes c ON s.words = c.words LEFT JOIN beaten t ON t.sid = c.sid
  WHERE t.sid IS NOT NULL OR {'d': s.doc_id, 'l': s.line_no} <> c.place),
by_doc AS (SELECT doc_id, count(*) AS n_removed, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(string_split(coalesce(d.text, ''), chr(10))) AS BIGINT) AS n_lines,
       CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN by_doc USING (doc_id)
"""
