"""Nearest neighbours, shingle sets, lines, pages, the pipeline."""

import collections
import itertools
import random
import re

import duckdb
import numpy as np
import pytest

from packetloom.llm import additive_quantization as A
from packetloom.llm import html_text as H
from packetloom.llm import line_dedup as L
from packetloom.llm import ngram_join as N
from packetloom.llm.common import connected_components

from .helpers import DOCS, empty_documents, odd_documents, sentence


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    want = components({n for e in edges for n in e if e[0] != e[1]}, edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges + [(None, 3)], "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def exact_neighbours(x, ids, every=20, top=20):
    out = {}
    for i in np.nonzero(ids % every == 0)[0]:
        s = (x * x[i]).sum(1)
        s[ids == ids[i]] = -np.inf
        out[int(ids[i])] = [(int(ids[k]), float(s[k])) for k in np.lexsort((ids, -s))[:top] if s[k] > -np.inf]
    return out


def test_recall_and_exact_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = table.collect()
    want = exact_neighbours(np.array([r.embedding for r in rows], dtype=np.float64), np.array([r.vec_id for r in rows]))
    got = collections.defaultdict(list)
    for r in sorted(A.search(table).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    truth = {q: dict(exact) for q, exact in exact_neighbours(np.array([r.embedding for r in rows], dtype=np.float64), np.array([r.vec_id for r in rows]), top=10**6).items()}
    assert all(s == truth[q][v] for q, found in got.items() for v, s in found)
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_encoding_beats_one_book_at_a_time():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 8))
    book = A.train(x, 4, 16)
    wide, narrow = (((x - book.decode(book.encode(x, b))) ** 2).sum() for b in (8, 1))
    assert wide <= narrow < (x**2).sum()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (None, [1.0, 1.0]), (10, [2.0, 0.0]), (11, [1.0, 0.0]), (11, [1.0, 0.0])]
    got = [tuple(r) for r in A.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 10, 2.0), (0, 2, 11, 1.0), (0, 3, 20, 1.0), (20, 1, 10, 2.0), (20, 2, 0, 1.0), (20, 3, 11, 1.0)]
    assert A.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (0, [3.0, 0.0]), (7, [2.0, 0.0]), (7, [4.0, 0.0]), (7, [4.0, 0.0])]
    got = sorted(tuple(r) for r in A.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), repeats=True).collect())
    # the query (1, 0) finds its namesake (3, 0), and the reverse
    mine = [(1, 7, 4.0), (2, 7, 4.0), (3, 0, 3.0), (4, 7, 2.0)]
    other = [(1, 7, 12.0), (2, 7, 12.0), (3, 7, 6.0), (4, 0, 3.0)]
    assert got == sorted((0, *x) for x in mine + other)
    assert A.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == 1


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = collections.Counter(p for h in holders.values() for p in itertools.combinations(sorted(h), 2))
    edges = [p for p, k in common.items() if 100 * k >= 75 * (len(sets[p[0]]) + len(sets[p[1]]) - k)]
    return {i: (len(sets[i]), c) for i, c in components(sets, edges).items()}


def variants(seed, groups=30):
    """Groups of texts near the threshold, a passage that many share, and exact copies."""
    rng, rows = random.Random(seed), []
    passage = sentence(rng, 30)
    for _ in range(groups):
        words = sentence(rng, rng.randrange(4, 60)).split()
        for _ in range(rng.randrange(1, 7)):
            copy = list(words)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(["new", "other"])
            rows.append((len(rows), " ".join(copy) if rng.random() < 0.8 else " ".join(copy) + "\n" + passage))
    return rows


@pytest.mark.parametrize("options", [{}, {"hot": 2}, {"block_sets": 2}, {"hot": 3, "block_sets": 3}])
def test_jaccard_components(spark, options):
    rows = variants(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()}
    assert got == brute_components(rows)


def test_t_occurrence_finds_every_component():
    for seed in range(20):
        sets = [np.array(sorted({hash(x) % (1 << 63) for x in shingles(t)}), np.uint64) for _, t in variants(seed, 40)]
        edges = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 7 * len(np.intersect1d(sets[i], sets[j])) >= 3 * (len(sets[i]) + len(sets[j])) > 0]
        links = N.t_occurrence(sets)
        assert set(map(lambda p: tuple(sorted(p)), links)) <= set(edges)
        assert components(range(len(sets)), links) == components(range(len(sets)), edges)
        part = [i % 2 for i in range(len(sets))]
        across = [e for e in edges if part[e[0]] != part[e[1]]]
        assert components(range(len(sets)), N.t_occurrence(sets, part=part)) == components(range(len(sets)), across)


def test_jaccard_odd_rows(spark):
    docs = odd_documents(spark)
    rows = N.jaccard_components(docs).collect()
    assert len(rows) == 11
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[5].component_id == 4 and by[2].n_shingles == by[3].n_shingles == 0 and by[3].component_id == 3
    assert N.jaccard_components(empty_documents(spark)).count() == 0
    kept = N.keep_first(docs)
    assert kept.columns == docs.columns and 5 not in {r.doc_id for r in kept.collect()}


def test_lines_against_sql(spark):
    rng = random.Random(9)
    texts = ["\n".join(t for _, t in rng.sample(variants(s, 12), 8)) for s in (1, 1, 2, 2, 3)] + ["", "Of A B\nof b a a\n\nx", None]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {tuple(r) for r in L.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_lines", "n_removed", "removed").collect()}
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = set(con.execute(f"select doc_id, n_lines, n_removed, removed from ({L.ORACLE})").fetchall())
    assert got == want and sum(r[2] for r in got) > 5


def test_lines_are_taken_out(spark):
    rows = [(1, "one two three four\nrest", "en", "a", 23), (2, "intro\none TWO three  four\nend", "en", "a", 30), (3, None, None, None, None)]
    got = {r.doc_id: (r.text, r.n_chars) for r in L.without_matches(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: (rows[0][1], 23), 2: ("intro\nend", 9), 3: (None, None)}
    docs = odd_documents(spark)
    assert L.removed_lines(docs).count() == 11 and L.without_matches(docs).count() == 11
    assert L.without_matches(docs).columns == docs.columns
    assert L.removed_lines(empty_documents(spark)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><script>var t="</p>";</script>
<nav><ul><li><a href="/x">Home of the site</a></li></ul></nav><div class="cookie-notice">We use the cookies of this site and that is all there is to it.</div>
<div id="main"><article><header><h1>The   title &amp; more</h1></header><p>This is the first paragraph of the article and it is long enough to be good, with many of the words that stop lists have in them.
<p>Short one.<br>Second line.</p><form><p>Your mail in the form of an address</p></form><ul><li>an item of the list</li></ul>
<aside class="sidebar">This is an aside of the page.</aside><p>The last paragraph is as long as the first, and it says that this was all there is to be said in the article.</p></article></div>
<div class="comments"><p>I think that this is the best of all the articles that I have read on this site and on others.</p></div><footer>&copy; the site</footer></body>"""


def test_main_text():
    assert H.main_text(PAGE).split("\n\n") == [
        "The title & more",
        "This is the first paragraph of the article and it is long enough to be good, with many of the words that stop lists have in them.",
        "Short one. Second line.", "an item of the list",
        "The last paragraph is as long as the first, and it says that this was all there is to be said in the article.",
    ]


def test_pages_of_the_test_data(spark):
    import html

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r for r in H.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    for r in rows:
        article = r.html.partition("<article>")[2].partition("</article>")[0].replace("<b>", "").replace("</b>", "").replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id].text == "\n\n".join(b for b in blocks if b) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_broken_pages(spark):
    pages = [(1, None, None), (2, "u", ""), (3, "u", "<p>unclosed <b>bold text of the page"), (4, "u", "no markup at all, but the text of a page that is long enough to be decided by what it says and how it says it, which is what counts."), (5, "u", "<div" * 1000), (6, "u", "</p>" * 3 + "<p>" * 2000 + "x"), (None, None, "<script>never ends"), (7, "u", "<!-- open")]
    rows = H.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(rows) == len(pages) and {r.page_id: r.text for r in rows}[4] == pages[3][2]
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    from packetloom.llm.common import materialize

    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, sf), "test-stage")
        seen.append((name, before, docs))
    assert all(d.columns == columns for _, _, d in seen[:-1])
    assert seen[0][2].count() >= 0.95 * seen[0][1].count()
    assert seen[1][2].count() == seen[1][1].count()
    before = [(r.doc_id, r.text) for r in seen[2][1].collect()]
    assert {r.doc_id for r in seen[2][2].collect()} == {i for i, (_, c) in brute_components(before).items() if i == c}
    words = sum(len((r.text or "").split()) for r in seen[3][1].collect())
    assert sum(len(r.text.split()) for r in seen[3][2].collect()) == pytest.approx(1.5 * words, rel=0.25)
    assert {r.doc_id for r in docs.select("doc_id").collect()} == {r.doc_id for r in seen[3][2].select("doc_id").collect()}


def test_keep_first_of_repeated_rows(spark):
    rng = random.Random(2)
    a, b = sentence(rng, 30), sentence(rng, 30)
    near = a + " more"
    rows = [(1, a), (1, a), (1, near), (2, a), (7, b), (7, sentence(rng, 30)), (None, a), (None, b + " x y"), (None, None), (None, None), (None, sentence(rng, 9))]
    got = collections.Counter((r.doc_id, r.text) for r in N.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sum(got[1, t] for t in (a, near)) == 1 and (2, a) not in got and (None, a) not in got
    assert got[7, b] == 1 and got[rows[5]] == 1 and (None, b + " x y") not in got
    assert got[None, None] == 2 and got[rows[10]] == 1 and sum(got.values()) == 6


@pytest.mark.parametrize("page", ['<a "' * 250_000, "<" * 1_000_000, "<select>" * 120_000, "<svg>" * 200_000, "<!--" * 250_000, "<a \"'" * 200_000, "<script" * 150_000, "<" * 500_000 + ">", "<?x" * 300_000])
def test_pages_in_linear_time(page):
    import time

    began = time.process_time()
    H.main_text(page)
    assert time.process_time() - began < 5


def test_tag_ends_are_those_of_the_pattern():
    """Quotes hide a tag's end; a quote that never closes makes text of the tag."""
    whole = re.compile(r"<a(?:\"[^\"]*\"|'[^']*'|[^'\">])*>")
    rng = random.Random(4)
    for _ in range(5000):
        page = "".join(rng.choice(["<a ", '"', "'", ">", "x"]) for _ in range(rng.randrange(1, 20)))
        ends, want, got, at = H._Ends(page), [m.span() for m in whole.finditer(page)], [], 0
        while (at := page.find("<", at)) >= 0:
            end = ends.tag(at + 2)
            if end > 0:
                got.append((at, end))
            at = end if end > 0 else at + 1
        assert got == want


def test_lines_of_repeated_rows(spark):
    rows = [(None, "a b c d\nx y z"), (None, "a b c d\nx y z"), (None, "q r s t\na b c d"), (5, "a b c d\n\nother line of words"), (5, "a b c d\n\nother line of words")]
    got = collections.Counter((r.doc_id, r.n_lines, r.removed) for r in L.removed_lines(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect())
    assert got == {(None, 2, ""): 1, (None, 2, "1,2"): 1, (None, 2, "2"): 1, (5, 3, "1"): 1, (5, 3, "1,3"): 1}
    kept = collections.Counter(r.text for r in L.without_matches(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect())
    assert kept == {"a b c d\nx y z": 1, "": 2, "q r s t": 1, "\nother line of words": 1}
