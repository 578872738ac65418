"""Personal data: base patterns, and a skip-chain conditional random field that adds what they miss.

Nodes of a document's field are its base spans (their labels are observed) and its other candidate spans: digit groups
and address-like tokens. Neighbours in the text are linked in a chain; candidates whose normal forms repeat or nest are
linked by skip edges, however far apart, and each of them with the observed spans of its form. Sum-product message passing over this loopy graph lets an observed entity
carry its label to later mentions in another form (no plus sign, other separators, "at" spelled out).

Weights are trained on a bounded sample of documents (TRAIN_DOCS): the node weights by multinomial logistic regression
with the base spans as labels, the agreement weight of skip edges from how often linked base spans share their label.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Bound of the training sample, in documents.
TRAIN_DOCS = 2000
ROUNDS = 10
ACCEPT = 0.5

#: What stands before the sign of an address, and after it; matches are found from the sign, so that long runs take linear time.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match begins where a run of digits begins (one that began inside it would fail or succeed alike), which keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NUMBER_LIKE = re.compile(r"\+?\(?[0-9](?:[0-9]|[ ().-]{1,2}(?=[0-9(]))*")
AT = re.compile("@")
AT_SPELLED = re.compile(r" ?[\[(](?:at|AT)[\])] ?|@")
DOMAIN_LIKE = re.compile(r"[A-Za-z0-9.-]*[A-Za-z0-9]")
DIGIT = re.compile("[0-9]")


def addresses(text: str, sign: re.Pattern, domain: re.Pattern) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping spans of LOCAL letters, sign and domain."""
    end = 0
    for m in sign.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if end <= start < m.start() and (found := domain.match(text, m.end())):
            end = found.end()
            yield start, end


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for d in digits[-2::-2]:
        total += (2 * int(d)) // 10 + (2 * int(d)) % 10
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    found = []
    if "@" in text:
        found += [("email", *x) for x in addresses(text, AT, DOMAIN)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append(("phone", *m.span()))
    return found


def normal_form(s: str) -> str:
    if "@" in s or re.search("[A-Za-z]", s):
        return re.sub(r" ?[\[(]at[\])] ?", "@", s.lower()).strip(".")
    return "".join(c for c in s if c.isdigit())


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that no base span overlaps and that may be mentions: ("", start, end)."""
    from bisect import bisect_left

    # base spans of different kinds may overlap: joined, the last one that begins before an end tells whether a place is free
    taken: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e in base):
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    starts = [s for s, _ in taken]
    out = []

    def free(s: int, e: int) -> bool:
        i = bisect_left(starts, e)
        return not i or taken[i - 1][1] <= s

    if DIGIT.search(text):
        out += [("", *m.span()) for m in NUMBER_LIKE.finditer(text) if m.end() - m.start() >= 7 and sum(c.isdigit() for c in m[0]) >= 7 and free(*m.span())]
    if "@" in text or "at)" in text or "at]" in text or "AT" in text:
        held = {s for _, s, _ in out}
        out += [("", *x) for x in addresses(text, AT_SPELLED, DOMAIN_LIKE) if x[0] not in held and free(*x)]
    return out


def features(s: str) -> np.ndarray:
    """What a span looks like, without its place: counts of digits in steps, separators, letters."""
    digits = sum(c.isdigit() for c in s)
    steps = [digits < 7, 7 <= digits <= 11, 12 <= digits <= 15, 16 <= digits <= 19, digits > 19]
    marks = ["@" in s or "at" in s.lower(), "+" in s, s.count(".") == 3, "(" in s, "-" in s, " " in s, any(c.isalpha() for c in s)]
    d = "".join(c for c in s if c.isdigit())
    return np.array([1.0, *steps, *marks, 16 <= digits <= 19 and luhn(d), len(s) > 0 and s[0] == "+"])


def allowed(s: str) -> np.ndarray:
    """0 for labels that the span's characters permit, else minus infinity."""
    number = not any(c.isalpha() for c in s) and "@" not in s
    n = sum(c.isdigit() for c in s)
    ok = [True, not number, number and s.count(".") == 3, number and 16 <= n <= 19, number and 8 <= n <= 15]
    return np.where(ok, 0.0, -np.inf)


def train(texts: list[str], l2: float = 1e-2, steps: int = 300) -> tuple[np.ndarray, float]:
    """(node weights, agreement weight) from documents, with base spans as labels. Without any span: zeros and 1."""
    rows, labels, same, other = [], [], 0, 0
    for text in texts:
        base = base_spans(text)
        by_form: dict[str, str] = {}
        for kind, s, e in base:
            rows.append(features(text[s:e]))
            labels.append(LABELS.index(kind))
            form = normal_form(text[s:e])
            if form in by_form:
                same, other = (same + 1, other) if by_form[form] == kind else (same, other + 1)
            by_form[form] = kind
        for _, s, e in candidates(text, base):
            rows.append(features(text[s:e]))
            labels.append(0)
    agree = min(4.0, max(1.0, math.log((same + 20) / (other + 1))))
    if not rows:
        return np.zeros((len(features("")), len(LABELS))), agree
    x, y = np.array(rows), np.eye(len(LABELS))[labels]
    w = np.zeros((x.shape[1], len(LABELS)))
    for _ in range(steps):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= 1.0 * (x.T @ (p - y) / len(x) + l2 * w)
    return w, agree


def skip_edges(forms: list[str], kinds: list[str]) -> list[tuple[int, int]]:
    """Each node with the last earlier one of its form, and with the last whose form ends in its last eight digits or has its mailbox.

    Open nodes (kind "") are also linked with an observed one of each kind that shares a key, wherever it stands: its
    evidence reaches every mention in one step, however many there are, and the edges stay linear in the nodes.
    """
    keys = [{form, "tail:" + form[-8:] if form.isdigit() and len(form) >= 8 else form, "box:" + form.partition("@")[0] if "@" in form else form} for form in forms]
    observed: dict[str, dict[str, int]] = {}
    for i, kind in enumerate(kinds):
        for k in keys[i] if kind else ():
            observed.setdefault(k, {}).setdefault(kind, i)
    last: dict[str, int] = {}
    edges = set()
    for i, kind in enumerate(kinds):
        for k in keys[i]:
            if k in last and last[k] != i:
                edges.add((last[k], i))
            last[k] = i
            if not kind:
                edges |= {(min(i, j), max(i, j)) for j in observed.get(k, {}).values()}
    return sorted(edges)


def propagate(unary: np.ndarray, edges: list[tuple[int, int, np.ndarray]], rounds: int | None = None) -> np.ndarray:
    """Node marginals by loopy sum-product in logs, by sweeps to and fro until messages settle (at most ROUNDS more than nodes, by default). unary: nodes x labels; edges: (i, j, log potential[label i, label j])."""
    def lse(a: np.ndarray, axis: int) -> np.ndarray:
        top = np.max(a, axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))

    k = unary.shape[1]
    forth, back = [np.zeros(k) for _ in edges], [np.zeros(k) for _ in edges]
    belief = unary.copy()
    places = list(enumerate(edges))
    for sweep in range((rounds or ROUNDS + len(unary)) if edges else 0):
        moved = 0.0
        for n, (i, j, pot) in places if sweep % 2 == 0 else reversed(places):
            f = lse((belief[i] - back[n])[:, None] + pot, 0)
            f = np.maximum(f - lse(f, 0), -50)
            belief[j] += f - forth[n]
            b = lse((belief[j] - f)[None, :] + pot, 1)
            b = np.maximum(b - lse(b, 0), -50)
            belief[i] += b - back[n]
            moved = max(moved, np.abs(f - forth[n]).max(), np.abs(b - back[n]).max())
            forth[n], back[n] = f, b
        if moved < 1e-4:
            break
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def find(text: str, weights: np.ndarray, agree: float) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of a text; both by kind as listed, then start."""
    base = base_spans(text)
    open_ = candidates(text, base)
    if not open_:
        return base, base
    nodes = sorted(base + open_, key=lambda n: n[1:])
    parts = [text[s:e] for _, s, e in nodes]
    unary = np.stack([features(p) @ weights + allowed(p) if not kind else np.where(np.arange(len(LABELS)) == LABELS.index(kind), 0.0, -np.inf) for (kind, _, _), p in zip(nodes, parts)])
    unary = np.maximum(unary, -50)
    agreement = agree * np.eye(len(LABELS))
    chain = 0.1 * np.eye(len(LABELS))
    edges = [(i, j, agreement) for i, j in skip_edges([normal_form(p) for p in parts], [kind for kind, _, _ in nodes])]
    edges += [(i, i + 1, chain) for i in range(len(nodes) - 1) if nodes[i + 1][1] - nodes[i][2] < 40]
    p = propagate(unary, edges)
    more = [(LABELS[k], s, e) for (kind, s, e), row in zip(nodes, p) if not kind and (k := int(row.argmax())) and row[k] >= ACCEPT]
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + more, key=lambda x: (order[x[0]], x[1], x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: x[1:]):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row per row of docs: doc_id, counts of base spans by kind, base_sha256, spans, masked_text, n_spans (all of them).

    Null text counts as empty (null ids are kept); whole texts of any length are read; repeated rows are worked on each;
    other columns aren't read; an empty table gives no rows. The field is trained on at most train_docs documents,
    those with the smallest hash of their id, so that reruns agree.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    share = train_docs / max(docs.select("doc_id").count(), 1)
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    sample = docs.where(hashed < int(1_000_000 * min(1.0, share)) + 1).where(F.col("text").rlike("[0-9@]")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    weights, agree = train([r.text for r in sample.select("text").toLocalIterator()])
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "masked_text", "n_spans"]
    types = [pa.int64()] * 5 + [pa.string()] * 3 + [pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                base, every = find(text or "", weights, agree)
                n = [sum(k == x[0] for x in base) for k in KINDS]
                rows.append((i, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), mask(text or "", every), len(every)))
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return docs.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, masked_text string, n_spans long")
