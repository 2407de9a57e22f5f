"""Personal data by patterns and a skip-chain conditional random field.

The patterns find the base spans. The field looks at each whole document's nodes in text order: the base
spans, whose labels are given, and candidates that no pattern accepts (numbers of 6 to 19 digits, tokens with
an at sign, addresses spelled with ``[at]`` or ``[.]``, and words that equal the local part of an address in the document). A
number ends where the next one would make it more than one: a group of seven digits or more stands alone. A node's
potential comes from its shape and the cue words before it; neighbours in the text share a transition
potential; and nodes that repeat or resemble each other (the same digits, the same last seven digits of a phone
number, the same address, the same local part) share a skip potential wherever they stand: each is linked to the
one before it and to the first with that key. Loopy belief propagation over chains and skips gives each candidate's
label, document by document: what a document gets does not depend on those it is processed with. Candidates that
are likelier than ``accept`` to be personal data become spans. Base spans always stay.

All weights are learned from all documents, by counts: which shapes have which label (base spans have their kind's,
candidates that resemble no base span have none), which labels are neighbours, and how often linked labels agree.
The driver gets a row for each combination of features and label, whose number the features bound. Node
weights are a softmax regression on these counts (each combination weighs the logarithm of its count) with a prior that says what
the features mean, transition and skip weights are smoothed log ratios (piecewise training). Texts without
a candidate cost only the patterns.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import slices
from heddle.session import ship

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
NEAR = 60  # characters between neighbours that share a transition
CUE_CHARS = 30
ROUNDS = 30  # of messages, and one more for each node of the document
SETTLED = 1e-4
UNSEEN = 10  # neighbours of any two labels assumed, as many as expected
AGREED = 20  # agreeing skip links assumed, beside one that disagrees
ACCEPT = 0.5
MIN_DIGITS, MAX_DIGITS, ALONE_DIGITS = 6, 19, 7

# The base patterns' character classes, and cue words by label.
AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
CUES = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write)\b[^\n]{0,12}\Z"),
    "ip": re.compile(r"(?i)\b(?:ip|host|address|server)\b[^\n]{0,12}\Z"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|credit|payment)\b[^\n]{0,12}\Z"),
    "phone": re.compile(r"(?i)\b(?:tel|phone|call|mobile|fax|cell)\b[^\n]{0,12}\Z"),
}

# Candidates: runs of digit groups, and spelled-out addresses.
GROUP = re.compile(r"[0-9]++")
JOINT = re.compile(r"[\x20().-]{1,2}\Z")
SPELLED_AT = re.compile(
    r"[\x20]?(?:\[at\]|\(at\)|\[@\]|\(@\))[\x20]?([A-Za-z0-9-]++(?:[\x20]?(?:\.|\[\.\]|\(\.\)|\[dot\]|\(dot\))[\x20]?[A-Za-z0-9-]++)++)",
    re.IGNORECASE,
)
SPELLED_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))[0-9]{1,3}){3}(?![0-9])", re.IGNORECASE)
DOT = re.compile(r"[\x20]?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\.)[\x20]?", re.IGNORECASE)
TOKEN = re.compile(r"[^\s,;:!?<>()\[\]\"']++")

#: Binary features of a node, with what is known of their meaning: log odds of labels, the prior means of the weights.
MEANING: dict[str, dict[str, float]] = {
    "any": {"none": 3.0},
    "at sign": {"email": 1.0},
    "word": {"email": -1.0},
    "spelled email": {"email": 7.0},
    "spelled ip": {"ip": 7.0},
    **{f"{n} digits": {"phone": -1.5, "card": -3.0} for n in (6, 7, 8)},
    **{f"{n} digits": {"card": -3.0} for n in (9, 10, 11)},
    "12 digits": {},
    "13 to 15 digits": {},
    "16 digits": {"phone": -3.0},
    "17 to 19 digits": {"phone": -3.0},
    "groups": {"phone": 0.5},
    "groups of four": {"card": 1.0},
    "brackets": {"phone": 2.0},
    "luhn": {"card": 2.0},
    **{f"{kind} cue": {kind: 2.5} for kind in KINDS},
}
NAMES = tuple(MEANING)
AT = {name: i for i, name in enumerate(NAMES)}


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int


@dataclass
class Model:
    node: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The pattern matches that pass their checks, by start, then kind. Linear in the text's length."""
    out, end = [], 0
    if "@" in text:
        for m in AT_DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in LOCAL_CHARS:
                start -= 1
            if start < m.start():
                out.append(Span("email", start, m.end()))
                end = m.end()
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(Span("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(Span("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                    out.append(Span("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


@dataclass
class _Node:
    start: int
    end: int
    label: int  # -1: not given
    keys: tuple[str, ...]
    shape: int  # a bit for each feature


def _keys(kind: str, piece: str) -> tuple[str, ...]:
    if kind == "email":
        low = piece.lower()
        return ("a" + low, "l" + low.split("@")[0])
    if kind == "word":
        return ("l" + piece.lower(),)
    if kind == "ip":
        return ("i" + piece,)
    digits = "".join(GROUP.findall(piece))
    return ("d" + digits, "s" + digits[-7:]) if 7 <= len(digits) <= 15 and kind != "card" else ("d" + digits,)


def _shape(text: str, start: int, end: int, kind: str) -> int:
    names = ["any"]
    if kind in ("at sign", "word", "spelled email", "spelled ip"):
        names.append(kind)
    elif kind == "number":
        groups = GROUP.findall(text, start, end)
        digits = "".join(groups)
        n = len(digits)
        names.append(f"{n} digits" if n <= 12 or n == 16 else "13 to 15 digits" if n < 16 else "17 to 19 digits")
        names += ["groups"] * (len(groups) > 1) + ["groups of four"] * (len(groups) > 2 and all(len(g) == 4 for g in groups[:-1]))
        names += ["brackets"] * (text.find(")", start, end) >= 0) + ["luhn"] * (n >= 12 and luhn(digits))
    before = text[max(0, start - CUE_CHARS) : start]
    names += [f"{cue} cue" for cue in KINDS if CUES[cue].search(before)]
    return sum(1 << AT[n] for n in names if n in AT)


def _numbers(text: str) -> list[tuple[int, int]]:
    """Where the numbers are that one thing may have: neighbouring short groups of digits together, longer ones alone."""
    runs: list[list[tuple[int, int]]] = []
    for m in GROUP.finditer(text):
        a, b = m.span()
        joined = bool(runs) and b - a < ALONE_DIGITS and runs[-1][-1][1] - runs[-1][-1][0] < ALONE_DIGITS and JOINT.match(text, runs[-1][-1][1], a) is not None
        runs[-1].append((a, b)) if joined else runs.append([(a, b)])
    out = []
    for run in runs:
        parts = [run]
        if sum(b - a for a, b in run) > MAX_DIGITS:  # a row of numbers: only what is tied by other marks than blanks stays together
            parts = [[run[0]]]
            for before, group in zip(run, run[1:], strict=False):
                parts[-1].append(group) if text[before[1] : group[0]].strip(" ") else parts.append([group])
        for part in parts:
            a, b = part[0][0], part[-1][1]
            if MIN_DIGITS <= sum(y - x for x, y in part) <= MAX_DIGITS:
                if not (a and (text[a - 1].isalnum() or text[a - 1] == "_") or b < len(text) and (text[b].isalnum() or text[b] == "_")):
                    out.append((a - (a > 0 and text[a - 1] == "(" and ")" in text[a:b]), b))
    return out


def _nodes(text: str, base: list[Span]) -> list[_Node]:
    """Base spans and candidates in text order."""
    found: list[tuple[int, int, str, tuple[str, ...]]] = []
    if DIGIT.search(text):
        found += [(a, b, "number", _keys("number", text[a:b])) for a, b in _numbers(text)]
        found += [(*m.span(), "spelled ip", ("i" + DOT.sub(".", m[0]),)) for m in SPELLED_IP.finditer(text)]
    end = 0
    for m in SPELLED_AT.finditer(text) if "[" in text or "(" in text else ():
        start = m.start()
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < m.start():
            end = m.end()
            found.append((start, end, "spelled email", _keys("email", text[start : m.start()] + "@" + DOT.sub(".", m[1]))))
    locals_ = {x for s in base if s.kind == "email" if len(x := text[s.start : s.end].lower().split("@")[0]) >= 5}
    if locals_ or "@" in text:
        for m in TOKEN.finditer(text):
            piece = m[0].rstrip(".")
            if "@" in piece.strip("@"):
                found.append((m.start(), m.start() + len(piece), "at sign", _keys("email", piece)))
            elif piece.lower() in locals_:
                found.append((m.start(), m.start() + len(piece), "word", _keys("word", piece)))
    nodes = [
        _Node(
            s.start,
            s.end,
            LABELS.index(s.kind),
            _keys(s.kind, text[s.start : s.end]),
            _shape(text, s.start, s.end, "number" if s.kind in ("card", "phone") else s.kind),
        ) for s in base
    ]
    if found:
        taken, i, last = sorted((s.start, s.end) for s in base), 0, 0
        reach = [0]  # the farthest end among the base spans so far
        for _, b in taken:
            reach.append(max(reach[-1], b))
        for start, end, kind, keys in sorted(found, key=lambda c: (c[0], -c[1])):
            while i < len(taken) and taken[i][0] < end:
                i += 1
            if start >= last and reach[i] <= start:  # overlaps neither a candidate nor a base span
                nodes.append(_Node(start, end, -1, keys, _shape(text, start, end, kind)))
                last = end
    return sorted(nodes, key=lambda n: (n.start, n.end, n.label))


def _edges(nodes: list[_Node]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain and skip edges: a node is linked by each of its keys to the last node before it with that key, and to the first.

    Base spans of two kinds over the same text are no neighbours and no repeats of each other.
    """
    apart = lambda a, b: nodes[a].end <= nodes[b].start
    chain = [(i - 1, i) for i in range(1, len(nodes)) if 0 <= nodes[i].start - nodes[i - 1].end <= NEAR]
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    skip = set()
    for i, node in enumerate(nodes):
        for key in node.keys:
            if key in last:
                skip |= {(j, i) for j in (last[key], first[key]) if apart(j, i)}
            first.setdefault(key, i)
            last[key] = i
    return chain, sorted(skip)


def propagate(node: np.ndarray, edges: np.ndarray, potentials: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """Marginals by loopy belief propagation in the log domain, half of each message kept (damping).

    node: nodes x labels; edges: pairs of nodes; potentials: edges x labels x labels (rows: first end); of: the number of
    the graph that each node is in, ascending. Each graph stops by itself, once its messages have settled or after
    ROUNDS rounds and one for each of its nodes. Without cycles, the result is exact once messages have crossed the
    longest path.
    """

    def normal(x: np.ndarray) -> np.ndarray:
        top = x.max(1, keepdims=True)
        return x - top - np.log(np.exp(x - top).sum(1, keepdims=True))

    of = np.zeros(len(node), np.int64) if of is None else of
    n = len(edges)
    ends = np.concatenate([edges[:, 0], edges[:, 1]])
    others = np.concatenate([edges[:, 1], edges[:, 0]])
    table = np.concatenate([potentials, potentials.transpose(0, 2, 1)])  # from ends to others
    messages = np.zeros((2 * n, node.shape[1]))
    back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
    graphs = int(of[-1]) + 1 if len(of) else 0
    most = ROUNDS + np.bincount(of, minlength=graphs)
    open_ = np.arange(2 * n)  # messages of graphs that have not settled
    step = 0
    while len(open_):
        belief = node.copy()
        np.add.at(belief, others[open_], messages[open_])
        out = (belief[ends[open_]] - messages[back[open_]])[:, :, None] + table[open_]
        top = out.max(1)
        new = normal(top + np.log(np.exp(out - top[:, None, :]).sum(1)))
        if step:
            new = normal(np.logaddexp(new, messages[open_]) - np.log(2))
        moved = np.zeros(graphs)
        np.maximum.at(moved, of[ends[open_]], np.abs(new - messages[open_]).max(1))
        messages[open_] = new
        step += 1
        open_ = open_[((moved >= SETTLED) & (step < most))[of[ends[open_]]]]
    belief = node.copy()
    np.add.at(belief, others, messages)
    return np.exp(normal(belief))


def _bits(shapes: Iterable[int]) -> np.ndarray:
    """Shapes as rows of zeros and ones."""
    return ((np.array(list(shapes), np.int64)[:, None] >> np.arange(len(NAMES))) & 1).astype(np.float64)


def field(nodes: list[_Node], chain: list[tuple[int, int]], skip: list[tuple[int, int]], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node potentials, edges and their potentials of one document or of several end to end; a pair that is both neighbours and linked is one edge."""
    potential = _bits(n.shape for n in nodes).reshape(-1, len(NAMES)) @ model.node
    for i, node in enumerate(nodes):
        if node.label >= 0:
            potential[i] = -50.0
            potential[i, node.label] = 0
    near, linked = set(chain), set(skip)
    pairs = sorted(near | linked)
    kinds = np.array([model.chain * 0, model.chain, model.skip, model.chain + model.skip])
    return potential, np.array(pairs, np.int64).reshape(-1, 2), kinds[[(p in near) + 2 * (p in linked) for p in pairs]].reshape(-1, *model.chain.shape)


def find(texts: list[str | None], model: Model, accept: float = ACCEPT) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text; null is empty. Added spans overlap no base span."""
    out, nodes, at, chain, skip = [], [], [], [], []
    for i, text in enumerate(texts):
        base = base_spans(text) if text else []
        out.append((base, []))
        own = _nodes(text, base) if text else []
        if all(n.label >= 0 for n in own):
            continue
        c, s = _edges(own)
        chain += [(a + len(nodes), b + len(nodes)) for a, b in c]
        skip += [(a + len(nodes), b + len(nodes)) for a, b in s]
        nodes += own
        at += [i] * len(own)
    if not nodes:
        return out
    marginal = propagate(*field(nodes, chain, skip, model), np.array(at, np.int64))
    for i, node in enumerate(nodes):
        label = int(marginal[i].argmax())
        if node.label < 0 and label and marginal[i, label] > accept:
            out[at[i]][1].append(Span(LABELS[label], node.start, node.end))
    return out


def counts(texts: Iterable[str | None]) -> Counter:
    """(part, a, b): how often a shape has a label (``node``), and how often labels are neighbours (``chain``) or linked (``skip``).

    Candidates linked to a node that has a label are not counted as having none: they may repeat it.
    """
    out: Counter = Counter()
    for text in texts:
        nodes = _nodes(text, base_spans(text)) if text else []
        if not nodes:
            continue
        chain, skip = _edges(nodes)
        linked = {i for a, b in skip for i in (a, b) if max(nodes[a].label, nodes[b].label) > 0}
        out.update(("node", n.shape, max(n.label, 0)) for i, n in enumerate(nodes) if n.label > 0 or i not in linked)
        out.update(("chain", max(nodes[a].label, 0), max(nodes[b].label, 0)) for a, b in chain)
        out.update(("skip", nodes[a].label, nodes[b].label) for a, b in skip if nodes[a].label > 0 and nodes[b].label > 0)
    return out


def learn(counted: dict[tuple[str, int, int], int]) -> Model:
    """The weights that these counts give; without any, only what the features mean counts."""
    size = len(LABELS)
    agree, pairs = np.zeros((size, size)), np.zeros((size, size))
    for (part, a, b), n in counted.items():
        if part == "chain":
            pairs[a, b] += n
        elif part == "skip":
            agree[a, b] += n
    shapes = sorted((a, b, n) for (part, a, b), n in counted.items() if part == "node")
    weights = _softmax_regression(
        _bits(a for a, _, _ in shapes).reshape(-1, len(NAMES)),
        np.array([b for _, b, _ in shapes], np.int64),
        np.log1p([n for *_, n in shapes]),
    )
    expected = pairs.sum(1, keepdims=True) * pairs.sum(0, keepdims=True) / max(pairs.sum(), 1.0)
    chain = np.log((pairs + UNSEEN) / (expected + UNSEEN))
    same = np.trace(agree)
    skip = np.full((size, size), -np.log((same + AGREED) / (agree.sum() - same + 1)))
    skip[np.diag_indices(size)] = 0
    return Model(weights, np.clip(chain, -1, 1), np.clip(2 * skip, -8, 0))


def fit(texts: Iterable[str | None]) -> Model:
    return learn(counts(texts))


def _softmax_regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1.0, steps: int = 400) -> np.ndarray:
    """The weights most likely after the rows and the prior (a normal one around the features' meaning), by gradient steps with momentum."""
    mean = np.zeros((len(NAMES), len(LABELS)))
    for name, odds in MEANING.items():
        for label, value in odds.items():
            mean[AT[name], LABELS.index(label)] = value
    w, speed = mean.copy(), np.zeros_like(mean)
    if not len(y):
        return w
    rate = 1 / (decay + 2 * weight.sum())
    for _ in range(steps):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        speed = 0.9 * speed - rate * (x.T @ (p * weight[:, None]) + decay * (w - mean))
        w += speed
    return w


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Learns from the counts over all texts; the driver gets a row for each combination of features and label."""
    ship(docs.sparkSession)

    def batches(parts):
        found: Counter = Counter()
        for part in (p for whole in parts for p in slices(whole, 0)):
            found += counts(part.column(0).to_pylist())
        rows = list(found.items())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[i] for k, _ in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))
            ] + [pa.array([n for _, n in rows], pa.int64())],
            names=["part", "a", "b", "n"],
        )

    each = docs.select(F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").mapInArrow(batches, "part string, a long, b long, n long")
    return learn({(r.part, r.a, r.b): r.n for r in each.groupBy("part", "a", "b").agg(F.sum("n").alias("n")).collect()})


def join(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end)))


def redact(text: str, spans: list[Span]) -> str:
    """Each span becomes its kind in brackets; overlapping spans become one, of the first's kind."""
    out, end = [], 0
    for s in sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind))):
        if s.start >= end:
            out += [text[end : s.start], f"[{s.kind.upper()}]"]
        end = max(end, s.end)
    return "".join(out) + text[end:]


def detect(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row.

    The counts and the digest are of base spans; ``spans`` has the added ones too. Null texts are empty and
    have no spans. Ids may be null or repeat; other columns aren't read.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(parts):
        own = shared.value
        for part in (p for whole in parts for p in slices(whole, 1)):
            found = find(part.column(1).to_pylist(), own)
            counts = [pa.array([sum(s.kind == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(join(base).encode()).hexdigest() for base, _ in found], pa.string())
            spans = pa.array([join(base + added) for base, added in found], pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *counts, digest, spans, pa.array([len(a) for _, a in found], pa.int64())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(
        batches,
        f"doc_id {dict(kept.dtypes)['doc_id']}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long",
    )


def redact_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind; other columns pass through, null texts stay null."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def batches(parts):
        own = shared.value
        for part in (p for whole in parts for p in slices(whole, at)):
            some = part.column(at).to_pylist()
            texts = [t if t is None else redact(t, base + added) for t, (base, added) in zip(some, find(some, own), strict=True)]
            columns = [pa.array(texts, part.schema.field(at).type) if j == at else c for j, c in enumerate(part.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(batches, docs.schema)
