"""Base spans against the plain patterns, propagation against enumeration, and what the field adds."""

import hashlib
import itertools
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from heddle.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and bool(digits) and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), list(PLAIN).index(kind), m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "B.", "@", ".", "-", "+", " ", "(", ")", "1", "42", "555", "4111111111111111", "10.0.0.1", "a@b.co", "é", "\n", "%", "0000"]), max_size=25).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert [(s.start, pii.KINDS.index(s.kind), s.end) for s in pii.base_spans(text)] == plain_spans(text)


def test_propagation_is_exact_on_trees_and_sane_on_loops():
    rng = np.random.default_rng(1)
    for edges in ([(0, 1), (1, 2), (1, 3)], [(0, 1), (1, 2), (0, 2)]):
        node, tables = rng.normal(size=(4, 3)), 0.5 * rng.normal(size=(len(edges), 3, 3))
        want = np.zeros((4, 3))
        for labels in itertools.product(range(3), repeat=4):
            p = np.exp(sum(node[i, x] for i, x in enumerate(labels)) + sum(t[labels[a], labels[b]] for (a, b), t in zip(edges, tables, strict=True)))
            for i, x in enumerate(labels):
                want[i, x] += p
        want /= want.sum(1, keepdims=True)
        got = pii.propagate(node, np.array(edges), tables)
        assert np.abs(got - want).max() < (2e-3 if len(edges) == 3 and edges[2] == (1, 3) else 0.05)


def enumerate_marginals(node, edges, tables):
    """Marginals by summing over all labelings."""
    want = np.zeros_like(node)
    for labels in itertools.product(range(node.shape[1]), repeat=len(node)):
        p = np.exp(sum(node[i, x] for i, x in enumerate(labels)) + sum(t[labels[a], labels[b]] for (a, b), t in zip(edges, tables, strict=True)))
        for i, x in enumerate(labels):
            want[i, x] += p
    return want / want.sum(1, keepdims=True)


def test_graphs_side_by_side_get_what_they_get_alone():
    rng = np.random.default_rng(4)
    chain = [(i - 1, i) for i in range(1, 30)]
    node, table = rng.normal(size=(30, 5)), np.full((5, 5), -7.4) + 7.4 * np.eye(5)
    alone = pii.propagate(node, np.array(chain), np.repeat(table[None], 29, 0))
    pairs = 4000
    others = rng.normal(size=(2 * pairs, 5))
    edges = np.array(chain + [(30 + 2 * i, 31 + 2 * i) for i in range(pairs)])
    of = np.concatenate([np.zeros(30, np.int64), 1 + np.repeat(np.arange(pairs), 2)])
    both = pii.propagate(np.concatenate([node, others]), edges, np.repeat(table[None], len(edges), 0), of)
    assert (both[:30] == alone).all()
    loops = np.array(chain + [(0, 9), (9, 20), (3, 28)])
    assert (pii.propagate(node, loops, np.repeat(table[None], 32, 0)) == pii.propagate(np.concatenate([node, others]), np.concatenate([loops, edges[29:]]), np.repeat(table[None], 32 + pairs, 0), of)[:30]).all()


def number(rng, n, lead="123456789"):
    return rng.choice(lead) + "".join(rng.choice("0123456789") for _ in range(n - 1))


def card(rng):
    body = number(rng, 15)
    return next(body + d for d in "0123456789" if pii.luhn(body + d))


def phone(rng):
    return f"({number(rng, 3)}) 555-{number(rng, 4, '0123456789')}"


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta omega sigma kappa theta zeta eta".split()) for _ in range(n))


def corpus(rng, n=300):
    out = []
    for i in range(n):
        kind = i % 6
        piece = [f"+1 {phone(rng)}", f"+44 {number(rng, 4)} {number(rng, 6)}", card(rng), f"bob.smith{i}@mail{i % 7}.example.com", f"10.2.{i % 250}.7", f"order {number(rng, 16)} of 2024-0{1 + i % 9}-1{i % 9} lot {number(rng, 8)}"][kind]
        cue = {0: "call ", 1: "phone: ", 2: "card no "}.get(kind, "") if i % 2 else ""
        out.append(f"{prose(rng, 9)} {cue}{piece} {prose(rng, 8)}")
    return out


TRAIN = corpus(random.Random(1))


def test_numbers_are_not_glued():
    numbers = lambda t: [t[a:b] for a, b in pii._numbers(t)]
    assert numbers("7536784127813050 4845168114407329 12") == ["7536784127813050", "4845168114407329"]
    assert numbers("call (456) 555-2186 or 4111 1111 1111 1111, x1234567 1234567y 12345") == ["(456) 555-2186", "4111 1111 1111 1111"]
    assert numbers("12 34 56 78 90 11 22 33 44 55 66 77 555-123-4567 8") == ["555-123-4567"]
    assert numbers("9" * 50 + " 1" * 5000) == []


def test_the_field_equals_enumeration():
    """Labels and added spans of small documents against the field's exact marginals."""
    rng, model = random.Random(7), pii.fit(TRAIN)
    differ = total = 0
    for _ in range(150):
        own = [card(rng), phone(rng), number(rng, 16), number(rng, 8), "bob.smith@mail.example.com", "ann@home"]
        parts = [rng.choice([*own, "+1 " + own[1], own[1].replace(" ", ""), "bob.smith", "call " + own[1], "card", own[0] + " " + own[0], prose(rng, 3), prose(rng, 30)]) for _ in range(rng.randrange(2, 7))]
        text = " ".join(parts)
        base = pii.base_spans(text)
        nodes = pii._nodes(text, base)
        if not 0 < len(nodes) <= 7:
            continue
        chain, skip = pii._edges(nodes)
        potential, edges, tables = pii.field(nodes, chain, skip, model)
        exact = enumerate_marginals(potential, edges, tables)
        got = pii.propagate(potential, edges, tables)
        part = list(range(len(nodes)))
        cyclic = False
        for a, b in edges:
            while part[a] != a:
                a = part[a]
            while part[b] != b:
                b = part[b]
            cyclic |= a == b
            part[a] = b
        assert np.abs(got - exact).max() < (0.3 if cyclic else 2e-3), text
        want = [pii.Span(pii.LABELS[int(m.argmax())], n.start, n.end) for n, m in zip(nodes, exact, strict=True) if n.label < 0 and m.argmax() and m.max() > pii.ACCEPT]
        (_, added), = pii.find([text], model)
        total += 1
        differ += added != want
        assert not any(a.start < b.end and b.start < a.end for a in added for b in base)
    assert total > 100 and differ <= 0.02 * total


def test_planted_repeats_are_found_and_others_left_alone():
    rng, model = random.Random(11), pii.fit(TRAIN)
    caught = planted = wrong = 0
    texts, wanted = [], []
    for i in range(300):
        mail, call, pay = f"carol{i}.jones@mail.example.com", phone(rng), card(rng)
        base, again = [(mail, f"carol{i}.jones"), (f"+1 {call}", call), (f"+1 {call}", call.replace(" ", "").replace("(", "").replace(")", "-")), (pay, ".".join(pay[j : j + 4] for j in range(0, 16, 4)))][i % 4]
        texts.append(f"{prose(rng, 5)} {base} {prose(rng, 2 + 60 * (i % 5))} {again} {prose(rng, 5)} {number(rng, 16)} {number(rng, 8)} 2024-05-1{i % 9} {prose(rng, 3)}")
        wanted.append(again)
    for text, again, (base, added) in zip(texts, wanted, pii.find(texts, model), strict=True):
        got = [text[s.start : s.end] for s in added]
        planted += 1
        caught += again in got
        wrong += len([g for g in got if g != again and not pii.luhn(g)])
    assert caught >= 0.9 * planted and wrong <= 0.01 * planted, (caught, wrong, planted)


def test_shape_and_cues_decide_without_a_repeat():
    model = pii.fit(TRAIN)
    texts = ["please call (456) 555-2186 today", "mail me: bob.smith [at] example [dot] com", "server 10[.]2[.]3[.]4 is down", "card 4111.1111.1111.1111 was charged", "lot 20240101 and 1234567 pieces, 7536784127813050 in all", "token 908038b7daaf919876543210"]
    assert [[s.kind for s in added] for _, added in pii.find(texts, model)] == [["phone"], ["email"], ["ip"], ["card"], [], []]


def test_results_do_not_depend_on_other_texts():
    rng, model = random.Random(5), pii.fit(TRAIN)
    call = phone(rng)
    chained = f"+1 {call} " + " ".join(f"{prose(rng, 20)} {call}" for _ in range(300))
    texts = [chained, *corpus(rng, 200), chained]
    together = pii.find(texts, model)
    assert together == [pii.find([t], model)[0] for t in texts]
    assert len(together[0][1]) == 300


def test_the_field_adds_repeats_only():
    model = pii.fit(TRAIN)
    text = "Reach me at +1 (456) 555-2186, bob.smith@mail.example.com. " + "filler " * 400 + "Again (456) 555-2186 or bob.smith, not 1234567890 nor smith."
    (base, added), (none, clean), (null, _) = pii.find([text, "order 1234567890 of 20240101 and lot 998877", None], model)
    assert {text[s.start : s.end]: s.kind for s in added} == {"(456) 555-2186": "phone", "bob.smith": "email"}
    assert len(base) == 2 and not none and not clean and not null
    assert pii.redact(text, base + added).count("[PHONE]") == 2


def test_spark(spark):
    rows = [(1, "a@b.co x 10.0.0.1", 1), (1, "a@b.co x 10.0.0.1", 2), (None, None, 3), (3, "", 4), (4, "9" * 50000 + "a." * 50000 + "@" * 20000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    model = pii.train(docs)
    texts = [r[1] for r in rows]
    assert (model.node == pii.fit(texts).node).all() and (model.skip == pii.fit(texts).skip).all()  # counts of all rows
    got = {(r.doc_id, r.spans, r.n_email, r.n_ip, r.base_sha256) for r in pii.detect(docs, model).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {(1, "email:0:6,ip:9:17", 1, 1, sha("email:0:6,ip:9:17"))} | {(i, "", 0, 0, sha("")) for i in (None, 3, 4)}
    texts = [r.text for r in pii.redact_documents(docs, model).collect()]
    assert texts[0] == "[EMAIL] x [IP]" and texts[2] is None and len(texts) == 5
    assert pii.detect(docs.where("doc_id > 9"), pii.train(docs.where("doc_id > 9"))).count() == 0
