"""Spelling variants against comparing all words, and forms followed one by one."""

import random
import re
import zlib
from collections import Counter

from heddle.llm import variants


def vocabulary(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def direct(rows):
    words = vocabulary(rows)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words)


def grouped(spark, rows, schema="doc_id long, text string"):
    return sorted(tuple(r) for r in variants.group(spark.createDataFrame(rows, schema)).select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_random_texts_against_direct(spark):
    rng = random.Random(5)
    for letters, shape in (("ab", (4, 7)), ("aBéÉ×", (5, 6)), ("abcdefgh", (5, 9))):
        stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(*shape))) for _ in range(12)]

        def mistyped(w, letters=letters):
            kind, i = rng.randrange(6), rng.randrange(len(w))
            return [w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :], w, w, w][kind]

        rows = [(i, rng.choice([" ", "-", "İ", "7"]).join(mistyped(rng.choice(stems[: 1 + rng.randrange(12)])) for _ in range(60))) for i in range(40)]
        assert grouped(spark, rows) == direct(rows)


def test_chains_lead_to_the_last_form(spark):
    steps = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb"]
    rows = [(i, " ".join(w for j, w in enumerate(steps) for _ in range(3 * 2**j))) for i in range(1)]
    got = grouped(spark, rows)
    assert got == direct(rows)
    assert {r[2] for r in got} == {"bbbbb"}


def test_letters_are_dropped_where_97_divides(spark):
    rows = [(i, "wonderful wonderful") for i in range(3000)]
    got = grouped(spark, rows)
    assert got == direct(rows) and len(got) > 1


def test_words_longer_than_literal_keys(spark):
    word = "".join(chr(97 + i * i % 26) for i in range(200))
    rows = [(i, t) for i, t in enumerate([f"{word} {word[:-1]} {word[:64]} {word[:65]} {word[:63]} {word[:100]}z{word[101:]} {word}"] * 3)]
    assert grouped(spark, rows) == direct(rows)
    assert [r[4] for r in direct(rows)] == [1, 2, 1, 1, 2, 1]


def test_one_word_in_a_third_of_all_rows(spark):
    rows = [(i, "common words common " + ("commas" if i % 3 else "comman")) for i in range(120)]
    assert grouped(spark, rows) == direct(rows)


def test_nulls_empty_texts_repeats_clashes_and_empty_tables(spark):
    rows = [(None, "lettre lettre lettre lettra", "a"), (3, None, "b"), (4, "", "b"), (4, "lettra, LETTRA!", None), (4, "lettra, LETTRA!", None)]
    got = grouped(spark, rows, "doc_id long, text string, word string")
    assert got == direct([r[:2] for r in rows]) and len(got) == 2
    assert grouped(spark, [], "doc_id long, text string") == []
    assert grouped(spark, [(1, "a b c 1 2 3")]) == []


def test_a_long_text_is_read_piece_by_piece(monkeypatch):
    text = "alpha Betaé gamma-delta " * 50
    whole = variants.words_of(7, text)
    monkeypatch.setattr(variants, "PIECE", 11)
    assert variants.words_of(7, text) == whole
