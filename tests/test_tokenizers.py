"""Windows by tokens: within the budget, substrings that cover all words, the greedy ones."""

import random

import public_tokenizers
import pytest

from heddle.operators import tokenizers
from heddle.plans import chunk_plans

KINDS = {
    "pattern": lambda: tokenizers.Pattern(),
    "bytes": lambda: tokenizers.Vocabulary(public_tokenizers.path("byte_bpe_50k.json")),
    "words": lambda: tokenizers.Vocabulary(public_tokenizers.path("word_bpe_49k.json")),
}


def texts():
    draw = random.Random(3)
    for _ in range(150):
        text = "".join(draw.choice("ab c.,\n \u00e9\U0001f600\u6f22 xyz-") for _ in range(draw.randint(0, 120)))
        yield draw.choice([text, text, "x-" * 40 + text + "\u6f22\U0001f600" * 9, "<|endoftext|> " + text])


@pytest.mark.parametrize("kind", KINDS)
def test_budget_and_cover(kind):
    tokenizer, draw = KINDS[kind](), random.Random(5)
    for text in texts():
        most = draw.randint(4, 20)
        overlap = draw.randint(0, most - 1)
        found = list(tokenizers.cut(text, tokenizer, most, overlap))
        covered = {i for start, end, _ in found for i in range(start, end)}
        assert {i for m in tokenizers.WORD.finditer(text) for i in range(*m.span())} <= covered
        assert all(n == len(tokenizer.spans(text[start:end])) <= most for start, end, n in found)
        assert [f[:2] for f in found] == sorted({f[:2] for f in found})
        words = {m.start(): m.end() for m in tokenizers.WORD.finditer(text)}
        if all(len(tokenizer.spans(text[a:b])) <= most for a, b in words.items()):
            assert all(start in words and end in words.values() for start, end, _ in found)


def test_greedy_by_brute_force():
    """Without overlap a window is as many words as fit."""
    tokenizer = tokenizers.Pattern()
    for text in texts():
        words, want, first = [m.span() for m in tokenizers.WORD.finditer(text)], [], 0
        fits = lambda i, j: len(tokenizer.spans(text[words[i][0] : words[j][1]])) <= 30  # noqa: B023, E731
        if not all(fits(i, i) for i in range(len(words))):
            continue
        while first < len(words):
            last = max(j for j in range(first, len(words)) if fits(first, j))
            want.append((words[first][0], words[last][1]))
            first = last + 1
        assert [f[:2] for f in tokenizers.cut(text, tokenizer, 30)] == want


def test_equals_sql(same_rows):
    same_rows(chunk_plans.chunk_tokens, chunk_plans.ORACLES["chunk_tokens"])


def test_edges(spark):
    rows = [("a", None, 1), ("b", "", 1), ("c", " \n", 1), (None, "one two", 1), ("d", "one two", 1), ("d", "one two", 1)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, piece int")
    found = tokenizers.windows(docs, KINDS["bytes"](), 4)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(x, 0, 0, 7, "one two", 2) for x in (None, "d", "d")], key=str)
    assert tokenizers.windows(docs.where("false"), tokenizers.Pattern(), 4).count() == 0
    one = spark.createDataFrame([("d", "\U0001f9ff")], "doc_id string, text string")
    assert [r.token_count > 1 for r in tokenizers.windows(one, KINDS["bytes"](), 1).collect()] == [True]  # one code point is never cut
    with pytest.raises(ValueError, match="smaller"):
        tokenizers.windows(docs, tokenizers.Pattern(), 4, 4)
