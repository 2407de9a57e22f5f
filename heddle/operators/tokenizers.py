"""Token budgets by a real tokenizer: where its tokens stand in a text, and windows of whole words within a budget of them.

A window is always a substring of its text, and never has more tokens, counted on its own, than the budget; only a single code point that the
tokenizer cuts into more than that stands alone beyond it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate
from pathlib import Path
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from heddle.session import ship

WORD = re.compile(r"[^\x09-\x0D\x20]+")
FLUSH_CHARS = 4 << 20


class Tokenizer(Protocol):
    """What counts tokens. It is sent to executors, so it must pickle."""

    def spans(self, text: str) -> Sequence[tuple[int, int]]:
        """(start, end) of each token in code points, ascending; several tokens of one code point have the same span."""


class Pattern:
    """The leftmost matches of a regular expression are the tokens."""

    def __init__(self, pattern: str = r"[A-Za-z0-9]+|[^A-Za-z0-9\x09-\x0D\x20]"):
        self.pattern = re.compile(pattern)

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.pattern.finditer(text)]


class Vocabulary:
    """A tokenizer file of the ``tokenizers`` library, read once by the driver; no special tokens are added or recognised."""

    def __init__(self, path: str):
        self.definition = Path(path).read_text(encoding="utf-8")
        self._made = None

    def __getstate__(self) -> dict:
        return {"definition": self.definition, "_made": None}

    def spans(self, text: str) -> list[tuple[int, int]]:
        if self._made is None:
            import tokenizers

            self._made = tokenizers.Tokenizer.from_str(self.definition)
            self._made.encode_special_tokens = True
            self._made.no_truncation()
        return self._made.encode(text, add_special_tokens=False).offsets


def _units(text: str, tokenizer: Tokenizer, most: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of what is never cut: words, or parts of a word that alone is beyond the budget.

    A token belongs to the last word that begins before its end, so white space that has tokens of its own counts to the word before it.
    """
    words = [m.span() for m in WORD.finditer(text)]
    starts, spans = [w[0] for w in words], tokenizer.spans(text)
    counts, own = [0] * len(words), [[] for _ in words]
    for at, end in spans:
        if (i := max(0, bisect_left(starts, end) - 1)) < len(words):
            counts[i] += 1
            own[i].append(at)
    out = []
    for (begin, end), n, tokens in zip(words, counts, own, strict=True):
        cuts = [begin]
        if n > most:  # alone it may have fewer, without the white space after it
            tokens = [begin + at for at, _ in tokenizer.spans(text[begin:end])]
            n = len(tokens)
        for k in range(most, n, most):
            if cuts[-1] < tokens[k] < end:
                cuts.append(tokens[k])
        parts = list(zip(cuts, [*cuts[1:], end], strict=True))
        out += [(a, b, n if len(parts) == 1 else bisect_left(tokens, b) - bisect_left(tokens, a) if b < end else n - bisect_left(tokens, a)) for a, b in parts]
    return out


def _halves(text: str, start: int, end: int, tokenizer: Tokenizer, most: int) -> Iterator[tuple[int, int, int]]:
    """A unit in parts that fit when they are counted alone; one code point stays as it is."""
    n = len(tokenizer.spans(text[start:end]))
    if n <= most or end - start == 1:
        yield start, end, n
    else:
        middle = (start + end) // 2
        yield from _halves(text, start, middle, tokenizer, most)
        yield from _halves(text, middle, end, tokenizer, most)


def cut(text: str, tokenizer: Tokenizer, max_tokens: int, overlap: int = 0) -> Iterator[tuple[int, int, int]]:
    """(start, end, tokens) of the windows of one text.

    Each takes as many whole words as fit. The next begins at the first word after this one's first from which at most ``overlap`` tokens
    are left of this one; the last window ends with the text's last word.
    """
    units = _units(text, tokenizer, max_tokens)
    total = list(accumulate((u[2] for u in units), initial=0))
    first = 0
    while first < len(units):
        last = max(first + 1, bisect_right(total, total[first] + max_tokens) - 1)
        while (n := len(tokenizer.spans(text[units[first][0] : units[last - 1][1]]))) > max_tokens and last > first + 1:
            last -= 1
        if n > max_tokens:
            yield from _halves(text, *units[first][:2], tokenizer, max_tokens)
        else:
            yield units[first][0], units[last - 1][1], n
        if last == len(units):
            return
        first = max(first + 1, min(last, bisect_left(total, total[last] - overlap)))


def windows(docs: DataFrame, tokenizer: Tokenizer, max_tokens: int, overlap: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, end, text, token_count): each text's windows, from 0; null and blank texts have none.

    Texts are cut one by one in Arrow batches, and what they give leaves in batches of about four million characters: nothing is shuffled.
    """
    if not 0 <= overlap < max_tokens:
        raise ValueError(f"overlap ({overlap}) must be smaller than max_tokens ({max_tokens})")
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def flush(ids: list, rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays(ids), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["id", "piece", "start", "end", "text", "token_count"]
        )

    def batches(parts):
        for part in parts:
            ids, rows, held = [], [], 0
            for i in range(part.num_rows):
                text = part.column(1)[i].as_py() or ""
                for piece, (start, end, n) in enumerate(cut(text, tokenizer, max_tokens, overlap)):
                    ids.append(part.column(0)[i : i + 1])
                    rows.append((piece, start, end, text[start:end], n))
                    held += end - start
                    if held >= FLUSH_CHARS:
                        yield flush(ids, rows)
                        ids, rows, held = [], [], 0
            if rows:
                yield flush(ids, rows)

    made = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t")).mapInArrow(
        batches, f"id {id_type}, piece long, start int, end int, text string, token_count long"
    )
    return made.withColumnRenamed("id", id_col)
