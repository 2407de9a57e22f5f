"""SentencePiece byte-fallback BPE, encoded and decoded by vectorised merge rounds.

A text becomes words, each beginning with the space mark, and a word that a task has met before is looked up.
The symbols of the others lie end to end in one array. A round finds the least pair rank of each word and merges
its leftmost such pairs at once, in all words together, then closes the gaps and looks up the pairs
that changed; words without a pair that merges drop out. Merging all occurrences at once equals
merging them one by one unless the new symbol is in a pair of a better rank; where the vocabulary has such
a pair, a round merges only the leftmost.

In words longer than ``LONG`` a round merges every pair that is the least within ``reach`` symbols on both sides. No
piece is longer than that, so nothing merged before it elsewhere could get there, and the number of rounds doesn't follow
the length of the word. What is left after ``ROUNDS`` rounds (periodic words, in which one merge waits for the
last) is merged by a queue over the word's pairs.

Runs of space marks are pieces of their own, of one score below all others; they are formed last, from the left.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import slices
from heddle.session import ship

MARK = "▁"
NEVER = np.int32(2**31 - 1)
LONG, ROUNDS = 64, 200
HASH_BITS = 20
MEMO_BYTES = 40 << 20  # of words remembered by a task


@dataclass
class Vocabulary:
    chars: dict[str, int]  # symbol of a character; those from `size` on are no pieces
    size: int
    begin: int
    end: int
    byte_ids: np.ndarray
    keys: np.ndarray  # left * 2**32 + right, in the order of their hashes; -1 from the last on
    first: np.ndarray  # by hash: where its keys begin, the last place if it has none
    ranks: np.ndarray
    merged: np.ndarray
    alone: np.ndarray  # by rank: merge one at a time
    runs: np.ndarray  # piece of a run of space marks, by its length; 0 where there is none
    rests: list[list[int]]  # the pieces' lengths for a run shorter than the longest piece
    surface: np.ndarray  # the pieces' bytes, end to end
    surface_at: np.ndarray
    reach: int  # characters of the longest piece

    @cached_property
    def pairs(self) -> dict[int, tuple[int, int]]:
        return {k: (r, m) for k, r, m in zip(self.keys.tolist(), self.ranks.tolist(), self.merged.tolist(), strict=True) if k >= 0}


def load(path: str) -> Vocabulary:
    """Reads a BPE model with byte fallback; raises ValueError where this encoder's assumptions don't hold."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    spec, trainer = proto.normalizer_spec, proto.trainer_spec
    if trainer.model_type != 2 or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
        raise ValueError("a BPE model with byte fallback, a dummy prefix and no normalisation is needed")
    sp = SentencePieceProcessor(model_file=path)
    size = len(proto.pieces)
    normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
    if any(p.type not in (1, 2, 3, 6) for p in proto.pieces):
        raise ValueError("user-defined and unused pieces are not supported")
    runs = {len(p): i for p, i in normal.items() if p == MARK * len(p)}
    longest = max(runs)
    scores = {p: proto.pieces[i].score for p, i in normal.items()}
    ranked = sorted((p for p in normal if len(p) > 1 and p != MARK * len(p)), key=lambda p: -scores[p])
    if any(MARK in p[1:] for p in ranked) or 1 not in runs:
        raise ValueError("space marks inside pieces are not supported")
    if longest > 1 and (len({scores[MARK * n] for n in runs if n > 1}) > 1 or ranked and scores[MARK * longest] >= scores[ranked[-1]]):
        raise ValueError("runs of space marks must share the lowest score")
    rests = [_leftmost(n, set(runs)) for n in range(longest)]
    if any(_leftmost(longest + n, set(runs)) != [longest, *_leftmost(n, set(runs))] for n in range(2 * longest)):
        raise ValueError("runs of space marks must repeat with the longest piece")
    chars = {p: i for p, i in normal.items() if len(p) == 1}
    for p in ranked:
        for c in p:
            if c not in chars:
                chars[c] = size + len(chars)
    symbol = chars | {p: normal[p] for p in ranked}
    rank_of, before = {}, None
    for p in ranked:
        if scores[p] != before:
            before, rank = scores[p], len(rank_of)
        rank_of[p] = rank
    shared = Counter(rank_of.values())
    pairs, alone = [], np.zeros(max(1, len(ranked)), bool)
    for p in ranked:
        for cut in range(1, len(p)):
            a, b = p[:cut], p[cut:]
            if a in symbol and b in symbol:
                pairs.append((symbol[a] << 32 | symbol[b], rank_of[p], normal[p]))
                for part in (a, b):
                    if rank_of.get(part, -1) >= rank_of[p]:
                        alone[rank_of[part]] = True
    for rank, n in shared.items():
        alone[rank] |= n > 1
    keys, ranks, merged = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    hashes = _hash(keys)
    order = np.argsort(hashes, kind="stable")
    found, starts, sizes = np.unique(hashes[order], return_index=True, return_counts=True)
    first = np.full(1 << HASH_BITS, len(keys), np.int32)
    first[found] = starts
    pad = np.full(int(sizes.max()), -1)
    keys, ranks, merged = (np.concatenate([x[order], pad]) for x in (keys, ranks, merged))
    text = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type != 1 else p.piece.replace(MARK, " ").encode() for p in proto.pieces]
    byte_ids = np.zeros(256, np.int64)
    for i, p in enumerate(proto.pieces):
        if p.type == 6:
            byte_ids[int(p.piece[3:5], 16)] = i
    return Vocabulary(
        chars,
        size,
        sp.bos_id(),
        sp.eos_id(),
        byte_ids,
        keys,
        first,
        ranks.astype(np.int32),
        merged,
        alone,
        np.array([runs.get(n, 0) for n in range(longest + 1)]),
        rests,
        np.frombuffer(b"".join(text), np.uint8),
        np.cumsum([0, *map(len, text)]),
        max(map(len, ranked)),
    )


def _leftmost(n: int, lengths: set[int]) -> list[int]:
    """A run of n marks when the leftmost two neighbours whose sum is a piece merge, until none are left."""
    row = [1] * n
    while at := next((i + 1 for i in range(len(row) - 1) if row[i] + row[i + 1] in lengths), 0):
        row[at - 1 : at + 1] = [row[at - 1] + row[at]]
    return row


def _hash(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def _pair(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and symbol of each pair; NEVER where the vocabulary has none. Pairs whose hash is shared are looked at one by one."""
    key = left << np.int64(32) | right
    hashes = _hash(key)
    at = v.first[hashes]
    hit = v.keys[at] == key
    rest = np.flatnonzero(~hit & (v.keys[at] >= 0))
    while len(rest):
        at[rest] += 1
        held = v.keys[at[rest]]
        hit[rest] = held == key[rest]
        rest = rest[~hit[rest] & (held >= 0)]
        rest = rest[_hash(v.keys[at[rest]]) == hashes[rest]]
    return np.where(hit, v.ranks[at], NEVER), v.merged[at]


def _merge_words(words: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The words' piece ids end to end, and where each word starts."""
    text = "".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    seen, back = np.unique(points, return_inverse=True)
    unknown = 1 << 24  # a character that no piece has: its symbol is this plus its code point
    table = np.array([v.chars.get(chr(p), unknown + int(p)) for p in seen], np.int64)
    every, owner = table[back], np.repeat(np.arange(len(words)), sizes)
    long = (sizes > LONG)[owner]
    symbols, word = every[~long], owner[~long]
    rank = np.full(len(symbols), NEVER, np.int32)
    into = np.zeros(len(symbols), np.int64)
    inner = np.flatnonzero(word[:-1] == word[1:]) if len(word) else np.zeros(0, np.int64)
    rank[inner], into[inner] = _pair(v, symbols[inner], symbols[inner + 1])
    done_symbols, done_words = map(list, zip(_merge_long(every[long], owner[long], v), strict=True)) if long.any() else ([], [])
    while len(symbols):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        of = np.repeat(np.arange(len(first)), np.diff(first, append=len(word)))
        least = np.minimum.reduceat(rank, first)
        if (over := least == NEVER).any():
            out = over[of]
            done_symbols.append(symbols[out])
            done_words.append(word[out])
            stay = ~out
            symbols, word, rank, into = symbols[stay], word[stay], rank[stay], into[stay]
            if not len(symbols):
                break
            first = np.flatnonzero(np.diff(word, prepend=-1))
            of = np.repeat(np.arange(len(first)), np.diff(first, append=len(word)))
            least = least[~over]
        at = np.flatnonzero(rank == least[of])
        start = np.diff(at, prepend=-2) != 1  # of two overlapping pairs the left one merges, so every other of a run
        place = np.arange(len(at))
        kept = (place - np.maximum.accumulate(np.where(start, place, 0))) % 2 == 0
        single = v.alone[rank[at]]
        if single.any():
            kept &= ~single | (np.diff(of[at], prepend=-1) != 0)
        symbols, word, rank, into = _close(at[kept], symbols, word, rank, into, v)
    symbols, word = np.concatenate([*done_symbols, np.zeros(0, np.int64)]), np.concatenate([*done_words, np.zeros(0, np.int64)])
    order = np.argsort(word, kind="stable")
    symbols, word = symbols[order], word[order]
    if (symbols >= v.size).any():
        symbols, word = _bytes(symbols, word, v)
    return symbols, np.searchsorted(word, np.arange(len(words) + 1))


def _close(at: np.ndarray, symbols: np.ndarray, word: np.ndarray, rank: np.ndarray, into: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, ...]:
    """The arrays after merging the pairs at these places, which don't overlap."""
    symbols[at] = into[at]
    gone = np.zeros(len(symbols), bool)
    gone[at + 1] = True
    changed = np.zeros(len(symbols), bool)
    changed[at] = True
    changed[at[at > 0] - 1] = True
    previous_gone = at[(at > 1) & gone[np.maximum(at - 1, 0)]]
    changed[previous_gone - 2] = True
    stay = ~gone
    symbols, word, rank, into, changed = symbols[stay], word[stay], rank[stay], into[stay], changed[stay]
    look = np.flatnonzero(changed)
    rank[look] = NEVER
    look = look[look + 1 < len(symbols)]
    look = look[word[look] == word[look + 1]]
    rank[look], into[look] = _pair(v, symbols[look], symbols[look + 1])
    return symbols, word, rank, into


def _merge_long(symbols: np.ndarray, word: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and words after all merges, for words of any length."""
    rank, into = np.full(len(symbols), NEVER, np.int32), np.zeros(len(symbols), np.int64)
    inner = np.flatnonzero(word[:-1] == word[1:])
    rank[inner], into[inner] = _pair(v, symbols[inner], symbols[inner + 1])
    reach, edge = v.reach, np.full(v.reach, NEVER, np.int32)
    for _ in range(ROUNDS):
        # least[i]: the least rank among the `reach` pairs from i - reach on
        least, size = np.concatenate([edge, rank, edge]), 1
        while size < reach:
            step = min(size, reach - size)
            least = np.minimum(least[:-step], least[step:])
            size += step
        n = len(rank)
        before, after = least[:n], least[reach : reach + n]
        fits = (rank != NEVER) & (rank <= before) & (rank == after)
        at = np.flatnonzero(fits)
        if not len(at):
            return symbols, word
        alone = v.alone[rank[at]]
        kept = ~alone | (rank[at] < before[at])
        # of overlapping pairs of one rank every other one merges, counted from the first, which must fit too
        same = np.zeros(n, bool)
        same[1:] = (rank[1:] == rank[:-1]) & (rank[1:] != NEVER)
        if same[at].any():
            place = np.arange(n)
            begin = np.maximum.accumulate(np.where(same, 0, place))[at]
            kept &= alone | (fits[begin] & ((at - begin) % 2 == 0))
        symbols, word, rank, into = _close(at[kept], symbols, word, rank, into, v)
    out_symbols, out_words = [], []
    bounds = [*np.flatnonzero(np.diff(word, prepend=-1)).tolist(), len(word)]
    for a, b in zip(bounds, bounds[1:], strict=False):
        own = symbols[a:b] if (rank[a:b] == NEVER).all() else np.array(_queue(symbols[a:b].tolist(), v.pairs), np.int64)
        out_symbols.append(own)
        out_words.append(np.full(len(own), word[a]))
    return np.concatenate(out_symbols), np.concatenate(out_words)


def _queue(row: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    """One word's symbols after merging the leftmost pair of the least rank until there is none."""
    n = len(row)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    waiting = [(found[0], i, found[1], row[i], row[i + 1]) for i in range(n - 1) if (found := pairs.get(row[i] << 32 | row[i + 1]))]
    heapify(waiting)
    while waiting:
        _, i, merged, a, b = heappop(waiting)
        j = after[i]
        if row[i] != a or j < 0 or row[j] != b:
            continue  # one of the two has merged meanwhile
        row[i], row[j], after[i] = merged, -1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for x in (before[i], i):
            if x >= 0 and (y := after[x]) >= 0 and (found := pairs.get(row[x] << 32 | row[y])):
                heappush(waiting, (found[0], x, found[1], row[x], row[y]))
    return [x for x in row if x >= 0]


class _Memo(dict):
    """Words that a task has met, numbered, and their ids end to end; forgotten once they are beyond ``MEMO_BYTES``."""

    def __init__(self, v: Vocabulary):
        super().__init__()
        self.v, self.fresh, self.chars = v, [], 0
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number

    def numbers(self, words: list[str]) -> np.ndarray:
        """Each word's place in ``at``; new ones are merged."""
        if 200 * len(self) + 4 * self.chars + 4 * len(self.ids) > MEMO_BYTES:
            self.__init__(self.v)
            self.clear()
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            ids, at = _merge_words([MARK + w for w in self.fresh], self.v)
            self.chars += sum(map(len, self.fresh))
            self.at = np.concatenate([self.at, self.at[-1] + at[1:]])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.fresh = []
        return out


def _bytes(symbols: np.ndarray, word: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Characters that are no pieces become the pieces of their UTF-8 bytes."""
    names = {s: c for c, s in v.chars.items() if s >= v.size}
    plain = symbols < v.size
    spelled = {
        s: v.byte_ids[
            np.frombuffer((names.get(s) or chr(s - (1 << 24))).encode("utf-8", "surrogatepass"), np.uint8)
        ] for s in map(int, np.unique(symbols[~plain]))
    }
    lengths = np.ones(len(symbols), np.int64)
    for s, ids in spelled.items():
        lengths[symbols == s] = len(ids)
    out, starts = np.repeat(symbols, lengths), np.cumsum(lengths) - lengths
    for s, ids in spelled.items():
        out[(starts[symbols == s][:, None] + np.arange(len(ids))).ravel()] = np.tile(ids, int((symbols == s).sum()))
    return out, np.repeat(word, lengths)


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` end to end."""
    ends = np.cumsum(lengths)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]


def _join_runs(ids: np.ndarray, owner_ends: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Joins neighbouring single space marks of a text into the longest runs that are pieces, from the left."""
    longest = len(v.runs) - 1
    mark = ids == v.runs[1]
    if longest < 2 or not (mark[1:] & mark[:-1]).any():
        return ids, owner_ends
    text = np.searchsorted(owner_ends, np.arange(len(ids)), side="right")
    starts = np.flatnonzero(mark & ~(np.concatenate([[False], mark[:-1]]) & (np.diff(text, prepend=-1) == 0)))
    place = np.arange(len(ids))
    begin = np.zeros(len(ids), np.int64)
    begin[starts] = starts
    begin = np.maximum.accumulate(begin)
    head = mark & ((place - begin) % longest == 0)
    nexts = np.flatnonzero(head | ~mark)
    sizes = np.diff(nexts, append=len(ids))
    for rest in np.unique(sizes[mark[nexts]]):
        if rest < longest and len(v.rests[rest]) > 1:
            ragged = nexts[mark[nexts] & (sizes == rest)]
            for offset in np.cumsum(v.rests[rest])[:-1]:
                head[ragged + offset] = True
    nexts = np.flatnonzero(head | ~mark)
    sizes = np.diff(nexts, append=len(ids))
    out = ids[nexts].copy()
    runs = mark[nexts]
    out[runs] = v.runs[sizes[runs]]
    return out, np.searchsorted(nexts, owner_ends)


def encode_batch(texts: list[str], v: Vocabulary, memo: _Memo | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts end to end, begin and end ids included, and where each text ends."""
    memo = _Memo(v) if memo is None else memo
    parts = [t.replace(MARK, " ").split(" ") if t else [] for t in texts]
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    codes = memo.numbers([w for p in parts for w in p])
    sizes = np.diff(memo.at)[codes]
    body = _gather(memo.ids, memo.at[:-1][codes], sizes).astype(np.int64)
    word_ends = np.concatenate([[0], np.cumsum(sizes)])
    body, ends = _join_runs(body, word_ends[np.cumsum(counts)], v)
    out = np.empty(len(body) + 2 * len(texts), np.int64)
    lengths = np.diff(ends, prepend=0)
    stops = np.cumsum(lengths + 2)
    edge = np.zeros(len(out), bool)
    edge[stops - 1] = True
    edge[stops - 2 - lengths] = True
    out[stops - 2 - lengths] = v.begin
    out[stops - 1] = v.end
    out[~edge] = body
    return out, stops


def decode_batch(ids: np.ndarray, stops: np.ndarray, v: Vocabulary) -> list[bytes]:
    """The texts' UTF-8 bytes: pieces end to end without control ids, the dummy prefix removed."""
    lengths = np.diff(v.surface_at)[ids]
    flat = _gather(v.surface, v.surface_at[ids], lengths).tobytes()
    ends = np.concatenate([[0], np.cumsum(lengths)])[stops].tolist()
    out, start = [], 0
    for end in ends:
        out.append(flat[start + (flat[start : start + 1] == b" ") : end] if end > start else b"")
        start = end
    return out


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row, and ``ids`` (array) and ``decoded`` where asked for.

    Null texts are empty: two ids, the begin and the end. Ids of documents may be null or repeat. The vocabulary is read
    on the driver and broadcast; its size is fixed. Batches are cut into slices, so memory
    follows the longest text, not the table; a task remembers at most ``MEMO_BYTES`` of words.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load(model_path))
    extra = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string())}

    def batches(parts):
        v = shared.value
        memo = _Memo(v)
        for part in (p for whole in parts for p in slices(whole, 1)):
            ids, stops = encode_batch([t or "" for t in part.column(1).to_pylist()], v, memo)
            decoded = decode_batch(ids, stops, v)
            raw, ends = ids.astype("<u4").tobytes(), [0, *(4 * stops).tolist()]
            columns = [
                part.column(0),
                pa.array(np.diff(stops, prepend=0)),
                pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)], pa.string()),
                pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
            ]
            if "ids" in outputs:
                columns.append(pa.ListArray.from_arrays(pa.array([0, *stops.tolist()], pa.int32()), pa.array(ids.astype(np.int32))))
            if "decoded" in outputs:
                columns.append(pa.array([d.decode("utf-8", "replace") for d in decoded], pa.string()))
            yield pa.RecordBatch.from_arrays(
                columns,
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *[x for x in extra if x in outputs]],
            )

    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {dict(kept.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(f", {x} {extra[x][0]}" for x in extra if x in outputs)
    return kept.mapInArrow(batches, schema)
