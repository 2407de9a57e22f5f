"""Structural chunks against a direct version."""

import random
import re

from heddle.operators import chunking as C
from test_chunking import BLOCKS, direct_pack


def direct_fit(kind, text, room):
    if len(text.split()) <= room:
        return [text]
    if kind == "table":
        lines = [x for x in text.split("\n") if x.strip()]
        top = 2 if len(lines) > 1 and re.fullmatch(r"[|\s:-]+", lines[1]) else 1
        if len(lines) <= top:
            return [text]
        head = "\n".join(lines[:top])
        return [head + "\n" + b for b in direct_pack([x + "\n" for x in lines[top:]], max(1, room - len(head.split())))]
    small = []
    for s in [p for p in re.sub(r"((?<=[.!?])\s+|\n{2,})", "\\1\x01", text).split("\x01") if p]:
        words = s.split()
        small += [" ".join(words[i : i + room]) + " " for i in range(0, len(words), room)] if len(words) > room else [s]
    return direct_pack(small, room)


def direct(blocks, budget):
    out, path, runs = [], {}, []
    for _, ord_, kind, level, text in sorted(blocks):
        if kind in ("title", "heading"):
            own = 0 if kind == "title" else min(max(level, 1), 6)
            path = {k: v for k, v in path.items() if k < own} | {own: text}
        elif kind != "picture" and text and text.strip():
            now = [path[k] for k in sorted(path)]
            if not runs or runs[-1][0] != now:
                runs.append((now, ord_, []))
            room = max(budget - len(" ".join(now).split()), budget // 2)
            runs[-1][2].extend(t + "\n" for t in direct_fit(kind, text, room))
    for run, (now, ord_, pieces) in enumerate(runs):
        room = max(budget - len(" ".join(now).split()), budget // 2)
        out += [(run, ord_, now, i, t.rstrip("\n")) for i, t in enumerate(direct_pack(pieces, room))]
    return out


def corpus(rng):
    blocks = []
    for doc in range(40):
        for ord_ in range(rng.randrange(0, 25)):
            kind = rng.choice(["text"] * 5 + ["heading"] * 3 + ["table", "table", "title", "picture"])
            if kind == "table":
                rule = ["| --- | --- |"] if rng.random() < 0.7 else []
                text = "\n".join(["| key | value |", *rule, *(f"| {i} | {'v ' * rng.randrange(1, 9)}|" for i in range(rng.randrange(0, 9)))])
            elif kind in ("heading", "title"):
                text = rng.choice(["A", "B", "A long name of a part"])
            else:
                text = " ".join(rng.choice(["word", "other", "end.", "Why?", "\n\n"]) for _ in range(rng.randrange(0, 60)))
            blocks.append((doc, ord_, kind, rng.randrange(1, 4) if kind == "heading" else None, text))
    return [*blocks, (90, 0, "text", None, None), (91, 0, "text", None, "  "), (92, 0, "text", None, "x " * 500)]


def test_structural_equals_a_direct_version(spark):
    blocks = corpus(random.Random(11))
    found = C.structural(C.segment(spark.createDataFrame(blocks, BLOCKS)), 16).collect()
    for doc in {b[0] for b in blocks}:
        own = sorted((r.run, r.ord, list(r.headings), r.piece, r.text) for r in found if r.doc_id == doc)
        assert own == direct([b for b in blocks if b[0] == doc], 16), doc
    assert all(r.token_count == len(r.text.split()) for r in found)
    rooms = {(r.doc_id, r.run, r.piece): max(16 - len(" ".join(r.headings).split()), 8) for r in found}
    assert all(r.token_count <= rooms[r.doc_id, r.run, r.piece] or r.text.count("|") for r in found)  # only a table's row can be larger
    assert C.structural(C.segment(spark.createDataFrame([], BLOCKS)), 16).count() == 0
