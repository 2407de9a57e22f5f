"""Chat records of different layouts made one, and rendered with a loss mask.

A record's layout is recognised by a schema fingerprint: the hash of the nested field paths, down to the fields of
array elements, that hold a value somewhere in that record. So two records of one table, or of one column, can
have different layouts. Each declared layout has the fingerprints of its required paths with every choice of its
optional ones, and says how these fields become canonical turns of a role and a text.

The template writes ``<|start|>role``, a line feed, the text and ``<|end|>`` with a line feed for each turn. Inside
roles and texts, ``&``, ``<`` and ``[`` are written as entities, so no control string of this or of another
common template can begin there; reading back undoes it exactly. The loss mask is the list of the
assistant texts' spans, in code points of the rendered text, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm.common import spare

START, END = "<|start|>", "<|end|>\n"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
#: What speakers are called where a layout has "from" instead of "role".
SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
BLOCK = 256
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Paths are column or field names joined by dots; ``[]`` marks an array's elements.

    ``needed`` are optional paths that the table's schema must have all the same.
    """

    name: str
    required: tuple[str, ...]
    turns: Callable[[Callable[[str], Column]], Column]  # from a column of each path's top field
    optional: tuple[str, ...] = ()
    needed: tuple[str, ...] = ()


def _turn(role: Column | str, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _speaker(role: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in SPEAKERS.items() for x in pair]), role), role)


def _spoken(column: Column, role: str, text: str) -> Column:
    return F.transform(column, lambda m: _turn(_speaker(m[role]) if role == "from" else m[role], m[text]))


def _asked(system: Column, question: Column, answer: Column) -> Column:
    return F.filter(
        F.array(F.when(system.isNotNull(), _turn("system", system)), _turn("user", question), _turn("assistant", answer)),
        lambda t: t.isNotNull(),
    )


def _list(name: str, column: str, role: str, text: str) -> Layout:
    """Turns as an array's elements; a record whose texts are all null has the layout too."""
    return Layout(name, (f"{column}[].{role}",), lambda c: _spoken(c(column), role, text), (f"{column}[].{text}",), (f"{column}[].{text}",))


LAYOUTS = (
    _list("turns", "turns", "role", "text"),
    _list("messages", "messages", "role", "content"),
    _list("messages_from", "messages", "from", "value"),
    _list("conversations", "conversations", "from", "value"),
    _list("conversations_role", "conversations", "role", "content"),
    Layout("prompt_response", ("prompt", "response"), lambda c: _asked(c("system"), c("prompt"), c("response")), ("system",)),
    Layout("prompt_completion", ("prompt", "completion"), lambda c: _asked(c("system"), c("prompt"), c("completion")), ("system",)),
    Layout("instruction", ("instruction", "output"), lambda c: _asked(c("system"), F.concat(c("instruction"), F.when(F.coalesce(c("input"), F.lit("")) != "", F.concat(F.lit("\n\n"), c("input"))).otherwise(F.lit(""))), c("output")), ("input", "system")),
)


def leaf_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """The paths of all leaves."""
    out = []
    for f in schema.fields:
        kind, path = f.dataType, prefix + f.name
        while isinstance(kind, T.ArrayType):
            kind, path = kind.elementType, path + "[]"
        out += leaf_paths(kind, path + ".") if isinstance(kind, T.StructType) else [path]
    return out


def _holds(value: Column, steps: list[str]) -> Column:
    """Whether a nested value has something at the end of a path: ``[]`` goes into elements, others into fields."""
    if not steps:
        return value.isNotNull()
    if steps[0] == "[]":
        return F.coalesce(F.exists(value, lambda x: _holds(x, steps[1:])), F.lit(False))
    return _holds(value[steps[0]], steps[1:])


def _steps(path: str) -> list[str]:
    return [s for part in path.split(".") for s in (part.replace("[]", ""), *["[]"] * part.count("[]"))]


def schema_fingerprint(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The hash of the sorted nested paths, among those that layouts name, that hold a value in the row."""
    known = {p for lay in layouts for p in (*lay.required, *lay.optional)}
    present = []
    for path in sorted(p for p in leaf_paths(df.schema) if p in known):
        top, *rest = _steps(path)
        present.append(F.when(_holds(F.col(f"`{top}`"), rest), F.lit(path)))
    return F.xxhash64(F.concat_ws("\n", *present))


def canonical_turns(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds ``layout`` and ``turns``: an array of (role, text) in order; columns of these names are replaced.

    A row whose fingerprint no layout has gets a null layout and no turns, as has one whose array is empty. Null roles and
    texts are empty, null elements are dropped. All other columns pass through; those that no layout names don't count,
    whatever they are called, nor does a column of a known name and another shape.
    """
    paths = set(leaf_paths(df.schema))
    mark = spare(df, "fingerprint")
    marked = df.withColumn(mark, schema_fingerprint(df, layouts))

    def column(name: str) -> Column:
        return F.col(f"`{name}`") if any(_steps(p)[0] == name for p in paths) else F.lit(None).cast("string")

    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for lay in reversed(layouts):
        if not paths.issuperset((*lay.required, *lay.needed)):
            continue
        there = [p for p in lay.optional if p in paths]
        prints = [F.xxhash64(F.lit("\n".join(sorted((*lay.required, *some))))) for n in range(len(there) + 1) for some in combinations(there, n)]
        mine = reduce(lambda a, b: a | b, [F.col(mark) == p for p in prints])
        layout = F.when(mine, F.lit(lay.name)).otherwise(layout)
        turns = F.when(mine, F.filter(lay.turns(column), lambda t: t.isNotNull()).cast(TURNS)).otherwise(turns)
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("layout", "turns")]
    return marked.select(*keep, layout.alias("layout"), turns.alias("turns"))


def from_rows(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): one record for each id (null included) from a row for each turn.

    Turns are in the order of ``turn_col`` (null first), ties in that of role and text; repeated rows are turns of their own.
    A conversation is one record, so its turns meet in one task by definition.
    """
    row = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    met = df.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return met.select("conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"))


def escape(text: Column) -> Column:
    for raw, entity in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for raw, entity in reversed(ESCAPES):
        text = F.replace(text, F.lit(entity), F.lit(raw))
    return text


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def _running(sizes: Column) -> Column:
    """The sum of the sizes before each element. Sums run within blocks first, so long arrays aren't copied for every element."""
    run = lambda xs: F.aggregate(xs, F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(sizes), F.lit(1)), F.lit(BLOCK)), lambda i: run(F.slice(sizes, i, BLOCK)))
    before = run(F.transform(blocks, lambda b: F.element_at(b, -1)))
    return F.flatten(
        F.zip_with(
            blocks,
            F.slice(before, 1, F.size(before) - F.lit(1)),
            lambda b, start: F.transform(F.slice(b, 1, F.size(b) - F.lit(1)), lambda x: x + start),
        )
    )


def render(df: DataFrame, turns: str = "turns") -> DataFrame:
    """Adds ``formatted`` and ``loss_mask`` (an array of (start, end)); no turns give an empty text and mask.

    Columns of the added names are replaced, all others pass through, whatever they are called.
    """
    written, starts = spare(df, "written"), spare(df, "starts")
    pieces = F.transform(
        turns,
        lambda t: F.struct(
            (t["role"] == "assistant").alias("own"),
            F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
        ),
    )
    sizes = F.transform(written, lambda t: (F.length(t["head"]) + F.length(t["body"]) + F.lit(len(END))).cast("long"))

    def span(t: Column, i: Column) -> Column:
        start = F.get(F.col(starts), i) + F.length(t["head"])
        return F.when(t["own"], F.struct(start.cast("int").alias("start"), (start + F.length(t["body"])).cast("int").alias("end")))

    df = df.withColumn(written, pieces)
    df = df.withColumn(starts, _running(sizes))
    return df.withColumns(
        {
            "formatted": F.array_join(F.transform(written, lambda t: F.concat(t["head"], t["body"], F.lit(END))), ""),
            "loss_mask": F.filter(F.transform(written, span), lambda s: s.isNotNull()),
        }
    ).drop(written, starts)


def read_turns(formatted: Column) -> Column:
    """The turns of a rendered text."""
    parts = F.split(formatted, "<\\|start\\|>")

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        begin = F.length(role) + F.lit(2)
        return F.struct(
            _unescape_role(role).alias("role"),
            unescape(F.substring(part, begin, F.length(part) - begin + F.lit(1 - len(END)))).alias("text"),
        )

    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - F.lit(1), F.lit(0))), turn)


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return unescape(F.array_join(F.transform(mask, lambda s: F.substring(formatted, s["start"] + F.lit(1), s["end"] - s["start"])), ""))
