"""Documents out of files: a parser protocol, a stand-in for plain texts, and what a parse amounts to."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.session import ship

BLOCKS = "doc_id string, ord int, kind string, level int, text string, page int"
SCANNED_CHARS = 50
PICTURE_SIDE = 50.0
SAME_START = 24
FENCE = "```"
HAN = "[⺀-鿿]"
EDGES = r"(?U)^\s+|\s+$"


class Parser(Protocol):
    def __call__(self, content: bytes) -> list[tuple[str, int | None, str, int]]:
        """(kind, level, text, page) of each block; raises for a file that can't be read whole."""


def plain_parser(content: bytes) -> list[tuple[str, int | None, str, int]]:
    """UTF-8 text: a form feed starts a page, ``#`` marks headings, blank lines part paragraphs."""
    out: list[tuple[str, int | None, str, int]] = []
    for page, text in enumerate(content.decode("utf-8").split("\f"), 1):
        for part in re.split(r"\n\s*\n", text):
            part = part.strip()
            if mark := re.match(r"(#{1,6})\s+(.*)", part):
                out.append(("heading", len(mark[1]), mark[2].strip(), page))
            elif part:
                out.append(("table" if part.startswith("|") else "text", None, part, page))
    return out


def timeout_s(pages: int) -> float:
    """The time that a file of so many pages may take."""
    return max(600.0, 20.0 * pages)


class ParseTimeout(RuntimeError):
    """A file took longer than its pages allow."""


def in_time(parser: Parser, content: bytes, limit: float) -> list[tuple[str, int | None, str, int]]:
    """What the parser makes of a file; ParseTimeout once the limit has passed (the parser's thread is left behind)."""
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(parser, content).result(limit)
    except TimeoutError:
        raise ParseTimeout(f"The file was not read in {limit:g} s.") from None
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def page_count(content: bytes) -> int:
    """Pages of a file, by its form feeds or a PDF's page objects."""
    return max(content.count(b"\f") + 1, len(re.findall(rb"/Type\s*/Page\b", content)))


def parse(files: DataFrame, parser: Parser = plain_parser, limit: Callable[[int], float] = timeout_s) -> DataFrame:
    """Blocks of (doc_id, content) files; a file that fails, or takes longer than its pages allow, fails the job, so a document is whole or absent."""

    ship(files.sparkSession)
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32())

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for doc, content in zip(part.column(0).to_pylist(), part.column(1), strict=True):  # a file at a time: memory follows the largest
                held = content.as_py()
                rows = [(doc, i, *block) for i, block in enumerate(in_time(parser, held, limit(page_count(held))))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)],
                    names=["doc_id", "ord", "kind", "level", "text", "page"],
                )

    return files.select("doc_id", "content").mapInArrow(batches, BLOCKS)


def summary(blocks: DataFrame) -> DataFrame:
    """(doc_id, pages, tables, table_cells, text_items, text_chars, chars_per_page, scanned): what a parse reached.

    Pages are those that a block is on. A table's cells are the fields of its lines, the rule under the header aside.
    """
    text = F.col("kind").isin("text", "heading", "title")
    lines = F.filter(F.split("text", "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^[|\s:-]+$"))
    cells = F.aggregate(lines, F.lit(0), lambda n, x: n + F.size(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|")))
    met = blocks.groupBy("doc_id").agg(
        F.count_distinct("page").alias("pages"),
        F.count_if(F.col("kind") == "table").alias("tables"),
        F.coalesce(F.sum(F.when(F.col("kind") == "table", cells)), F.lit(0)).alias("table_cells"),
        F.count_if(text).alias("text_items"),
        F.coalesce(F.sum(F.when(text, F.length("text"))), F.lit(0)).alias("text_chars"),
    )
    per_page = F.round(F.try_divide(F.col("text_chars"), F.col("pages")), 1)
    return met.withColumn("chars_per_page", per_page).withColumn("scanned", per_page < SCANNED_CHARS)


class Reader(Protocol):
    def read(self, picture: bytes) -> str:
        """The text of a picture of a page's region."""


def fill(regions: DataFrame, reader: Reader, lenient: bool = False) -> DataFrame:
    """Regions (..., text, picture) with the text of those that have none read from their picture, and what happened: ``kept``, ``read``, ``cut`` or ``empty``.

    A reading ends where the model starts to repeat itself (see ``reading_of``). Regions without a picture stay as they are. Pictures are taken
    from a batch one by one.
    """
    ship(regions.sparkSession)
    added = T.StructType([*regions.schema.fields, T.StructField("reading", T.StringType())])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts, pictures = (part.column(part.schema.get_field_index(c)) for c in ("text", "picture"))
            blank = [p.is_valid and not (t.as_py() or "").strip() for t, p in zip(texts, pictures, strict=True)]
            read = [reader.read(p.as_py()) if b else None for b, p in zip(blank, pictures, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(read, pa.string())], names=[*part.schema.names, "reading"])

    read = regions.mapInArrow(batches, added).withColumn("reading", F.when(F.col("reading").isNotNull(), reading_of(F.col("reading"), lenient=lenient)))
    outcome = F.when(F.col("reading").isNull(), "kept").when(F.size("reading.lines") == 0, "empty").when(F.col("reading.ended"), "cut").otherwise("read")
    return read.withColumns(
        {"text": F.when(F.col("reading").isNull(), F.col("text")).otherwise(F.array_join("reading.lines", "\n")), "outcome": outcome}
    ).drop("reading")


def fill_counts(filled: DataFrame) -> DataFrame:
    """(doc_id, regions, read, cut, empty) of filled regions."""
    return filled.groupBy("doc_id").agg(
        F.count("*").alias("regions"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("read", "cut", "empty")],
    )


def crops(pictures: DataFrame, least: float = PICTURE_SIDE) -> DataFrame:
    """(doc_id, ord, page, bbox, image) of the pictures (doc_id, ord, page, bbox) that are kept, ``image`` being where their file belongs."""
    kept = pictures.where(keeps_picture(F.col("bbox"), least))
    return kept.select(
        "doc_id",
        "ord",
        "page",
        "bbox",
        F.concat(F.col("doc_id"), F.lit("/"), F.lpad(F.col("ord").cast("string"), 5, "0"), F.lit(".png")).alias("image"),
    )


def keeps_picture(bbox: Column, least: float = PICTURE_SIDE) -> Column:
    """Whether both sides of [left, top, right, bottom] reach the least size."""
    side = lambda a, b: F.abs(F.get(bbox, F.lit(b)) - F.get(bbox, F.lit(a)))
    return F.least(side(0, 2), side(1, 3)) >= least


def reading_of(text: Column, complete: Column | None = None, lenient: bool = False) -> Column:
    """A model's reading of a region as a struct: its ``lines`` before it repeats itself or wanders off, and whether it ``ended`` there.

    Every line is judged by itself: code fences, the first line again (by its first SAME_START characters, if it has so many), and
    Han characters after a first line without any end a reading before them; so do lines without letters or digits and, from where it
    stood first, a line that was there before, both unless ``lenient``. The earliest of these ends counts. The last line of a text that is not
    ``complete`` may still grow: it ends a reading only by how it begins, and isn't kept. Null reads as empty.
    """
    whole = F.lit(True) if complete is None else complete
    raw = F.split(F.coalesce(text, F.lit("")), "\n")
    trimmed = F.transform(raw, lambda x, i: F.struct(F.regexp_replace(x, EDGES, "").alias("line"), (~whole & (i == F.size(raw) - F.lit(1))).alias("grows")))
    said = F.filter(trimmed, lambda x: x["line"] != "")
    lines = F.transform(said, lambda x: x["line"])
    first = F.get(lines, F.lit(0))
    again = lambda x: F.when(F.length(first) >= SAME_START, x["line"].startswith(F.substring(first, 1, SAME_START))).otherwise(~x["grows"] & (x["line"] == first))
    strange = lambda x: x["line"].rlike(HAN) & ~first.rlike(HAN)
    bare = lambda x: ~x["grows"] & ~x["line"].rlike(r"[\p{L}\p{N}]")

    def end(x: Column, i: Column) -> Column:
        """How many lines stay if the reading ends at this one; null if it goes on."""
        here = x["line"].startswith(FENCE) | ((i > 0) & (again(x) | strange(x)))
        if lenient:
            return F.when(here, i)
        before = (F.array_position(lines, x["line"]) - F.lit(1)).cast("int")
        return F.when(here | ((i > 0) & bare(x)), i).when(~x["grows"] & (before < i), before)

    stop = F.get(F.filter(F.transform(said, end), lambda n: n.isNotNull()), F.lit(0))
    kept = F.when(stop.isNotNull(), F.slice(lines, 1, F.coalesce(stop, F.lit(0)))).otherwise(F.transform(F.filter(said, lambda x: ~x["grows"]), lambda x: x["line"]))
    return F.struct(kept.alias("lines"), stop.isNotNull().alias("ended"))
