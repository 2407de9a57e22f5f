"""Documents as blocks, sections and chunks.

Blocks are (doc_id, ord, kind, level, text): kind is title, heading, text, table or picture. Sequential rules
(packing up to a budget) are folds over one section's pieces, inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.functions.arrays import running
from heddle.functions.text import chunk_id, squash
from heddle.functions.vectors import cosine

LEVELS = 7  # a title is level 0
SENTENCE_END = r"((?<=[.!?])\s+|\n{2,})"
SPLIT = "\x01"
MODALITIES = ("picture", "table", "text")
TABLE_HANDLING = ("markdown", "rows", "skip")
#: Entities that page texts hold.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
NOISE = r"(?is)<(script|style|nav|footer|aside)\b.*?</\1\s*>|<!--.*?-->|<div class=\"ad\">.*?</div>"
BLOCK = r"(?is)<(h[1-6]|p|li)\b[^>]*>(.*?)(?=<(?:h[1-6]|p|li|ul|ol|table|article|body|footer|div)\b|</(?:h[1-6]|p|li|ul|ol|table|article|body|div)\s*>|$)"


def blocks_from_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every line that is not blank is a text block."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode_outer(F.split(text_col, "\n")).alias("ord", "text"))
    return lines.where(F.trim("text") != "").select("doc_id", "ord", F.lit("text").alias("kind"), F.lit(None).cast("int").alias("level"), "text")


def blocks_from_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Headings, paragraphs and list items of a page, without scripts, navigation, advertisements and footers."""
    clean = F.regexp_replace(html_col, NOISE, "")
    found = pages.select(
        F.col(id_col).alias("doc_id"),
        F.regexp_extract_all(clean, F.lit(BLOCK), F.lit(1)).alias("tags"),
        F.regexp_extract_all(clean, F.lit(BLOCK), F.lit(2)).alias("bodies"),
    )
    each = found.select("doc_id", F.posexplode_outer(F.arrays_zip("tags", "bodies")).alias("ord", "b")).select(
        "doc_id",
        "ord",
        F.lower("b.tags").alias("tag"),
        F.col("b.bodies").alias("body"),
    )
    text = F.regexp_replace("body", "(?is)<[^>]*>", " ")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    heading = F.col("tag").startswith("h")
    rows = each.select(
        "doc_id",
        "ord",
        F.when(heading, "heading").otherwise("text").alias("kind"),
        F.when(heading, F.substring("tag", 2, 1).cast("int")).alias("level"),
        squash(text).alias("text"),
    )
    return rows.where(F.col("text") != "")


def segment(blocks: DataFrame) -> DataFrame:
    """Blocks with ``section`` (counted from 0 in each document) and ``headings`` (the path in force, a title first).

    A heading closes the section and clears deeper headings; pictures and blank blocks are left out. One window pass.
    """
    kept = blocks.where((F.col("kind") != "picture") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    order = Window.partitionBy("doc_id").orderBy("ord")
    level = F.when(F.col("kind") == "title", 0).when(F.col("kind") == "heading", F.greatest(F.lit(1), F.least(F.col("level"), F.lit(LEVELS - 1))))
    marked = kept.withColumn("_level", level)
    seen = marked.withColumns(
        {
            f"_h{i}": F.last(F.when(F.col("_level") == i, F.struct("ord", "text")), ignorenulls=True).over(order) for i in range(LEVELS)
        } | {"_s": F.sum(F.when(F.col("_level").isNotNull(), 1).otherwise(0)).over(order)}
    )
    path = []
    for i in range(LEVELS):
        above = [F.coalesce(F.col(f"_h{j}.ord"), F.lit(-1)) for j in range(i)]
        newer = F.col(f"_h{i}.ord") > (F.greatest(F.lit(-1), *above) if above else F.lit(-1))
        path.append(F.when(newer, F.col(f"_h{i}.text")))
    out = seen.withColumn("headings", F.array_compact(F.array(*path)))
    return out.select("doc_id", "ord", "kind", "level", "text", F.col("_s").cast("long").alias("section"), "headings")


def sections(segmented: DataFrame) -> DataFrame:
    """(doc_id, section, headings, text, starts): paragraphs joined by blank lines, with the offset at which each starts."""
    return _placed_sections(segmented).drop("_ord")


def _placed_sections(segmented: DataFrame) -> DataFrame:
    """``sections`` with ``_ord``, where each begins."""
    rows = segmented.where(~F.col("kind").isin("heading", "title", "table"))
    met = rows.groupBy("doc_id", "section").agg(
        F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("p"),
        F.first("headings").alias("headings"),
        F.min("ord").alias("_ord"),
    )
    met = met.withColumn("starts", running(F.transform("p", lambda p: F.length(p["text"]) + 2)))
    return met.select(
        "doc_id",
        "section",
        "headings",
        F.array_join(F.transform("p", lambda p: p["text"]), "\n\n").alias("text"),
        F.transform("starts", lambda s: s.cast("int")).alias("starts"),
        "_ord",
    )


def locate(starts: Column, offset: Column) -> Column:
    """The number (from 0) of the last paragraph that starts at or before an offset."""
    return F.greatest(F.size(F.filter(starts, lambda s: s <= offset)) - 1, F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def fixed(docs: DataFrame, max_tokens: int, overlap: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, text, token_count): windows of words; the last window ends with the text."""
    if overlap >= max_tokens:
        raise ValueError(f"overlap ({overlap}) must be smaller than max_tokens ({max_tokens})")
    step = max_tokens - overlap
    split = docs.select(id_col, words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - F.lit(overlap)), F.lit(step))
    piece = split.select(id_col, "w", F.posexplode(starts).alias("piece", "start"))
    own = F.slice("w", F.col("start"), max_tokens)
    return piece.select(
        id_col,
        F.col("piece").cast("long").alias("piece"),
        F.array_join(own, " ").alias("text"),
        F.size(own).cast("long").alias("token_count"),
    )


def _blank(x: Column) -> Column:
    return ~x.rlike(r"\S")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once: a lambda that names an expression would work it out anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _split_sentences(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, SENTENCE_END, f"$1{SPLIT}"), SPLIT), lambda x: x != "")


def _cut_at(pieces: Column, starts: Column) -> Column:
    """The pieces from each start (counted from 0) up to the next one, joined."""
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(pieces)))
    return F.zip_with(starts, ends, lambda a, b: F.array_join(F.slice(pieces, a + F.lit(1), b - a), ""))


def _join_blanks(pieces: Column) -> Column:
    """Blank pieces go with the piece before them, those at the start with the first that isn't blank."""
    solid = lambda p: F.filter(F.transform(p, lambda x, i: F.when(~_blank(x), i)), lambda i: i.isNotNull())
    starts = lambda at: F.concat(F.array(F.lit(0)), F.slice(at, 2, F.greatest(F.size(at), F.lit(1))))
    joined = lambda p: _once(_once(solid(p), starts), lambda at: _cut_at(p, at))
    return _once(pieces, lambda p: F.when(F.exists(p, _blank), joined(p)).otherwise(p))


def sentences(text: Column) -> Column:
    """Pieces that join to the text again: a boundary stays with the sentence before it; blank pieces go with their neighbour."""
    return _join_blanks(_split_sentences(text))


def pack(pieces: Column, max_tokens: int) -> Column:
    """Texts of neighbouring pieces joined while they have at most ``max_tokens`` words; a larger piece is alone."""
    return pack_by(pieces, F.transform(pieces, lambda x: F.size(words_of(x))), F.lit(max_tokens))


def pack_by(pieces: Column, sizes: Column, budget: Column) -> Column:
    """``pack`` with given sizes and budget, which may differ by row.

    The fold carries two numbers and where chunks start; texts are cut after it.
    """
    begin = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at"), F.lit(0).alias("n"))

    def step(acc: Column, n: Column) -> Column:
        fits = (acc["at"] > 0) & ((acc["n"] + n <= budget) | (acc["n"] == 0))
        starts = F.when(fits, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["at"])))
        return F.struct(starts.alias("starts"), (acc["at"] + 1).alias("at"), F.when(fits, acc["n"] + n).otherwise(n).alias("n"))

    starts = F.aggregate(sizes, begin, step, lambda acc: acc["starts"])
    cut = _once(pieces, lambda p: _once(starts, lambda at: _cut_at(p, at)))
    return F.filter(F.transform(cut, lambda t: F.trim(t)), lambda t: ~_blank(t))


def recursive(parts: DataFrame, max_tokens: int, text_col: str = "text") -> DataFrame:
    """Rows with ``pieces``: sentences packed to the budget; a sentence beyond it is cut into windows of words."""
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w)), F.lit(max_tokens)), lambda i: F.concat(F.array_join(F.slice(w, i, max_tokens), " "), F.lit(" ")))
    # most texts have no blank piece and need no fold; each step is a column, so that it is evaluated once
    split = parts.withColumn("_p", _split_sentences(F.col(text_col))).withColumn(
        "_p",
        F.when(F.exists("_p", _blank), _join_blanks(F.col("_p"))).otherwise(F.col("_p")),
    )
    split = split.withColumn("_w", F.transform("_p", lambda s: F.struct(s.alias("t"), words_of(s).alias("w"))))
    split = split.withColumn(
        "_s",
        F.flatten(F.transform("_w", lambda x: F.when(F.size(x["w"]) > max_tokens, cut(x["w"])).otherwise(F.array(x["t"])))),
    )
    return split.withColumn("pieces", pack(F.col("_s"), max_tokens)).drop("_p", "_w", "_s")


def breakpoints(
    sentences_: DataFrame,
    percentile: float = 0.9,
    by: str | list[str] = "section",
    order_col: str = "ord",
    vector_col: str = "embedding",
) -> DataFrame:
    """Rows with ``distance`` (to the sentence before), ``threshold`` (of the section) and ``piece``: a new one after a jump."""
    by = [by] if isinstance(by, str) else by
    order = Window.partitionBy(*by).orderBy(order_col)
    far = sentences_.withColumn("_before", F.lag(vector_col).over(order)).withColumn("distance", 1 - cosine(F.col(vector_col), F.col("_before"))).drop("_before")
    limit = F.percentile("distance", F.lit(percentile)).over(Window.partitionBy(*by))  # a section is in one window already
    jump = F.when(F.col("distance") > F.col("threshold"), 1).otherwise(0)
    return far.withColumn("threshold", limit).withColumn("piece", F.sum(jump).over(order).cast("long"))


def sentence_groups(parts: DataFrame, buffer: int = 1, by: tuple[str, ...] = ("doc_id", "section"), text_col: str = "text") -> DataFrame:
    """(by, ord, sentence, context): each sentence with the ``buffer`` sentences on both sides of it."""
    each = parts.select(*by, F.posexplode_outer(sentences(F.col(text_col))).alias("ord", "sentence")).where("sentence IS NOT NULL")
    around = Window.partitionBy(*by).orderBy("ord").rowsBetween(-buffer, buffer)
    return each.withColumn("context", F.array_join(F.collect_list("sentence").over(around), ""))


def semantic(
    parts: DataFrame,
    embed: Callable[[DataFrame], DataFrame],
    max_tokens: int,
    percentile: float = 0.9,
    buffer: int = 1,
    by: tuple[str, ...] = ("doc_id", "section"),
    text_col: str = "text",
) -> DataFrame:
    """(by, piece, text, token_count): sentences cut where their context turns, then cut to the budget.

    ``embed`` adds ``embedding`` to (by, ord, sentence, context). A section is cut where the distance between neighbours is
    beyond its own ``percentile``; a piece of more than ``max_tokens`` words is split as ``recursive`` does.
    """
    cut = breakpoints(embed(sentence_groups(parts, buffer, by, text_col)), percentile, list(by))
    met = cut.groupBy(*by, "piece").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "sentence"))), lambda s: s["sentence"]), "").alias("text")
    )
    split = recursive(met, max_tokens).select(*by, "piece", F.posexplode_outer("pieces").alias("part", "text")).where("text IS NOT NULL")
    order = Window.partitionBy(*by).orderBy("piece", "part")
    return split.select(
        *by,
        (F.row_number().over(order) - 1).cast("long").alias("piece"),
        "text",
        F.size(words_of(F.col("text"))).cast("long").alias("token_count"),
    )


def locate_pieces(text: Column, pieces: Column) -> Column:
    """Where each piece stands in its text, counted from 0.

    Each is sought from just after the start of the one before it, so overlapping pieces and repeated texts are told apart; one that
    isn't there (its white space was changed) has the start of the one before it.
    """
    begin = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("next"), F.lit(0).alias("last"))

    def step(acc: Column, piece: Column) -> Column:
        found = F.position(piece, text, acc["next"] + F.lit(1)) - F.lit(1)
        kept = lambda at: F.when(at >= 0, at).otherwise(acc["last"])
        add = lambda at: F.struct(F.concat(acc["out"], F.array(at)).alias("out"), (at + 1).alias("next"), at.alias("last"))
        return _once(_once(found, kept), add)

    return F.aggregate(pieces, begin, step, lambda acc: acc["out"])


def hierarchical(segmented: DataFrame) -> DataFrame:
    """(doc_id, ord, headings, text): one chunk for each structural element, however long."""
    return segmented.where(~F.col("kind").isin("heading", "title")).select("doc_id", "ord", "headings", "text")


def merge_peers(blocks: DataFrame, max_tokens: int) -> DataFrame:
    """(doc_id, section, headings, piece, text, token_count): neighbouring blocks of a section joined while they fit."""
    rows = blocks.where(~F.col("kind").isin("heading", "title"))
    met = rows.groupBy("doc_id", "section").agg(
        F.first("headings").alias("headings"),
        F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda p: F.concat(p["text"], F.lit("\n"))).alias("p"),
    )
    out = met.select(
        "doc_id",
        "section",
        "headings",
        F.posexplode_outer(pack(F.col("p"), max_tokens)).alias("piece", "text"),
    ).where("text IS NOT NULL")
    return out.select(
        "doc_id",
        "section",
        "headings",
        F.col("piece").cast("long").alias("piece"),
        "text",
        F.size(words_of(F.col("text"))).cast("long").alias("token_count"),
    )


def _fit_text(text: Column, budget: Column) -> Column:
    """A text as it is if it fits, else its sentences, those beyond the budget in windows of words, packed to it."""
    windows = lambda w: F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w)), budget), lambda i: F.concat(F.array_join(F.slice(w, i, budget), " "), F.lit(" "))
    )
    split = F.transform(_split_sentences(text), lambda x: F.struct(x.alias("t"), words_of(x).alias("w")))
    small = F.flatten(F.transform(split, lambda x: F.when(F.size(x["w"]) > budget, windows(x["w"])).otherwise(F.array(x["t"]))))
    return F.when(F.size(words_of(text)) <= budget, F.array(text)).otherwise(pack_within(small, budget))


def _fit_table(text: Column, budget: Column) -> Column:
    """A Markdown table as it is if it fits, else tables of its rows, packed so that each fits with the header repeated; a larger row is alone in its own."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~_blank(x))
    ruled = F.get(lines, F.lit(1)).rlike(r"^[|\s:-]+$")
    top = F.when(ruled, 2).otherwise(1)
    head = F.array_join(F.slice(lines, F.lit(1), top), "\n")
    rows = F.transform(F.slice(lines, top + 1, F.greatest(F.lit(0), F.size(lines) - top)), lambda r: F.concat(r, F.lit("\n")))
    room = F.greatest(F.lit(1), budget - F.size(words_of(head)))
    split = F.transform(pack_within(rows, room), lambda body: F.concat(head, F.lit("\n"), body))
    return F.when((F.size(words_of(text)) <= budget) | (F.size(lines) <= top), F.array(text)).otherwise(split)


def structural(segmented: DataFrame, max_tokens: int) -> DataFrame:
    """(doc_id, run, ord, headings, piece, text, token_count): elements cut to the budget, then undersized neighbours under the same headings joined.

    The budget is what the heading path leaves of ``max_tokens`` (at least half). Tables are Markdown among the texts. A ``run`` is a stretch of a
    document whose elements have the same heading path, over however many sections; ``ord`` is where it begins. Blank elements and
    pictures are left out; a document without others has no rows.
    """
    rows = segmented.where(~F.col("kind").isin("heading", "title", "picture") & ~_blank(F.coalesce("text", F.lit(""))))
    order = Window.partitionBy("doc_id").orderBy("ord")
    begins = F.when(F.col("headings") == F.lag("headings").over(order), 0).otherwise(1)
    marked = rows.withColumn("_begins", begins).withColumn("run", F.sum("_begins").over(order) - 1)
    room = table_budget(max_tokens, F.size(words_of(F.array_join("headings", " "))))
    fitted = marked.withColumn("_room", room).withColumn(
        "_fit", F.when(F.col("kind") == "table", _fit_table(F.col("text"), F.col("_room"))).otherwise(_fit_text(F.col("text"), F.col("_room")))
    )
    met = fitted.groupBy("doc_id", "run").agg(
        F.min("ord").alias("ord"),
        F.first("headings").alias("headings"),
        F.first("_room").alias("_room"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", "_fit"))), lambda e: e["_fit"])).alias("_all"),
    )
    packed = pack_within(F.transform("_all", lambda t: F.concat(t, F.lit("\n"))), F.col("_room"))
    out = met.withColumn("_pieces", packed).select("doc_id", "run", "ord", "headings", F.posexplode_outer("_pieces").alias("piece", "text")).where("text IS NOT NULL")
    text = F.regexp_replace("text", r"\n+$", "")
    return out.withColumn("text", text).withColumns({"piece": F.col("piece").cast("long"), "token_count": F.size(words_of(F.col("text"))).cast("long")})


def with_headings(headings: Column, text: Column) -> Column:
    """What is embedded: the heading path, a line each, before the text."""
    return F.concat_ws("\n", F.when(F.size(headings) > 0, F.array_join(headings, "\n")), text)


def table_budget(max_tokens: int, prefix_tokens: Column) -> Column:
    return F.greatest(F.lit(max_tokens) - prefix_tokens, F.lit(max_tokens // 2))


def rows_as_text(header: Column, cells: Column) -> Column:
    """``column: value; ...`` without blank cells."""
    pairs = F.zip_with(header, cells, lambda h, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(h, F.lit(": "), F.trim(c))))
    return F.array_join(F.filter(pairs, lambda p: p.isNotNull()), "; ")


def markdown_row(cells: Column) -> Column:
    """A Markdown table's line; bars and line feeds inside cells are kept apart from the table's own."""
    clean = F.transform(
        cells,
        lambda c: F.replace(F.regexp_replace(F.trim(F.coalesce(c.cast("string"), F.lit(""))), r"\s+", " "), F.lit("|"), F.lit("\\|")),
    )
    return F.concat(F.lit("| "), F.array_join(clean, " | "), F.lit(" |"))


def table_chunks(tables: DataFrame, max_tokens: int, handling: str = "markdown") -> DataFrame:
    """(doc_id, ord, headings, piece, text) of tables with ``header`` (array) and ``rows`` (array of arrays).

    ``markdown`` gives tables with the header repeated in each piece, within the budget that the heading path leaves; ``rows`` a line
    for each row, packed to the budget; ``skip`` none.
    """
    if handling not in TABLE_HANDLING:
        raise ValueError(f"Tables can be handled as {', '.join(TABLE_HANDLING)}, not {handling}.")
    if handling == "skip":
        tables = tables.where("false")
    room = table_budget(max_tokens, F.size(words_of(F.array_join("headings", " "))))
    if handling == "rows":
        pieces = pack_within(F.transform("rows", lambda r: F.concat(rows_as_text(F.col("header"), r), F.lit("\n"))), room)
    else:
        rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size("header")))
        head = F.concat(markdown_row(F.col("header")), F.lit("\n"), rule)
        pieces = F.transform(
            pack_within(F.transform("rows", lambda r: F.concat(markdown_row(r), F.lit("\n"))), room),
            lambda body: F.concat(head, F.lit("\n"), body),
        )
    made = tables.withColumn("_pieces", pieces).select("doc_id", "ord", "headings", F.posexplode_outer("_pieces").alias("piece", "text"))
    return made.where("text IS NOT NULL").select("doc_id", "ord", "headings", F.col("piece").cast("long").alias("piece"), "text")


def pack_within(pieces: Column, budget: Column) -> Column:
    """``pack`` with a budget of the row's own."""
    return pack_by(pieces, F.transform(pieces, lambda x: F.size(words_of(x))), budget)


def split_table(header: Column, rows: Column, budget: int) -> Column:
    """Markdown tables of at most ``budget`` words, each with the header; a larger row is alone in its own."""
    return F.transform(pack(F.transform(rows, lambda r: F.concat(r, F.lit("\n"))), budget), lambda body: F.concat(header, F.lit("\n"), body))


def picture_chunks(blocks: DataFrame) -> DataFrame:
    """(doc_id, ord, text, headings): a picture's caption, or its page, under the headings of the last text or table before it."""
    known = segment(blocks).where(F.col("kind").isin("text", "table")).select("doc_id", "ord", "headings")
    order = Window.partitionBy("doc_id").orderBy("ord")
    beside = blocks.join(known, ["doc_id", "ord"], "left").withColumn("headings", F.last("headings", ignorenulls=True).over(order))
    text = F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.concat(F.lit("Figure on page "), F.col("page").cast("string")))
    return beside.where(F.col("kind") == "picture").select(
        "doc_id",
        "ord",
        text.alias("text"),
        F.coalesce("headings", F.array().cast("array<string>")).alias("headings"),
    )


def number_chunks(chunks: DataFrame, *order: str) -> DataFrame:
    """Adds ``chunk_index`` from 0 in each document and ``chunk_id``."""
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1
    return chunks.withColumn("chunk_index", index.cast("long")).withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("chunk_index")))


def summary(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunks, tokens_min, tokens_mean, tokens_max), the mean at one decimal, and ``by_modality`` where chunks have one."""
    aggs = [
        F.count("*").alias("chunks"),
        F.min("token_count").alias("tokens_min"),
        F.round(F.avg("token_count"), 1).alias("tokens_mean"),
        F.max("token_count").alias("tokens_max"),
    ]
    if "modality" in chunks.columns:
        kinds = F.array_sort(F.collect_set("modality"))
        count = F.map_from_arrays(F.array(*[F.lit(m) for m in MODALITIES]), F.array(*[F.count_if(F.col("modality") == m) for m in MODALITIES]))
        aggs.append(F.map_filter(count, lambda m, n: F.array_contains(kinds, m)).alias("by_modality"))
    return chunks.groupBy("doc_id").agg(*aggs)


def assemble(
    segmented: DataFrame,
    split: Callable[[DataFrame], DataFrame],
    tables: DataFrame | None = None,
    pictures: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, chunk_index, chunk_id, modality, headings, text, embed_text, token_count): all chunks of each document in its order.

    ``split`` turns sections (doc_id, section, headings, text) into (doc_id, section, piece, text). Pieces stand where their section begins, or at their own ``ord`` if they have one; tables
    (doc_id, ord, headings, piece, text) and pictures (doc_id, ord, headings, text) where they were.
    """
    whole = _placed_sections(segmented)
    pieces = split(whole)
    if {"_ord", "_headings"} <= set(pieces.columns):  # the split has carried what places a piece, so no text is joined
        pieces = pieces.select("doc_id", "section", "piece", "text", F.col("_ord").alias("ord"), F.col("_headings").alias("headings"))
    else:
        place = whole.select("doc_id", "section", "headings", F.col("_ord").alias("ord"))
        own = ["ord"] * ("ord" in pieces.columns)
        pieces = pieces.select("doc_id", "section", "piece", "text", *own).join(place.drop(*own), ["doc_id", "section"])
    columns = ["doc_id", "ord", "piece", "modality", "headings", "text"]
    rows = pieces.withColumn("modality", F.lit("text")).select(columns)
    if tables is not None:
        rows = rows.unionByName(tables.withColumn("modality", F.lit("table")).select(columns))
    if pictures is not None:
        rows = rows.unionByName(pictures.withColumns({"modality": F.lit("picture"), "piece": F.lit(0).cast("long")}).select(columns))
    kept = rows.where(~_blank(F.col("text")))
    numbered = number_chunks(kept, "ord", "piece")
    return numbered.select(
        "doc_id",
        "chunk_index",
        "chunk_id",
        "modality",
        "headings",
        "text",
        with_headings(F.col("headings"), F.col("text")).alias("embed_text"),
        F.size(words_of(F.col("text"))).cast("long").alias("token_count"),
    )


def chunk(
    segmented: DataFrame,
    strategy: str,
    max_tokens: int = 512,
    overlap: int = 0,
    percentile: float = 0.9,
    buffer: int = 1,
    embed: Callable[[DataFrame], DataFrame] | None = None,
    tables: DataFrame | None = None,
    pictures: DataFrame | None = None,
    handling: str = "markdown",
) -> tuple[DataFrame, list[str]]:
    """(chunks as ``assemble`` gives them, warnings) by the strategy that settings name; an unknown one is a ValueError.

    Overlap only means something to ``fixed``; elsewhere it is left out with a warning.
    """
    warnings = []
    if overlap and strategy != "fixed":
        warnings.append(f"The overlap of {overlap} is not used by the strategy {strategy}.")
    if strategy in ("hybrid", "hierarchical") and handling == "rows":
        warnings.append(f"The strategy {strategy} writes tables as Markdown.")
        handling = "markdown"
    made = None if tables is None else table_chunks(tables, max_tokens, handling)

    def fixed_pieces(whole: DataFrame) -> DataFrame:
        keyed = whole.withColumn("_key", F.struct("doc_id", "section", "_ord", F.col("headings").alias("_headings")))
        return fixed(keyed, max_tokens, overlap, "_key").select("_key.*", "piece", "text")

    def recursive_pieces(whole: DataFrame) -> DataFrame:
        return recursive(whole, max_tokens).select(
            "doc_id",
            "section",
            "_ord",
            F.col("headings").alias("_headings"),
            F.posexplode_outer("pieces").alias("piece", "text"),
        ).where("text IS NOT NULL").withColumn("piece", F.col("piece").cast("long"))

    def semantic_pieces(whole: DataFrame) -> DataFrame:
        if embed is None:
            raise ValueError("The strategy semantic needs an embedding.")
        return semantic(whole, embed, max_tokens, percentile, buffer)

    splits = {
        "fixed": fixed_pieces,
        "recursive": recursive_pieces,
        "semantic": semantic_pieces,
        "hybrid": lambda _: merge_peers(segmented.where("kind <> 'table'"), max_tokens),
        "hierarchical": lambda _: hierarchical(segmented.where("kind <> 'table'")).join(
            segmented.select("doc_id", "ord", "section"),
            ["doc_id", "ord"],
        ).withColumn("piece", F.col("ord").cast("long")),
    }
    if strategy not in splits:
        raise ValueError(f"The strategy {strategy} is not one of {', '.join(sorted(splits))}.")
    return assemble(segmented, splits[strategy], made, pictures), warnings


def without_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents that gave no chunk: none may be indexed silently empty."""
    return documents.select("doc_id").distinct().join(chunks.select("doc_id").distinct(), "doc_id", "left_anti")
