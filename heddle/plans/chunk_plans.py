"""Queries over the chunking operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.text import content_id
from heddle.operators import chunking as C
from heddle.operators import tokenizers
from heddle.sources.tables import table

MAX, OVERLAP = 64, 16
COUNTED = "aeinorst"


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.blocks_from_text(table(spark, sf_dir, "documents")).select("doc_id", "ord", F.length("text").alias("chars"))


def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.fixed(table(spark, sf_dir, "documents"), MAX, OVERLAP)
    return rows.select("doc_id", "piece", content_id(F.col("text")).alias("text_id"), "token_count")


def chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of whole words within a budget of tokens, those of a pattern, and how they overlap."""
    rows = tokenizers.windows(table(spark, sf_dir, "documents"), tokenizers.Pattern(), MAX, OVERLAP)
    return rows.select("doc_id", "piece", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), content_id(F.col("text")).alias("text_id"), "token_count")


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.number_chunks(C.fixed(table(spark, sf_dir, "documents"), MAX, OVERLAP), "piece")
    return rows.select("doc_id", "chunk_index", "chunk_id")


def chunk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.summary(C.fixed(table(spark, sf_dir, "documents"), MAX, OVERLAP))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents, every seventh a heading (levels 1 to 3) and every eleventh a picture."""
    lines = C.blocks_from_text(table(spark, sf_dir, "documents"))
    kind = F.when(F.col("ord") % 7 == 0, "heading").when(F.col("ord") % 11 == 5, "picture").otherwise("text")
    return lines.select("doc_id", "ord", kind.alias("kind"), F.when(kind == "heading", (F.col("ord") / 7).cast("int") % 3 + 1).alias("level"), "text")


def section_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.segment(_marked(spark, sf_dir))
    return rows.select("doc_id", "ord", "section", F.array_join("headings", " > ").alias("path"))


def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.sections(C.segment(_marked(spark, sf_dir)))
    return rows.select(
        "doc_id",
        "section",
        content_id(F.col("text")).alias("text_id"),
        F.size("starts").cast("long").alias("paragraphs"),
        F.element_at("starts", -1).cast("long").alias("last_start"),
    )


def paragraph_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraph that holds the middle of each section: the last start at or before an offset."""
    rows = C.sections(C.segment(_marked(spark, sf_dir)))
    return rows.select("doc_id", "section", C.locate(F.col("starts"), (F.length("text") / 2).cast("int")).cast("long").alias("paragraph"))


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of web pages with their section and heading path."""
    rows = C.segment(C.blocks_from_html(table(spark, sf_dir, "pages")))
    return rows.select("doc_id", "ord", "kind", "section", F.array_join("headings", " > ").alias("path"), F.length("text").alias("chars"))


def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences packed up to a budget."""
    rows = C.recursive(table(spark, sf_dir, "documents").select("doc_id", "text"), MAX)
    each = rows.select("doc_id", F.posexplode_outer("pieces").alias("piece", "text")).where("text IS NOT NULL")  # an inner explode would first filter, and so pack twice
    return each.select("doc_id", "piece", content_id(F.col("text")).alias("text_id"), F.size(C.words_of(F.col("text"))).alias("token_count"))


def chunk_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring blocks of a section merged while they fit."""
    rows = C.merge_peers(C.segment(_marked(spark, sf_dir)), MAX)
    return rows.select("doc_id", "section", "piece", content_id(F.col("text")).alias("text_id"), "token_count")


def chunk_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents: a section for each turn, three turns under one heading, and a table of the turns at the end."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("body"))
    null = F.lit(None).cast("int")
    part = F.concat(F.lit("Part "), F.floor(F.col("turn") / 3).cast("string"))
    heads = turns.select("doc_id", (2 * F.col("turn")).alias("ord"), F.lit("heading").alias("kind"), F.lit(1).alias("level"), part.alias("text"))
    texts = turns.select("doc_id", (2 * F.col("turn") + 1).alias("ord"), F.lit("text").alias("kind"), null.alias("level"), F.col("body").alias("text"))
    line = C.markdown_row(F.array(F.col("turn").cast("string"), F.col("role"), F.length("body").cast("string")))
    listed = turns.groupBy("doc_id").agg(F.max("turn").alias("last"), F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("rows"))
    whole = F.concat(F.lit("| turn | role | characters |\n| --- | --- | --- |\n"), F.array_join("rows.line", "\n"))
    tables = listed.select("doc_id", (2 * F.col("last") + 2).alias("ord"), F.lit("table").alias("kind"), null.alias("level"), whole.alias("text"))
    rows = C.structural(C.segment(heads.unionByName(texts).unionByName(tables)), MAX)
    return rows.select("doc_id", "run", "ord", "piece", content_id(F.col("text")).alias("text_id"), F.array_join("headings", " > ").alias("path"), "token_count")


def semantic_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label as the sentences of one section, cut where the distance jumps."""
    rows = C.breakpoints(table(spark, sf_dir, "embeddings"), 0.9, "label", "vec_id")
    return rows.select("label", "vec_id", F.round("distance", 6).alias("distance"), F.round("threshold", 6).alias("threshold"), "piece")


def _counted(rows: DataFrame) -> DataFrame:
    """A vector that SQL can make too: how long a text is and how often it has some letters."""
    n = lambda c: (F.length("context") - F.length(F.replace("context", F.lit(c), F.lit("")))).cast("double")
    return rows.withColumn("embedding", F.array(F.length("context").cast("double"), *[n(c) for c in COUNTED]))


def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each document, cut where the letters of their neighbourhood change most (no piece is over this budget)."""
    parts = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("section"), "text")
    rows = C.semantic(parts, _counted, 1 << 30)
    return rows.select("doc_id", "piece", content_id(F.trim("text")).alias("text_id"), "token_count")


def chunk_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each element, embedded under its headings."""
    rows, _ = C.chunk(C.segment(_marked(spark, sf_dir)), "hierarchical")
    return rows.select("doc_id", "chunk_index", "chunk_id", content_id(F.col("embed_text")).alias("embed_id"), "token_count")


def chunk_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections cut by the strategy that settings name, with pictures where they stand, numbered in document order."""
    blocks = _marked(spark, sf_dir)
    pictures = C.picture_chunks(blocks.withColumn("page", (F.col("ord") / 10).cast("int")))
    rows, _ = C.chunk(C.segment(blocks), "fixed", MAX, OVERLAP, pictures=pictures)
    return rows.select(
        "doc_id",
        "chunk_index",
        "modality",
        content_id(F.col("text")).alias("text_id"),
        F.array_join("headings", " > ").alias("path"),
        "token_count",
    )


def chunk_modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each document by modality, of a document's blocks as they are."""
    blocks = _marked(spark, sf_dir)
    made = blocks.where("kind <> 'heading'").select(
        "doc_id",
        F.col("kind").alias("modality"),
        F.size(C.words_of(F.col("text"))).cast("long").alias("token_count"),
    )
    rows = C.summary(made)
    return rows.select(
        "doc_id",
        "chunks",
        F.coalesce(F.try_element_at("by_modality", F.lit("picture")), F.lit(0)).alias("pictures"),
        F.coalesce(F.try_element_at("by_modality", F.lit("text")), F.lit(0)).alias("texts"),
    )


def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each sentence of a document stands in it, sought from the one before it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("p", C.sentences(F.col("text")))
    rows = docs.select("doc_id", F.posexplode_outer(C.locate_pieces(F.col("text"), F.col("p"))).alias("piece", "start"))
    return rows.where("start IS NOT NULL")


def picture_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _marked(spark, sf_dir).withColumn("page", (F.col("ord") / 10).cast("int")).withColumn(
        "text",
        F.when((F.col("kind") == "picture") & (F.col("ord") % 2 == 0), F.lit(None)).otherwise(F.col("text")),
    )
    return C.picture_chunks(blocks).select("doc_id", "ord", "text", F.array_join("headings", " > ").alias("path"))


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of supplier as ``column: value`` text."""
    s = table(spark, sf_dir, "supplier")
    cells = F.array(F.col("s_suppkey").cast("string"), F.when(F.col("s_nationkey") % 2 == 0, F.col("s_name")), F.col("s_nationkey").cast("string"))
    return s.select("s_suppkey", C.rows_as_text(F.array(F.lit("key"), F.lit("name"), F.lit("nation")), cells).alias("line"))


def table_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's nations as Markdown rows, split to a budget with the header repeated."""
    line = F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), F.col("n_name"), F.lit(" |"))
    met = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", line.alias("line")))), lambda r: r["line"]).alias("rows")
    )
    return met.select("n_regionkey", F.posexplode(C.split_table(F.lit("| key | name |"), F.col("rows"), 12)).alias("piece", "text"))


QUERIES = {f.__name__: f for f in (
    text_blocks, chunk_fixed, chunk_tokens, chunk_ids, chunk_summary, section_headings, chunk_sections, paragraph_at, page_blocks, chunk_recursive, chunk_hybrid, chunk_structural, semantic_breakpoints, chunk_semantic, chunk_hierarchical, chunk_dispatch, chunk_modalities, chunk_offsets, picture_headings, table_rows, table_pieces,
)}

_LINES = "SELECT doc_id, ord::INT AS ord, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents) WHERE trim(text) <> ''"
_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"
_FIXED = f"""SELECT doc_id, p AS piece, w[p * {MAX - OVERLAP} + 1 : p * {MAX - OVERLAP} + {MAX}] AS own
  FROM (SELECT doc_id, {_WORDS} AS w FROM documents) d, LATERAL (SELECT unnest(range(greatest(0, len(w) - {OVERLAP} - 1) // {MAX - OVERLAP} + 1)) AS p) WHERE len(w) > 0"""
_WORD, _TOKEN = r"[^\x09-\x0D\x20]+", r"[A-Za-z0-9]+|[^A-Za-z0-9\x09-\x0D\x20]"
# words, and the parts of those that alone are beyond the budget, are units; a unit's window ends with the last one that fits
_TOKENS = f"""WITH RECURSIVE gaps AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}') AS w, regexp_split_to_array(text, '{_WORD}') AS g FROM documents WHERE regexp_matches(text, '{_WORD}')),
 words AS (SELECT doc_id, i, len(g) AS gap, w, regexp_extract_all(w, '{_TOKEN}') AS t FROM (SELECT doc_id, unnest(w) AS w, unnest(g[1:len(w)]) AS g, unnest(range(len(w))) AS i FROM gaps)),
 placed AS (SELECT *, sum(gap + len(w)) OVER (PARTITION BY doc_id ORDER BY i) - len(w) AS head FROM words),
 parts AS (SELECT doc_id, i, k, t[k * {MAX} + 1 : k * {MAX} + {MAX}] AS own, head + len(array_to_string(t[1 : k * {MAX}], '')) AS start FROM placed, LATERAL (SELECT unnest(range(greatest(1, (len(t) + {MAX - 1}) // {MAX}))) AS k)),
 units AS (SELECT doc_id, row_number() OVER o AS u, start::BIGINT AS start, (start + len(array_to_string(own, '')))::BIGINT AS fin, len(own) AS n, sum(len(own)) OVER o AS cum FROM parts WINDOW o AS (PARTITION BY doc_id ORDER BY i, k)),
 back AS (SELECT *, cum - n AS before FROM units),
 led AS (SELECT *, max(u) OVER (PARTITION BY doc_id ORDER BY cum RANGE BETWEEN CURRENT ROW AND {MAX} - n FOLLOWING) AS last,
   CASE WHEN n > {OVERLAP} THEN u + 1 ELSE min(u) OVER (PARTITION BY doc_id ORDER BY before RANGE BETWEEN greatest({OVERLAP} - n, 0) PRECEDING AND CURRENT ROW) END AS again, max(u) OVER (PARTITION BY doc_id) AS top FROM back),
 jumps AS (SELECT a.doc_id, a.u, a.start, b.fin, (b.cum - a.before)::BIGINT AS token_count, CASE WHEN a.last < a.top THEN greatest(a.u + 1, b.again) END AS following FROM led a JOIN led b ON b.doc_id = a.doc_id AND b.u = a.last),
 walk AS (SELECT doc_id, u, 0::BIGINT AS piece FROM jumps WHERE u = 1 UNION ALL SELECT j.doc_id, j.following, piece + 1 FROM walk JOIN jumps j USING (doc_id, u) WHERE j.following IS NOT NULL)
 SELECT doc_id, piece, start, fin AS "end", substr(sha256(substr(text, start + 1, fin - start)), 1, 16) AS text_id, token_count FROM walk JOIN jumps USING (doc_id, u) JOIN documents USING (doc_id)"""
_MARKED = f"""marked AS (SELECT doc_id, ord, kind, CASE WHEN kind = 'heading' THEN (ord // 7) % 3 + 1 END AS level, text
  FROM (SELECT *, CASE WHEN ord % 7 = 0 THEN 'heading' WHEN ord % 11 = 5 THEN 'picture' ELSE 'text' END AS kind FROM ({_LINES})))"""
_SEG = f"""{_MARKED}, b AS (SELECT *, sum(CASE WHEN level IS NOT NULL THEN 1 ELSE 0 END) OVER w AS section,
   max(CASE WHEN level = 1 THEN ord END) OVER w AS o1, max(CASE WHEN level = 2 THEN ord END) OVER w AS o2, max(CASE WHEN level = 3 THEN ord END) OVER w AS o3,
   last_value(CASE WHEN level = 1 THEN text END IGNORE NULLS) OVER w AS h1, last_value(CASE WHEN level = 2 THEN text END IGNORE NULLS) OVER w AS h2, last_value(CASE WHEN level = 3 THEN text END IGNORE NULLS) OVER w AS h3
   FROM marked WHERE kind <> 'picture' AND trim(text) <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
 seg AS (SELECT doc_id, ord, kind, level, text, section::BIGINT AS section, concat_ws(' > ', h1, CASE WHEN o2 > coalesce(o1, -1) THEN h2 END, CASE WHEN o3 > greatest(coalesce(o1, -1), coalesce(o2, -1)) THEN h3 END) AS path FROM b)"""
_SECTIONS = f"""{_SEG}, par AS (SELECT doc_id, section, ord, text, sum(length(text) + 2) OVER (PARTITION BY doc_id, section ORDER BY ord) - length(text) - 2 AS start FROM seg WHERE kind = 'text'),
 sec AS (SELECT doc_id, section, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS text, list(start ORDER BY ord) AS starts FROM par GROUP BY doc_id, section)"""

#: Sentences of each document: split after a boundary, blank pieces with their neighbour.
_SENTENCES = r"""raw AS (SELECT doc_id, text, list_filter(string_split(regexp_replace(text, '([.!?]\s+|\n{2,})', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p FROM documents),
 each AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM raw),
 grp AS (SELECT doc_id, i, s, greatest(1, sum(CASE WHEN regexp_replace(s, '\s+', '', 'g') <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i)) AS g FROM each),
 sent AS (SELECT doc_id, g AS ord, string_agg(s, '' ORDER BY i) AS s FROM grp GROUP BY doc_id, g)"""


def _packed(keys: str, source: str, budget: int) -> str:
    """A walk over (keys, i, t, n) that packs neighbours up to a budget, and the packed texts with their number from 0."""
    same = " AND ".join(f"b.{k.strip()} = w.{k.strip()}" for k in keys.split(","))
    cols = ", ".join(f"b.{k.strip()}" for k in keys.split(","))
    fits = f"(w.acc + b.n <= {budget} OR w.acc = 0)"
    return f"""items AS ({source}), walk AS (SELECT {keys}, i, n AS acc, 0 AS piece FROM items WHERE i = 1
   UNION ALL SELECT {cols}, b.i, CASE WHEN {fits} THEN w.acc + b.n ELSE b.n END, w.piece + CASE WHEN {fits} THEN 0 ELSE 1 END FROM walk w JOIN items b ON {same} AND b.i = w.i + 1),
 joined AS (SELECT {keys}, piece AS raw_piece, trim(string_agg(t, '' ORDER BY i)) AS text FROM walk JOIN items USING ({keys}, i) GROUP BY {keys}, piece),
 packed AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY raw_piece) - 1 AS piece, text FROM joined WHERE regexp_replace(text, '\\s+', '', 'g') <> '')"""


_RECURSIVE = f"""sized AS (SELECT doc_id, ord, s, list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '') AS w FROM sent),
 parts AS (SELECT doc_id, ord, 0 AS k, s AS t, len(w) AS n FROM sized WHERE len(w) <= {MAX}
   UNION ALL SELECT doc_id, ord, k, array_to_string(w[k * {MAX} + 1 : k * {MAX} + {MAX}], ' ') || ' ', least({MAX}, len(w) - k * {MAX}) FROM sized, LATERAL (SELECT unnest(range((len(w) - 1) // {MAX} + 1)) AS k) WHERE len(w) > {MAX})"""

def _page_blocks() -> str:
    """Blocks of pages: marks put where blocks begin and end, then cut at the marks; sections and heading paths by level."""
    clean = "html"
    for tag in ("script", "style", "nav", "footer", "aside"):
        clean = f"regexp_replace({clean}, '(?is)<{tag}\\b.*?</{tag}\\s*>', '', 'g')"
    clean = f"regexp_replace(regexp_replace({clean}, '(?s)<!--.*?-->', '', 'g'), '(?is)<div class=\"ad\">.*?</div>', '', 'g')"
    text = "regexp_replace(body, '(?is)<[^>]*>', ' ', 'g')"
    for entity, char in C.ENTITIES:
        text = f"replace({text}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    levels = range(1, 7)
    above = lambda n: ", ".join(["-1", *[f"coalesce(o{j}, -1)" for j in range(1, n)]])
    return rf"""cut AS (SELECT page_id, string_split(regexp_replace(regexp_replace({clean}, '(?is)<(h[1-6]|p|li)\b[^>]*>', chr(1) || '\1' || chr(2), 'g'),
   '(?is)(<(ul|ol|table|article|body|footer|div)\b|</(h[1-6]|p|li|ul|ol|table|article|body|div)\s*>)', chr(3), 'g'), chr(1))[2:] AS parts FROM pages),
 each AS (SELECT page_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS ord FROM cut),
 tagged AS (SELECT page_id, ord, lower(split_part(part, chr(2), 1)) AS tag, split_part(split_part(part, chr(2), 2), chr(3), 1) AS body FROM each),
 blocks AS (SELECT page_id AS doc_id, ord::INT AS ord, CASE WHEN starts_with(tag, 'h') THEN 'heading' ELSE 'text' END AS kind, CASE WHEN starts_with(tag, 'h') THEN substr(tag, 2, 1)::INT END AS level, trim(regexp_replace({text}, '\s+', ' ', 'g')) AS text FROM tagged),
 seen AS (SELECT *, sum(CASE WHEN level IS NOT NULL THEN 1 ELSE 0 END) OVER w AS section, {', '.join(f"max(CASE WHEN level = {n} THEN ord END) OVER w AS o{n}, last_value(CASE WHEN level = {n} THEN text END IGNORE NULLS) OVER w AS h{n}" for n in levels)}
   FROM blocks WHERE text <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
 pages_seg AS (SELECT doc_id, ord, kind, section::BIGINT AS section, concat_ws(' > ', {', '.join(f"CASE WHEN o{n} > greatest({above(n)}) THEN h{n} END" for n in levels)}) AS path, text FROM seen)"""


ORACLES = {
    "text_blocks": f"SELECT doc_id, ord, length(text)::INT AS chars FROM ({_LINES})",
    "chunk_fixed": f"SELECT doc_id, piece, substr(sha256(array_to_string(own, ' ')), 1, 16) AS text_id, len(own)::BIGINT AS token_count FROM ({_FIXED})",
    "chunk_tokens": _TOKENS,
    "chunk_ids": f"SELECT doc_id, piece AS chunk_index, doc_id || ':' || lpad(piece::VARCHAR, 5, '0') AS chunk_id FROM ({_FIXED})",
    "chunk_summary": f"SELECT doc_id, count(*) AS chunks, min(len(own))::BIGINT AS tokens_min, round(avg(len(own)), 1) AS tokens_mean, max(len(own))::BIGINT AS tokens_max FROM ({_FIXED}) GROUP BY doc_id",
    "section_headings": f"WITH {_SEG} SELECT doc_id, ord, section, path FROM seg",
    "chunk_sections": f"WITH {_SECTIONS} SELECT doc_id, section, substr(sha256(text), 1, 16) AS text_id, len(starts)::BIGINT AS paragraphs, starts[-1]::BIGINT AS last_start FROM sec",
    "paragraph_at": f"WITH {_SECTIONS} SELECT doc_id, section, greatest(len(list_filter(starts, lambda s: s <= length(text) // 2)) - 1, 0)::BIGINT AS paragraph FROM sec",
    "semantic_breakpoints": """WITH d AS (SELECT label, vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id)) AS distance FROM embeddings),
      t AS (SELECT label, quantile_cont(distance, 0.9) AS threshold FROM d GROUP BY label)
      SELECT label, vec_id, round(distance, 6) AS distance, round(threshold, 6) AS threshold, sum(CASE WHEN distance > threshold THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id)::BIGINT AS piece FROM d JOIN t USING (label)""",
    "page_blocks": f"WITH {_page_blocks()} SELECT doc_id, ord, kind, section, path, length(text)::INT AS chars FROM pages_seg",
    "picture_headings": f"""WITH {_SEG}, pic AS (SELECT doc_id, ord, CASE WHEN ord % 2 = 0 THEN 'Figure on page ' || (ord // 10) ELSE trim(text) END AS text FROM marked WHERE kind = 'picture')
      SELECT p.doc_id, p.ord, p.text, coalesce((SELECT arg_max(s.path, s.ord) FROM seg s WHERE s.doc_id = p.doc_id AND s.ord < p.ord AND s.kind = 'text'), '') AS path FROM pic p""",
    "chunk_recursive": f"WITH RECURSIVE {_SENTENCES}, {_RECURSIVE}, " + _packed("doc_id", "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord, k) AS i, t, n FROM parts", MAX) + f" SELECT doc_id, piece::INT AS piece, substr(sha256(text), 1, 16) AS text_id, len({_WORDS})::INT AS token_count FROM packed",
    "chunk_hybrid": f"WITH RECURSIVE {_SEG}, " + _packed("doc_id, section", f"SELECT doc_id, section, row_number() OVER (PARTITION BY doc_id, section ORDER BY ord) AS i, text || chr(10) AS t, len({_WORDS}) AS n FROM seg WHERE kind = 'text'", MAX) + f" SELECT doc_id, section, piece, substr(sha256(text), 1, 16) AS text_id, len({_WORDS})::BIGINT AS token_count FROM packed",
    "chunk_semantic": f"""WITH {_SENTENCES}, ctx AS (SELECT doc_id, ord, s, string_agg(s, '') OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS c FROM sent),
      v AS (SELECT doc_id, ord, s, [length(c)::DOUBLE, {', '.join(f"(length(c) - length(replace(c, '{x}', '')))::DOUBLE" for x in COUNTED)}] AS e FROM ctx),
      d AS (SELECT doc_id, ord, s, 1 - list_cosine_similarity(e, lag(e) OVER (PARTITION BY doc_id ORDER BY ord)) AS distance FROM v),
      t AS (SELECT doc_id, quantile_cont(distance, 0.9) AS threshold FROM d GROUP BY doc_id),
      p AS (SELECT doc_id, ord, s, sum(CASE WHEN distance > threshold THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS piece FROM d JOIN t USING (doc_id)),
      j AS (SELECT doc_id, piece, trim(string_agg(s, '' ORDER BY ord)) AS text FROM p GROUP BY doc_id, piece)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY piece) - 1 AS piece, substr(sha256(text), 1, 16) AS text_id, len({_WORDS})::BIGINT AS token_count FROM j WHERE regexp_replace(text, '\\s+', '', 'g') <> ''""",
    "chunk_hierarchical": f"""WITH {_SEG}, n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS k, text, path FROM seg WHERE kind = 'text')
      SELECT doc_id, k AS chunk_index, doc_id || ':' || lpad(k::VARCHAR, 5, '0') AS chunk_id, substr(sha256(CASE WHEN path = '' THEN text ELSE replace(path, ' > ', chr(10)) || chr(10) || text END), 1, 16) AS embed_id, len({_WORDS})::BIGINT AS token_count FROM n""",
    "chunk_dispatch": f"""WITH {_SECTIONS}, heads AS (SELECT doc_id, section, any_value(path) AS path, min(ord) AS ord FROM seg WHERE kind = 'text' GROUP BY doc_id, section),
      w AS (SELECT doc_id, section, {_WORDS} AS w FROM sec), f AS (SELECT doc_id, section, p, w[p * {MAX - OVERLAP} + 1 : p * {MAX - OVERLAP} + {MAX}] AS own FROM w, LATERAL (SELECT unnest(range(greatest(0, len(w) - {OVERLAP} - 1) // {MAX - OVERLAP} + 1)) AS p) WHERE len(w) > 0),
      pic AS (SELECT doc_id, ord, trim(text) AS text FROM marked WHERE kind = 'picture'),
      u AS (SELECT doc_id, ord, p, 'text' AS modality, array_to_string(own, ' ') AS text, path FROM f JOIN heads USING (doc_id, section)
        UNION ALL SELECT p.doc_id, p.ord, 0, 'picture', p.text, coalesce((SELECT arg_max(s.path, s.ord) FROM seg s WHERE s.doc_id = p.doc_id AND s.ord < p.ord AND s.kind = 'text'), '') FROM pic p)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord, p) - 1 AS chunk_index, modality, substr(sha256(text), 1, 16) AS text_id, path, len({_WORDS})::BIGINT AS token_count FROM u""",
    "chunk_modalities": f"WITH {_MARKED} SELECT doc_id, count(*) AS chunks, count(*) FILTER (kind = 'picture') AS pictures, count(*) FILTER (kind = 'text') AS texts FROM marked WHERE kind <> 'heading' GROUP BY doc_id",
    "chunk_offsets": f"""WITH RECURSIVE {_SENTENCES}, walk AS (SELECT doc_id, ord, greatest(strpos(d.text, s) - 1, 0) AS start FROM sent JOIN documents d USING (doc_id) WHERE ord = 1
      UNION ALL SELECT b.doc_id, b.ord, CASE WHEN strpos(substr(d.text, w.start + 2), b.s) > 0 THEN w.start + strpos(substr(d.text, w.start + 2), b.s) ELSE w.start END FROM walk w JOIN sent b ON b.doc_id = w.doc_id AND b.ord = w.ord + 1 JOIN documents d ON d.doc_id = w.doc_id)
      SELECT doc_id, (ord - 1)::INT AS piece, start::INT AS start FROM walk""",
    "table_pieces": f"""WITH RECURSIVE {_packed("n_regionkey", "SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, t || chr(10) AS t, len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) AS n FROM (SELECT *, '| ' || n_nationkey || ' | ' || n_name || ' |' AS t FROM nation)", 12)}
      SELECT n_regionkey, piece::INT AS piece, '| key | name |' || chr(10) || text AS text FROM packed""",
    "table_rows": "SELECT s_suppkey, concat_ws('; ', 'key: ' || s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'name: ' || s_name END, 'nation: ' || s_nationkey) AS line FROM supplier",
}
