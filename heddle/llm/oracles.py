"""DuckDB SQL for the queries that SQL can express, hashes and all.

XXH64 and CRC-32 are not functions of that dialect, so they are written out: sums and products in 128 bits, taken modulo 2**64, a
step of the hash to a subquery.
"""

from __future__ import annotations

# The primes of XXH64 and the polynomial of CRC-32.
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
POLYNOMIAL = 0xEDB88320
SIZE = 1 << 64


def _n(x: int) -> str:
    return f"{x}::UHUGEINT"


def _mod(x: str) -> str:
    return f"(({x}) % {_n(SIZE)})"


def _xor(a: str, b: str) -> str:
    return f"xor(({a})::UBIGINT, ({b})::UBIGINT)::UHUGEINT"


def _turn(x: str, by: int) -> str:
    return f"({_mod(f'({x}) * {_n(1 << by)}')} + ({x}) // {_n(1 << (64 - by))})"


def _round(h: str, lane: str) -> str:
    return _mod(f"{_turn(_mod(f'{h} + {lane} * {_n(P2)}'), 31)} * {_n(P1)}")


def xxh64(name: str, source: str, data: str, seed: str) -> str:
    """CTEs that end in ``name``: the rows of ``source`` with ``h``, the XXH64 (UHUGEINT) of its column ``data`` (a list of bytes as UHUGEINT) with a seed."""
    lane = "+".join(f"b[8 * i + {j + 1}] * {_n(256**j)}" for j in range(8))
    four = "+".join(f"b[n // 8 * 8 + {j + 1}] * {_n(256**j)}" for j in range(4))
    start = [f"seed + {_n((P1 + P2) % SIZE)}", f"seed + {_n(P2)}", "seed", f"seed + {_n(SIZE - P1)}"]
    lines = [
        f"list_reduce(list_transform(range(n // 32), lambda i: lanes[4 * i + {j + 1}]), lambda v, k: {_round('v', 'k')}, {_mod(s)})" for j, s in enumerate(start)
    ]
    met = _mod(" + ".join(_turn(f"v[{j + 1}]", by) for j, by in enumerate((1, 7, 12, 18))))
    merged = f"list_reduce(v, lambda h, x: {_mod(_mod(_xor('h', _round('0::UHUGEINT', 'x')) + f' * {_n(P1)}') + f' + {_n(P4)}')}, {met})"
    eight = _mod(_mod(_turn(_xor("h", _round("0::UHUGEINT", "k")), 27) + f" * {_n(P1)}") + f" + {_n(P4)}")
    last = _mod(_turn(_xor("h", _mod(f"x * {_n(P5)}")), 11) + f" * {_n(P1)}")
    steps = [
        f"SELECT *, {data} AS b, len({data}) AS n, ({seed})::UHUGEINT AS seed FROM {source}",
        f"SELECT *, list_transform(range(n // 8), lambda i: {lane}) AS lanes FROM {{}}",
        f"SELECT *, CASE WHEN n >= 32 THEN [{', '.join(lines)}] END AS v FROM {{}}",
        f"SELECT *, {_mod(f'CASE WHEN n >= 32 THEN {merged} ELSE seed + {_n(P5)} END + n::UHUGEINT')} AS h0 FROM {{}}",
        f"SELECT *, list_reduce(lanes[n // 32 * 4 + 1 :], lambda h, k: {eight}, h0) AS h1 FROM {{}}",
        f"SELECT *, CASE WHEN n % 8 >= 4 THEN {_xor('h1', _mod(f'({four}) * {_n(P1)}'))} END AS x1 FROM {{}}",
        f"SELECT *, CASE WHEN n % 8 >= 4 THEN {_mod(_mod(_turn('x1', 23) + f' * {_n(P2)}') + f' + {_n(P3)}')} ELSE h1 END AS h2 FROM {{}}",
        f"SELECT *, list_reduce(b[n // 4 * 4 + 1 :], lambda h, x: {last}, h2) AS h3 FROM {{}}",
        f"SELECT *, {_mod(_xor('h3', f'h3 // {_n(1 << 33)}') + f' * {_n(P2)}')} AS h4 FROM {{}}",
        f"SELECT *, {_mod(_xor('h4', f'h4 // {_n(1 << 29)}') + f' * {_n(P3)}')} AS h5 FROM {{}}",
        f"SELECT * EXCLUDE (b, n, seed, lanes, v, h0, h1, x1, h2, h3, h4, h5), {_xor('h5', f'h5 // {_n(1 << 32)}')} AS h FROM {{}}",
    ]
    names = [f"{name}_{i}" for i in range(len(steps) - 1)] + [name]
    return ", ".join(f"{own} AS ({step.format(before)})" for own, step, before in zip(names, steps, ["", *names], strict=False))


def text_bytes(text: str) -> str:
    """A text's UTF-8 bytes."""
    return f"list_transform(regexp_extract_all(hex({text}), '..'), lambda p: ('0x' || p)::UHUGEINT)"


def long_bytes(value: str) -> str:
    """The eight bytes of an unsigned 64-bit number, the least first."""
    return "[" + ", ".join(f"{value} // {_n(256**j)} % 256::UHUGEINT" for j in range(8)) + "]"


def crc32(data: str) -> str:
    """The CRC-32 (BIGINT) of a list of bytes, by a table of the remainders of all bytes."""
    rests = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (POLYNOMIAL if byte & 1 else 0)
        rests.append(byte)
    table = "[" + ", ".join(map(str, rests)) + "]::BIGINT[]"
    return f"xor(4294967295::BIGINT, list_reduce({data}, lambda c, x: xor(({table})[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT))"


def sharding() -> str:
    """Shards and slots: every node's draw for every id, the least child followed from the root down, in the tree and in the one with a shard more."""
    from heddle.llm import sharding as own

    edges, names = [], set()

    def walk(kind: str, node: own.Node) -> None:
        for place, child in enumerate(node.children):
            edges.append((kind, node.name, place, child.name, child.total, -1 if child.children else child.shard))
            names.add(child.name)
            walk(kind, child)

    walk("now", own.tree())
    walk("grown", own.tree(added=1))
    values = ", ".join(f"('{k}', '{p}', {i}, '{n}', {t!r}::DOUBLE, {s})" for k, p, i, n, t, s in edges)
    named = ", ".join(f"('{n}')" for n in sorted(names))
    octets = "list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda p: ('0x' || p)::BIGINT)"
    return f"""
WITH edges(tree, parent, place, name, total, shard) AS (VALUES {values}), names(name) AS (VALUES {named}),
keys AS (SELECT DISTINCT doc_id AS id, CASE WHEN doc_id IS NULL THEN {_n(1 << 63)} WHEN doc_id < 0 THEN (doc_id::HUGEINT + {SIZE}::HUGEINT)::UHUGEINT ELSE doc_id::UHUGEINT END AS k FROM documents),
{xxh64("seeds", "keys", long_bytes("k"), _n(42))},
pairs AS (SELECT id, name, h AS sd FROM (SELECT id, h FROM seeds), names),
{xxh64("hashed", "pairs", text_bytes("name"), "sd")},
draws AS (SELECT id, tree, parent, e.name, shard, -ln(((h // 2048::UHUGEINT)::DOUBLE + 0.5) / 9007199254740992.0::DOUBLE) / total AS draw FROM hashed JOIN edges e USING (name)),
least AS (SELECT id, tree, parent, arg_min(name, draw) AS name, arg_min(shard, draw) AS shard FROM draws GROUP BY ALL),
placed AS (SELECT a.id, a.tree, c.shard FROM least a JOIN least b ON b.id IS NOT DISTINCT FROM a.id AND b.tree = a.tree AND b.parent = a.name JOIN least c ON c.id IS NOT DISTINCT FROM a.id AND c.tree = a.tree AND c.parent = b.name WHERE a.parent = 'root'),
rows_ AS (SELECT doc_id, (strlen(coalesce(text, '')) + 8)::BIGINT AS size, {crc32(octets)} AS text_crc32 FROM documents)
SELECT doc_id, size, text_crc32, 'key' AS law, n.shard::INT AS shard, row_number() OVER (PARTITION BY n.shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, g.shard::INT AS grown_shard
FROM rows_ JOIN placed n ON n.tree = 'now' AND n.id IS NOT DISTINCT FROM doc_id JOIN placed g ON g.tree = 'grown' AND g.id IS NOT DISTINCT FROM doc_id
"""


def simhash() -> str:
    """Fingerprints by votes of all shingles' bits, links by comparing all distinct fingerprints, groups by what can be reached."""
    bits = ", ".join(f"sum((h::UBIGINT >> {b}) & 1) * 2 > count(*) AS b{b}" for b in range(64))
    joined = " + ".join(f"(CASE WHEN b{b} THEN {1 << b} ELSE 0 END)::UHUGEINT" for b in range(64))
    return f"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT doc_id, unnest(list_transform(range(greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i + 1 : i + 3], ' '))) AS s FROM split WHERE len(w) > 0),
counted AS (SELECT doc_id, s, count(*) AS times FROM shingles GROUP BY ALL), single AS (SELECT DISTINCT s FROM counted),
{xxh64("hashed", "single", text_bytes("s"), _n(42))},
votes AS (SELECT doc_id, {bits.replace("sum((h", "sum(times * ((h").replace("& 1) * 2", "& 1)) * 2").replace("count(*)", "sum(times)")} FROM counted JOIN hashed USING (s) GROUP BY doc_id),
fps AS (SELECT doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM documents LEFT JOIN (SELECT doc_id, ({joined})::UBIGINT AS fp FROM votes) USING (doc_id)),
nodes AS (SELECT DISTINCT fp FROM fps),
links AS (SELECT a.fp AS a, b.fp AS b FROM nodes a JOIN nodes b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= 2),
reach(a, b) AS (SELECT fp, fp FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT r.a AS fp, min(f.doc_id) AS component_id FROM reach r JOIN fps f ON f.fp = r.b GROUP BY r.a)
SELECT doc_id, printf('%016x', fp) AS fingerprint, component_id FROM fps JOIN least USING (fp)
"""


def sketches(k: int = 128) -> str:
    """Bottom-k sketches of texts and edited texts: words hashed once each, then chained five by five, one word a step."""
    chain = []
    for step in range(1, 6):
        seed = _n(42) if step == 1 else "acc"
        chain.append(
            xxh64(
                f"c{step}",
                f"(SELECT *, coalesce(sh[{step}], {_n(0)}) AS word FROM {'runs' if step == 1 else f's{step - 1}'})",
                long_bytes("word"),
                seed,
            )
        )
        kept = "h" if step == 1 else f"CASE WHEN len(sh) >= {step} THEN h ELSE acc END"
        chain.append(f"s{step} AS (SELECT sh, {kept} AS acc FROM c{step})")
    union = lambda a, b: f"list_sort(list_distinct(list_concat({a}, {b})))[1 : {k}]"
    like = lambda a, b: f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({union(a, b)}, list_intersect({a}, {b}))) / len({union(a, b)}) END"
    count = lambda a: f"CASE WHEN len({a}) < {k} THEN len({a})::DOUBLE ELSE {k - 1} / ((({a})[{k}] + 1) / 4294967296.0::DOUBLE) END"
    shown = lambda a: f"array_to_string(list_transform({a}, lambda x: printf('%08x', x)), '')"
    return f"""
WITH own AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
beside AS (SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS after FROM own WINDOW w AS (ORDER BY doc_id NULLS FIRST)),
edited AS (SELECT doc_id, text, length(text) AS n, left(text, length(text) - length(text) // 2) || left(after, length(text) // 2) AS changed FROM beside),
both_ AS (SELECT doc_id, 0 AS which, text AS t FROM edited UNION ALL SELECT doc_id, 1, changed FROM edited),
split AS (SELECT doc_id, which, list_filter(regexp_split_to_array(lower(t), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM both_),
placed AS (SELECT doc_id, which, unnest(w) AS word_text, generate_subscripts(w, 1) AS i FROM split), single AS (SELECT DISTINCT word_text FROM placed),
{xxh64("hashed", "single", text_bytes("word_text"), _n(42))},
lists AS (SELECT doc_id, which, list(h ORDER BY i) AS hs FROM placed JOIN hashed USING (word_text) GROUP BY doc_id, which),
shingles AS (SELECT doc_id, which, unnest(list_transform(range(greatest(len(hs) - 4, 1)), lambda i: hs[i + 1 : i + 5])) AS sh FROM lists),
runs AS (SELECT DISTINCT sh FROM shingles),
{", ".join(chain)},
sketch AS (SELECT doc_id, which, list_sort(list_distinct(list((acc // {_n(1 << 32)})::BIGINT)))[1 : {k}] AS sk FROM shingles JOIN s5 USING (sh) GROUP BY doc_id, which),
whole AS (SELECT e.doc_id, e.n, e.changed, coalesce(a.sk, []::BIGINT[]) AS a, coalesce(b.sk, []::BIGINT[]) AS b FROM edited e LEFT JOIN sketch a ON a.doc_id IS NOT DISTINCT FROM e.doc_id AND a.which = 0 LEFT JOIN sketch b ON b.doc_id IS NOT DISTINCT FROM e.doc_id AND b.which = 1),
followed AS (SELECT *, coalesce(lead(a) OVER w, first_value(a) OVER w) AS c FROM whole WINDOW w AS (ORDER BY doc_id NULLS FIRST)),
measured AS (SELECT *, {like("a", "b")} AS near_edited, {like("a", "c")} AS near_next, {count("a")} AS n_distinct, {union("a", "c")} AS m FROM followed)
SELECT doc_id, n AS n_chars, sha256(changed) AS edited_sha256, {shown("a")} AS fingerprint, {shown("b")} AS edited_fingerprint, near_edited, near_next, n_distinct,
  CASE WHEN len(a) = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, near_next * ({count("m")}) / greatest(n_distinct, 1.0::DOUBLE)) END AS in_next
FROM measured
"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def licenses() -> str:
    """Detections by matching every rule whose keyword is there over words that each have their own two spaces, suppressed by comparing all of a text's."""
    from heddle.llm import licenses as own

    doubled = lambda p: " (?:" + p.replace(" ", "  ") + ") "
    values = ", ".join(f"({i}, '{r.label}', '{r.keyword}', {r.priority}, '{doubled(r.pattern)}')" for i, r in enumerate(own.rules()))
    phrases = ", ".join(f"('{phrase}', '{label}')" for phrase, label in own.BASE)
    strength = ", ".join(f"{s}::DOUBLE" for s in own.STRENGTH)
    return rf"""
WITH rules(rule, label, keyword, priority, pattern) AS (VALUES {values}), phrases(phrase, label) AS (VALUES {phrases}),
split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
base AS (
  SELECT doc_id, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + len(string_split(phrase, ' '))] = string_split(phrase, ' '))) AS start
  FROM split, phrases
), tried AS (
  SELECT doc_id, rule, label, priority, pattern, ' ' || array_to_string(w, '  ') || ' ' AS line FROM split JOIN rules ON list_contains(w, keyword)
), met AS (
  SELECT doc_id, rule, label, priority, list_transform(regexp_split_to_array(line, pattern), lambda x: len(x) - len(replace(x, ' ', ''))) AS gaps,
    list_transform(regexp_extract_all(line, pattern), lambda x: len(x) - len(replace(x, ' ', ''))) AS own
  FROM tried WHERE regexp_matches(line, pattern)
), found AS (
  SELECT doc_id, rule, label, priority, ((list_sum(gaps[: i]) + coalesce(list_sum(own[: i - 1]), 0)) // 2)::BIGINT AS a, (own[i] // 2)::BIGINT AS n
  FROM (SELECT *, unnest(range(1, len(own) + 1)) AS i FROM met)
), kept AS (
  SELECT * FROM found d WHERE NOT EXISTS (
    SELECT 1 FROM found e WHERE e.doc_id IS NOT DISTINCT FROM d.doc_id AND e.a <= d.a AND e.a + e.n >= d.a + d.n
      AND (e.priority, -e.n, e.rule) < (d.priority, -d.n, d.rule))
), b AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(label) AS ls FROM base GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_found, max(([{strength}])[priority + 1]) AS best, list(label) AS ls FROM kept GROUP BY doc_id)
SELECT s.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(list_distinct(b.ls)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(b.ls, k.ls))), ','), '') AS labels,
  greatest(coalesce(best, 0::DOUBLE), CASE WHEN n_base > 0 THEN {own.STRENGTH[own.HINT]}::DOUBLE ELSE 0::DOUBLE END) AS score, coalesce(n_found, 0) AS n_found
FROM split s LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def variants() -> str:
    """Words one edit apart by comparing all words of like length; letters beyond ASCII become single ASCII characters first, as distances are in bytes."""
    beyond = "".join(map(chr, range(0xC0, 0x100)))
    other = "".join(chr(c) for c in range(33, 127) if not chr(c).islower() and chr(c) != "'")[: len(beyond)]
    octets = "list_transform(regexp_extract_all(hex(doc_id::VARCHAR || ':' || run), '..'), lambda p: ('0x' || p)::BIGINT)"
    return f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS run FROM documents
), counted AS (SELECT doc_id, run, count(*) AS times FROM runs GROUP BY ALL),
hashed AS (SELECT run, times, {crc32(octets)} AS h FROM counted),
edited AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM hashed),
words AS (SELECT word, sum(times)::BIGINT AS n, translate(word, '{beyond}', '{other}') AS plain FROM edited WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM words a JOIN words b ON a.word <> b.word AND abs(length(a.plain) - length(b.plain)) <= 1 AND levenshtein(a.plain, b.plain) = 1),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
forms AS (
  SELECT word, CASE WHEN other_n >= 2 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), chains(word, upto) AS (SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM chains c JOIN forms f ON f.word = c.upto WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.upto AS root FROM chains c JOIN forms f ON f.word = c.upto WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""


def ranking() -> str:
    """Scores of all documents that share a term with an item."""
    terms = lambda table, key: rf"SELECT {key}, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM {table}"
    return f"""
WITH t AS ({terms("documents", "doc_id")}), q AS (SELECT DISTINCT * FROM ({terms("benchmark", "item_id")})),
lengths AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id), whole AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS l FROM lengths),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, whole GROUP BY term),
gains AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // l))) AS gain FROM tfs JOIN lengths USING (doc_id) JOIN weights USING (term), whole),
scores AS (SELECT item_id, doc_id, sum(gain)::BIGINT AS score FROM q JOIN gains USING (term) GROUP BY ALL HAVING sum(gain) > 0)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores) WHERE rank <= 10
"""
