"""A guard for SQL that others write: one bounded SELECT over listed tables, checked on Spark's own plan.

Everything is refused that is not on a positive list: plan nodes, functions and tables. CTE names hold only where they are
in scope. What runs is the checked text with the places of its relations, as the parser found them, changed to the views of this one
query; strings and columns stay as they are.
"""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from heddle.functions import sqlcompat

QUALIFIER = re.compile(r"\s*(?:`(?:[^`]|``)*`|\w+)\s*\.\s*")
#: The plan nodes that reading needs, and the functions besides the ones standard SQL has.
PLAN_NODES = frozenset(
    "Project Filter Aggregate Distinct Sort GlobalLimit LocalLimit Offset Join UnresolvedRelation SubqueryAlias UnresolvedSubqueryColumnAliases Union Intersect Except UnresolvedWith CTERelationDef "
    "UnresolvedHaving WithWindowDefinition Window OneRowRelation LateralJoin Generate Pivot Unpivot UnresolvedPivot Sample LimitAll UnresolvedInlineTable LocalRelation UnresolvedOrdinal CTERelationRef WithCTE ResolvedInlineTable UnresolvedTVFAliases".split()
)
FUNCTIONS = frozenset(
    "count sum avg min max lower upper coalesce round cast date_trunc extract date_part to_char age generate_series to_date to_timestamp initcap split_part regexp_replace regexp_match regexp_extract regexp_extract_all "
    "width_bucket percentile_cont percentile_disc percentile mode corr string_agg listagg array_agg collect_list bool_and bool_or every some any stddev stddev_samp stddev_pop variance var_samp var_pop justify_interval to_number "
    "btrim trim ltrim rtrim lpad rpad reverse repeat left right ceiling ceil floor trunc abs sign sqrt exp ln log log10 power pow mod length char_length octet_length concat concat_ws substring substr position locate replace translate "
    "nullif ifnull nvl greatest least if when case isnull isnotnull date_add date_sub datediff date_diff add_months months_between last_day year quarter month day dayofmonth dayofweek dayofyear hour minute second "
    "current_date current_timestamp now make_date make_timestamp date timestamp row_number rank dense_rank percent_rank cume_dist ntile lag lead first first_value last last_value nth_value median approx_count_distinct covar_pop covar_samp "
    "regr_slope grouping grouping_id explode sequence array struct named_struct size element_at array_contains array_join array_distinct sort_array int bigint double string boolean decimal float smallint like ilike rlike contains startswith endswith "
    "and or not in between div try_divide try_cast date_format to_json md5 sha2 crc32 hex ascii chr cardinality unnest".split()
)
SHOWN = "Use standard SQL: count, sum, avg, min, max, lower, upper, coalesce, round, date_trunc, extract, cast, case."
FETCH = re.compile(r"(?is)\bfetch\s+(?:first|next)\s+(\d+\s+)?rows?\s+(only|with\s+ties)\b")


class Refused(ValueError):
    """Why a query may not run, for whoever wrote it."""


class Busy(RuntimeError):
    """More guarded queries at once than are admitted."""


class Admission:
    """Lets at most ``most`` guarded queries run at once; one beyond that waits ``wait_s`` seconds for its turn and is then refused with Busy.

    What is admitted runs in the scheduler pool ``pool``, so that with ``spark.scheduler.mode`` FAIR other work keeps its share of the executors. A turn ends with
    its query, however that ends. The bound holds in one driver, by whichever threads ask.
    """

    def __init__(self, most: int = 10, wait_s: float = 0.0, pool: str = "guarded"):
        if most < 1:
            raise ValueError("at least one query must be admitted")
        self.most, self.wait_s, self.pool = most, wait_s, pool
        self._free = threading.BoundedSemaphore(most)

    @contextmanager
    def turn(self, spark: SparkSession) -> Iterator[None]:
        if not self._free.acquire(timeout=self.wait_s):
            raise Busy(f"{self.most} queries are running already; try again later.")
        context = spark.sparkContext
        before = context.getLocalProperty("spark.scheduler.pool")
        try:
            context.setLocalProperty("spark.scheduler.pool", self.pool)
            yield
        finally:
            context.setLocalProperty("spark.scheduler.pool", before)
            self._free.release()


@dataclass(frozen=True)
class QueryResult:
    columns: list[str]
    rows: list[tuple]
    row_count: int
    truncated: bool
    ms: float


def _outside_strings(sql: str) -> list[tuple[str, str]]:
    """(kind, piece): code, string, name (double quotes) or comment, in order."""
    pattern = re.compile(r"(?s)'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/")
    out, at = [], 0
    for m in pattern.finditer(sql):
        out.append(("code", sql[at : m.start()]))
        out.append(({"'": "string", '"': "name", "`": "tick"}.get(m[0][0], "comment"), m[0]))
        at = m.end()
    return [*out, ("code", sql[at:])]


def _prepare(sql: str) -> str:
    """Comments out, double-quoted names as Spark's, FETCH FIRST as LIMIT; refuses several statements and none."""
    parts = []
    for kind, piece in _outside_strings(sql):
        if kind == "name":
            inner = piece[1:-1].replace('""', '"')
            if inner != inner.lower():
                raise Refused(f"There is no table or column {inner}: a quoted name is exact.")
            parts.append(("tick", "`" + inner.replace("`", "``") + "`"))
        else:
            parts.append((kind, " " if kind == "comment" else piece))
    code = "".join(p if k == "code" else "x" for k, p in parts)
    if not code.replace(";", "").strip():
        raise Refused("There is no SQL to run.")
    if [s for s in code.split(";")[1:] if s.strip()]:
        raise Refused("Write exactly one SELECT statement; this has several.")
    out = []
    for kind, piece in parts:
        if kind == "code":
            if m := FETCH.search(piece):
                if "ties" in m[2].lower():
                    raise Refused("Use LIMIT instead of FETCH FIRST ... WITH TIES or PERCENT.")
                piece = FETCH.sub(lambda m: f"LIMIT {(m[1] or '1').strip()}", piece)
            piece = piece.replace(";", " ")
        out.append(piece)
    return "".join(out).strip()


def _list(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _class(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


class _Walk:
    """Checks a parsed plan and notes what has to change in the text, by place: (from, to, new text)."""

    def __init__(self, schema: str, tables: set[str], text: str):
        self.schema, self.tables, self.text = schema, tables, text
        self.edits: list[tuple[int, int, str]] = []
        self.helpers: set[str] = set()

    def refuse_table(self, name: str) -> Refused:
        return Refused(f"There is no table {name} in the schema {self.schema}. Tables: {', '.join(sorted(self.tables)) or 'none'}.")

    def place(self, node) -> tuple[int, int] | None:
        """Where a node stands in the text, end exclusive."""
        origin = node.origin()
        if origin.startIndex().isEmpty() or origin.stopIndex().isEmpty():
            return None
        return origin.startIndex().get(), origin.stopIndex().get() + 1

    def plan(self, node, ctes: frozenset[str]) -> None:
        kind = _class(node)
        if kind == "UnresolvedTableValuedFunction" and [p.lower() for p in _list(node.name())] == ["generate_series"]:
            self.rename(node, "generate_series", "heddle_series_table")
        elif kind not in PLAN_NODES:
            raise Refused(f"Only a SELECT statement may be run, not {kind}. Write a SELECT query.")
        if kind == "UnresolvedRelation":
            self.relation(node, _list(node.multipartIdentifier()), ctes)
        if kind == "UnresolvedWith":
            inner = ctes
            for pair in _list(node.cteRelations()):
                self.plan(pair._2(), inner)  # a CTE sees those before it
                inner = inner | {pair._1().lower()}
            self.plan(node.child(), inner)
            return
        for e in _list(node.expressions()):
            self.expression(e, ctes)
        for child in _list(node.children()):
            self.plan(child, ctes)

    def relation(self, node, parts: list[str], ctes: frozenset[str]) -> None:
        name = parts[-1].lower()
        if len(parts) == 1 and name in ctes:
            return
        if len(parts) > 2:
            raise Refused(f"Only tables of the schema {self.schema} may be used; drop the database name.")
        if len(parts) == 2 and parts[0].lower() != self.schema.lower():
            raise Refused(
                f"Only tables of the schema {self.schema} may be used, not {parts[0].lower()}.{name}. Tables: {', '.join(sorted(self.tables))}."
            )
        if name not in self.tables:
            raise self.refuse_table(name)
        if len(parts) == 2:
            self.unqualify(node)

    def unqualify(self, node) -> None:
        """The schema's name goes from the place of a relation or of a column."""
        if at := self.place(node):
            if m := QUALIFIER.match(self.text, at[0], at[1]):
                self.edits.append((m.start(), m.end(), ""))

    def rename(self, node, name: str, to: str) -> None:
        at = self.place(node)
        if at is None or self.text[at[0] : at[0] + len(name)].lower() != name:
            raise Refused(f"Write {name}(...) plainly.")
        self.helpers.add(to)
        self.edits.append((at[0], at[0] + len(name), to))

    def call(self, node, name: str) -> None:
        """Functions of the other dialect: under the names of their helpers, patterns in Spark's letters."""
        arguments = _list(node.arguments())
        literal = str(arguments[1].value()) if len(arguments) > 1 and _class(arguments[1]) == "Literal" else None
        if name in sqlcompat.HELPERS:
            self.rename(node, name, sqlcompat.HELPERS[name])
        elif name == "generate_series":
            at, places = self.place(node), [self.place(a) for a in arguments]
            if at is None or None in places or not 2 <= len(places) <= 3:
                raise Refused("Write generate_series(start, stop) or generate_series(start, stop, step).")
            self.edits.append((*at, sqlcompat.series(*[self.text[a:b] for a, b in places])))
        elif name == "regexp_match":
            if literal is None:
                raise Refused("regexp_match() needs its expression as a literal.")
            self.rename(node, name, f"heddle_match_{min(9, len(re.findall(r'(?<![\\])[(](?![?])', literal)))}")
        elif name in ("to_char", "to_date", "to_timestamp") and literal is not None and not re.search(r"[09]", literal):
            at = self.place(arguments[1])
            if at:
                self.edits.append((*at, "'" + sqlcompat.pattern(literal).replace("'", "\\'") + "'"))

    def expression(self, node, ctes: frozenset[str]) -> None:
        kind = _class(node)
        if kind == "UnresolvedFunction":
            parts = _list(node.nameParts())
            if len(parts) > 1 or parts[-1].lower() not in FUNCTIONS:
                raise Refused(f"The function {'.'.join(parts)}() is not allowed. {SHOWN}")
            self.call(node, parts[-1].lower())
        elif kind in ("UnresolvedTableValuedFunction", "NamedArgumentExpression", "UnresolvedExtractValueFunction"):
            raise Refused(f"{kind} is not allowed. {SHOWN}")
        elif self.schema and kind in ("UnresolvedAttribute", "UnresolvedStar"):
            parts = _list(node.nameParts()) if kind == "UnresolvedAttribute" else _list(node.target().get()) if node.target().isDefined() else []
            if len(parts) > (kind == "UnresolvedAttribute") + 1 and parts[0].lower() == self.schema.lower():
                self.unqualify(node)
        if hasattr(node, "plan") and "Subquery" in kind or kind in (
            "Exists",
            "ListQuery",
            "InSubquery",
            "LateralSubquery",
            "FunctionTableSubqueryArgumentExpression",
        ):
            inner = node.query() if kind == "InSubquery" else node
            self.plan(inner.plan(), ctes)
        for child in _list(node.children()):
            self.expression(child, ctes)

    def changed(self) -> str:
        text = self.text
        for start, end, new in sorted(set(self.edits), reverse=True):
            text = text[:start] + new + text[end:]
        return text


def _check(spark: SparkSession, sql: str, schema: str, tables: Iterable[str], max_rows: int | None) -> tuple[_Walk, int | None]:
    text = _prepare(sql)
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:  # noqa: BLE001  py4j wraps Spark's ParseException
        reason = next((x for x in str(getattr(e, "desc", None) or e).strip().splitlines() if x.strip()), "syntax error")
        raise Refused(f"The SQL could not be parsed: {reason[:200]}") from None
    root = plan
    while _class(root) in ("UnresolvedWith", "GlobalLimit", "LocalLimit", "Offset", "Sort"):
        root = root.child()
    if _class(root) in ("LocalRelation", "UnresolvedInlineTable", "ResolvedInlineTable"):
        raise Refused("Only a SELECT statement may be run, not VALUES. Write a SELECT query.")
    walk = _Walk(schema, {t.lower() for t in tables}, text)
    walk.plan(plan, frozenset())
    return walk, None if max_rows is None else limit_of(plan, max_rows)


def guard(spark: SparkSession, sql: str, schema: str, tables: Iterable[str], max_rows: int | None) -> tuple[str, int | None]:
    """(checked SQL, its row limit) or Refused; ``schema`` may be empty for temporary views. No ``max_rows`` sets no limit."""
    walk, limit = _check(spark, sql, schema, tables, max_rows)
    return walk.text, limit


def limit_of(plan, max_rows: int) -> int:
    """The least of the query's own outermost limit and ``max_rows``; LIMIT ALL and expressions count as none."""
    node = plan
    while _class(node) in ("UnresolvedWith", "Offset"):
        node = node.child()
    if _class(node) == "GlobalLimit" and re.fullmatch(r"\d+", str(node.limitExpr().toString())):
        return min(max_rows, int(node.limitExpr().toString()))
    return max_rows


def guarded(spark: SparkSession, sql: str, tables: dict[str, DataFrame], max_rows: int | None, schema: str = "") -> DataFrame:
    """The guarded query over these tables alone, with its limit (none without ``max_rows``, for results that stay distributed).

    It runs in a copy of the session that has nothing but these views besides, so queries at the same time don't see
    each other's tables and the session keeps its own views. Only relations and columns lose the schema's name, at the places that the parser gives.
    """
    walk, limit = _check(spark, sql, schema, tables, max_rows)
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    dataset = spark._jvm.org.apache.spark.sql.classic.Dataset
    for name, df in tables.items():
        dataset.ofRows(own._jsparkSession, df._jdf.queryExecution().analyzed()).createOrReplaceTempView(name)
    for helper in sorted(walk.helpers):
        own.sql(sqlcompat.definition(helper))
    frame = own.sql(walk.changed())
    return frame if limit is None else frame.limit(limit)


def run(
    spark: SparkSession,
    sql: str,
    tables: dict[str, DataFrame],
    row_limit: int = 200,
    timeout_s: float = 10.0,
    schema: str = "",
    admission: Admission | None = None,
) -> QueryResult:
    """At most ``row_limit`` rows, one more being fetched to see whether there are; cancelled after ``timeout_s``.

    With an ``admission`` it has to wait for its turn, which doesn't count as time of the query, and may be refused with Busy.
    """
    frame = guarded(spark, sql, tables, row_limit + 1, schema)
    with admission.turn(spark) if admission else nullcontext():
        return _timed(spark, frame, row_limit, timeout_s)


def _timed(spark: SparkSession, frame: DataFrame, row_limit: int, timeout_s: float) -> QueryResult:
    tag = f"heddle-{threading.get_ident()}-{time.monotonic_ns()}"
    context = spark.sparkContext
    context.addJobTag(tag)
    timer = threading.Timer(timeout_s, lambda: context.cancelJobsWithTag(tag))
    timer.start()
    began = time.perf_counter()
    try:
        rows = [tuple(r) for r in frame.collect()]
    except Exception as e:
        if time.perf_counter() - began >= timeout_s:
            raise TimeoutError(f"The query took longer than {timeout_s:g} s and was stopped.") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)
    return QueryResult(frame.columns, rows[:row_limit], min(len(rows), row_limit), len(rows) > row_limit, (time.perf_counter() - began) * 1000)
