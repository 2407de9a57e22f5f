"""What a front end needs of the library: events as records, a turn's stream, health, model calls, paths, ids, runs and migrations."""

from __future__ import annotations

import dataclasses
import json
import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.session import remove

SHOWN_ONLY = frozenset({"token"})  # events that are shown and not kept


class ServiceError(RuntimeError):
    """What is wrong, for whoever asked."""


# events


@dataclass(frozen=True)
class Event:
    """A step of a turn; ``seq`` is its place."""

    seq: int = 0


@dataclass(frozen=True)
class Query(Event):
    text: str = ""


@dataclass(frozen=True)
class Retrieved(Event):
    hits: tuple[dict[str, Any], ...] = ()
    reranked: int = 0


@dataclass(frozen=True)
class Graded(Event):
    best_score: float = 0.0
    enough: bool = False


@dataclass(frozen=True)
class Rewrote(Event):
    query: str = ""
    new: bool = True


@dataclass(frozen=True)
class SchemaRead(Event):
    tables: tuple[str, ...] = ()
    chars: int = 0


@dataclass(frozen=True)
class ExamplesFound(Event):
    found: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class SqlWritten(Event):
    sql: str = ""
    attempt: int = 1


@dataclass(frozen=True)
class SqlChecked(Event):
    ok: bool = True
    error: str = ""


@dataclass(frozen=True)
class SqlRan(Event):
    columns: tuple[str, ...] = ()
    rows: tuple[tuple[Any, ...], ...] = ()
    row_count: int = 0
    truncated: bool = False


@dataclass(frozen=True)
class Token(Event):
    text: str = ""


@dataclass(frozen=True)
class Done(Event):
    outcome: str = ""
    answer: str = ""
    cited: tuple[int, ...] = ()
    unknown_citations: tuple[int, ...] = ()
    sql: str = ""
    error: str = ""
    rewrites: int = 0
    top_score: float = 0.0
    query: str = ""


@dataclass(frozen=True)
class Failed(Event):
    error: str = ""


#: The events by the name that they have as records.
EVENTS: dict[str, type[Event]] = {
    "query": Query,
    "retrieved": Retrieved,
    "graded": Graded,
    "rewrote": Rewrote,
    "schema": SchemaRead,
    "examples": ExamplesFound,
    "sql_written": SqlWritten,
    "sql_checked": SqlChecked,
    "sql_ran": SqlRan,
    "token": Token,
    "done": Done,
    "failed": Failed,
}
NAMES = {kind: name for name, kind in EVENTS.items()}


def _plain(value: Any) -> Any:
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return {f.name: _plain(getattr(value, f.name)) for f in dataclasses.fields(value)}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


def _frozen(value: Any) -> Any:
    return tuple(map(_frozen, value)) if isinstance(value, list) else value


def to_record(event: Event) -> dict[str, Any]:
    """The event as plain values with its ``type``."""
    return {"type": NAMES[type(event)], **_plain(event)}


def from_record(record: dict[str, Any]) -> Event:
    """The event of a record; keys that it doesn't know are left out, an unknown type is an error."""
    if record.get("type") not in EVENTS:
        raise ServiceError(f"There is no event {record.get('type')!r}.")
    kind = EVENTS[record["type"]]
    known = {f.name for f in dataclasses.fields(kind)}
    return kind(**{k: _frozen(v) for k, v in record.items() if k in known})


def kept(records: Iterable[dict[str, Any]]) -> list[dict[str, Any]]:
    """The records that are saved, in order."""
    return sorted((r for r in records if r["type"] not in SHOWN_ONLY), key=lambda r: r["seq"])


def event_rows(spark: SparkSession, turns: dict[str, list[dict[str, Any]]]) -> DataFrame:
    """(turn, seq, kind, payload): the saved events of turns, the payload as JSON text."""
    rows = [
        (
            turn,
            r["seq"],
            r["type"],
            json.dumps(_plain({k: v for k, v in r.items() if k not in ("type", "seq")}), ensure_ascii=False),
        ) for turn, records in turns.items() for r in kept(records)
    ]
    return spark.createDataFrame(rows, "turn string, seq int, kind string, payload string")


def replayed(rows: DataFrame, turn: str) -> list[Event]:
    """A saved turn's events again, in order."""
    return [from_record({"type": r.kind, "seq": r.seq, **json.loads(r.payload)}) for r in rows.where(F.col("turn") == turn).orderBy("seq").collect()]


def server_events(records: Iterable[dict[str, Any]]) -> Iterator[str]:
    """Records as a text/event-stream: the type as the event's name, the rest as one line of JSON."""
    for r in records:
        yield f"event: {r['type']}\nid: {r['seq']}\ndata: {json.dumps(_plain({k: v for k, v in r.items() if k != 'type'}), ensure_ascii=False)}\n\n"


# health and model calls


def problems(checks: dict[str, Callable[[], object]]) -> list[str]:
    """What is wrong with the setup, all of it at once: each check that raises, or gives False."""
    out = []
    for name, check in checks.items():
        try:
            if check() is False:
                out.append(f"{name}: not available")
        except Exception as e:  # noqa: BLE001  whatever a check meets is what is reported
            out.append(f"{name}: {str(e).splitlines()[0][:200] if str(e) else type(e).__name__}")
    return out


def check_setup(checks: dict[str, Callable[[], object]]) -> None:
    if found := problems(checks):
        raise ServiceError("\n".join(found))


def can_write(spark: SparkSession, folder: str) -> bool:
    """Whether files can be made, read and removed in a folder."""
    probe = f"{folder.rstrip('/')}/probe-{uuid.uuid4().hex}"
    try:
        spark.range(1).write.parquet(probe)
        return spark.read.parquet(probe).count() == 1
    finally:
        remove(spark, probe)


def health(spark: SparkSession, checks: dict[str, Callable[[], object]]) -> DataFrame:
    """(name, ok, error) of each check."""
    rows = [(name, not (found := problems({name: check})), found[0] if found else None) for name, check in checks.items()]
    return spark.createDataFrame(rows, "name string, ok boolean, error string")


def model_calls(calls: DataFrame) -> DataFrame:
    """Calls (prompt_tokens, output_tokens, output_ms, context_tokens) with ``per_second`` and ``context_full``."""
    return calls.withColumns(
        {
            "per_second": F.try_divide(F.col("output_tokens").cast("double"), F.col("output_ms") / 1000),
            "context_full": F.coalesce(F.col("prompt_tokens") >= F.col("context_tokens"), F.lit(False)),
        }
    )


def model_label(label: Column) -> tuple[Column, Column]:
    """(model, size) of a ``model|size`` label; the size is null where there is none."""
    return F.substring_index(label, "|", 1), F.when(F.contains(label, F.lit("|")), F.substring_index(label, "|", -1).try_cast("int"))


# paths


def artifact_path(root: str, *parts: str) -> Path:
    """A file below a folder; parts that lead out of it, or are more than a name, are refused."""
    for part in parts:
        if not re.fullmatch(r"[\w][\w.\-]*", part) or ".." in part:
            raise ServiceError(f"{part!r} is not the name of a file here.")
    top = Path(root).resolve()
    path = top.joinpath(*parts).resolve()
    if not path.is_relative_to(top):
        raise ServiceError("That file is not in this folder.")
    return path


# one run at a time


class RunLock:
    """Lets one run at a time work on a folder: a file that only one can create, removed at the end.

    Works on every file system whose create call fails for a file that is there. A lock of a run that died is removed by hand, or by ``force``.
    """

    def __init__(self, spark: SparkSession, folder: str, force: bool = False):
        self.spark, self.path, self.force = spark, f"{folder.rstrip('/')}/.lock", force

    def __enter__(self) -> RunLock:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if self.force:
            remove(self.spark, self.path)
        try:
            out = fs.create(at, False)
        except Exception as e:
            raise ServiceError(f"Another run is at work here ({self.path}).") from e
        out.write(bytearray(f"{os.getpid()}\n".encode()))
        out.close()
        return self

    def __exit__(self, *_: object) -> None:
        remove(self.spark, self.path)


# the stored schema's version


def migrate(spark: SparkSession, folder: str, steps: dict[int, Callable[[SparkSession, str], None]]) -> list[int]:
    """Runs the numbered steps that a store has not seen yet, in order, and remembers each; returns those that ran.

    A step that fails is not remembered and ends the migration, so it can be asked for again. One migration runs at a time.
    """
    with RunLock(spark, folder):
        path = f"{folder.rstrip('/')}/schema_version"
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        known = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        done = {r.version for r in spark.read.parquet(path).collect()} if known else set()
        if late := [n for n in steps if n not in done and done and n < max(done)]:
            raise ServiceError(f"Step {min(late)} comes before those that ran; give it a later number.")
        ran = []
        for number in sorted(set(steps) - done):
            steps[number](spark, folder)
            spark.createDataFrame([(number,)], "version int").coalesce(1).write.mode("append").parquet(path)
            ran.append(number)
        return ran


# evaluation files


CASE = "id string, question string, history array<struct<role:string,text:string>>, expect string, facts array<string>, source struct<file:string,snippets:array<string>>"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from JSON lines; a repeated or missing id, or an unknown expectation, is an error."""
    cases = spark.read.schema(CASE).option("mode", "FAILFAST").json(path)
    odd = cases.where(
        F.col("id").isNull() | ~F.coalesce(F.col("expect"), F.lit("")).isin("answer", "abstain", "direct")
    ).select("id", "expect").limit(1).collect()
    if odd:
        raise ServiceError(f"The case {odd[0].id} expects {odd[0].expect!r}; cases expect answer, abstain or direct.")
    if twice := cases.groupBy("id").count().where("count > 1").limit(1).collect():
        raise ServiceError(f"Two cases have the id {twice[0].id}.")
    return cases


def write_results(results: DataFrame, path: str) -> None:
    """A run's results as JSON lines, replacing an earlier file of this name."""
    results.write.mode("overwrite").json(path)
