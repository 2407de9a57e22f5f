"""What people know about tables: an optional file of descriptions and column types beside the data."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators.profile import TYPES
from heddle.sources.settings import SettingsError


@dataclass(frozen=True)
class ColumnNote:
    type: str | None = None
    description: str = ""


@dataclass(frozen=True)
class TableNote:
    description: str = ""
    columns: dict[str, ColumnNote] = field(default_factory=dict)

    @property
    def types(self) -> dict[str, str]:
        return {name: c.type for name, c in self.columns.items() if c.type}


@dataclass(frozen=True)
class SchemaNote:
    description: str = ""
    tables: dict[str, TableNote] = field(default_factory=dict)


def _known(value: Any, keys: set[str], where: str) -> dict[str, Any]:
    if value is None:
        return {}
    if not isinstance(value, dict):
        raise SettingsError(f"{where} must have keys.")
    if odd := sorted(set(map(str, value)) - keys):
        raise SettingsError(f"{where}: unknown key {odd[0]}; known are {', '.join(sorted(keys))}.")
    return value


def _text(value: Any, where: str) -> str:
    if value is not None and not isinstance(value, str):
        raise SettingsError(f"{where} must be text.")
    return value or ""


def parse_notes(text: str, where: str = "notes") -> SchemaNote:
    """Notes out of YAML or JSON text; an unknown key or type is an error that names its place. Empty text has none."""
    if text.lstrip().startswith("{"):
        raw = json.loads(text)
    else:
        import yaml

        raw = yaml.safe_load(text)
    top = _known(raw, {"description", "tables"}, where)
    tables = {}
    for name, table in (top.get("tables") or {}).items():
        own = _known(table, {"description", "columns"}, f"{where}: {name}")
        columns = {}
        for column, note in (own.get("columns") or {}).items():
            at = f"{where}: {name}.{column}"
            note = _known({"description": note} if isinstance(note, str) else note, {"description", "type"}, at)
            if note.get("type") not in (None, *TYPES):
                raise SettingsError(f"{at}: the type {note['type']} is not one of {', '.join(TYPES)}.")
            columns[column] = ColumnNote(note.get("type"), _text(note.get("description"), at))
        tables[name] = TableNote(_text(own.get("description"), f"{where}: {name}"), columns)
    return SchemaNote(_text(top.get("description"), where), tables)


def read_notes(spark: SparkSession, path: str) -> SchemaNote:
    """The notes at a path of any file system Spark knows; none if there is no such file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return SchemaNote()
    return parse_notes(spark.read.text(path, wholetext=True).first()[0], path)


def as_rows(spark: SparkSession, notes: SchemaNote) -> DataFrame:
    """(table_name, column, type, description), the table's own note with a null column."""
    rows = [(t, None, None, n.description) for t, n in notes.tables.items()] + [
        (t, c, x.type, x.description) for t, n in notes.tables.items() for c, x in n.columns.items()
    ]
    return spark.createDataFrame(rows, 'table_name string, `column` string, type string, description string')


def described(profile: DataFrame, notes: DataFrame, table_name: str) -> DataFrame:
    """A table's profile rows with the descriptions that the notes have for its columns."""
    own = notes.where((F.col("table_name") == table_name) & F.col("column").isNotNull()).select("column", F.col("description").alias("_note"))
    return profile.drop("description").join(own, "column", "left").withColumn("description", F.coalesce("_note", F.lit(""))).drop("_note")
