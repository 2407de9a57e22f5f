"""The library's own records: experiments, schemas, chats, points, and what follows when some of them go.

Records are append-only tables; what is in force is a view over them. A check that fails raises ``RecordError`` before anything is
written, and removals run in an order that can be repeated after a crash.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.operators.registry import latest, upsert
from heddle.session import remove
from heddle.sources.snapshots import Change, Snapshot, Snapshots

RECENT = 30
FACET_LIMIT = 1000
NAME = re.compile(r"[a-z_][a-z0-9_]*\Z")
NAME_BYTES = 63
#: Names that a schema may not have.
RESERVED = frozenset({"public", "information_schema", "app", "default", "pg_catalog", "pg_toast"})
#: The stages of an ingestion.
STAGES = ("parse", "chunk", "embed", "index")
METRIC = "config_hash string, doc_id string, stage string, duration_ms double, items long, per_second double, details string, created_at timestamp"
SEARCH = "config_hash string, query string, top_k int, embed_ms double, search_ms double, total_ms double, top_similarity double, created_at timestamp"
TURN = "session_id string, kind string, turn long, question string, standalone string, answer string, outcome string, error string, events string, created_at timestamp"


class RecordError(ValueError):
    """Why a record can't be written or removed."""


# names


def name_problem(name: str) -> str | None:
    """Why a schema can't have this name; None if it can."""
    if not NAME.match(name):
        return f"{name!r} is not a plain name: lower-case letters, digits and underscores, no digit first."
    if len(name.encode()) > NAME_BYTES:
        return f"{name!r} has more than {NAME_BYTES} bytes."
    if name in RESERVED or name.startswith("pg_"):
        return f"{name!r} is reserved."
    return None


def name_ok(name: Column) -> Column:
    """``name_problem`` as an expression: whether there is none."""
    return name.rlike("^[a-z_][a-z0-9_]*$") & (F.octet_length(name) <= NAME_BYTES) & ~name.isin(*sorted(RESERVED)) & ~name.startswith("pg_")


def create_schema(spark: SparkSession, name: str, registered: set[str] = frozenset()) -> None:
    """A database for imported tables; names of registered ones, whose data is others', are refused."""
    if problem := name_problem(name):
        raise RecordError(problem)
    if name in registered:
        raise RecordError(f"The schema {name} is registered; its tables are not ours to make.")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def drop_schema(spark: SparkSession, name: str, registered: set[str] = frozenset()) -> bool:
    """Drops an imported schema with its tables; a registered one is only forgotten. Returns whether data went."""
    if problem := name_problem(name):
        raise RecordError(problem)
    if name in registered:
        return False
    spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")
    return True


def drop_table(spark: SparkSession, schema: str, table: str, registered: set[str] = frozenset()) -> bool:
    """Drops an imported table; one of a registered schema stays. Returns whether data went."""
    if schema in registered:
        return False
    spark.sql(f"DROP TABLE IF EXISTS `{schema}`.`{table.replace('`', '``')}`")
    return True


# experiments and schemas


def with_documents(experiments: DataFrame, metrics: DataFrame) -> DataFrame:
    """The last settings of each name with ``documents``: how many distinct documents its metrics know, 0 for none."""
    counts = metrics.groupBy("config_hash").agg(F.count_distinct("doc_id").alias("documents"))
    return latest(experiments, ["name"], [F.col("created_at")]).join(counts, "config_hash", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))


def with_tables(schemas: DataFrame, tables: DataFrame) -> DataFrame:
    """Schemas with ``tables``, how many each has, 0 for none."""
    counts = tables.groupBy("schema_name").agg(F.count("*").alias("tables"))
    return schemas.join(counts, "schema_name", "left").withColumn("tables", F.coalesce("tables", F.lit(0)))


def catalog_columns(namespaces: DataFrame, classes: DataFrame, attributes: DataFrame, types: DataFrame, schema: str) -> DataFrame:
    """(table_name, position, column, type, category) of a schema's readable tables, views and materialised views.

    The catalog's relations: namespaces (ns, name), classes (class, ns, name, kind, readable), attributes (class, num, name, type, dropped), types (type, name,
    category).
    """
    own = classes.where(
        F.col("kind").isin("r", "v", "m", "p", "f") & F.col("readable")
    ).join(namespaces.where(F.col("name") == schema).select("ns"), "ns").select("class", F.col("name").alias("table_name"))
    columns = attributes.where((F.col("num") > 0) & ~F.col("dropped")).select(
        "class",
        F.col("num").alias("position"),
        F.col("name").alias("column"),
        "type",
    )
    return own.join(columns, "class").join(types.select("type", F.col("name").alias("type_name"), "category"), "type").select(
        "table_name",
        "position",
        "column",
        F.col("type_name").alias("type"),
        "category",
    )


def catalog_relations(spark: SparkSession, schema: str, tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The relations that ``catalog_columns`` joins, for frames as the tables of one schema."""
    from heddle.operators.profile import column_kind

    category = {"bigint": "N", "double precision": "N", "date": "D", "timestamp": "D", "timestamptz": "D", "boolean": "B", "text": "S"}
    kinds: dict[str, int] = {}
    attributes = [
        (
            i,
            n + 1,
            f.name,
            kinds.setdefault(column_kind(f.dataType)[0], len(kinds)),
            False,
        ) for i, df in enumerate(tables.values()) for n, f in enumerate(df.schema.fields)
    ]
    return (
        spark.createDataFrame([(0, schema)], "ns int, name string"),
        spark.createDataFrame([(i, 0, name, "r", True) for i, name in enumerate(tables)], "class int, ns int, name string, kind string, readable boolean"),
        spark.createDataFrame(attributes, "class int, num int, name string, type int, dropped boolean"),
        spark.createDataFrame([(i, name, category.get(name, "U")) for name, i in kinds.items()], "type int, name string, category string"),
    )


def targets(experiments: DataFrame, collections: DataFrame) -> DataFrame:
    """Experiments that can be asked: their collection is there and their settings say that it has term weights.

    ``experiments`` has (name, config) with the settings as JSON text; a config that isn't JSON, or says nothing, counts as no.
    """
    sparse = F.coalesce(F.try_variant_get(F.try_parse_json("config"), "$.index.sparse", "boolean"), F.lit(False))
    return experiments.where(sparse).join(collections.select("name").distinct(), "name", "left_semi")


def where_given(df: DataFrame, **values: object) -> DataFrame:
    """Rows that equal each value given; None asks for nothing."""
    tests = [F.col(f"`{k}`") == F.lit(v) for k, v in values.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def upsert_experiment(experiments: DataFrame, rows: DataFrame) -> DataFrame:
    """``experiments`` (config_hash, name, config, created_at) with new ones by hash; one that is there stays as it is.

    Raises RecordError if a name is there with other settings, or twice among the rows: such an experiment needs a name of its own.
    """
    clash = rows.select("name", "config_hash").unionByName(experiments.select("name", "config_hash")).groupBy("name").agg(F.count_distinct("config_hash").alias("n")).where("n > 1")
    if taken := [r["name"] for r in clash.orderBy("name").limit(5).collect()]:
        raise RecordError(f"Other settings have the name {', '.join(taken)}; give these another.")
    return upsert(
        experiments,
        rows.join(experiments.select("config_hash"), "config_hash", "left_anti").dropDuplicates(["config_hash"]),
        ["config_hash"],
    )


def schema_names(schemas: DataFrame, collections: DataFrame, prefix: str = "examples_") -> DataFrame:
    """The names of schemas that are registered or have a collection of examples, each once."""
    held = collections.where(F.col("name").startswith(prefix)).select(F.substring("name", len(prefix) + 1, 1 << 30).alias("schema_name"))
    return schemas.select("schema_name").union(held).distinct()


def carry_over(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` columns (name, description, ...) with the description that the column had before where they bring none."""
    kept = old.select("name", F.col("description").alias("_kept"))
    return new.join(kept, "name", "left").withColumn(
        "description",
        F.coalesce(F.nullif("description", F.lit("")), "_kept", F.lit("")),
    ).drop("_kept").select(new.columns)


# points


def facet(points: DataFrame, key: str = "doc_id", limit: int = FACET_LIMIT, payload: tuple[str, ...] = ("source_file",)) -> DataFrame:
    """(key, points, payload...): exact counts by key with one point's payload, ordered by it and the key.

    At most ``limit`` keys, those that come first; RecordError says so if there are more, so that none are missed unseen: ask for more or filter.
    """
    found = points.groupBy(key).agg(F.count("*").alias("points"), *[F.min_by(c, F.struct(*payload)).alias(c) for c in payload])
    if (n := found.count()) > limit:
        raise RecordError(f"There are {n:,} of {key}; {limit:,} are listed.")
    return found.orderBy(*[F.coalesce(c, F.lit("")) for c in payload], key)


def count_document(points: DataFrame, doc_id: object) -> int:
    return points.where(F.col("doc_id") == F.lit(doc_id)).count()


def has_document(points: DataFrame, doc_id: object) -> bool:
    return bool(points.where(F.col("doc_id") == F.lit(doc_id)).limit(1).count())


def with_files(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks with the ``source_file`` of their document; null for one that isn't known any more."""
    return chunks.join(files.select("doc_id", "source_file"), "doc_id", "left").select(*chunks.columns, "source_file")


def point_id(name: Column, namespace: str) -> Column:
    """The version-5 UUID of a name: what is written again under it replaces itself. ``namespace`` is a UUID."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + F.lit(1), F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


# appended records


def append(rows: DataFrame, path: str, schema: str) -> None:
    """Adds rows to a log; columns that the schema lacks are refused, those that the rows lack are null, and the time is now."""
    spark, want = rows.sparkSession, T.StructType.fromDDL(schema)
    if unknown := set(rows.columns) - set(want.names):
        raise RecordError(f"The log has no column {', '.join(sorted(unknown))}.")
    now = lambda f: F.current_timestamp() if f.name == "created_at" else F.lit(None).cast(f.dataType)
    made = rows.select(
        *[(F.coalesce(F.col(f.name).cast(f.dataType), now(f)) if f.name in rows.columns else now(f)).alias(f.name) for f in want.fields]
    )
    if "stage" in want.names and (odd := made.where(~F.col("stage").isin(*STAGES)).select("stage").limit(1).collect()):
        raise RecordError(f"There is no stage {odd[0].stage}; stages are {', '.join(STAGES)}.")
    made.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log's rows; none where nothing has been written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def stage_metrics(done: DataFrame) -> DataFrame:
    """Rows for the metrics log out of (config_hash, doc_id, stage, duration_ms, items): with the throughput, null where no time passed."""
    return done.withColumn("per_second", F.try_divide(F.col("items").cast("double"), F.col("duration_ms") / 1000))


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """Each document's last run of each stage."""
    return latest(metrics, ["config_hash", "doc_id", "stage"], [F.col("created_at")])


# chats


def sessions_of(turns: DataFrame, title_chars: int = 80) -> DataFrame:
    """(session_id, kind, title, turns, created_at, updated_at) that turns make: the first question names a chat, the last turn dates it."""
    return turns.groupBy("session_id", "kind").agg(
        F.substring(F.min_by("question", F.struct("created_at", "turn")), 1, title_chars).alias("title"), F.count("*").alias("turns"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at")
    )


def recent_chats(turns: DataFrame, limit: int = RECENT) -> DataFrame:
    """The chats used last, newest first, ties by id."""
    return sessions_of(turns).orderBy(F.desc("updated_at"), "session_id").limit(limit)


def chat_turns(turns: DataFrame, session: object) -> DataFrame:
    return turns.where(F.col("session_id") == F.lit(session)).orderBy("turn")


def without_chat(turns: DataFrame, session: object) -> DataFrame:
    """What is left once a chat goes; a chat that isn't there takes nothing."""
    return turns.where(~F.col("session_id").eqNullSafe(F.lit(session)))


def chat_problems(turns: DataFrame) -> DataFrame:
    """(session_id, problem): sessions that are of two kinds, or repeat a turn's number; none if all is well."""
    kinds = turns.groupBy("session_id").agg(F.count_distinct("kind").alias("n")).where("n > 1").select("session_id", F.lit("two kinds").alias("problem"))
    return kinds.unionByName(
        turns.groupBy("session_id", "turn").agg(F.count("*").alias("n")).where("n > 1").select("session_id", F.lit("repeated turn").alias("problem")).distinct()
    )


def save_turns(store: Snapshots, turns: DataFrame) -> Snapshot:
    """Adds turns (session_id, kind, turn, question, created_at, ...) and brings their sessions up to date, both in one change.

    Only the sessions of these turns are worked out anew, from what is kept of them and the new turns. A turn's number that its session
    has, or two kinds in one, is a RecordError.
    """

    def work(now: Snapshot) -> Change:
        own = turns.select("session_id").distinct()
        known = now.table("turns", turns.schema)
        mine = known.join(own, "session_id", "left_semi").unionByName(turns)
        if odd := chat_problems(mine).limit(1).collect():
            raise RecordError(f"The session {odd[0].session_id} would have {odd[0].problem}.")
        fresh = sessions_of(mine)
        kept = now.table("sessions").join(own, "session_id", "left_anti").unionByName(fresh) if "sessions" in now else fresh
        return Change().add("turns", turns).replace("sessions", kept)

    return store.commit(work, rests_on=("turns",))


def good_answers(events: DataFrame, turn: str = "turn", seq: str = "seq", kind: str = "kind", value: str = "value") -> DataFrame:
    """(turn, sql): the SQL that answered each turn, to be kept as an example.

    Events are query, sql_written, sql_checked, sql_ran, answered, abstained and error. A turn counts if it was answered from a result and neither
    failed nor abstained; its SQL is the last that was written before the last run. One aggregate by turn: no window holds a turn.
    """
    at = lambda name: F.max(F.when(F.col(kind) == name, F.col(seq)))
    ran = events.groupBy(turn).agg(
        at("sql_ran").alias("ran"),
        at("answered").alias("answered"),
        at("abstained").alias("abstained"),
        at("error").alias("error"),
    )
    good = ran.where("ran IS NOT NULL AND answered IS NOT NULL AND abstained IS NULL AND error IS NULL").select(turn, "ran")
    written = events.where(F.col(kind) == "sql_written").join(good, turn).where(F.col(seq) < F.col("ran"))
    return written.groupBy(turn).agg(F.max_by(value, seq).alias("sql"))


def unmark(examples: DataFrame, turn_id: object) -> DataFrame:
    """Examples without the one that a turn gave; one that isn't there changes nothing."""
    return examples.where(~F.col("turn_id").eqNullSafe(F.lit(turn_id)))


# removals


def delete_document(doc_id: str, points: Callable[[str], None], files: list[str], rows: Callable[[str], None], spark: SparkSession) -> None:
    """A document's points, then its files, then its rows.

    The rows go last: as long as they are there, the removal can be asked for again, and each step finds nothing to do the second time.
    """
    points(doc_id)
    for path in files:
        remove(spark, path)
    rows(doc_id)


def drop_partition(spark: SparkSession, path: str, **keys: str) -> None:
    """Removes a partition folder of a store written by ``store.write_documents``: an experiment's points, or a document's."""
    remove(spark, "/".join([path, *(f"{k}={v}" for k, v in keys.items())]))
