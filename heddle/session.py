"""Session defaults: UTC, ANSI, adaptive execution."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextvars import ContextVar
from pathlib import Path
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "heddle", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; ``conf`` wins over them.

    On a cluster, leave ``master`` unset and let spark-submit name it. Locally the
    number of shuffle partitions follows the number of threads.
    """
    builder = SparkSession.builder.appName(app)
    settings = dict(DEFAULTS)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            cores = master[6:-1] if "[" in master else "1"
            settings["spark.sql.shuffle.partitions"] = str(os.cpu_count() if cores == "*" else int(cores))
            settings["spark.driver.memory"] = os.environ.get("HEDDLE_DRIVER_MEMORY", "8g")
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Gives executors this package, once a session, so that their Python workers can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_heddle_shipped", False):
        return
    root = Path(__file__).resolve().parent
    packed = Path(tempfile.mkdtemp(prefix="heddle-")) / "heddle.zip"
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(str(packed))
    context._heddle_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, for intermediate tables and streams.

    It is what ``spark.checkpoint.dir`` or the context's checkpoint folder names. Where neither is set, a local master gets a folder of
    this process; any other raises RuntimeError, as executors could not read what is left on one machine.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {context.master} share")
        found = f"file://{tempfile.mkdtemp(prefix='heddle-')}"
        context.setCheckpointDir(found)
    return found.rstrip("/")


class Scope:
    """What is stored within it is removed at its end, but for what it was told to ``keep``, which passes to the scope around it.

    ``with Scope() as scope: ...`` owns the tables that its own thread of work stores, so that queries at the same time don't meet. A lazy
    result must be written, or kept, before the scope ends.
    """

    _now: ClassVar[ContextVar[Scope | None]] = ContextVar("heddle_scope", default=None)

    def __init__(self):
        self.made: list[Folder] = []
        self.kept: list[Folder] = []

    def __enter__(self) -> Scope:
        self._around, self._token = Scope._now.get(), Scope._now.set(self)
        return self

    def __exit__(self, *_: object) -> None:
        Scope._now.reset(self._token)
        for one in self.made:
            if one not in self.kept:
                one.drop()
            elif self._around is not None:
                self._around.made.append(one)

    def keep(self, stored: Stored) -> Stored:
        self.kept.append(stored)
        return stored


class Folder:
    """A new folder in the shared folder; its Scope, ``drop()`` or the end of the driver's process removes it with all that is in it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark)}/heddle-{uuid.uuid4().hex}"
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        if (scope := Scope._now.get()) is not None:
            scope.made.append(self)

    def drop(self) -> None:
        remove(self.spark, self.path)


class Stored(Folder):
    """A table written to the shared folder: ``df`` reads it, ``drop()`` removes it.

    Reading it again never repeats the work that made it, also after a lost executor. The Scope that it is made in owns it;
    outside of any it stays until ``drop`` or the end of the driver's process, as a lazy result may still read it.
    """

    def __init__(self, df: DataFrame):
        super().__init__(df.sparkSession)
        df.write.parquet(f"{self.path}/table")
        self.df = self.spark.read.schema(df.schema).parquet(f"{self.path}/table")


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or folder of any file system Spark knows; one that isn't there is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
