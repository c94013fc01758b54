"""Session helpers and lineage cuts.

Iterative operators cut their lineage by writing a Parquet table to the folder that
all executors share (``spark.checkpoint.dir``).  A table written there survives the
loss of any executor, is read with column pruning and carries exact row counts, and
unlike ``Dataset.checkpoint`` the plan behind it runs once.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def session(app: str = "corpuschain", cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the library expects; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    Taken from ``spark.checkpoint.dir``.  Only where that is unset is a folder of this
    machine used, and then only by a local master, whose executors all see it.
    """
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="corpuschain-")
    spark.conf.set(CHECKPOINT_KEY, made)
    return made


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it is merged and never broadcast.

    Adaptive execution judges by compressed bytes of shuffles, and a broadcast passes
    through the driver unpacked, so several at once of 10 MB each fill its memory.
    """
    return df.hint("merge")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application.

    Functions that run in workers are sent by name, and workers need not have the package on their path.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="corpuschain-code-")) / "corpuschain.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


_written: list[Scratch] = []


@atexit.register
def _clear() -> None:
    """Deletes what operators have written: results read it lazily, so it stays as long as the application."""
    for scratch in _written:
        with contextlib.suppress(Exception):  # a session that has ended has no file system to ask
            scratch._delete([scratch.root])


class Scratch:
    """Tables written to the shared folder by one run of an operator.

    >>> with_scratch = Scratch(spark, "components")
    >>> edges = with_scratch.cut(edges, "edges")      # written, then read back
    >>> with_scratch.drop("edges")                     # when a later table replaces it
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._paths: dict[str, str] = {}
        self._serial = 0
        _written.append(self)

    def write(self, df: DataFrame, name: str) -> str:
        self._serial += 1
        path = f"{self.root}/{self._serial:04d}-{name}"
        df.write.mode("overwrite").option("compression", "snappy").parquet(path)
        self._paths[path] = name
        return path

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        return self.spark.read.schema(schema).parquet(self.write(df, name))

    def drop(self, *names: str) -> None:
        """Deletes all tables written under these names, but for the latest of each."""
        for name in names:
            own = sorted(p for p, n in self._paths.items() if n == name)
            self._delete(own[:-1])

    def drop_all(self, names: Iterable[str]) -> None:
        wanted = set(names)
        self._delete([p for p, n in self._paths.items() if n in wanted])

    def _delete(self, paths: list[str]) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
            self._paths.pop(path, None)
