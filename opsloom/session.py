"""Session settings and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "opsloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are designed around.

    Nothing here sizes the cluster: executors, memory and
    ``spark.sql.shuffle.partitions`` come from the submitter.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Frames, hours and dates are defined in UTC unless a zone is passed."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Where it is unset, a cluster gets an error; a session on one machine, as in a test
    run, gets a fresh folder.
    """
    sc = spark.sparkContext
    path = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF)
    if not path:
        path = sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        path = tempfile.mkdtemp(prefix="opsloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder, one folder per application."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/opsloom/{app}/{label}-{uuid.uuid4().hex}"


#: Paths of tables that go when the innermost ``scratch`` block ends.
_open: ContextVar[list[str] | None] = ContextVar("_open", default=None)


def stored(df: DataFrame, label: str = "table", keep: bool = False) -> DataFrame:
    """Write a result that several steps read, and read it back.

    A Parquet table in the shared folder cuts the lineage: it is computed once,
    read by column, has a known size for join planning, and survives the loss of
    any executor. Inside a ``scratch`` block the table goes with the block, unless
    ``keep`` says that the result of the block reads it.
    """
    path = scratch_path(df.sparkSession, label)
    paths = _open.get()
    if paths is not None and not keep:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, path: str) -> None:
    """Remove a table below the shared folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A block whose ``stored`` tables are removed at its end.

    What the block returns must not read them: write it inside the block, or store it with
    ``keep``. Kept tables go by ``release_all``.
    """
    paths: list[str] = []
    token = _open.set(paths)
    try:
        yield
    finally:
        _open.reset(token)
        for p in paths:
            release(spark, p)


def release_all(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; its earlier results can't be read after that."""
    release(spark, f"{shared_dir(spark).rstrip('/')}/opsloom/{spark.sparkContext.applicationId}")
