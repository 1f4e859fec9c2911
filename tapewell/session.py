"""Session set-up, lineage cuts and the step tables of a job."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_WRITTEN: ContextVar[list[str] | None] = ContextVar("tapewell_written", default=None)


def build_session(app: str = "tapewell", master: str | None = None, **conf: str) -> SparkSession:
    """UTC session with adaptive execution; everything else is left to the cluster's defaults."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        b = b.config(key, value)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or where that is unset a folder of the warehouse."""
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if not named:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/steps-{spark.sparkContext.applicationId}"
        spark.conf.set(CHECKPOINT_CONF, named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and go on from that table.

    An operator that reads its input twice then computes it once, and a lost executor costs a re-read
    only.  Unlike an RDD checkpoint the table is columnar, so later steps read the columns they need,
    and its size is known to the optimizer, which broadcasts a side only where that size allows it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, for tables a job writes and reads back."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    written = _WRITTEN.get()
    if written is not None:
        written.append(path)
    return path


def files(spark: SparkSession, path: str):
    """The file system of ``path`` and the maker of its paths."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    return jvm_path(path).getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


@contextmanager
def job(spark: SparkSession) -> Iterator[list[str]]:
    """A job: the step tables written within are dropped at its end, so write or collect its results inside.

    Gives the list of their paths.  Jobs nest; an inner one drops its own tables.
    """
    written: list[str] = []
    token = _WRITTEN.set(written)
    try:
        yield written
    finally:
        _WRITTEN.reset(token)
        for path in written:
            fs, make = files(spark, path)
            fs.delete(make(path), True)


class Run:
    """What one run has built so far, by name: every step table is written once and handed on."""

    def __init__(self) -> None:
        self._held: dict[str, DataFrame] = {}

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._held:
            self._held[name] = checkpointed(build())
        return self._held[name]

    def keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """``once`` for a step that writes its table itself and reads further columns off it."""
        if name not in self._held:
            self._held[name] = build()
        return self._held[name]


def step_table(fn: Callable[[Run], DataFrame]) -> Callable[[Run], DataFrame]:
    """Makes ``fn(run)`` a step table of its run: written at the first call, the same table at later ones."""

    @wraps(fn)
    def held(run: Run) -> DataFrame:
        return run.once(f"{fn.__module__}.{fn.__qualname__}", lambda: fn(run))

    return held
