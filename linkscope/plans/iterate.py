"""Fixed-point loops over DataFrames.

Each round's state is written to the shared folder and read back, so lineage doesn't
grow, a lost executor doesn't restart the loop, and Spark knows the state's size.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which driver and executors share. Where that
    is unset, a temporary folder does on a single machine; on a cluster it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="linkscope-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Writes df in the shared folder and reads it back."""
    path = f"{shared_dir(df.sparkSession)}/scratch/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of cut that nothing will read again, such as a loop's past states."""
    for t in tables:
        for file in t.inputFiles()[:1]:
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(df: DataFrame, rows: int = 1000, size: int = 8_000_000) -> DataFrame:
    """df, after its session's Arrow batches have been bounded for rows with whole texts; a
    tighter bound that the session has already stays."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        now = conf.get(f"spark.sql.execution.arrow.{name}", None)
        if not (now and now.isdigit() and 0 < int(now) <= most):
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df


class NotFinished(RuntimeError):
    """A loop reached its bound on rounds; it has no result."""


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], done: Callable[[DataFrame, DataFrame], bool], max_rounds: int | None = None) -> DataFrame:
    """Applies step until done(before, after); a bound on rounds that is reached is an error."""
    state = cut(state)
    i = 0
    while True:
        if max_rounds is not None and i >= max_rounds:
            raise NotFinished(f"not done after {max_rounds} rounds")
        after = cut(step(state, i))
        if done(state, after):
            discard(state)
            return after
        discard(state)
        state, i = after, i + 1
