"""What several operators share: words, scratch tables, Arrow helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Upper and lower case of A-Z only; other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's
    ``spark.checkpoint.dir``. Where that is unset, a temporary folder does on a single
    machine; on a cluster it is an error, as executors wouldn't see the same one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="linkscope-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends
    there, a lost executor costs nothing, and the table's size is known."""
    path = f"{shared_dir(df.sparkSession)}/scratch/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of cut that nothing will read again, such as a loop's past states."""
    for t in tables:
        for file in t.inputFiles()[:1]:
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the words of text; empty for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words, without building them: each word starts where a
    non-space follows the start or a space."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def text_batches(df: DataFrame) -> DataFrame:
    """df, after its session's Arrow batches have been bounded for rows with whole texts:
    TEXT_BYTES, and TEXT_ROWS rows. Every operator that sends whole texts through Arrow
    does so, as Spark reads the settings when a job starts; a tighter bound that the
    session has already stays. Results don't depend on it."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", TEXT_ROWS), ("maxBytesPerBatch", TEXT_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{name}", None)
        if not (now and now.isdigit() and 0 < int(now) <= most):
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df


#: Bounds of an Arrow batch that holds whole texts; a single longer text is a batch of its own.
TEXT_ROWS, TEXT_BYTES = 1000, 8_000_000


def release() -> None:
    """Gives a task's Arrow memory back, as workers live on for other tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


def arrow_schema(df_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df_schema)


def vocabulary_path(name: str) -> str:
    """Where a public tokenizer's file lies; any path may be given instead."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
