"""Helpers shared by the corpus operators: shared storage, texts, batches."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portloom.storage import shared_dir

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def raw_of(text: str) -> bytes:
    """UTF-8 of a text, lone surrogates too."""
    return text.encode("utf-8", "surrogatepass")


def lower_ascii(text: str) -> str:
    """Lower-cases A-Z and nothing else, as bytes do."""
    return raw_of(text).lower().decode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[str]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none of a null.

    Bytes split at just these characters; ``str.split()`` would also cut at
    Unicode spaces and at 0x1C-0x1F.
    """
    return [w.decode("utf-8", "surrogatepass") for w in raw_of(text).split()] if text else []


def lower_az(col: Column) -> Column:
    """Lower-cases A-Z only; other letters stay as they are."""
    return F.translate(col, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again.

    This cuts the lineage: what follows survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/portloom-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Gives back to the system what a task has freed; else an idle worker keeps its peak beside all that its executor does next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than GNU's have no such call
        ctypes.CDLL(None).malloc_trim(0)


#: Rows of a table with one row for each source, group or rule that may be broadcast; about 10 MB.
SMALL_ROWS = 50_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it holds ``most`` rows at most; else as it is, for Spark's own joins by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
