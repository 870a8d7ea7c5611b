"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size of a table that is sent to every executor.
BROADCAST_BYTES = 32 << 20
#: Words of the contracts: maximal runs without these white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


#: Size of the Arrow batches that Python workers get; long texts then do not add up in a worker.
BATCH_BYTES = "8m"


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of ``sf_dir``; from now on the session hands Python workers bounded batches."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; only a local session without one, as in tests, has its own made."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestat-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there.

    That cuts its lineage, and the estimates of size that joins multiply: the plans of iterative operators start
    from the size of the files.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_or_shuffled(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if its counted rows fit in BROADCAST_BYTES; otherwise left to a shuffled join."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def remainder(column: str | Column, modulus: int) -> Column:
    """crc32 of the column's text form, modulo ``modulus``; null ids count as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus

