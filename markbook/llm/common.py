"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook.session import scratch_dir

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def in_small_batches(df: DataFrame, rows: int = 1_000) -> DataFrame:
    """Texts reach Python workers ``rows`` at a time, so that a batch of long ones fits a worker.

    Sets the session's Arrow batch size where it is larger; results don't depend on it.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it again.

    Cuts the lineage: a lost executor costs a reread, and several readers share one computation.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    # Spark drops the shuffle files behind a written table once its driver has collected garbage.
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once what was made of them is written itself."""
    for df in frames:
        files = df.inputFiles()
        if files:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))
