"""Reading sources and writing results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_sources(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """One row per file: source_id (its path) and text. Bytes that aren't UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select(F.col("path").alias("source_id"), F.decode("content", "UTF-8").alias("text"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """The same for valid UTF-8, by Spark's text reader."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_id"), F.col("value").alias("text"))


def write_outputs(df: DataFrame, path: str, value: str) -> None:
    """One file per partition, one value per record; values may hold line ends, so records end with a zero byte."""
    df.select(F.col(value).cast("string")).write.mode("overwrite").option("lineSep", "\x00").text(path)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name that the driver and all executors see: below ``spark.checkpoint.dir``, or where everything runs in one process a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("executors need a shared folder: set spark.checkpoint.dir")
        base = "file://" + tempfile.mkdtemp(prefix="folio-")
    return f"{base.rstrip('/')}/folio-{uuid.uuid4().hex}"
