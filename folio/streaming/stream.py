"""The same outputs on streams. Parsing keeps no state, so every output of DocFrame works as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.documents import DocFrame


def stream_references(stream: DataFrame, text_col: str, id_col: str, **options) -> DataFrame:
    return DocFrame(stream, text_col, id_col, **options).references()


def windowed_tags(stream: DataFrame, text_col: str, time_col: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Tag counts by event-time window; rows later than the watermark are left out."""
    from ..functions.text import names

    tags = stream.withWatermark(time_col, late).select(F.col(time_col).alias("ts"), F.explode(names(F.col(text_col), "#")).alias("tag"))
    return tags.groupBy(F.window("ts", window), "tag").agg(F.count(F.lit(1)).alias("n"))
