"""Streams that remember: what a new version of a source adds to its references and withdraws, and sessions of edits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..kernels import blocks
from ..operators.documents import DocFrame

CHANGES = "source_id string, version timestamp, kind string, name string, added boolean"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Changes(StatefulProcessor):
    """State of a source: the time of its last version and the references that it had."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.version = handle.getValueState("version", "at timestamp", self.keep_ms)
        self.names = handle.getValueState("names", "kinds array<string>, names array<string>", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["version", "text_hash"], kind="stable")
        last = pd.Timestamp(self.version.get()[0]) if self.version.exists() else None
        had = set(zip(*(x or [] for x in self.names.get()))) if self.names.exists() else set()
        out = []
        for version, kinds, names in zip(new["version"], new["kinds"], new["names"]):
            if last is not None and version < last:
                continue  # late: a newer version is known already
            has = set(zip(kinds, names))
            out += [(key[0], version, k, n, True) for k, n in sorted(has - had)] + [(key[0], version, k, n, False) for k, n in sorted(had - has)]
            last, had = version, has
        if last is not None:
            self.version.update((last.to_pydatetime(),))
            kept = sorted(had)
            self.names.update(([k for k, _ in kept], [n for _, n in kept]))
        yield pd.DataFrame(out, columns=["source_id", "version", "kind", "name", "added"])

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """States with a time to live need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def reference_changes(stream: DataFrame, text_col: str, id_col: str, version_col: str, keep_ms: int | None = None, **options) -> DataFrame:
    """CHANGES: for each version of a source the references that the version before didn't have, and those it had and this one doesn't.

    A first version adds all. Versions that come after a newer one was seen are passed over; of two with one time both count, in the order of their texts' hashes. keep_ms: a source without a
    new version for so long (of processing time) is forgotten, and then starts anew, and the query runs until it is stopped; None keeps it. References are found before the shuffle, which carries names, not texts.
    Null ids are one source. Works on streams only (output mode append or update); sums over the changes give what the last versions hold.
    """
    o = blocks.Options(**options)

    def names(t: str | None):
        found = sorted({(k, n) for _, k, n in blocks.parse(t, o).references})
        return [([k for k, _ in found], [n for _, n in found])]

    keyed = stream.select(F.struct(F.col(id_col).cast("string").alias("id"), F.col(version_col).cast("timestamp").alias("version"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("text_hash")).alias("source_id"), F.col(text_col).alias("text"))
    found = DocFrame(keyed)._rows("kinds array<string>, names array<string>", names)
    flat = found.select(F.col("source_id.id").alias("id"), F.col("source_id.version").alias("version"), F.col("source_id.text_hash").alias("text_hash"), "kinds", "names")
    return flat.groupBy("id").transformWithStateInPandas(_Changes(keep_ms), outputStructType=CHANGES, outputMode="Append", timeMode="ProcessingTime" if keep_ms else "None")


def edit_sessions(versions: DataFrame, id_col: str, version_col: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(source_id, start, end, versions): versions of a source with no longer pause than ``gap`` between them; on streams rows beyond the watermark are left out."""
    x = versions.select(F.col(id_col).alias("source_id"), F.col(version_col).alias("at"))
    got = x.withWatermark("at", late).groupBy("source_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("versions"))
    return got.select("source_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "versions")
