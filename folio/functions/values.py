"""Accessors of YAML and JSON values, as columns over canonical JSON: number of members, members by place or key, keys, and flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count(json: Column) -> Column:
    """Members of a sequence or mapping; 0 for a scalar, null for null."""
    return F.when(json.isNotNull(), F.coalesce(F.json_array_length(json), F.size(F.json_object_keys(json)), F.lit(0))).cast("long")


def key(json: Column, i: int | Column) -> Column:
    """The i-th key of a mapping, in its order; null if there is none."""
    return F.get(F.json_object_keys(json), F.lit(i) if isinstance(i, int) else i)


def at(json: Column, i: int) -> Column:
    """The i-th member of a sequence as JSON (a string without its quotes); null if there is none."""
    return F.get_json_object(json, f"$[{i}]")


def get(json: Column, name: str) -> Column:
    """The member of a mapping of that key, likewise."""
    return F.get_json_object(json, f"$['{name}']")


def flatten(df: DataFrame, json_col: str, levels: int = 8) -> DataFrame:
    """(source_id, path, type, value) of every scalar inside the JSON values, by variants exploded level by level.

    Each level is a lateral explode in the JVM. Containers below ``levels`` levels come out as they are, with type OBJECT or ARRAY, and so do empty ones. type: as Spark names
    a variant's schema (BIGINT, STRING, BOOLEAN, DECIMAL, DOUBLE, VOID). Rows whose JSON is null or no JSON give none.
    """
    now = df.select("source_id", F.lit("$").alias("path"), F.try_parse_json(json_col).alias("v")).where("v IS NOT NULL")
    done = None
    kind = F.schema_of_variant("v")
    inner = kind.startswith("OBJECT<") | kind.startswith("ARRAY<")
    empty = (kind == "OBJECT<>") | (kind == "ARRAY<VOID>") & (F.to_json("v") == "[]")
    for level in range(levels + 1):
        ends = now.where(~inner | empty) if level < levels else now
        name = F.when(kind.startswith("OBJECT"), "OBJECT").when(kind.startswith("ARRAY"), "ARRAY").when(kind.startswith("DECIMAL"), "DECIMAL").otherwise(kind)
        ends = ends.select("source_id", "path", name.alias("type"), F.when(name.isin("OBJECT", "ARRAY"), F.to_json("v")).otherwise(F.try_variant_get("v", "$", "string")).alias("value"))
        done = ends if done is None else done.unionByName(ends)
        if level == levels:
            break
        tvf = df.sparkSession.tvf
        more = now.where(inner & ~empty).lateralJoin(tvf.variant_explode(F.col("v").outer()).toDF("pos", "key", "member"))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.col("key"))).otherwise(F.concat(F.lit("["), F.col("pos"), F.lit("]")))
        now = more.select("source_id", F.concat("path", step).alias("path"), F.col("member").alias("v"))
    return done
