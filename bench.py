"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Each query is run once to warm up at the smallest scale, then timed writing its whole result to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["refs_by_tag", "documents_html", "documents_nodes", "pages_messages", "emails", "task_progress", "urls", "split_documents", "yaml_scalars", "front_matter_by_columns", "markdown_html", "heading_ids", "tables_cells", "script_compile", "document_tags_by_columns"]


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from folio.operators.documents import DocFrame
    from folio.plans.catalog import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "8g", "spark.sql.files.maxPartitionBytes": "2m", "spark.sql.files.openCostInBytes": "64k"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    docs = lambda s, d: DocFrame(s.read.parquet(f"{d}/documents.parquet"), "text", "doc_id")
    queries = QUERIES | {"documents_html": lambda s, d: docs(s, d).html(), "documents_nodes": lambda s, d: docs(s, d).nodes()}
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    times = {}
    for name in HEADLINE:
        if os.path.isdir(small):
            queries[name](spark, small).write.format("noop").mode("overwrite").save()
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    size, nodes = docs(spark, sf_dir).stats().agg(F.sum("bytes"), F.sum("nodes")).first()
    print(json.dumps({"metric": "headline queries, total time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rpartition("sf")[2], "cpus": int(cpus), "parse_mb_per_sec": round(size / 1e6 / times["documents_html"], 2), "nodes_per_sec": round(nodes / times["documents_nodes"])}))
    spark.stop()


if __name__ == "__main__":
    main()
