"""A resumable index build: new files are read as a stream, passages embedded and stored in shards.

The checkpoint is the cursor: it moves on only when a batch is stored, and a batch that runs again
overwrites its own folder, so every passage is stored once. ``availableNow`` takes what is there
and ends; ``max_files`` bounds a batch. Progress comes from the query's own metrics.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.chunks import first_passage
from palimpsest.operators.vectors import HashEmbedder, embed, shard_name

LINE = "text string, source string"


def passages(lines: DataFrame, min_words: int = 80, max_words: int = 160) -> DataFrame:
    """(id, text, source): the first passage of each line that has one; ids are digests of the line, so a repeated line is one id."""
    found = lines.withColumn("passage", first_passage(F.col("text"), min_words, max_words)).where("passage is not null")
    return found.select(F.concat(F.lit("passage:"), F.substring(F.sha2("text", 256), 1, 32)).alias("id"), F.col("passage").alias("text"), "source")


def build_index(spark: SparkSession, source: str, target: str, checkpoint: str, make: Callable = HashEmbedder, max_files: int = 16, shards: int = 64, base: str = "passages", file_format: str = "json") -> dict:
    """Read all new files of ``source``, store vectors below ``target`` by shard, and return the run's counts.

    Rows: id, text, source, vector, shard. A passage's shard is a hash of its id, so a later
    delivery lands beside the earlier one; ``latest`` keeps one.
    """
    lines = spark.readStream.schema(LINE).option("maxFilesPerTrigger", max_files).format(file_format).load(source)

    def store(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(["id"]).withColumn("vector", embed(make, F.col("text"))).withColumn("batch", F.lit(number))
        named = rows.withColumn("shard", shard_name(base, F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")))
        named.write.mode("overwrite").partitionBy("shard").parquet(f"{target}/batch={number}")

    query = passages(lines).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    progress = query.recentProgress
    seen = sum(p["numInputRows"] for p in progress)
    seconds = sum(p["durationMs"].get("triggerExecution", 0) for p in progress) / 1000
    return {"status": "complete" if seen else "no_new_input", "batches": len([p for p in progress if p["numInputRows"]]), "lines": seen, "lines_per_second": round(seen / seconds, 2) if seconds else 0.0}


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The stored passages, one row for each id."""
    rows = spark.read.option("basePath", target).parquet(f"{target}/batch=*")
    return rows.groupBy("id").agg(F.max_by(F.struct("text", "source", "vector", "shard"), "batch").alias("r")).select("id", "r.*")


def write_state(state: dict, folder: str) -> None:
    """``latest.json`` and a numbered report, each written beside and then renamed."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    for name in ("latest.json", f"batch-{state.get('batches', 0):04d}.json"):
        temporary = out / f"{name}.tmp"
        temporary.write_text(json.dumps(state, indent=2, sort_keys=True) + "\n", encoding="utf-8")
        temporary.replace(out / name)
