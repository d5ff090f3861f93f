"""Tables of documents, chunks and scans: Parquet folders with upserts and the reads the service needs.

An upsert writes a new version of the table beside the old one and switches a pointer file, so a
reader sees the old or the new rows, never a mixture, and a failed write leaves the old version.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.reports import validate
from palimpsest.operators.vectors import upsert

SCHEMAS = {
    "documents": "id string, text string, sha256 string, metadata map<string,string>, created_at timestamp, updated_at timestamp",
    "chunks": "document_id string, chunk_index int, id string, text string, start int, end int",
    "scans": "id string, status string, report string, created_at timestamp, updated_at timestamp",
}


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        os.makedirs(self.folder, exist_ok=True)

    def _pointer(self, name: str) -> str:
        return f"{self.folder}/{name}.current"

    def read(self, name: str) -> DataFrame:
        if os.path.exists(self._pointer(name)):
            with open(self._pointer(name), encoding="utf-8") as f:
                return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{json.load(f)['path']}")
        return self.spark.createDataFrame([], SCHEMAS[name])

    def _replace(self, name: str, rows: DataFrame) -> None:
        version = f"{name}-{uuid.uuid4().hex}"
        rows.select(*(c.split()[0] for c in SCHEMAS[name].split(", "))).write.option("compression", "zstd").parquet(f"{self.folder}/{version}")
        old = None
        if os.path.exists(self._pointer(name)):
            with open(self._pointer(name), encoding="utf-8") as f:
                old = json.load(f)["path"]
        with open(f"{self._pointer(name)}.tmp", "w", encoding="utf-8") as f:
            json.dump({"path": version}, f)
        os.replace(f"{self._pointer(name)}.tmp", self._pointer(name))
        if old:
            shutil.rmtree(f"{self.folder}/{old}", ignore_errors=True)

    def upsert_documents(self, documents: DataFrame, chunks: DataFrame) -> None:
        """Insert or replace documents by id, keep their first ``created_at``, and replace all their chunks."""
        now = F.current_timestamp()
        new = documents.select("id", "text", "sha256", "metadata", now.alias("created_at"), now.alias("updated_at"))
        self._replace("documents", upsert(self.read("documents"), new, "id", "updated_at", keep=("created_at",)))
        left = self.read("chunks").join(documents.select(F.col("id").alias("document_id")).distinct(), "document_id", "left_anti")
        self._replace("chunks", left.unionByName(chunks.select("document_id", "chunk_index", "id", "text", "start", "end")))

    def upsert_scans(self, scans: DataFrame) -> None:
        """Insert or replace scans (id, report JSON); invalid reports are refused with their first message."""
        bad = validate(scans).where(F.size("errors") > 0).limit(1).collect()
        if bad:
            raise ValueError(f"Invalid scan report {bad[0][0]}: {bad[0].errors[0]}")
        now = F.current_timestamp()
        new = scans.select("id", F.lit("complete").alias("status"), "report", now.alias("created_at"), now.alias("updated_at"))
        self._replace("scans", upsert(self.read("scans"), new, "id", "updated_at", keep=("created_at",)))

    def document(self, key: str) -> DataFrame:
        return self.read("documents").where(F.col("id") == key)

    def documents(self) -> DataFrame:
        """Summaries, the newest first; never the text."""
        return self.read("documents").select("id", "sha256", F.length("text").alias("characters"), "metadata", "created_at").orderBy(F.desc("created_at"), "id")

    def chunks(self, document: str) -> DataFrame:
        return self.read("chunks").where(F.col("document_id") == document).select("id", "document_id", "start", "end", F.length("text").alias("characters")).orderBy("start", "id")

    def scan(self, key: str) -> DataFrame:
        return self.read("scans").where(F.col("id") == key)

    def scans(self) -> DataFrame:
        r = F.try_parse_json("report")
        scores = F.transform(F.try_variant_get(r, "$.matches", "array<variant>"), lambda m: F.try_variant_get(m, "$.score", "double"))
        return self.read("scans").select("id", "status", "created_at", F.coalesce(F.size(scores), F.lit(0)).alias("match_count"), F.coalesce(F.array_max(scores), F.lit(0.0)).alias("top_score")).orderBy(F.desc("created_at"), "id")
