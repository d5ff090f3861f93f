"""Scans of files as the command line and a host application run them: load, match, report."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.ids import public_id_of
from palimpsest.operators import lexical, reports, vectors
from palimpsest.operators.chunks import chunk
from palimpsest.sources.files import load


def session(name: str = "palimpsest") -> SparkSession:
    """The active session, or a new one whose settings suit one machine; a cluster's own settings are kept."""
    active = SparkSession.getActiveSession()
    if active:
        return active
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def documents(spark: SparkSession, root: str, key: str) -> DataFrame:
    """(key, sha256, text) of the files below ``root``, or of one file; the id is the file's stem if it may be shown."""
    files = load(spark, root)
    digest = F.sha2("text", 256)
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    from palimpsest.functions.ids import public_id

    return files.select(public_id(stem, digest).alias(key), digest.alias("sha256"), "text")


def scan_files(spark: SparkSession, suspicious: str, sources: str, min_score: float = 0.5, semantic: bool = False, min_cosine: float = vectors.MIN_COSINE, top_k: int = vectors.TOP_K, config: dict | None = None) -> dict:
    """The report of one suspicious file against the files below ``sources``."""
    left, right = documents(spark, suspicious, "suspicious_id").cache(), documents(spark, sources, "source_id").cache()
    found = lexical.scan_corpus(left, right, "suspicious_id", "source_id", min_score=min_score)
    if semantic:
        a = chunk(left, "suspicious_id", "text").withColumn("vector", vectors.embed(vectors.HashEmbedder, F.col("text")))
        b = chunk(right, "source_id", "text").withColumn("vector", vectors.embed(vectors.HashEmbedder, F.col("text")))
        found = found.unionByName(vectors.semantic_matches(a, b, "suspicious_id", "source_id", min_cosine, top_k))
    own = left.select("suspicious_id", "sha256").first()
    listed = [r.asDict() for r in right.select(F.col("source_id").alias("id"), "sha256").orderBy("id").collect()]
    scan = str(uuid.uuid4())
    one = len(listed) == 1
    built = reports.build(
        found.withColumn("scan", F.lit(scan)),
        "scan",
        suspicious_document_id=F.lit(own.suspicious_id),
        suspicious_document_sha256=F.lit(own.sha256),
        source_document_id=F.lit(listed[0]["id"] if one else f"corpus:{len(listed)}"),
        source_document_sha256=F.lit(listed[0]["sha256"] if one else None),
    )
    row = reports.to_json(built).first()
    report = json.loads(row.report) if row else {"schema_version": reports.SCHEMA_VERSION, "scan_id": scan, "suspicious_document_id": own.suspicious_id, "suspicious_document_sha256": own.sha256, "source_document_id": listed[0]["id"] if one else f"corpus:{len(listed)}", "generated_at": str(spark.sql("select current_timestamp()").first()[0]), "matches": []}
    return report | {"source_documents": listed, "runtime_config": config or {"baseline_lexical_threshold": min_score}}


def extractor(path: str) -> str:
    """For a host application: a saved report as searchable text, refused if it breaks a rule; never raw text."""
    report = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(report, dict) or not isinstance(report.get("matches"), list):
        raise ValueError("report must be a JSON object with matches")
    for key in ("suspicious_document_id", "source_document_id"):
        if public_id_of(report.get(key)) != report.get(key):
            raise ValueError(f"{key} must be a public-safe document ID")
    lines = [f"- {m['kind']} score={m['score']:.4f}: {m['explanation']}" for m in report["matches"]]
    return "\n".join([f"Scan {report['scan_id']}", f"Matches: {len(lines)}", *lines])
