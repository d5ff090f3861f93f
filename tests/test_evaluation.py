"""Spans, metrics, calibration, reports, vectors, upserts, stores."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import evaluate, lexical, reports, spans, vectors
from palimpsest.plans import registry
from palimpsest.plans.report_store import Store


def test_span_overlap_golden(spark):
    truth = spark.createDataFrame([(1, 0, 10), (1, 8, 20)], "k int, start int, end int")
    found = spark.createDataFrame([(1, 5, 12), (1, 30, 40)], "k int, start int, end int")
    r = spans.overlap_metrics(truth, found, ["k"]).first()
    assert (r.truth_chars, r.predicted_chars, r.overlap_chars) == (20, 17, 7)
    assert r.precision == pytest.approx(7 / 17) and r.recall == pytest.approx(7 / 20)
    none = spark.createDataFrame([], "k int, start int, end int")
    assert spans.overlap_metrics(truth, none, ["k"]).first().recall == 0.0
    pooled = spans.pooled_overlap_metrics(truth, found, ["k"], one_space=True).first()
    assert pooled.overlap_chars == 7


def test_touching_spans_merge(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 9, 10), ("a", 1, 2), ("b", 3, 4)], "k string, start int, end int")
    assert {tuple(r) for r in spans.merge(df, ["k"]).collect()} == {("a", 0, 7), ("a", 9, 10), ("b", 3, 4)}


def test_confusion_golden(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "e boolean, p boolean")
    r = evaluate.metrics(df, F.col("e"), F.col("p")).first()
    assert (r.tp, r.fn, r.fp, r.tn) == (1, 1, 1, 1) and r.f1 == r.precision == r.recall == r.accuracy == 0.5
    empty = evaluate.metrics(df.where("false"), F.col("e"), F.col("p")).first()
    assert empty.tp == 0 and empty.f1 == 0.0


def test_mean_absolute_error(spark):
    df = spark.createDataFrame([(1.0, 0.8), (0.5, 0.2), (0.0, 0.1)], "e double, p double")
    assert df.agg(evaluate.mean_absolute_error(F.col("e"), F.col("p"))).first()[0] == pytest.approx(0.2)
    assert df.where("false").agg(evaluate.mean_absolute_error(F.col("e"), F.col("p"))).first()[0] == 0.0


def test_calibration(spark):
    rows = [("a", "one two three four five", "one two three four five", True, "en"), ("b", "one two three", "six seven eight", False, "en"), ("c", "uno dos tres cuatro", "uno dos tres cinco", True, "es")]
    df = spark.createDataFrame(rows, "id string, l string, r string, label boolean, language string")
    found = lexical.compare_pairs(df, "id", "l", "r", 0.4)
    one = evaluate.calibrate(found, df, "id", "label").first()
    assert one.selected_threshold == 0.4 and len(one.scores) == len(evaluate.THRESHOLDS)
    by = {r.language: r.selected_threshold for r in evaluate.calibrate(found, df, "id", "label", by=["language"]).collect()}
    assert set(by) == {"en", "es"}
    with pytest.raises(ValueError):
        evaluate.calibrate(found, df.where("false"), "id", "label")
    with pytest.raises(ValueError):
        evaluate.calibrate(found, df.withColumn("label", F.lit(None).cast("boolean")), "id", "label")


def good():
    match = {"kind": "exact_overlap", "suspicious_chunk_id": "s:0", "source_chunk_id": "t:0", "score": 1.0, "suspicious_start": 0, "suspicious_end": 5, "source_start": 0, "source_end": 5, "explanation": "x"}
    return {"schema_version": 1, "scan_id": "x", "suspicious_document_id": "submitted", "source_document_id": "source", "generated_at": "now", "matches": [match], "source_documents": [{"id": "source", "sha256": "a" * 64}], "extra": 1}


def errors(spark, report):
    text = report if isinstance(report, str) or report is None else json.dumps(report)
    return reports.validate(spark.createDataFrame([("k", text)], "id string, report string")).first().errors


def test_validation(spark):
    assert errors(spark, good()) == []
    bad = good() | {"suspicious_document_sha256": "zz"}
    bad["matches"][0] |= {"suspicious_start": 5, "suspicious_end": 1}
    assert errors(spark, bad) == ["Invalid SHA-256 field: suspicious_document_sha256", "matches[0].suspicious offsets are invalid"]
    bad = good() | {"suspicious_document_id": "Student-Jane-Doe", "source_documents": [{"id": "source.docx"}, 3]}
    bad["matches"][0] |= {"source_chunk_id": "source.docx:0", "score": 1.5, "source_end": 2.5}
    del bad["matches"][0]["kind"]
    assert errors(spark, bad) == [
        "suspicious_document_id must be a public-safe document ID",
        "source_documents[0].id must be a public-safe document ID",
        "source_documents[1] must be an object",
        "matches[0] missing required field: kind",
        "matches[0].score must be between 0 and 1",
        "matches[0].source_chunk_id must be a public-safe ID",
        "matches[0].source offsets must be integers",
    ]
    assert errors(spark, {"matches": 3, "runtime_config": []}) == [
        *(f"Missing required field: {k}" for k in ("generated_at", "scan_id", "schema_version", "source_document_id", "suspicious_document_id")),
        "Unsupported schema_version: None",
        "runtime_config must be an object",
        "matches must be a list",
    ]
    assert errors(spark, None) == errors(spark, "[1]") == errors(spark, "{broken") == ["report must be a JSON object"]


def test_report_round_trip_and_html(spark):
    rows = spark.createDataFrame([("x", "exact_overlap", "s:0", "t:0", 1.0, 0, 5, 0, 5, "<why>"), ("x", "needs_review", "s:1", "t:1", 0.6, 6, 9, 6, 9, "w")], "scan string, kind string, suspicious_chunk_id string, source_chunk_id string, score double, suspicious_start int, suspicious_end int, source_start int, source_end int, explanation string")
    built = reports.to_json(reports.build(rows, "scan", suspicious_document_id=F.lit("s"), source_document_id=F.lit("t")))
    report = json.loads(built.first().report)
    assert [m["score"] for m in report["matches"]] == [1.0, 0.6] and errors(spark, report) == []
    page = reports.html_report(report | {"matches": [*report["matches"], "oops"]})
    assert "&lt;why&gt;" in page and "<why>" not in page and "Invalid match entry" in page
    assert reports.summary(rows, "scan").first().top_score == 1.0
    assert reports.searchable_text(rows, "scan").first().text.splitlines()[2] == "- exact_overlap score=1.0000: <why>"


def test_snippet(spark):
    df = spark.createDataFrame([("a<b>" + "x" * 300, 4, 10)], "t string, s int, e int")
    shown = df.select(reports.snippet(F.col("t"), F.col("s"), F.col("e"), 4)).first()[0]
    assert shown == "a&lt;b&gt;<mark>xxxxxx</mark>xxxx..."


def test_top_k_upsert_and_sources(spark):
    index = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.0])], "id string, v array<double>")
    query = spark.createDataFrame([("q", [0.9, 0.1])], "q string, v array<double>")
    assert [r.id for r in vectors.top_k(query, index, "q", "id", "v", 2).orderBy("rank").collect()] == ["a", "c"]
    old = spark.createDataFrame([("a", 1, 10), ("b", 1, 10)], "id string, version int, born int")
    new = spark.createDataFrame([("a", 2, 20), ("c", 1, 30)], "id string, version int, born int")
    assert {tuple(r) for r in vectors.upsert(old, new, "id", "version", keep=("born",)).collect()} == {("a", 2, 10), ("b", 1, 10), ("c", 1, 30)}
    evidence = spark.createDataFrame([("x:1:2",), ("x:1",), ("y:0",), ("x",)], "chunk string")
    sources = spark.createDataFrame([("x",), ("x:1",)], "source string")
    assert {tuple(r) for r in vectors.resolve_sources(evidence, sources, "chunk", "source").collect()} == {("x:1:2", "x:1"), ("x:1", "x:1"), ("y:0", None), ("x", "x")}
    names = spark.createDataFrame([(0,), (2,)], "n int").select(vectors.shard_name("base", F.col("n")).alias("s")).select("s", vectors.shard_index("base", F.col("s")).alias("i")).collect()
    assert [tuple(r) for r in names] == [("base", 0), ("base_shard_0002", 2)]


def test_semantic_and_rerank(spark):
    schema = "k string, id string, start int, end int, chunk_index int, vector array<double>"
    left = spark.createDataFrame([("s", "s:0", 0, 5, 0, [1.0, 0.0])], schema)
    right = spark.createDataFrame([("source-a", "source-a:0", 0, 5, 0, [0.95, 0.05]), ("source-b", "source-b:0", 0, 5, 0, [0.0, 1.0])], schema).withColumnRenamed("k", "d")
    found = vectors.semantic_matches(left, right, "k", "d", 0.9, 1)
    assert [(r.kind, r.d) for r in found.collect()] == [("possible_paraphrase", "source-a")]
    row = vectors.rerank(found, F.lit(0.91)).first()
    assert row.score == 0.91 and row.explanation.endswith(" Reranker score applied.")
    texts = lambda k, v: spark.createDataFrame([(v, "hello world")], f"{k} string, text string")

    class Fixed:
        def score_pairs(self, pairs):
            assert pairs == [("hello", "hello")]
            return [1.7]

    assert vectors.rerank_spans(found, texts("k", "s"), texts("d", "source-a"), "k", "d", Fixed).first().score == 1.0
    df = spark.createDataFrame([("alpha beta",), (None,)], "t string").select(vectors.embed(vectors.HashEmbedder, F.col("t")).alias("v")).collect()
    assert len(df[0].v) == 64 and df[1].v is None


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    docs = spark.createDataFrame([("d1", "text", "a" * 64)], "id string, text string, sha256 string").withColumn("metadata", F.create_map().cast("map<string,string>"))
    chunk = spark.createDataFrame([("d1", 0, "d1:0", "text", 0, 4)], "document_id string, chunk_index int, id string, text string, start int, end int")
    store.upsert_documents(docs, chunk)
    first = store.document("d1").first()
    store.upsert_documents(docs.withColumn("text", F.lit("other")), chunk.withColumn("text", F.lit("other")))
    again = store.document("d1").first()
    assert again.text == "other" and again.created_at == first.created_at and store.chunks("d1").count() == 1
    assert "text" not in store.documents().columns and "text" not in store.chunks("d1").columns
    store.upsert_scans(spark.createDataFrame([("x", json.dumps(good()))], "id string, report string"))
    row = store.scans().first()
    assert (row.match_count, row.top_score, row.status) == (1, 1.0, "complete")
    with pytest.raises(ValueError):
        store.upsert_scans(spark.createDataFrame([("y", "{}")], "id string, report string"))


def test_registry(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"schema_version": 1, "models": [{"id": "m"}], "datasets": [{"id": "d", "enabled_by_default": True}]}))
    reg = registry.Registry.load(path)
    config = registry.RunConfig.resolve(reg, {"selected_threshold": 0.7}, 0.4, embedding_model_id="m")
    assert config.baseline_lexical_threshold == 0.7 and config.enabled_dataset_ids == ("d",)
    with pytest.raises(KeyError):
        registry.RunConfig.resolve(reg, reranker_model_id="nope")
    with pytest.raises(ValueError):
        registry.Registry.load(tmp_path / "c.yaml")
