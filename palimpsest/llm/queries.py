"""The queries of the training-data problems, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import components, language, leakage, nearcopies, neighbours, packing, residue, sharedspans, splitting, textform
from palimpsest.llm.oracles import ORACLES  # noqa: F401 - the entry module takes it from here
from palimpsest.plans.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _near_copies(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    both = nearcopies.texts_of(table(spark, folder, "documents"), "documents", "doc_id").unionByName(nearcopies.texts_of(table(spark, folder, "passages"), "passages", "passage_no"))
    return nearcopies.near_copies(both, threshold=0.6, least=40)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return nearcopies.record_pairs(*_near_copies(spark, folder))


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    return nearcopies.record_classes(*_near_copies(spark, folder))


def p2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.neighbour_pairs(table(spark, folder, "vector_records"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.linked(p2_neighbours(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.must_be_cut(table(spark, folder, "documents")).select(F.col("id").alias("doc_id"), "para_index")


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.oversized_pieces(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return sharedspans.shared_spans(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def p4_shared(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return sharedspans.shared_amounts(docs, sharedspans.shared_spans(docs)).withColumnRenamed("id", "doc_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return textform.look_alike_pairs(table(spark, folder, "documents")).select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p5_forms(spark: SparkSession, folder: str) -> DataFrame:
    return textform.consistent_documents(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def p6_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Every record's languages with their confidence; documents of problem 10 and texts without letters drop out."""
    docs, pairs = table(spark, folder, "documents"), table(spark, folder, "pair_examples")
    network = language.fit(docs)
    code = language.named(F.col("lang")).alias("code")
    one, copies = residue.one_of_each(docs, extra=(code,))
    # one pass cuts and labels every text, so the consistent forms are made once
    rows = residue.piece_rows(one, extra=(code if copies is None else F.lit(None).cast("string").alias("code"),), beside=language.form_labeller(network), schema=language.SCHEMA)
    labelled = rows.where("rec_id is not null").select("rec_id", "segment", "lang", "confidence", "mixed", "label")
    if copies is not None:
        labelled = language.label_copies(labelled, copies)
    found = residue.residue_of(rows, copies).withColumn("id", F.col("id").cast("string"))
    both = residue.without_residue(labelled, found, "rec_id").select(F.lit("documents").alias("tbl"), "*")
    return both.unionByName(language.label_pairs(pairs, network).select(F.lit("pair_examples").alias("tbl"), "*")).distinct()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.to_correct(p6_labels(spark, folder)).select("tbl", "rec_id", "segment", "lang").distinct()


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return components.groups(table(spark, folder, "match_evidence"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, folder, "documents"))).withColumnRenamed("id", "doc_id")


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.report(p8_containers(spark, folder))


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).withColumnRenamed("id", "doc_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_leaks(spark, folder).select("doc_id", "item_id")


def p9_kept(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return leakage.without_leaks(docs.select("doc_id", "source", "n_chars"), leakage.leaks(docs, table(spark, folder, "eval_items")))


def p10_residue(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_residue(spark, folder).select("doc_id")


def p10_kept(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return residue.without_residue(docs.select("doc_id", "source", "n_chars"), residue.residue(docs))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_classes, p2_found, p2_neighbours, p3_found, p3_pieces, p4_found, p4_shared, p5_found, p5_forms, p6_found, p6_labels, p7_found, p8_containers, p8_report, p9_found, p9_leaks, p9_kept, p10_found, p10_residue, p10_kept)}

