"""Spans: merging, coverage and overlap, per record or pooled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end): overlapping and touching spans of a key as one (gaps and islands)."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("_opens", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    numbered = opened.withColumn("_run", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def covered(spans: DataFrame, keys: list[str], name: str = "chars") -> DataFrame:
    return merge(spans, keys).groupBy(*keys).agg(F.sum(F.greatest(F.col("end") - F.col("start"), F.lit(0))).cast("bigint").alias(name))


def overlap_metrics(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, predicted_chars, truth_chars, overlap_chars, precision, recall, f1); an empty side has 0."""
    a, b = merge(truth, keys), merge(predicted, keys)
    other = b.select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"))
    shared = a.join(other, keys).where((F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end"))).groupBy(*keys).agg(F.sum(F.least("end", "_e") - F.greatest("start", "_s")).cast("bigint").alias("overlap_chars"))
    sizes = covered(truth, keys, "truth_chars").join(covered(predicted, keys, "predicted_chars"), keys, "full").join(shared, keys, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return with_ratios(sizes.select(*keys, zero("predicted_chars"), zero("truth_chars"), zero("overlap_chars")))


def with_ratios(df: DataFrame) -> DataFrame:
    p = F.when(F.col("predicted_chars") > 0, F.col("overlap_chars") / F.col("predicted_chars")).otherwise(0.0)
    r = F.when(F.col("truth_chars") > 0, F.col("overlap_chars") / F.col("truth_chars")).otherwise(0.0)
    both = df.withColumn("precision", p).withColumn("recall", r)
    return both.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def pooled_overlap_metrics(truth: DataFrame, predicted: DataFrame, keys: list[str], one_space: bool = False) -> DataFrame:
    """One row over all keys: sums of the keys' characters, or (``one_space``) all offsets merged as if of one record."""
    if one_space:
        truth, predicted = (x.withColumn("_all", F.lit(1)) for x in (truth, predicted))
        return overlap_metrics(truth, predicted, ["_all"]).drop("_all")
    each = overlap_metrics(truth, predicted, keys)
    return with_ratios(each.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("predicted_chars", "truth_chars", "overlap_chars"))))
