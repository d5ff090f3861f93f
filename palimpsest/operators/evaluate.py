"""Classification metrics, threshold sweeps, calibration and score scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLDS = (0.40, 0.50, 0.55, 0.60, 0.70, 0.80, 0.90)
SWEEP = (0.40, 0.50, 0.55, 0.60, 0.70, 0.72, 0.75, 0.80, 0.85, 0.90)


def confusion(expected: Column, predicted: Column) -> list[Column]:
    """Aggregates tp, fp, tn, fn; rows with a null on either side count as false there."""
    e, p = F.coalesce(expected, F.lit(False)), F.coalesce(predicted, F.lit(False))
    return [F.count_if(p & e).alias("tp"), F.count_if(p & ~e).alias("fp"), F.count_if(~p & ~e).alias("tn"), F.count_if(~p & e).alias("fn")]


def ratios(df: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1 and false positive rate from the counts; 0 where nothing is counted."""
    c = F.col
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = df.withColumn("precision", safe(c("tp"), c("tp") + c("fp"))).withColumn("recall", safe(c("tp"), c("tp") + c("fn")))
    out = out.withColumn("f1", safe(2 * c("precision") * c("recall"), c("precision") + c("recall")))
    out = out.withColumn("accuracy", (c("tp") + c("tn")) / F.greatest(c("tp") + c("tn") + c("fp") + c("fn"), F.lit(1)))
    return out.withColumn("fpr", safe(c("fp"), c("fp") + c("tn")))


def metrics(df: DataFrame, expected: Column, predicted: Column, by: list[str] | None = None) -> DataFrame:
    return ratios(df.groupBy(*(by or [])).agg(*confusion(expected, predicted)))


def metrics_by_each(df: DataFrame, expected: Column, predicted: Column, columns: list[str]) -> DataFrame:
    """(dimension, value, counts, ratios) for each column on its own; blank and null values are ``none``. One pass, rows are not repeated before the partial sums."""
    parts = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("none")).alias("value")) for c in columns)))
    return metrics(df.select(expected.alias("_e"), predicted.alias("_p"), parts.alias("d")).select("_e", "_p", "d.*"), F.col("_e"), F.col("_p"), ["dimension", "value"])


def sweep(df: DataFrame, expected: Column, score: Column, thresholds: tuple[float, ...] = THRESHOLDS, by: list[str] | None = None, always: Column | None = None) -> DataFrame:
    """(by, ordinal, threshold, counts, ratios): predicted means score >= threshold, or ``always`` (an exact match).

    Pairs are scored once; each threshold is a set of conditional counts in the same pass.
    """
    if not thresholds:
        raise ValueError("thresholds must not be empty")
    values = F.posexplode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("ordinal", "threshold")
    rows = df.select(*(by or []), expected.alias("_e"), score.alias("_s"), (always if always is not None else F.lit(False)).alias("_x")).select("*", values)
    predicted = F.col("_x") | (F.coalesce("_s", F.lit(-1.0)) >= F.col("threshold"))
    return ratios(rows.groupBy(*(by or []), "ordinal", "threshold").agg(*confusion(F.col("_e"), predicted)))


def best(swept: DataFrame, metric: str = "f1", by: list[str] | None = None, rule: str = "calibrate") -> DataFrame:
    """The row of the best threshold: by rounded metric, precision, recall (``calibrate``) or f1, recall, -fpr (``sweep``); the first on ties."""
    r = lambda c: F.round(c, 4)
    order = [r(metric), r("precision"), r("recall"), -F.col("ordinal")] if rule == "calibrate" else [r("f1"), r("recall"), -r("fpr"), -F.col("ordinal")]
    columns = [c for c in swept.columns if c not in (by or [])]
    top = swept.groupBy(*(by or [])).agg(F.max_by(F.struct(*columns), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))).alias("b"))
    return top.select(*(by or []), "b.*")


def calibrate(evidence: DataFrame, examples: DataFrame, key: str, label: str, by: list[str] | None = None, thresholds: tuple[float, ...] = THRESHOLDS, metric: str = "f1") -> DataFrame:
    """(by, selected_threshold, selection_metric, scores): one scoring pass over evidence made with the lowest threshold.

    An example is predicted positive at t if it has an exact sequence or evidence of raw score t.
    Without a group, or with a null label, the call fails.
    """
    if examples.isEmpty():
        raise ValueError("examples must not be empty")
    if not examples.where(F.col(label).isNull()).isEmpty():
        raise ValueError("lexical threshold calibration requires boolean labels")
    grouped = examples
    for c in by or []:
        grouped = grouped.where(F.col(c).isNotNull() & (F.col(c) != ""))
    if by and grouped.isEmpty():
        raise ValueError(f"No examples contained metadata key: {', '.join(by)}")
    tops = evidence.groupBy(key).agg(F.max(F.when(F.col("kind") != "exact_token_sequence", F.col("raw_score"))).alias("_top"), F.bool_or(F.col("kind") == "exact_token_sequence").alias("_exact"))
    joined = grouped.join(tops, key, "left")
    swept = sweep(joined, F.col(label), F.col("_top"), thresholds, by, F.coalesce("_exact", F.lit(False)))
    chosen = best(swept, metric, by).select(*(by or []), F.col("threshold").alias("selected_threshold"))
    listed = swept.groupBy(*(by or [])).agg(F.sort_array(F.collect_list(F.struct("threshold", "accuracy", "precision", "recall", "f1", "tp", "fp", "tn", "fn"))).alias("scores"))
    joined_rows = chosen.join(listed, by) if by else chosen.crossJoin(listed)  # one row each
    return joined_rows.withColumn("selection_metric", F.lit(metric)).withColumn("detector_id", F.lit("baseline_lexical"))


def quantiles(df: DataFrame, score: Column, parts: int = 10) -> Column:
    return F.percentile(score, F.array(*(F.lit(i / parts) for i in range(parts + 1))))


def mean_absolute_error(expected: Column, predicted: Column) -> Column:
    return F.coalesce(F.avg(F.abs(expected - predicted)), F.lit(0.0))


def min_max(df: DataFrame, score: str, by: list[str] | None = None) -> DataFrame:
    """The table with ``scaled``: (x - min) / (max - min), 0 if all scores are equal. Two numbers per group are joined back."""
    ends = df.groupBy(*(by or [])).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    joined = df.join(ends, by) if by else df.crossJoin(ends)  # one row
    return joined.withColumn("scaled", F.when(F.col("_hi") > F.col("_lo"), (F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)).drop("_lo", "_hi")


def sampled(df: DataFrame, key: str, n: int, seed: int = 20260428) -> DataFrame:
    """A sample of ``n`` rows, the same for the same rows and seed: those of smallest hash (partial top-k, no full sort)."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def controlled_reuse(passages: DataFrame, key: str, text: str, limit: int = 700, seed: int = 20260428) -> DataFrame:
    """(case, left_text, right_text, expected): each sampled passage against itself, against a mechanical obfuscation, and against another passage."""
    from palimpsest.operators.chunks import obfuscate, words

    rows = sampled(passages, key, limit, seed).select(F.col(key).alias("k"), F.col(text).alias("left_text"))
    order = Window.orderBy(F.xxhash64(F.lit(seed), F.col("k")), "k")  # at most ``limit`` rows
    ringed = rows.withColumn("other", F.coalesce(F.lead("left_text").over(order), F.first("left_text").over(order)))
    cases = F.explode(F.array(*(F.struct(F.lit(c).alias("case"), r.alias("right_text"), F.lit(e).alias("expected")) for c, r, e in (("exact", F.col("left_text"), True), ("obfuscated", obfuscate(words(F.col("left_text"))), True), ("unrelated", F.col("other"), False)))))
    return ringed.select("k", "left_text", cases.alias("c")).select(F.concat_ws(":", "c.case", F.col("k").cast("string")).alias("id"), "c.case", "left_text", "c.right_text", "c.expected")


def plagdet(spans: DataFrame, keys: list[str], granularity: Column) -> DataFrame:
    """F1 divided by log2(1 + granularity), the published detection score; ``spans`` as from ``overlap_metrics``."""
    return spans.withColumn("plagdet", F.col("f1") / F.log2(1 + granularity))
