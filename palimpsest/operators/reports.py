"""Scan reports: building, validating, summarising, and rendering without raw text."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.ids import is_public_id, is_sha256

SCHEMA_VERSION = 1
REQUIRED = ("generated_at", "matches", "scan_id", "schema_version", "source_document_id", "suspicious_document_id")
MATCH_FIELDS = ("explanation", "kind", "score", "source_chunk_id", "source_end", "source_start", "suspicious_chunk_id", "suspicious_end", "suspicious_start")


def build(evidence: DataFrame, scan: str, **columns: Column) -> DataFrame:
    """One report for each scan: matches by score (descending), then ``ord`` if there is one; further fields as columns over the scan."""
    rank = F.struct((-F.col("score")).alias("s"), *([F.col("ord")] if "ord" in evidence.columns else []), *MATCH_FIELDS)
    item = F.struct(rank.alias("r"), F.struct(*MATCH_FIELDS).alias("m"))
    rows = evidence.groupBy(scan).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["m"]).alias("matches"))
    fixed = {"schema_version": F.lit(SCHEMA_VERSION), "generated_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")}
    return rows.select(F.col(scan).alias("scan_id"), *((fixed | columns)[c].alias(c) for c in sorted(fixed | columns)), "matches")


def to_json(reports: DataFrame) -> DataFrame:
    """(scan_id, report) with the JSON of each report."""
    return reports.select("scan_id", F.to_json(F.struct(*sorted(reports.columns)), {"ignoreNullFields": "false"}).alias("report"))


def pretty(report: str) -> str:
    return json.dumps(json.loads(report), indent=2, sort_keys=True, ensure_ascii=True)


def summary(evidence: DataFrame, scan: str) -> DataFrame:
    """(scan, match_count, top_score, kinds): no text; top_score 0 without scores."""
    return evidence.groupBy(scan).agg(F.count("*").alias("match_count"), F.coalesce(F.max("score"), F.lit(0.0)).alias("top_score"), F.count_distinct("kind").alias("kinds"))


def searchable_text(evidence: DataFrame, scan: str) -> DataFrame:
    """(scan, text): a header and a line for each match, for a host application's index."""
    line = F.concat(F.lit("- "), F.col("kind"), F.lit(" score="), F.format_string("%.4f", F.col("score")), F.lit(": "), F.col("explanation"))
    rows = evidence.groupBy(scan).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), line.alias("l")))).alias("lines"))
    return rows.select(scan, F.concat(F.lit("Scan "), F.col(scan), F.lit("\nMatches: "), F.col("n").cast("string"), F.lit("\n"), F.array_join(F.transform("lines", lambda x: x["l"]), "\n")).alias("text"))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _is_number(kind: Column) -> Column:
    return kind.rlike("^(BIGINT|DOUBLE|DECIMAL.*|BOOLEAN)$")


def validate(reports: DataFrame, json_column: str = "report", key: str = "id") -> DataFrame:
    """(key, errors): the messages of every rule a JSON report breaks, in order; unknown fields are tolerated, null or broken JSON is one error."""
    v = F.try_parse_json(json_column)
    base = reports.select(key, F.col(json_column).alias("_j"), v.alias("_v"))
    r = F.col("_v")
    keys = F.coalesce(F.json_object_keys("_j"), F.array().cast("array<string>"))
    missing = F.transform(F.array_except(F.array(*map(F.lit, REQUIRED)), keys), lambda k: F.concat(F.lit("Missing required field: "), k))

    def when(condition: Column, message: Column | str) -> Column:
        text = F.lit(message) if isinstance(message, str) else message
        return F.when(F.coalesce(condition, F.lit(False)), F.array(text)).otherwise(F.array().cast("array<string>"))

    version = _get(r, "$.schema_version", "double")
    shown = F.coalesce(F.get_json_object("_j", "$.schema_version"), F.lit("None"))
    parts = [missing, when(F.coalesce(version != SCHEMA_VERSION, F.lit(True)), F.concat(F.lit("Unsupported schema_version: "), shown))]
    present = lambda path: ~F.coalesce(_kind(r, path), F.lit("VOID")).isin("VOID")
    for name in ("suspicious_document_sha256", "source_document_sha256"):
        parts.append(when(present(f"$.{name}") & ~F.coalesce((_kind(r, f"$.{name}") == "STRING") & is_sha256(_get(r, f"$.{name}", "string")), F.lit(False)), f"Invalid SHA-256 field: {name}"))
    for name in ("suspicious_document_id", "source_document_id"):
        parts.append(when(present(f"$.{name}") & ~((_kind(r, f"$.{name}") == "STRING") & is_public_id(_get(r, f"$.{name}", "string"))), f"{name} must be a public-safe document ID"))
    parts.append(when(present("$.runtime_config") & ~_kind(r, "$.runtime_config").startswith("OBJECT"), "runtime_config must be an object"))
    sources = _get(r, "$.source_documents", "array<variant>")
    listed = present("$.source_documents") & _kind(r, "$.source_documents").startswith("ARRAY")
    parts.append(when(F.array_contains(keys, "source_documents") & ~F.coalesce(listed, F.lit(False)), "source_documents must be a list"))

    def document_errors(d: Column, i: Column) -> Column:
        at = F.concat(F.lit("source_documents["), i.cast("string"), F.lit("]"))
        name, text = F.schema_of_variant(d), _get(d, "$.id", "string")
        named = (_kind(d, "$.id") == "STRING") & (text != "")
        sha = F.coalesce(_kind(d, "$.sha256"), F.lit("VOID"))
        inner = F.concat(
            F.when(F.coalesce(named, F.lit(False)), when(~is_public_id(text), F.concat(at, F.lit(".id must be a public-safe document ID")))).otherwise(F.array(F.concat(at, F.lit(".id must be a non-empty string")))),
            when((sha != "VOID") & ~F.coalesce((sha == "STRING") & is_sha256(_get(d, "$.sha256", "string")), F.lit(False)), F.concat(at, F.lit(".sha256 must be a valid SHA-256 hash"))),
        )
        return F.when(name.startswith("OBJECT"), inner).otherwise(F.array(F.concat(at, F.lit(" must be an object"))))

    empty = F.array().cast("array<string>")
    parts.append(F.coalesce(F.flatten(F.transform(sources, document_errors)), empty))
    is_list = F.coalesce(present("$.matches") & _kind(r, "$.matches").startswith("ARRAY"), F.lit(False))
    parts.append(when(F.array_contains(keys, "matches") & ~is_list, "matches must be a list"))

    def match_errors(m: Column, i: Column) -> Column:
        at = F.concat(F.lit("matches["), i.cast("string"), F.lit("]"))
        have = lambda n: F.coalesce(_kind(m, f"$.{n}"), F.lit("absent"))
        own = F.json_object_keys(m.cast("string"))
        lost = F.transform(F.array_except(F.array(*map(F.lit, MATCH_FIELDS)), F.coalesce(own, empty)), lambda k: F.concat(at, F.lit(" missing required field: "), k))
        score = _get(m, "$.score", "double")
        rules = [lost, when(~F.coalesce(_is_number(have("score")) & score.between(0, 1), F.lit(False)), F.concat(at, F.lit(".score must be between 0 and 1")))]
        for side in ("suspicious", "source"):
            chunk = _get(m, f"$.{side}_chunk_id", "string")
            rules.append(when(~have(f"{side}_chunk_id").isin("VOID", "absent") & ~((have(f"{side}_chunk_id") == "STRING") & is_public_id(chunk)), F.concat(at, F.lit(f".{side}_chunk_id must be a public-safe ID"))))
            whole = have(f"{side}_start").isin("BIGINT", "BOOLEAN") & have(f"{side}_end").isin("BIGINT", "BOOLEAN")
            start, end = _get(m, f"$.{side}_start", "bigint"), _get(m, f"$.{side}_end", "bigint")
            rules.append(F.when(~whole, F.array(F.concat(at, F.lit(f".{side} offsets must be integers")))).otherwise(when((start < 0) | (end < start), F.concat(at, F.lit(f".{side} offsets are invalid")))))
        return F.when(F.schema_of_variant(m).startswith("OBJECT"), F.concat(*rules)).otherwise(F.array(F.concat(at, F.lit(" must be an object"))))

    parts.append(F.coalesce(F.flatten(F.transform(_get(r, "$.matches", "array<variant>"), match_errors)), empty))
    good = r.isNotNull() & F.schema_of_variant(r).startswith("OBJECT")
    return base.select(key, F.when(F.coalesce(good, F.lit(False)), F.concat(*parts)).otherwise(F.array(F.lit("report must be a JSON object"))).alias("errors"))


def snippet(text: Column, start: Column, end: Column, context: int = 160) -> Column:
    """The span in its context, HTML-escaped and marked, with dots where text is left out; for local review only."""
    size = F.length(text)
    lo = F.greatest(F.least(start, size), F.lit(0))
    hi = F.greatest(F.least(end, size), lo)
    a, b = F.greatest(lo - context, F.lit(0)), F.least(hi + context, size)
    part = lambda x, y: escape(F.substring(text, x + 1, y - x))
    return F.concat(F.when(a > 0, "...").otherwise(""), part(a, lo), F.lit("<mark>"), part(lo, hi), F.lit("</mark>"), part(hi, b), F.when(b < size, "...").otherwise(""))


def escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def score_text(value: Column) -> Column:
    return F.coalesce(F.format_string("%.4f", value.try_cast("double")), F.lit(""))


def html_report(report: dict) -> str:
    """A page of one report: identities, numbers and the evidence table, never raw text; malformed rows are named as such."""
    e = lambda x: html.escape(str(x if x is not None else ""), quote=True)
    matches = report.get("matches") if isinstance(report.get("matches"), list) else []
    scores = [m["score"] for m in matches if isinstance(m, dict) and isinstance(m.get("score"), int | float)]
    rows = []
    for m in matches:
        if not isinstance(m, dict):
            rows.append("<tr><td colspan='6'>Invalid match entry</td></tr>")
            continue
        score = f"{m['score']:.4f}" if isinstance(m.get("score"), int | float) else ""
        spans = [f"{m[f'{s}_start']}-{m[f'{s}_end']}" if isinstance(m.get(f"{s}_start"), int) and isinstance(m.get(f"{s}_end"), int) else "" for s in ("suspicious", "source")]
        rows.append(f"<tr><td>{e(m.get('kind'))}</td><td>{score}</td><td>{e(m.get('suspicious_chunk_id'))} {spans[0]}</td><td>{e(m.get('source_chunk_id'))} {spans[1]}</td><td>{e(m.get('explanation'))}</td></tr>")
    facts = "".join(f"<li>{e(k)}: <code>{e(report.get(k))}</code></li>" for k in ("scan_id", "generated_at", "suspicious_document_id", "source_document_id", "suspicious_document_sha256", "source_document_sha256"))
    sources = "".join(f"<li><code>{e(d.get('id'))}</code> {e(d.get('sha256'))}</li>" for d in report.get("source_documents") or [] if isinstance(d, dict))
    return f"<!doctype html><html lang='en'><head><meta charset='utf-8'><title>Scan {e(report.get('scan_id'))}</title></head><body><main><h1>Text reuse evidence</h1><p>{len(matches)} matches, top score {max(scores, default=0):.4f}. Evidence for review, not a verdict.</p><ul>{facts}</ul><h2>Sources</h2><ul>{sources}</ul><h2>Evidence</h2><table><thead><tr><th scope='col'>Kind</th><th scope='col'>Score</th><th scope='col'>Suspicious</th><th scope='col'>Source</th><th scope='col'>Why</th></tr></thead><tbody>{''.join(rows)}</tbody></table></main></body></html>"
