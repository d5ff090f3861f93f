"""The engine's queries by name, each over its whole tables, with the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import fingerprints, ids, scores, tokens
from palimpsest.functions.textnorm import EDGE, normalize_col
from palimpsest.operators import chunks, evaluate, exact, lexical, reports, spans, vectors
from palimpsest.plans.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# ---------------------------------------------------------------- SQL parts shared by the oracles
_NL = "chr(10)"
_EDGE_SQL = "'" + EDGE + "'"


def _norm(x: str) -> str:
    lines = f"string_split(replace(replace({x}, chr(13) || {_NL}, {_NL}), chr(13), {_NL}), {_NL})"
    clean = rf"list_transform({lines}, lambda l: trim(regexp_replace(l, '[ \t\f\v]+', ' ', 'g'), {_EDGE_SQL}))"
    return rf"trim(regexp_replace(array_to_string({clean}, {_NL}), '\n{{3,}}', {_NL} || {_NL}, 'g'), {_EDGE_SQL} || {_NL})"


def _fold(x: str) -> str:
    out = f"lower({x})"
    for code, expanded in tokens.EXPANSIONS:
        out = f"replace({out}, chr({code}), '{expanded}')"
    return out


def _toks(x: str) -> str:
    return rf"list_transform(regexp_extract_all({x}, '[\p{{L}}\p{{N}}'']+'), lambda w: {_fold('w')})"


_DOCS = f"n AS (SELECT doc_id, lang, {_norm('text')} AS t FROM documents WHERE text IS NOT NULL)"
_PARAS = (
    f"q AS (SELECT doc_id, lang, string_split(t, {_NL} || {_NL}) AS ps FROM n), "
    "u AS (SELECT doc_id, lang, unnest(ps) AS part, generate_subscripts(ps, 1) AS k FROM q), "
    "p AS (SELECT doc_id, lang, k, part, sum(length(part) + 2) OVER (PARTITION BY doc_id ORDER BY k) - length(part) - 2 AS ofs FROM u)"
)


def _chunks(size: int, overlap: int) -> str:
    step = size - overlap
    wide = f"{_EDGE_SQL} || {_NL}"
    return (
        f"WITH {_DOCS}, {_PARAS}, w AS (SELECT doc_id, lang, k, ofs, part, unnest(range(0, CASE WHEN length(part) <= {size} THEN 1 ELSE 1 + CAST(ceil((length(part) - {size}) / {step}.0) AS BIGINT) END)) AS i FROM p WHERE part <> ''), "
        f"x AS (SELECT doc_id, lang, k, i, ofs, substring(part, CAST(i * {step} + 1 AS BIGINT), {size}) AS raw FROM w), "
        f"y AS (SELECT doc_id, lang, k, i, trim(raw, {wide}) AS body, ofs + i * {step} + length(raw) - length(ltrim(raw, {wide})) AS s FROM x), "
        "c AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY k, i) - 1 AS chunk_index, body, s FROM y WHERE body <> '') "
    )


def _tokens(name: str, source: str, key: str) -> str:
    """CTE of tokens with offsets of ``source`` (key, t)."""
    rx = r"([^\p{L}\p{N}'']*)([\p{L}\p{N}'']+)"
    return (
        f"{name}_x AS (SELECT {key}, regexp_extract_all(t, '{rx}', 1) AS g, regexp_extract_all(t, '{rx}', 2) AS v FROM {source}), "
        f"{name}_y AS (SELECT {key}, unnest(g) AS g, unnest(v) AS v, generate_subscripts(v, 1) - 1 AS pos FROM {name}_x), "
        f"{name} AS (SELECT {key}, pos, {_fold('v')} AS value, CAST(sum(length(g) + length(v)) OVER (PARTITION BY {key} ORDER BY pos) - length(v) AS BIGINT) AS s, CAST(sum(length(g) + length(v)) OVER (PARTITION BY {key} ORDER BY pos) AS BIGINT) AS e FROM {name}_y)"
    )


def _grams(name: str, source: str, key: str) -> str:
    return (
        f"{name}_t AS (SELECT {key}, {_toks('t')} AS v FROM {source}), "
        f"{name}_i AS (SELECT {key}, v, unnest(range(0, len(v) - 7)) AS pos FROM {name}_t WHERE len(v) >= 8), "
        f"{name} AS (SELECT {key}, pos, array_to_string(v[pos + 1 : pos + 8], ' ') AS g FROM {name}_i)"
    )


_ITEMS = f"m AS (SELECT item_id, {_norm('text')} AS t FROM eval_items WHERE text IS NOT NULL)"
_RUNS = (
    f"{_DOCS}, {_ITEMS}, {_grams('ga', 'm', 'item_id')}, {_grams('gb', 'n', 'doc_id')}, "
    "sd AS (SELECT item_id, doc_id, ga.pos AS a, gb.pos AS b FROM ga JOIN gb USING (g)), "
    "il AS (SELECT *, a - row_number() OVER (PARTITION BY item_id, doc_id, b - a ORDER BY a) AS i FROM sd), "
    "rn AS (SELECT item_id, doc_id, a, b, max(a) OVER z - a + 8 AS len, min(a) OVER z = a AS head FROM il WINDOW z AS (PARTITION BY item_id, doc_id, b - a, i))"
)
_OVER = "(x[1].a < y.a + y.len AND y.a < x[1].a + x[1].len) OR (x[1].b < y.b + y.len AND y.b < x[1].b + x[1].len)"
_SPANS = (
    f"{_RUNS}, cd AS (SELECT item_id, doc_id, list(struct_pack(len := len, a := a, b := b) ORDER BY len DESC, a DESC, b DESC) AS c FROM rn GROUP BY ALL), "
    f"gr AS (SELECT item_id, doc_id, list_reduce(list_transform(c, lambda x: [x]), lambda acc, x: CASE WHEN len(acc) >= 100 OR len(list_filter(acc, lambda y: {_OVER})) > 0 THEN acc ELSE list_concat(acc, x) END) AS c FROM cd), "
    "gu AS (SELECT item_id, doc_id, unnest(c) AS x, generate_subscripts(c, 1) - 1 AS match_index FROM gr), "
    f"{_tokens('ta', 'm', 'item_id')}, {_tokens('tb', 'n', 'doc_id')}, "
    "es AS (SELECT gu.item_id, gu.doc_id, match_index, x.len AS tokens, a1.s AS suspicious_start, a2.e AS suspicious_end, b1.s AS source_start, b2.e AS source_end FROM gu "
    "JOIN ta a1 ON a1.item_id = gu.item_id AND a1.pos = x.a JOIN ta a2 ON a2.item_id = gu.item_id AND a2.pos = x.a + x.len - 1 "
    "JOIN tb b1 ON b1.doc_id = gu.doc_id AND b1.pos = x.b JOIN tb b2 ON b2.doc_id = gu.doc_id AND b2.pos = x.b + x.len - 1)"
)
_PAIRS = f"pe AS (SELECT id, coalesce({_norm('min(left_text)')}, '') AS l, coalesce({_norm('min(right_text)')}, '') AS r, bool_or(label) AS label, max(label_value) AS label_value, max(metadata['language']) AS language, max(metadata['genre']) AS genre, max(metadata['generation']) AS generation, max(metadata['plagiarism_type']) AS plagiarism_type FROM pair_examples WHERE id IS NOT NULL GROUP BY id), pt AS (SELECT *, {_toks('l')} AS a, {_toks('r')} AS b FROM pe)"
_COUNT = lambda xs: f"len(list_filter({xs}, lambda y: y = w))"
_SIGNALS = (
    f"{_PAIRS}, ps AS (SELECT *, CASE WHEN l = '' OR r = '' THEN 0.0 WHEN {_fold('l')} = {_fold('r')} THEN 1.0 "
    f"WHEN least(length({_fold('l')}), length({_fold('r')})) >= 40 AND (CASE WHEN length({_fold('l')}) <= length({_fold('r')}) THEN contains({_fold('r')}, {_fold('l')}) ELSE contains({_fold('l')}, {_fold('r')}) END) THEN least(length({_fold('l')}), length({_fold('r')})) / CAST(greatest(length({_fold('l')}), length({_fold('r')})) AS DOUBLE) ELSE 0.0 END AS exact, "
    "CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / CAST(least(len(list_distinct(a)), len(list_distinct(b))) AS DOUBLE) END AS containment, "
    "CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) END AS jaccard, "
    f"CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 2.0 * coalesce(list_sum(list_transform(list_intersect(a, b), lambda w: least({_COUNT('a')}, {_COUNT('b')}))), 0) / (len(a) + len(b)) END AS bound FROM pt)"
)
_VALID = "ev AS (SELECT * FROM match_evidence WHERE score BETWEEN 0 AND 1 AND suspicious_start >= 0 AND suspicious_end > suspicious_start AND source_start >= 0 AND source_end > source_start)"


def _merged(name: str, source: str, key: str) -> str:
    """CTE of the merged spans (key, s, e) of ``source``."""
    return (
        f"{name}_o AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY {key} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS o FROM {source}), "
        f"{name}_r AS (SELECT *, sum(o) OVER (PARTITION BY {key} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS r FROM {name}_o), "
        f"{name} AS (SELECT {key}, min(s) AS s, max(e) AS e FROM {name}_r GROUP BY {key}, r)"
    )


_RATIOS = (
    "CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0.0 END AS recall, "
    "CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1, (tp + tn) / CAST(greatest(tp + tn + fp + fn, 1) AS DOUBLE) AS accuracy, CASE WHEN fp + tn > 0 THEN fp / CAST(fp + tn AS DOUBLE) ELSE 0.0 END AS fpr"
)
_CONFUSION = "CAST(count(*) FILTER (p AND x) AS BIGINT) AS tp, CAST(count(*) FILTER (p AND NOT x) AS BIGINT) AS fp, CAST(count(*) FILTER (NOT p AND NOT x) AS BIGINT) AS tn, CAST(count(*) FILTER (NOT p AND x) AS BIGINT) AS fn"
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("precision", "recall", "f1", "accuracy", "fpr"))
_METRICS = ("precision", "recall", "f1", "accuracy", "fpr")


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; integers leave it as bigint so that both engines agree on types."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = f(spark, folder)
            return df.select(*(F.col(f"`{c}`").cast("bigint").alias(c) if t in ("int", "smallint") else F.col(f"`{c}`") for c, t in df.dtypes))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return run

    return add


# ---------------------------------------------------------------- tables as the queries use them
def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", "id", "lang", normalize_col(F.col("text")).alias("text"))


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_items").where("text is not null").select("item_id", normalize_col(F.col("text")).alias("text"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled pairs, one row for each id."""
    meta = lambda k: F.max(F.try_element_at("metadata", F.lit(k))).alias(k)
    rows = table(spark, folder, "pair_examples").where("id is not null").groupBy("id").agg(F.min("left_text").alias("left_text"), F.min("right_text").alias("right_text"), F.bool_or("label").alias("label"), F.max("label_value").alias("label_value"), *map(meta, ("language", "genre", "generation", "plagiarism_type")))
    return rows


def _signals(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.signals(_pairs(spark, folder), "left_text", "right_text")


def _valid(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "match_evidence").where("score between 0 and 1 and suspicious_start >= 0 and suspicious_end > suspicious_start and source_start >= 0 and source_end > source_start")


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---------------------------------------------------------------- normalisation, ids, chunks
@query(f"WITH {_DOCS} SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS sha FROM n")
def normalize_hash(spark, folder):
    return _docs(spark, folder).select("doc_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha"))


_IDS_SQL = "SELECT source AS v FROM documents UNION SELECT c_name FROM customer UNION SELECT id FROM passages UNION SELECT document_id || '/' || coalesce(id, '') FROM chunks UNION SELECT scan_id || '.pdf' FROM scan_configs UNION SELECT dataset || '-essay' FROM eval_items"
_KEEP = r"regexp_full_match(v, '[a-z0-9][a-z0-9_.:-]{0,63}') AND NOT (contains(v, '..') OR regexp_matches(v, '^(c:|file:)') OR regexp_matches(v, '(?i)\.(docx?|pdf|md|markdown|txt|rtf|odt)([^A-Za-z0-9_]|$)') OR list_has_any(regexp_split_to_array(lower(v), '[-_.:]+'), ['assignment','draft','essay','homework','learner','name','paper','person','student','submission','teacher','user']))"


@query(f"WITH x AS ({_IDS_SQL}) SELECT v AS value, CASE WHEN {_KEEP} THEN v ELSE 'doc:' || substring(sha256(v), 1, 16) END AS public_id, {_KEEP} AS is_public FROM x WHERE v IS NOT NULL")
def public_ids(spark, folder):
    t = lambda n: table(spark, folder, n)
    every = t("documents").select(F.col("source").alias("value"))
    for df in (t("customer").select("c_name"), t("passages").select("id"), t("chunks").select(F.concat("document_id", F.lit("/"), F.coalesce("id", F.lit("")))), t("scan_configs").select(F.concat("scan_id", F.lit(".pdf"))), t("eval_items").select(F.concat("dataset", F.lit("-essay")))):
        every = every.union(df)
    v = F.col("value")
    return every.where("value is not null").distinct().select("value", ids.public_id(v).alias("public_id"), ids.is_public_id(v).alias("is_public"))


@query(f"WITH {_DOCS}, {_PARAS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS BIGINT) AS idx, CAST(ofs AS BIGINT) AS start_char, CAST(ofs + length(part) AS BIGINT) AS end_char, 'paragraph ' || row_number() OVER (PARTITION BY doc_id ORDER BY k) AS label FROM p WHERE part <> ''")
def paragraph_segments(spark, folder):
    rows = _docs(spark, folder).select("doc_id", F.explode(chunks.paragraph_segments(F.col("text"))).alias("s"))
    return rows.select("doc_id", F.col("s.index").alias("idx"), F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"), "s.label")


@query(f"WITH c AS (SELECT DISTINCT document_id, chunk_index, text FROM chunks WHERE document_id IS NOT NULL), l AS (SELECT document_id, list_filter(list_transform(list(text ORDER BY chunk_index, text), lambda x: {_norm('x')}), lambda x: x <> '') AS ts FROM c WHERE text IS NOT NULL GROUP BY 1) SELECT document_id, CAST(len(ts) AS BIGINT) AS segments, md5(array_to_string(ts, chr(10) || chr(10))) AS digest, CAST(length(array_to_string(ts, chr(10) || chr(10))) AS BIGINT) AS last_end FROM l")
def segmented_documents(spark, folder):
    rows = table(spark, folder, "chunks").where("document_id is not null and text is not null").select("document_id", "chunk_index", "text").distinct()
    grouped = rows.groupBy("document_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]).alias("parts"))
    built = grouped.select("document_id", chunks.segmented(F.col("parts"), "page").alias("d"))
    return built.select("document_id", F.size("d.segments").alias("segments"), F.md5(F.col("d.text").cast("binary")).alias("digest"), F.coalesce(F.try_element_at("d.segments", F.lit(-1))["end"], F.lit(0)).alias("last_end"))


def _chunk_query(size: int, overlap: int) -> Query:
    def run(spark, folder):
        rows = chunks.chunk(_docs(spark, folder), "doc_id", "text", size, overlap, normalized=True)
        return rows.select("doc_id", "chunk_index", "id", F.col("start").alias("start_char"), F.col("end").alias("end_char"), F.md5(F.col("text").cast("binary")).alias("digest"))

    return run


for _name, _size, _overlap in (("chunks_default", 900, 120), ("chunks_small", 200, 50)):
    _run = _chunk_query(_size, _overlap)
    _run.__name__ = _name
    query(_chunks(_size, _overlap) + "SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, doc_id || ':' || chunk_index AS id, CAST(s AS BIGINT) AS start_char, CAST(s + length(body) AS BIGINT) AS end_char, md5(body) AS digest FROM c")(_run)


@query(_chunks(900, 120) + "SELECT coalesce(lang, '') AS lang, CAST(count(*) AS BIGINT) AS chunks, CAST(sum(length(body)) AS BIGINT) AS chars, CAST(max(chunk_index) + 1 AS BIGINT) AS most FROM c GROUP BY 1")
def chunk_stats(spark, folder):
    docs = _docs(spark, folder)
    rows = chunks.chunk(docs.select(F.struct("doc_id", F.coalesce("lang", F.lit("")).alias("lang")).alias("k"), "text"), "k", "text", normalized=True)
    return rows.groupBy(F.col("k.lang").alias("lang")).agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"), (F.max("chunk_index") + 1).alias("most"))


_WORD_SQL = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_''-]*[\p{L}\p{N}_])?"
_PASSAGE = f"SELECT doc_id, list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda p: replace(p, chr(10), ' ')), lambda p: len(regexp_extract_all(p, '{_WORD_SQL}')) >= 80) AS f, t FROM n"


@query(f"WITH {_DOCS}, a AS ({_PASSAGE}), w AS (SELECT doc_id, regexp_extract_all(coalesce(f[1], t), '{_WORD_SQL}') AS w FROM a) SELECT doc_id, CASE WHEN len(w) >= 80 THEN md5(array_to_string(w[1:160], ' ')) END AS digest FROM w")
def first_passages(spark, folder):
    return _docs(spark, folder).select("doc_id", F.md5(chunks.first_passage(F.col("text")).cast("binary")).alias("digest"))


@query(f"WITH {_DOCS}, w AS (SELECT doc_id, list_filter(regexp_extract_all(t, '{_WORD_SQL}'), lambda w, i: i % 9 <> 0) AS k FROM n) SELECT doc_id, md5(array_to_string(list_transform(k, lambda w, i: CASE WHEN (i - 1) IN (10, 27, 44, 61, 78) AND i < len(k) THEN k[i + 1] WHEN (i - 2) IN (10, 27, 44, 61, 78) THEN k[i - 1] ELSE w END), ' ')) AS digest FROM w")
def obfuscated(spark, folder):
    return _docs(spark, folder).select("doc_id", F.md5(chunks.obfuscate(chunks.words(F.col("text"))).cast("binary")).alias("digest"))


# ---------------------------------------------------------------- tokens
@query(f"WITH {_DOCS}, {_tokens('k', 'n', 'doc_id')} SELECT doc_id, CAST(pos AS BIGINT) AS pos, value, s AS start_char, e AS end_char FROM k")
def token_positions(spark, folder):
    return tokens.token_table(_docs(spark, folder), "doc_id", "text").withColumnsRenamed({"start": "start_char", "end": "end_char"})


@query(f"WITH {_DOCS}, k AS (SELECT doc_id, {_toks('t')} AS v FROM n) SELECT doc_id, CAST(len(v) AS BIGINT) AS n_tokens, CAST(len(list_distinct(v)) AS BIGINT) AS n_distinct FROM k")
def token_stats(spark, folder):
    t = tokens.tokens(F.col("text"))
    return _docs(spark, folder).select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


@query(f"WITH {_DOCS}, k AS (SELECT unnest({_toks('t')}) AS value FROM n) SELECT value, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY 1 ORDER BY n DESC, value LIMIT 100")
def token_frequency_top(spark, folder):
    return _docs(spark, folder).select(F.explode(tokens.tokens(F.col("text"))).alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(100)


# ---------------------------------------------------------------- exact sequences
@query(f"WITH {_DOCS}, {_grams('g8', 'n', 'doc_id')}, f AS (SELECT g, count(DISTINCT doc_id) AS df FROM g8 GROUP BY 1) SELECT CAST(df AS BIGINT) AS df, CAST(count(*) AS BIGINT) AS grams FROM f GROUP BY 1")
def ngram_df_histogram(spark, folder):
    g = exact.grams(_docs(spark, folder), "doc_id", "text").select("gram", "check", "doc_id").distinct()
    return g.groupBy("gram", "check").agg(F.count("*").alias("df")).groupBy("df").agg(F.count("*").alias("grams"))


@query(f"WITH {_RUNS} SELECT item_id, doc_id, CAST(count(*) AS BIGINT) AS seeds FROM sd GROUP BY ALL")
def shared_ngram_pairs(spark, folder):
    left, right = exact.grams(_items(spark, folder), "item_id", "text"), exact.grams(_docs(spark, folder), "doc_id", "text")
    return exact.seeds(left, right, "item_id", "doc_id").groupBy("item_id", "doc_id").agg(F.count("*").alias("seeds"))


def _runs(spark, folder):
    left, right = exact.grams(_items(spark, folder), "item_id", "text"), exact.grams(_docs(spark, folder), "doc_id", "text")
    return exact.runs(exact.seeds(left, right, "item_id", "doc_id"), "item_id", "doc_id")


@query(f"WITH {_RUNS} SELECT item_id, doc_id, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(len AS BIGINT) AS length FROM rn")
def exact_runs(spark, folder):
    return _runs(spark, folder).select("item_id", "doc_id", "a", "b", "length")


@query(f"WITH {_RUNS} SELECT item_id, doc_id, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(len AS BIGINT) AS length FROM rn WHERE head")
def exact_maximal_runs(spark, folder):
    return _runs(spark, folder).where("head").select("item_id", "doc_id", "a", "b", "length")


def _spans(spark, folder):
    return exact.exact_spans(_items(spark, folder), _docs(spark, folder), "item_id", "doc_id")


@query(f"WITH {_SPANS} SELECT item_id, doc_id, CAST(match_index AS BIGINT) AS match_index, CAST(tokens AS BIGINT) AS tokens, item_id || ':exact:' || match_index AS suspicious_chunk_id, doc_id || ':exact:' || match_index AS source_chunk_id, suspicious_start, suspicious_end, source_start, source_end, 1.0::DOUBLE AS score, 'Exact shared token sequence of ' || tokens || ' tokens.' AS explanation FROM es")
def exact_spans(spark, folder):
    return _spans(spark, folder).drop("kind")


@query(f"WITH {_SPANS}, sp AS (SELECT doc_id, source_start AS s, source_end AS e FROM es), {_merged('mg', 'sp', 'doc_id')} SELECT doc_id, CAST(sum(e - s) AS BIGINT) AS chars FROM mg GROUP BY 1")
def exact_span_coverage(spark, folder):
    found = _spans(spark, folder).select("doc_id", F.col("source_start").alias("start"), F.col("source_end").alias("end"))
    return spans.covered(found, ["doc_id"])


# ---------------------------------------------------------------- lexical scores
@query(f"WITH {_SIGNALS} SELECT id, round(exact, 6) AS exact, round(containment, 6) AS containment, round(jaccard, 6) AS jaccard FROM ps")
def pair_scores(spark, folder):
    return _rounded(_signals(spark, folder).select("id", "exact", "containment", "jaccard"), "exact", "containment", "jaccard")


@query(f"WITH {_SIGNALS} SELECT id, round(bound, 6) AS order_bound FROM ps")
def order_bounds(spark, folder):
    return _signals(spark, folder).select("id", F.round(scores.order_bound(F.col("_l"), F.col("_r")), 6).alias("order_bound"))


@query(f"WITH {_SIGNALS} SELECT id, CASE WHEN exact >= 0.95 THEN 'exact_overlap' WHEN containment >= 0.8 THEN 'near_duplicate' WHEN jaccard >= 0.55 THEN 'lexical_similarity' ELSE 'needs_review' END AS kind FROM ps")
def pair_kinds(spark, folder):
    return _signals(spark, folder).select("id", scores.kind(F.col("exact"), F.col("containment"), F.col("jaccard")).alias("kind"))


@query()
def scored_pairs(spark, folder):
    """Pairs above the threshold with the order-aware score (no SQL: Ratcliff-Obershelp; tested against the standard library)."""
    return lexical.scored(_pairs(spark, folder), "left_text", "right_text").select("id", "kind", "score", F.round("order", 6).alias("order_similarity"))


@query()
def compare_pairs(spark, folder):
    return lexical.compare_pairs(_pairs(spark, folder), "id", "left_text", "right_text").drop("ord", "raw_score")


@query()
def corpus_scan(spark, folder):
    return lexical.scan_corpus(_items(spark, folder), _docs(spark, folder), "item_id", "doc_id").drop("ord", "raw_score")


@query(f"WITH {_DOCS} SELECT sha256(t) AS sha, CAST(count(*) AS BIGINT) AS copies, min(doc_id) AS first_id FROM n GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, folder):
    return _docs(spark, folder).groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


# ---------------------------------------------------------------- fingerprints and vectors
def _simhash_sql(source: str, key: str) -> str:
    return (
        f"h AS (SELECT {key}, w, count(*) AS c FROM (SELECT {key}, unnest({_toks('t')}) AS w FROM {source}) GROUP BY ALL), "
        f"k AS (SELECT {key}, c, CAST('0x' || substring(md5(w), 1, 16) AS UBIGINT) AS x FROM h), "
        f"b AS (SELECT {key}, i, sum(CASE WHEN (x >> i) & 1 = 1 THEN c ELSE -c END) AS s FROM k, range(0, 64) r(i) GROUP BY ALL), "
        f"sh AS (SELECT {key}, coalesce(bit_or(1::UBIGINT << i) FILTER (s > 0), 0::UBIGINT) AS x FROM b GROUP BY 1)"
    )


@query(f"WITH {_DOCS}, {_simhash_sql('n', 'doc_id')} SELECT doc_id, lower(printf('%016x', x)) AS simhash FROM sh")
def simhash_md5(spark, folder):
    found = fingerprints.simhash_table(tokens.token_values(_docs(spark, folder), "doc_id", "text"), "doc_id")
    return found.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("simhash"))


@query()
def simhash_blake2b(spark, folder):
    """Fingerprints with the BLAKE2b token hash (no SQL function; tested against hashlib)."""
    return _docs(spark, folder).select("doc_id", fingerprints.simhash(tokens.tokens(F.col("text"))).alias("simhash"))


@query(f"WITH m AS (SELECT item_id AS k, {_norm('text')} AS t FROM eval_items WHERE text IS NOT NULL), pg AS (SELECT -passage_no AS k, {_norm('min(text)')} AS t FROM passages WHERE text IS NOT NULL GROUP BY passage_no), al AS (SELECT * FROM m UNION ALL SELECT * FROM pg), {_simhash_sql('al', 'k')}, d AS (SELECT a.k AS item_id, -b.k AS passage_no, CAST(bit_count(xor(a.x, b.x)) AS BIGINT) AS distance FROM sh a, sh b WHERE a.k > 0 AND b.k < 0), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, passage_no) AS rank FROM d) SELECT item_id, passage_no, distance, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 20 AND distance <= 28")
def hamming_top(spark, folder):
    """The nearest 20 passages of each test item (a fixed set of 400) within 28 bits."""
    from pyspark.sql import Window

    mark = lambda df, k: fingerprints.simhash_table(tokens.token_values(df, k, "text"), k)
    items = mark(_items(spark, folder), "item_id").withColumnRenamed("simhash", "x")
    rows = table(spark, folder, "passages").where("text is not null").groupBy("passage_no").agg(normalize_col(F.min("text")).alias("text"))
    pairs = mark(rows, "passage_no").join(F.broadcast(items), F.lit(True)).select("item_id", "passage_no", scores.hamming(F.col("x"), F.col("simhash")).alias("distance"))
    order = Window.partitionBy("item_id").orderBy("distance", "passage_no")
    return pairs.withColumn("rank", F.row_number().over(order)).where("rank <= 20 and distance <= 28")


_COS = "round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 4)"
_TOP = f"d AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, {_COS} AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)"


def _vectors(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v"), e


@query(f"WITH {_TOP}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM d) SELECT query_id, vec_id, score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 5")
def cosine_top(spark, folder):
    """Queries: every vector whose id is divisible by 50; index: all vectors."""
    q, e = _vectors(spark, folder)
    return vectors.top_k(q, e, "query_id", "vec_id", "v", 5, exclude_self=True, digits=4)


@query(f"WITH {_TOP}, s AS (SELECT *, row_number() OVER (PARTITION BY query_id, vec_id % 4 ORDER BY score DESC, vec_id) AS k FROM d), r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE k <= 5) SELECT query_id, vec_id, score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 5")
def sharded_top_merge(spark, folder):
    q, e = _vectors(spark, folder)
    parts = vectors.top_k(q, e.withColumn("shard", F.pmod("vec_id", F.lit(4))), "query_id", "vec_id", "v", 5, within=["shard"], exclude_self=True, digits=4)
    return vectors.merge_top_k(parts.drop("shard"), "query_id", "vec_id", 5)


@query("WITH d AS (SELECT v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 4) AS score FROM embeddings v, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q) SELECT vec_id, score FROM d ORDER BY score DESC, vec_id LIMIT 10")
def vector_query_top(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    one = e.orderBy("vec_id").limit(1).select(F.col("v").alias("q"))
    return e.join(F.broadcast(one), F.lit(True)).select("vec_id", F.round(scores.cosine(F.col("q"), F.col("v")), 4).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@query(f"WITH d AS (SELECT q.label = v.label AS x, {_COS} >= 0.5 AS p FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0), c AS (SELECT {_CONFUSION} FROM d), r AS (SELECT *, {_RATIOS} FROM c) SELECT tp, fp, tn, fn, {_ROUNDED} FROM r")
def cosine_label_confusion(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("v").alias("q"), F.col("label").alias("q_label"))
    pairs = e.join(q, F.col("q_id") != F.col("vec_id"))
    near = F.round(scores.cosine(F.col("q"), F.col("v")), 4) >= 0.5
    return _rounded(evaluate.metrics(pairs, F.col("q_label") == F.col("label"), near), *_METRICS)


@query()
def semantic_evidence(spark, folder):
    """Paraphrase candidates of each test item in the passages, with the model-free embedder."""
    def embedded(df, key):
        return chunks.chunk(df, key, "text", normalized=True).withColumn("vector", vectors.embed(vectors.HashEmbedder, F.col("text")))

    rows = table(spark, folder, "passages").where("text is not null").groupBy("passage_no").agg(normalize_col(F.min("text")).alias("text"))
    return vectors.semantic_matches(embedded(_items(spark, folder), "item_id"), embedded(rows, "passage_no"), "item_id", "passage_no", min_score=0.5).drop("ord", "raw_score")


@query("WITH b AS (SELECT passage_no, min(fetched_at) AS first_seen, min(text) AS text FROM passages GROUP BY 1) SELECT passage_no, md5(text || '!') AS digest, first_seen, first_seen + INTERVAL 1 DAY AS stored FROM b")
def passage_upsert(spark, folder):
    """Stored passages replaced by a later delivery of all of them; the first time seen is kept."""
    old = table(spark, folder, "passages").groupBy("passage_no").agg(F.min("fetched_at").alias("first_seen"), F.min("text").alias("text")).withColumn("stored", F.col("first_seen"))
    new = old.select("passage_no", "first_seen", F.concat("text", F.lit("!")).alias("text"), (F.col("stored") + F.expr("interval 1 day")).alias("stored"))
    both = vectors.upsert(old, new, "passage_no", "stored", keep=("first_seen",))
    return both.select("passage_no", F.md5(F.col("text").cast("binary")).alias("digest"), "first_seen", "stored")


@query("SELECT id, max(upserted_at) AS upserted_at, CAST(count(DISTINCT upserted_at) AS BIGINT) AS versions FROM vector_records WHERE id IS NOT NULL GROUP BY 1")
def vector_versions(spark, folder):
    return table(spark, folder, "vector_records").where("id is not null").groupBy("id").agg(F.max("upserted_at").alias("upserted_at"), F.count_distinct("upserted_at").alias("versions"))


# ---------------------------------------------------------------- evaluation
_LABELLED = f"{_SIGNALS}, d AS (SELECT *, coalesce(label, FALSE) AS x, jaccard >= 0.5 AS p FROM ps WHERE label IS NOT NULL)"


def _labelled(spark, folder):
    return _signals(spark, folder).where("label is not null")


@query(f"WITH {_LABELLED}, c AS (SELECT {_CONFUSION} FROM d), r AS (SELECT *, {_RATIOS} FROM c) SELECT tp, fp, tn, fn, {_ROUNDED} FROM r")
def classification_metrics(spark, folder):
    return _rounded(evaluate.metrics(_labelled(spark, folder), F.col("label"), F.col("jaccard") >= 0.5), *_METRICS)


_EACH = " UNION ALL ".join(f"SELECT '{c}' AS dimension, coalesce(nullif(trim({c}), ''), 'none') AS value, x, p FROM d" for c in ("plagiarism_type", "generation", "genre"))


@query(f"WITH {_LABELLED}, g AS ({_EACH}), c AS (SELECT dimension, value, {_CONFUSION} FROM g GROUP BY ALL), r AS (SELECT *, {_RATIOS} FROM c) SELECT dimension, value, tp, fp, tn, fn, {_ROUNDED} FROM r")
def metrics_by_group(spark, folder):
    return _rounded(evaluate.metrics_by_each(_labelled(spark, folder), F.col("label"), F.col("jaccard") >= 0.5, ["plagiarism_type", "generation", "genre"]), *_METRICS)


_SWEEP = "ts AS (SELECT unnest(range(0, 10)) AS ordinal, unnest([0.40, 0.50, 0.55, 0.60, 0.70, 0.72, 0.75, 0.80, 0.85, 0.90]::DOUBLE[]) AS threshold)"


@query(f"WITH {_LABELLED}, {_SWEEP}, g AS (SELECT ordinal, threshold, x, jaccard >= threshold AS p FROM d, ts), c AS (SELECT ordinal, threshold, {_CONFUSION} FROM g GROUP BY ALL), r AS (SELECT *, {_RATIOS} FROM c) SELECT CAST(ordinal AS BIGINT) AS ordinal, threshold, tp, fp, tn, fn, {_ROUNDED} FROM r")
def threshold_sweep(spark, folder):
    return _rounded(evaluate.sweep(_labelled(spark, folder), F.col("label"), F.col("jaccard"), evaluate.SWEEP), *_METRICS)


@query(f"WITH {_LABELLED}, {_SWEEP}, g AS (SELECT ordinal, threshold, x, jaccard >= threshold AS p FROM d, ts), c AS (SELECT ordinal, threshold, {_CONFUSION} FROM g GROUP BY ALL), r AS (SELECT *, {_RATIOS} FROM c) SELECT threshold, tp, fp, tn, fn FROM r ORDER BY round(f1, 4) DESC, round(recall, 4) DESC, round(fpr, 4), ordinal LIMIT 1")
def best_threshold(spark, folder):
    return evaluate.best(evaluate.sweep(_labelled(spark, folder), F.col("label"), F.col("jaccard"), evaluate.SWEEP), rule="sweep").select("threshold", "tp", "fp", "tn", "fn")


@query(f"WITH {_LABELLED}, {_SWEEP}, g AS (SELECT language, ordinal, threshold, x, jaccard >= threshold AS p FROM d, ts WHERE language <> ''), c AS (SELECT language, ordinal, threshold, {_CONFUSION} FROM g GROUP BY ALL), r AS (SELECT *, {_RATIOS} FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY round(f1, 4) DESC, round(precision, 4) DESC, round(recall, 4) DESC, ordinal) AS k FROM r) SELECT language, threshold, tp, fp, tn, fn FROM k WHERE k = 1")
def best_threshold_by_language(spark, folder):
    rows = _labelled(spark, folder).where("language <> ''")
    return evaluate.best(evaluate.sweep(rows, F.col("label"), F.col("jaccard"), evaluate.SWEEP, ["language"]), by=["language"]).select("language", "threshold", "tp", "fp", "tn", "fn")


@query()
def calibration(spark, folder):
    """The lexical threshold by the full pair scan, one scoring pass (rows only: needs the order similarity)."""
    pairs = _pairs(spark, folder).where("label is not null")
    found = lexical.compare_pairs(pairs, "id", "left_text", "right_text", min_score=min(evaluate.THRESHOLDS))
    return evaluate.calibrate(found, pairs, "id", "label").select("selected_threshold", "selection_metric", "detector_id")


@query("WITH p AS (SELECT quantile_cont(score, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM match_evidence WHERE score BETWEEN 0 AND 1) SELECT CAST(unnest(range(0, 11)) AS BIGINT) AS step, round(unnest(q), 6) AS quantile FROM p")
def score_quantiles(spark, folder):
    rows = table(spark, folder, "match_evidence").where("score between 0 and 1")
    return rows.agg(evaluate.quantiles(rows, F.col("score")).alias("q")).select(F.posexplode("q").alias("step", "quantile")).withColumn("quantile", F.round("quantile", 6))


@query(f"WITH {_SIGNALS} SELECT round(coalesce(avg(abs(label_value - containment)), 0), 6) AS mae FROM ps WHERE label_value IS NOT NULL")
def mean_absolute_error(spark, folder):
    return _signals(spark, folder).where("label_value is not null").agg(F.round(evaluate.mean_absolute_error(F.col("label_value"), F.col("containment")), 6).alias("mae"))


@query(f"WITH {_VALID}, m AS (SELECT *, min(score) OVER (PARTITION BY kind) AS lo, max(score) OVER (PARTITION BY kind) AS hi FROM ev WHERE kind IS NOT NULL) SELECT kind, round(avg(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.0 END), 6) AS scaled, round(avg(1 / (1 + exp(-score))), 6) AS squashed FROM m GROUP BY 1")
def scaled_scores(spark, folder):
    rows = evaluate.min_max(_valid(spark, folder).where("kind is not null"), "score", ["kind"])
    return rows.groupBy("kind").agg(F.round(F.avg("scaled"), 6).alias("scaled"), F.round(F.avg(scores.sigmoid(F.col("score"))), 6).alias("squashed"))


@query()
def controlled_reuse(spark, folder):
    """Exact, obfuscated and unrelated cases from sampled passages, scored (the sample is the operator)."""
    rows = table(spark, folder, "passages").where("text is not null").groupBy("passage_no").agg(F.min("text").alias("text"))
    passages = rows.select("passage_no", chunks.first_passage(normalize_col(F.col("text")), min_words=40).alias("text")).where("text is not null")
    cases = evaluate.controlled_reuse(passages, "passage_no", "text")
    scored = lexical.scored(cases, "left_text", "right_text", 0.0)
    return _rounded(evaluate.metrics(scored, F.col("expected"), F.col("raw_score") >= 0.5, ["case"]), *_METRICS)


# ---------------------------------------------------------------- spans and evidence
@query(f"WITH {_VALID}, sp AS (SELECT suspicious_chunk_id AS k, suspicious_start AS s, suspicious_end AS e FROM ev WHERE suspicious_chunk_id IS NOT NULL), {_merged('mg', 'sp', 'k')} SELECT k AS chunk_id, CAST(s AS BIGINT) AS start_char, CAST(e AS BIGINT) AS end_char FROM mg")
def merged_spans(spark, folder):
    rows = _valid(spark, folder).where("suspicious_chunk_id is not null").select(F.col("suspicious_chunk_id").alias("chunk_id"), F.col("suspicious_start").alias("start"), F.col("suspicious_end").alias("end"))
    return spans.merge(rows, ["chunk_id"]).withColumnsRenamed({"start": "start_char", "end": "end_char"})


@query(
    f"WITH {_VALID}, ts AS (SELECT scan_id AS k, suspicious_start AS s, suspicious_end AS e FROM ev WHERE kind = 'exact_overlap'), ps AS (SELECT scan_id AS k, suspicious_start AS s, suspicious_end AS e FROM ev WHERE kind = 'exact_token_sequence'), {_merged('mt', 'ts', 'k')}, {_merged('mp', 'ps', 'k')}, "
    "a AS (SELECT k, sum(e - s) AS truth_chars FROM mt GROUP BY 1), b AS (SELECT k, sum(e - s) AS predicted_chars FROM mp GROUP BY 1), o AS (SELECT mt.k, sum(least(mt.e, mp.e) - greatest(mt.s, mp.s)) AS overlap_chars FROM mt JOIN mp ON mt.k = mp.k AND mt.s < mp.e AND mp.s < mt.e GROUP BY 1), "
    "j AS (SELECT coalesce(a.k, b.k) AS k, CAST(coalesce(predicted_chars, 0) AS BIGINT) AS predicted_chars, CAST(coalesce(truth_chars, 0) AS BIGINT) AS truth_chars FROM a FULL JOIN b ON a.k = b.k), x AS (SELECT j.*, CAST(coalesce(overlap_chars, 0) AS BIGINT) AS overlap_chars FROM j LEFT JOIN o USING (k)) "
    "SELECT k AS scan_id, predicted_chars, truth_chars, overlap_chars, round(CASE WHEN predicted_chars > 0 THEN overlap_chars / CAST(predicted_chars AS DOUBLE) ELSE 0.0 END, 6) AS precision, round(CASE WHEN truth_chars > 0 THEN overlap_chars / CAST(truth_chars AS DOUBLE) ELSE 0.0 END, 6) AS recall, round(CASE WHEN overlap_chars > 0 THEN 2.0 * overlap_chars / (predicted_chars + truth_chars) ELSE 0.0 END, 6) AS f1 FROM x"
)
def span_overlap_metrics(spark, folder):
    rows = _valid(spark, folder).select("scan_id", "kind", F.col("suspicious_start").alias("start"), F.col("suspicious_end").alias("end"))
    pick = lambda k: rows.where(F.col("kind") == k).drop("kind")
    return _rounded(spans.overlap_metrics(pick("exact_overlap"), pick("exact_token_sequence"), ["scan_id"]), "precision", "recall", "f1")


@query(f"WITH {_VALID} SELECT scan_id, kind, CAST(suspicious_start AS BIGINT) AS suspicious_start, CAST(suspicious_end AS BIGINT) AS suspicious_end, CAST(source_start AS BIGINT) AS source_start, CAST(source_end AS BIGINT) AS source_end, max(score) AS score FROM ev WHERE scan_id IS NOT NULL AND kind IS NOT NULL GROUP BY ALL")
def deduped_evidence(spark, folder):
    rows = _valid(spark, folder).where("scan_id is not null and kind is not null").withColumn("ord", F.struct("suspicious_chunk_id", "source_chunk_id"))
    return lexical.dedupe(rows, ["scan_id"]).select("scan_id", "kind", "suspicious_start", "suspicious_end", "source_start", "source_end", "score")


@query(f"WITH {_VALID} SELECT scan_id, CAST(count(*) AS BIGINT) AS match_count, coalesce(max(score), 0) AS top_score, CAST(count(DISTINCT kind) AS BIGINT) AS kinds FROM ev GROUP BY 1")
def scan_summary(spark, folder):
    return reports.summary(_valid(spark, folder), "scan_id")


@query("SELECT kind, CAST(count(*) AS BIGINT) AS n FROM match_evidence GROUP BY 1")
def kind_counts(spark, folder):
    return table(spark, folder, "match_evidence").groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {_VALID}, l AS (SELECT scan_id, score, '- ' || kind || ' score=' || printf('%.4f', score) || ': ' || explanation AS line FROM ev WHERE scan_id IS NOT NULL AND kind IS NOT NULL AND explanation IS NOT NULL) SELECT scan_id, md5('Scan ' || scan_id || chr(10) || 'Matches: ' || count(*) || chr(10) || string_agg(line, chr(10) ORDER BY -score, line)) AS digest FROM l GROUP BY scan_id")
def report_texts(spark, folder):
    rows = reports.searchable_text(_valid(spark, folder).where("scan_id is not null and kind is not null and explanation is not null"), "scan_id")
    return rows.select("scan_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"WITH {_VALID}, r AS (SELECT scan_id, kind, CASE WHEN kind = 'possible_paraphrase' THEN greatest(0, least(1, ((suspicious_end - suspicious_start) * 100 // (source_end - source_start)) / 100.0)) ELSE score END AS score, kind = 'possible_paraphrase' AS changed FROM ev) SELECT scan_id, CAST(count(*) FILTER (changed) AS BIGINT) AS changed, round(sum(score), 3) AS total FROM r GROUP BY 1")
def reranked(spark, folder):
    """Evidence reranked by a fixed scorer (the ratio of span lengths, in hundredths) where it is a paraphrase candidate."""
    new = F.when(F.col("kind") == "possible_paraphrase", F.floor((F.col("suspicious_end") - F.col("suspicious_start")) * 100 / (F.col("source_end") - F.col("source_start"))) / 100)
    rows = vectors.rerank(_valid(spark, folder), new)
    return rows.groupBy("scan_id").agg(F.count_if(F.col("explanation").endswith("Reranker score applied.")).alias("changed"), F.round(F.sum("score"), 3).alias("total"))


@query("WITH c AS (SELECT DISTINCT source_chunk_id AS chunk_id FROM match_evidence WHERE source_chunk_id IS NOT NULL), m AS (SELECT c.chunk_id, d.id, row_number() OVER (PARTITION BY c.chunk_id ORDER BY length(d.id) DESC) AS k FROM c JOIN documents d ON c.chunk_id = d.id OR starts_with(c.chunk_id, d.id || ':')) SELECT c.chunk_id, m.id AS source_id FROM c LEFT JOIN m ON c.chunk_id = m.chunk_id AND k = 1")
def resolved_sources(spark, folder):
    rows = table(spark, folder, "match_evidence").where("source_chunk_id is not null").select(F.col("source_chunk_id").alias("chunk_id")).distinct()
    return vectors.resolve_sources(rows, table(spark, folder, "documents").select(F.col("id").alias("source_id")), "chunk_id", "source_id")


def _escaped(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


_SNIP = "least(greatest(least(suspicious_start, length(t)), 0), length(t))"


@query(
    f"WITH {_VALID}, d AS (SELECT id, {_norm('text')} AS t FROM documents WHERE text IS NOT NULL), j AS (SELECT DISTINCT d.id, t, suspicious_start, suspicious_end FROM ev JOIN d ON split_part(suspicious_chunk_id, ':', 1) = d.id), "
    f"p AS (SELECT id, t, suspicious_start, suspicious_end, {_SNIP} AS lo, greatest(least(suspicious_end, length(t)), {_SNIP}) AS hi FROM j), q AS (SELECT *, greatest(lo - 160, 0) AS a, least(hi + 160, length(t)) AS b FROM p) "
    f"SELECT id, CAST(suspicious_start AS BIGINT) AS start_char, CAST(suspicious_end AS BIGINT) AS end_char, md5(CASE WHEN a > 0 THEN '...' ELSE '' END || {_escaped('substring(t, a + 1, lo - a)')} || '<mark>' || {_escaped('substring(t, lo + 1, hi - lo)')} || '</mark>' || {_escaped('substring(t, hi + 1, b - hi)')} || CASE WHEN b < length(t) THEN '...' ELSE '' END) AS digest FROM q"
)
def snippets(spark, folder):
    rows = _valid(spark, folder).select(F.split_part("suspicious_chunk_id", F.lit(":"), F.lit(1)).alias("id"), "suspicious_start", "suspicious_end").distinct()
    joined = rows.join(_docs(spark, folder).select("id", "text"), "id")
    shown = reports.snippet(F.col("text"), F.col("suspicious_start"), F.col("suspicious_end"))
    return joined.select("id", F.col("suspicious_start").alias("start_char"), F.col("suspicious_end").alias("end_char"), F.md5(shown.cast("binary")).alias("digest"))


@query()
def validated_reports(spark, folder):
    """The errors of a JSON report built for every scan from its rows as they are."""
    rows = table(spark, folder, "match_evidence").where("scan_id is not null")
    built = reports.build(rows, "scan_id", suspicious_document_id=F.lit("corpus"), source_document_id=F.concat(F.lit("corpus:"), F.lit("1")))
    checked = reports.validate(reports.to_json(built), key="scan_id")
    return checked.select("scan_id", F.size("errors").alias("errors"), F.try_element_at("errors", F.lit(1)).alias("first_error"))
