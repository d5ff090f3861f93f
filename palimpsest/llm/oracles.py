"""SQL counterparts of the queries that SQL can express on whole tables."""

from __future__ import annotations

from palimpsest.catalogue import _DOCS, _PARAS, _merged

_NEAREST = (
    "WITH l AS (SELECT id, vector, row_number() OVER (PARTITION BY id ORDER BY upserted_at DESC NULLS LAST, vector DESC NULLS LAST) AS k FROM vector_records WHERE id IS NOT NULL), "
    "v AS (SELECT id, vector FROM l WHERE k = 1 AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0), "
    "c AS (SELECT a.id AS x, b.id AS y, round(list_cosine_similarity(a.vector, b.vector), 9) AS s FROM v a JOIN v b ON a.id <> b.id), "
    "r AS (SELECT x, y, s, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) AS k FROM c WHERE s >= 0.85) "
)
_SHARED = (
    "WITH w AS (SELECT doc_id, i, md5(substring(text, CAST(i + 1 AS BIGINT), 240)) AS h FROM (SELECT doc_id, text, unnest(range(0, length(text) - 239)) AS i FROM documents WHERE length(text) >= 240)), "
    "s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)), sp AS (SELECT DISTINCT doc_id, i AS s, i + 240 AS e FROM w WHERE h IN (SELECT h FROM s)), "
    f"{_merged('mg', 'sp', 'doc_id')} "
)

ORACLES: dict[str, str] = {
    "p2_neighbours": _NEAREST + "SELECT x AS id, y AS neighbour, s AS cosine, CAST(k AS INTEGER) AS place FROM r WHERE k <= 5",
    "p4_shared": (
        _SHARED + "SELECT d.doc_id, CAST(coalesce(length(d.text), 0) AS INTEGER) AS chars, CAST(coalesce(m.shared, 0) AS BIGINT) AS shared, CAST(coalesce(m.runs, 0) AS BIGINT) AS runs "
        "FROM documents d LEFT JOIN (SELECT doc_id, sum(e - s) AS shared, count(*) AS runs FROM mg GROUP BY doc_id) m USING (doc_id)"
    ),
    "p2_found": _NEAREST + "SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM r WHERE k <= 5",
    "p3_found": f"WITH {_DOCS}, {_PARAS}, x AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i, length(part) AS n FROM p WHERE part <> '') SELECT doc_id, CAST(i AS INTEGER) AS para_index FROM x WHERE n > 900",
    "p4_found": _SHARED + "SELECT doc_id, CAST(s AS INTEGER) AS start_char, CAST(e AS INTEGER) AS end_char FROM mg",
    "p7_found": (
        "WITH RECURSIVE t AS (SELECT lower(trim(suspicious_chunk_id)) AS a, lower(trim(source_chunk_id)) AS b FROM match_evidence), d AS (SELECT DISTINCT a, b FROM t WHERE a <> b AND a <> '' AND b <> ''), "
        "e AS (SELECT a, b FROM d UNION SELECT b, a FROM d), r AS (SELECT a AS id, a AS g FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.g = e.a) SELECT id AS chunk_id, min(g) AS group_id FROM r GROUP BY id"
    ),
}
