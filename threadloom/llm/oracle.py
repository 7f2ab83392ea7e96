"""Operators over whole tables as SQL, where SQL can express them. It shares no definition with the operators."""

from __future__ import annotations

from threadloom.llm import divergence, line_dedup, merkle

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = rf"""
WITH item AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS} AS w FROM benchmark),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM win),
run AS (SELECT r, m, i, array_to_string(w[i : i + m - 1], ' ') AS s FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc, sizes WHERE len(w) >= m)),
met AS (SELECT r, i, m, item_id FROM run JOIN win USING (m, s)),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT r, i, m FROM met)) GROUP BY 1),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM met) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""

SIMILARITY = rf"""
WITH RECURSIVE doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
class AS (SELECT array_to_string(w, ' ') AS key, any_value(w) AS w, count(*) AS copies, min(doc_id) AS class_id, row_number() OVER () AS c FROM doc WHERE len(w) > 0 GROUP BY 1),
gram AS (SELECT DISTINCT c, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT c, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM class)),
size AS (SELECT c, count(*) AS k FROM gram GROUP BY 1),
pair AS (SELECT a.c AS x, b.c AS y, count(*) AS shared FROM gram a JOIN gram b ON a.g = b.g AND a.c <> b.c GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN size p ON p.c = x JOIN size q ON q.c = y WHERE shared >= 0.8 * (p.k + q.k - shared) - 1e-9),
reach AS (SELECT c AS x, c AS y FROM class UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
comp AS (SELECT x AS c, min(class_id) AS component_id FROM reach JOIN class ON class.c = reach.y GROUP BY 1),
far AS (SELECT x AS c, sum(copies) AS links FROM link JOIN class ON class.c = link.y GROUP BY 1)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(copies, 1) AS n_copies, CAST(CASE WHEN copies IS NULL THEN 0 ELSE coalesce(links, 0) + copies - 1 END AS BIGINT) AS n_links,
       coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM doc LEFT JOIN class ON key = array_to_string(doc.w, ' ') AND len(doc.w) > 0 LEFT JOIN comp USING (c) LEFT JOIN far USING (c)"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
comp AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY 1), deg AS (SELECT x AS vec_id, count(*) AS n FROM link GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, component_id = vec_id AS kept FROM v JOIN comp USING (vec_id) LEFT JOIN deg USING (vec_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": CONTAMINATION, "op4_jaccard_join": SIMILARITY, "op9_embed_dedup": EMBEDDINGS, "op10_line_dedup": line_dedup.ORACLE, "op12_divergence": divergence.ORACLE, "op13_merkle": merkle.ORACLE}
