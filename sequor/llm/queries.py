"""Registered queries of the corpus operators, and oracle SQL where SQL can express them."""

from __future__ import annotations

from sequor.llm.html import op8_html_extraction
from sequor.llm.packing import op9_packing
from sequor.llm.pieces import op10_sentencepiece
from sequor.llm.quality import op1_quality_rules
from sequor.llm.repeats import op5_substring_dedup, op7_suffix_dedup
from sequor.llm.shards import op3_sharding
from sequor.llm.simhash import op6_simhash
from sequor.llm.spelling import op12_spelling_variants
from sequor.llm.toxicity import op13_toxicity
from sequor.llm.urls import op4_url_filter
from sequor.llm.vectors import op2_embedding_dedup
from sequor.llm.whitening import op11_embedding_whitening

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_embedding_dedup, op3_sharding, op4_url_filter, op5_substring_dedup, op6_simhash, op7_suffix_dedup, op8_html_extraction, op9_packing, op10_sentencepiece, op11_embedding_whitening, op12_spelling_variants, op13_toxicity)}

ORACLE_SQL = {
    "op2_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
        n AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS len FROM v),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE a.len > 0 AND b.len > 0 AND list_inner_product(a.e, b.e) / (a.len * b.len) >= 0.98),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        k AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
        SELECT e.vec_id, CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
        FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN k ON k.a = e.vec_id""",
    "op5_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 19), ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
        f AS (SELECT k, min(struct_pack(d := doc_id, s := i)) AS f FROM win GROUP BY k HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM win JOIN f USING (k) WHERE struct_pack(d := doc_id, s := i) > f.f),
        word AS (SELECT doc_id, p, ws[p] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
        r AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN r USING (doc_id)""",
    "op12_spelling_variants": r"""
        WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        r AS (SELECT id, run, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
            WHERE length(run) >= 6 GROUP BY id, run),
        h AS (SELECT run, n, hex(encode(id || ':' || run)) AS x FROM r),
        c AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: strpos('123456789ABCDEF', substr(x, 2 * i + 1, 1)) * 16 + strpos('123456789ABCDEF', substr(x, 2 * i + 2, 1)))),
            lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) AS h FROM h, crc),
        w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM c)
            WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        d AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS k FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM w)),
        one AS (SELECT DISTINCT word, n, k FROM d),
        near AS (SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.k = b.k AND a.p = b.p AND a.word <> b.word
            UNION ALL SELECT a.word, b.word, b.n FROM one a JOIN w b ON a.k = b.word UNION ALL SELECT b.word, a.word, a.n FROM one a JOIN w b ON a.k = b.word),
        best AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -m, other := other)) AS t FROM near GROUP BY word),
        f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -t.less >= 5 * w.n THEN t.other END AS form, CASE WHEN -t.less >= 5 * w.n THEN -t.less END AS form_n FROM w LEFT JOIN best USING (word)),
        up AS (SELECT word, word AS top, 0 AS step FROM f UNION ALL SELECT up.word, f.form, step + 1 FROM up JOIN f ON f.word = up.top WHERE f.form IS NOT NULL),
        root AS (SELECT word, arg_max(top, step) AS root FROM up GROUP BY word)
        SELECT word, form, root, n, n_near, form_n FROM f JOIN root USING (word)""",
}
