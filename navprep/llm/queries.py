"""The operators' queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import ann, bpe, chat, fingerprint, lm, manifest, mixing, near_dup, phrases, sharding, substring, toxicity, warc

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_nearest": ann.op2_nearest,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_chat": chat.op4_chat,
    "op5_substrings": substring.op5_substrings,
    "op6_lm": lm.op6_lm,
    "op7_revisits": warc.op7_revisits,
    "op8_fingerprints": fingerprint.op8_fingerprints,
    "op9_mix": mixing.op9_mix,
    "op10_near_duplicates": near_dup.op10_near_duplicates,
    "op11_shards": sharding.op11_shards,
    "op12_phrases": phrases.op12_phrases,
    "op13_manifest": manifest.op13_manifest,
}

_OP2 = """
WITH v AS (SELECT vec_id, embedding e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, list_transform(e, lambda x: CAST(x AS DOUBLE)) e FROM v),
s AS (SELECT q.vec_id query_id, c.vec_id, list_cosine_similarity(q.e, c.e) score FROM n q JOIN n c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_OP10 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 2], ' ') END s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT DISTINCT a node, a root FROM e UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.node),
m AS (SELECT node, min(root) root FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) n_shingles, coalesce(m.root, d.doc_id) component_id, coalesce(m.root, d.doc_id) = d.doc_id kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = d.doc_id
"""

_OP5 = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) i FROM w WHERE len(ws) >= 13)),
f AS (SELECT s, min(doc_id) m FROM g GROUP BY 1),
c AS (SELECT DISTINCT g.doc_id, g.i + k.k p FROM g JOIN f USING (s) CROSS JOIN (SELECT unnest(range(0, 13)) k) k WHERE f.m < g.doc_id),
x AS (SELECT doc_id, list(p) ps FROM c GROUP BY 1),
o AS (SELECT w.doc_id, ws, coalesce(ps, []) ps FROM w LEFT JOIN x USING (doc_id))
SELECT doc_id, len(ws) n_words, len(ps) n_removed, sha256(array_to_string(list_transform(list_sort(list_where(range(1, len(ws) + 1), list_transform(range(1, len(ws) + 1), lambda i: NOT list_contains(ps, i)))), lambda i: ws[i]), ' ')) kept_sha256 FROM o
"""

ORACLES = {"op2_nearest": _OP2, "op5_substrings": _OP5, "op7_revisits": warc.ORACLE, "op10_near_duplicates": _OP10, "op12_phrases": phrases.ORACLE, "op13_manifest": manifest.ORACLE}
