"""SQL counterparts, for DuckDB, of the registered queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {
    "op8_benchmark_decontamination": f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
items AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
cut AS (SELECT item_id, w, least(13, len(w)) AS size FROM items WHERE len(w) > 0),
windows AS (
    SELECT DISTINCT item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
    FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM cut)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
    SELECT r, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
    FROM (SELECT r, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)),
hits AS (SELECT r, i, size, item_id FROM places JOIN windows USING (size, win)),
spots AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT r, i, size FROM hits)) GROUP BY r),
found AS (
    SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
    FROM (SELECT DISTINCT r, item_id::VARCHAR AS name FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM docs LEFT JOIN spots USING (r) LEFT JOIN found USING (r)
""",
    "op4_warc_bundles": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, p.digest AS payload_digest, CASE WHEN first != page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first != page_id THEN first END AS refers_to
FROM p LEFT JOIN g ON p.digest = g.digest AND n >= 100
""",
    "op6_temperature_mixing": """
WITH RECURSIVE r AS (SELECT doc_id, source, strlen(coalesce(text, '')) // 4 + 1 AS tokens FROM documents),
s AS (SELECT source, sum(tokens)::BIGINT AS source_tokens FROM r GROUP BY source),
t AS (SELECT sum(source_tokens)::BIGINT AS total, count(*) AS sources FROM s),
l AS (SELECT source, source_tokens, ln(source_tokens / total::DOUBLE) AS log_p FROM s, t),
e AS (
    SELECT 0 AS k, 0::DOUBLE AS lo, 1::DOUBLE AS hi
    UNION ALL
    SELECT k + 1, CASE WHEN flat THEN mid ELSE lo END, CASE WHEN flat THEN hi ELSE mid END
    FROM (
        SELECT k, lo, hi, (lo + hi) / 2 AS mid,
            (SELECT ln(sum(exp(log_p * ((lo + hi) / 2)))) - sum(exp(log_p * ((lo + hi) / 2)) * log_p * ((lo + hi) / 2)) / sum(exp(log_p * ((lo + hi) / 2)))
                > ln(count(*)::DOUBLE) * 0.95 FROM l) AS flat
        FROM e WHERE k < 40)),
m AS (
    SELECT 0 AS k, 0::DOUBLE AS lo, 1::DOUBLE AS hi
    UNION ALL
    SELECT k + 1, CASE WHEN flat THEN mid ELSE lo END, CASE WHEN flat THEN hi ELSE mid END
    FROM (
        SELECT k, lo, hi, (lo + hi) / 2 AS mid,
            (SELECT max(exp(log_p * ((lo + hi) / 2 - 1))) / sum(exp(log_p * ((lo + hi) / 2))) > 4 FROM l) AS flat
        FROM m WHERE k < 40)),
x AS (SELECT round(greatest((SELECT max(hi) FROM e WHERE k = 40), (SELECT max(hi) FROM m WHERE k = 40)), 9) AS x),
w AS (SELECT source, source_tokens, round(exp(log_p * x) / (SELECT sum(exp(log_p * x)) FROM l, x) * total)::BIGINT AS quota FROM l, x, t),
q AS (SELECT *, quota // source_tokens AS epochs FROM w),
c AS (SELECT doc_id, r.source, tokens, source_tokens, quota, unnest(range(0, epochs + 1)) AS epoch FROM r JOIN q ON r.source IS NOT DISTINCT FROM q.source),
d AS (
    SELECT *, (('0x' || substr(md5('mix:' || epoch || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS draw,
        (('0x' || substr(md5('mix:place:' || epoch || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS place
    FROM c),
o AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source, epoch ORDER BY draw, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d)
SELECT doc_id, source, epoch::INTEGER AS epoch, tokens::BIGINT AS tokens,
    floor((epoch * source_tokens + before) * 64 / quota::DOUBLE)::INTEGER AS block, place
FROM o WHERE epoch * source_tokens + before + tokens <= quota
""",
    "op9_reply_tree_chats": r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
    SELECT *, length(regexp_replace(replace(text, '\', '\\'),
            '(<|\[)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])', '\1\\\2', 'g')) AS n,
        length(regexp_replace(replace(role, '\', '\\'),
            '(<|\[)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])', '\1\\\2', 'g'))
        + length(role) - length(replace(role, chr(10), '')) AS n_role
    FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(n + n_role + 24)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op7_embedding_near_duplicates": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id != b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
c AS (SELECT vec_id, vec_id AS r FROM v UNION SELECT c.vec_id, l.b FROM c JOIN l ON c.r = l.a),
m AS (SELECT vec_id, min(r) AS component_id FROM c GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN n USING (vec_id)
""",
    "op13_filter_interactions": r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM t),
l AS (SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
    SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
        100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
        least IS NOT NULL AND (doc_id IS NULL OR least < doc_id) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
    FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
    SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p JOIN x q ON q.x != p.x JOIN x r ON r.x NOT IN (p.x, q.x)
    JOIN x s ON s.x NOT IN (p.x, q.x, r.x) JOIN x t ON t.x NOT IN (p.x, q.x, r.x, s.x)),
k AS (
    SELECT m.*, filter_order, least(CASE WHEN a THEN strpos(filter_order, 'A') ELSE 9 END, CASE WHEN b THEN strpos(filter_order, 'B') ELSE 9 END,
        CASE WHEN c THEN strpos(filter_order, 'C') ELSE 9 END, CASE WHEN d THEN strpos(filter_order, 'D') ELSE 9 END,
        CASE WHEN e THEN strpos(filter_order, 'E') ELSE 9 END) AS gone
    FROM m, o),
s AS (
    SELECT *, CASE letter WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fails
    FROM (SELECT k.*, step, substr(filter_order, step, 1) AS letter FROM k, (SELECT unnest(range(1, 6)) AS step))),
g AS (
    SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (gone > step), 0) AS kept, coalesce(sum(n) FILTER (gone = step), 0) AS removed,
        coalesce(sum(n) FILTER (fails AND gone < step), 0) AS redundant,
        coalesce(sum(n) FILTER (fails AND a::INT + b::INT + c::INT + d::INT + e::INT = 1), 0) AS unique_fails,
        coalesce(sum(good) FILTER (gone = step), 0) AS good_lost, coalesce(sum(toxic) FILTER (gone = step), 0) AS toxic_lost
    FROM s GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM g
""",
}
