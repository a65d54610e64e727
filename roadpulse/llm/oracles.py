"""SQL of the queries that SQL can express."""

from __future__ import annotations

from roadpulse.llm.oracle_repair import REPAIR
from roadpulse.llm.oracle_variants import VARIANTS

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op12_conversation_repair": REPAIR,
    "op13_spelling_variants": VARIANTS,
    "op11_lattice_near_dedup": """
        WITH RECURSIVE rows AS (
            SELECT row_number() OVER () AS row_id, vec_id, label, CAST(embedding AS DOUBLE[]) AS v,
                   label IS NOT NULL AND len(list_filter(v, lambda x: isfinite(x))) = len(v) AND len(list_filter(v, lambda x: x <> 0)) > 0 AS sound
            FROM embeddings),
        links AS (
            SELECT x.row_id AS a, y.row_id AS b FROM rows x JOIN rows y ON x.label = y.label AND len(x.v) = len(y.v) AND x.row_id <> y.row_id
            WHERE x.sound AND y.sound AND CASE WHEN x.sound AND y.sound THEN list_cosine_similarity(x.v, y.v) >= 0.93 ELSE false END),
        reached(a, b) AS (SELECT row_id, row_id FROM rows UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
        least AS (SELECT reached.a, min(vec_id) AS component_id FROM reached JOIN rows ON rows.row_id = reached.b GROUP BY reached.a),
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
        FROM rows JOIN least ON least.a = row_id LEFT JOIN counts ON counts.a = row_id""",
    "op6_url_filter": """
        WITH urls AS (
            SELECT row_number() OVER () AS row_id, page_id,
                   CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
        cut AS (
            SELECT row_id, page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, rest FROM urls),
        named AS (
            SELECT row_id, page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path
            FROM cut),
        rules(rule_verdict, h, p) AS (
            VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
        best AS (
            SELECT row_id, h || p AS rule, rule_verdict,
                   row_number() OVER (PARTITION BY row_id ORDER BY length(h || p) DESC, length(h) DESC) AS place
            FROM named JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
        SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE
            WHEN regexp_matches(host, '(^|[.])(spam-farm|cheap-pills)[.]example[.](com|org)$') THEN 'block' ELSE 'allow' END) AS verdict
        FROM named LEFT JOIN best ON named.row_id = best.row_id AND place = 1""",
    "op8_decontamination": rf"""
        WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, least(len(w), 13) AS l, array_to_string(w[i : i + 12], ' ') AS s
            FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM items WHERE len(w) > 0)),
        lengths AS (SELECT DISTINCT l FROM windows),
        docs AS (SELECT row_number() OVER () AS row_id, doc_id, {_WORDS} AS w FROM documents),
        places AS (
            SELECT row_id, l, i, array_to_string(w[i : i + l - 1], ' ') AS s
            FROM (SELECT row_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM docs, lengths WHERE len(w) >= l)),
        found AS (SELECT row_id, item_id, l, i FROM places JOIN windows USING (l, s)),
        hits AS (
            SELECT row_id, count(DISTINCT spot) AS n_hit
            FROM (SELECT row_id, unnest(range(i, i + l)) AS spot FROM found) GROUP BY row_id),
        listed AS (
            SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
            FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY row_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
        FROM docs LEFT JOIN hits USING (row_id) LEFT JOIN listed USING (row_id)""",
    "op9_warc": """
        WITH sized AS (SELECT page_id, coalesce(html, '') AS body, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
        kept AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS best, count(*) OVER (PARTITION BY body) AS n FROM sized),
        told AS (SELECT *, payload_bytes >= 1000 AND n > 1 AND page_id <> best AS again FROM kept)
        SELECT page_id, payload_bytes, sha1(body) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN again THEN best END AS refers_to
        FROM told""",
}
