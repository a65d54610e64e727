"""SQL of the spelling query: words, near ones by deleted letters, and the forms they lead to."""

from __future__ import annotations

from roadpulse.llm.oracle_repair import CRC_TABLE, crc

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OCTETS = "list_transform(range(0, strlen(marked)), lambda x: ('0x' || substr(hex(marked), 2 * x + 1, 2))::BIGINT)"

VARIANTS = f"""
        WITH RECURSIVE {CRC_TABLE},
        runs AS (
            SELECT doc_id, run, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS marked
            FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
            WHERE length(run) >= 5 GROUP BY doc_id, run),
        hashed AS (SELECT run, n, {crc(_OCTETS)} AS h FROM runs, crc_table),
        spelled AS (
            SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
        words AS (
            SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        cut AS (
            SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest
            FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
        pairs AS (
            SELECT x.word, y.word AS other, y.n AS other_n FROM cut x JOIN cut y ON x.rest = y.rest AND x.p = y.p AND x.word <> y.word
            UNION SELECT words.word, cut.word, cut.n FROM words JOIN cut ON words.word = cut.rest
            UNION SELECT cut.word, words.word, words.n FROM words JOIN cut ON words.word = cut.rest),
        best AS (
            SELECT word, count(*) AS n_near, list_min(list({{'less': -other_n, 'other': other}})) AS first FROM pairs GROUP BY word),
        formed AS (
            SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -first.less >= 2 * n THEN first.other END AS form,
                   CASE WHEN -first.less >= 2 * n THEN -first.less END AS form_n
            FROM words LEFT JOIN best ON best.word = words.word),
        ways(word, place) AS (
            SELECT word, word FROM formed
            UNION ALL SELECT ways.word, formed.form FROM ways JOIN formed ON formed.word = ways.place WHERE formed.form IS NOT NULL)
        SELECT formed.word, formed.form, ways.place AS root, formed.n, formed.n_near, formed.form_n
        FROM formed JOIN ways ON ways.word = formed.word JOIN formed AS ends ON ends.word = ways.place AND ends.form IS NULL"""
