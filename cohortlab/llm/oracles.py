"""SQL counterparts, run by DuckDB over the same tables, of the queries that SQL can express."""

from __future__ import annotations

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op1_exact_dedup": f"""
        WITH keyed AS (SELECT doc_id, sha256({LOWERED}) AS text_sha256 FROM documents),
        grouped AS (
            SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM keyed GROUP BY text_sha256
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM keyed JOIN grouped USING (text_sha256)
    """,
    "op11_warc": """
        WITH stored AS (
            SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
            FROM pages
        ),
        held AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM stored)
        SELECT page_id, payload_bytes, payload_digest, url,
            CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
        FROM held
    """,
    "op13_phrases": rf"""
        WITH cut AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ),
        words AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM cut),
        totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
        grams AS (
            SELECT lang, 1 AS size, unnest(w) AS phrase FROM words
            UNION ALL
            SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: concat_ws(' ', w[i], w[i + 1]))) FROM words
            UNION ALL
            SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])))
            FROM words
        ),
        f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
        parts AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
        cuts AS (
            SELECT lang, size, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
            FROM (SELECT *, unnest(range(1, size)) AS k FROM parts)
        ),
        scored AS (
            SELECT c.*, x.f AS l, y.f AS r,
                ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
            FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = head JOIN f y ON y.lang = c.lang AND y.phrase = tail
        ),
        least AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ),
        inner_pairs AS (
            SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS longer
            FROM (SELECT *, unnest([1, 2]) AS i FROM parts WHERE size = 3) GROUP BY ALL
        ),
        ranked AS (
            SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
                phrase, a, l, r, n, score
            FROM least JOIN totals USING (lang) LEFT JOIN inner_pairs USING (lang, phrase)
            WHERE longer IS NULL OR 100 * longer < 50 * a
        )
        SELECT * FROM ranked WHERE rank <= 2000
    """,
}
