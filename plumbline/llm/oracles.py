"""DuckDB SQL for the queries that SQL can express."""

ORACLES = {
    "op3_warc": """
        WITH hashed AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), named AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM hashed
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN first_page END AS refers_to
        FROM named
    """,
    "op4_neighbours": """
        WITH vectors AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, x -> x <> 0)) > 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v) AS score
            FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op11_trie": """
        WITH RECURSIVE turns AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
            FROM conversations WHERE conv_id IS NOT NULL
        ), crc AS (  -- a bit a step; the next byte comes in at every eighth
            SELECT conv_id, CAST(conv_id AS VARCHAR) AS digits, 0 AS step, 4294967295::BIGINT AS x FROM (SELECT DISTINCT conv_id FROM turns)
            UNION ALL
            SELECT conv_id, digits, step + 1, CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END
            FROM (
                SELECT conv_id, digits, step,
                       CASE WHEN step % 8 = 0 THEN xor(x, CAST(ascii(substr(digits, step // 8 + 1, 1)) AS BIGINT)) ELSE x END AS y
                FROM crc WHERE step < 8 * length(digits)
            )
        ), ids AS (
            SELECT conv_id, conv_id - conv_id % 5 AS lender, xor(x, 4294967295::BIGINT) % 9 AS h FROM crc WHERE step = 8 * length(digits)
        ), spoken AS (
            SELECT i.conv_id, 0 AS part, t.place, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.lender AND t.place <= i.h
            UNION ALL
            SELECT i.conv_id, 1, t.place, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.place > i.h
        ), placed AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth, octet_length(encode(text)) AS bytes,
                   sha256(CAST(octet_length(encode(role)) AS VARCHAR) || ':' || role || text) AS said
            FROM spoken
        ), paths AS (
            SELECT conv_id, depth, bytes, sha256(string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM placed
            UNION ALL
            SELECT conv_id, 0, 0, 'root' FROM ids
        ), steps AS (
            SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent,
                   depth = max(depth) OVER (PARTITION BY conv_id) AS at_end
            FROM paths
        ), nodes AS (
            SELECT node, any_value(depth) AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
                   (count(*) - 1) * any_value(bytes) AS saved,
                   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE at_end), '')) AS ends_sha256
            FROM steps GROUP BY node
        ), children AS (
            SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
        ), counted AS (
            SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (node)
        ), within AS (
            SELECT DISTINCT a.node AS top, b.node FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND a.depth <= b.depth
        ), sums AS (
            SELECT w.top AS node, count(*) FILTER (WHERE c.n_children = 0) AS n_leaves, CAST(sum(c.saved) AS BIGINT) AS saved_tokens
            FROM within w JOIN counted c USING (node) GROUP BY w.top
        )
        SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves,
               s.saved_tokens, c.ends_sha256
        FROM counted c JOIN sums s USING (node) LEFT JOIN nodes p ON c.parent = p.node
    """,
}
