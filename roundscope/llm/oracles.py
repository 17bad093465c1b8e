"""The same results as DuckDB SQL, where SQL can express them on whole tables."""

from __future__ import annotations

_OP2 = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
    SELECT *,
        -- each of \ # < (and : in a role) takes one more character in a formatted text
        4 + length(role) + 2 + length(text) + 8
            + length(role) - length(translate(role, '\#<:', ''))
            + length(text) - length(translate(text, '\#<', '')) AS size
    FROM rows
), placed AS (
    SELECT *,
        sum(size) OVER (PARTITION BY conv_id ORDER BY turn, role, text
            ROWS UNBOUNDED PRECEDING) AS upto,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back
    FROM sized
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
        AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
        FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(coalesce(sum(upto) FILTER (role = 'assistant' OR back = 1), 0) AS BIGINT)
        AS formatted_chars
FROM placed GROUP BY conv_id
"""


_OP11 = r"""
WITH turns AS (
    SELECT conv_id, strlen(coalesce(text, '')) AS size,
        length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '') AS said,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(
            length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')
        )) AS place
    FROM conversations WHERE conv_id IS NOT NULL
), drawn AS (
    -- crc32, bit by bit
    SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(
            string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda crc, byte: list_reduce(
            list_prepend(xor(crc, byte), [0::BIGINT FOR i IN range(8)]),
            lambda r, bit: xor(r >> 1, 3988292384::BIGINT * (r & 1)))
    ), 4294967295::BIGINT) % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
    SELECT d.conv_id, t.place, t.said, t.size
    FROM drawn d JOIN turns t ON t.conv_id = d.base AND t.place <= d.h
    UNION ALL
    SELECT d.conv_id, 1000000 + t.place, t.said, t.size
    FROM drawn d JOIN turns t ON t.conv_id = d.conv_id AND t.place > d.h
), numbered AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth, said, size
    FROM rebuilt
), prefixes AS (
    SELECT conv_id, 0 AS depth, '' AS key, 0 AS size FROM drawn
    UNION ALL
    SELECT conv_id, depth, sha256(string_agg(sha256(said), '') OVER (
        PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING)), size
    FROM numbered
), ends AS (
    SELECT conv_id, max(depth) AS depth FROM prefixes GROUP BY conv_id
), nodes AS (
    SELECT key, p.depth, min(p.conv_id) AS conv_id, count(*) AS n_convs,
        (count(*) - 1) * any_value(size) AS saved,
        sha256(coalesce(string_agg(e.conv_id::VARCHAR, ',' ORDER BY e.conv_id), '')) AS ends_sha256
    FROM prefixes p LEFT JOIN ends e ON e.conv_id = p.conv_id AND e.depth = p.depth
    GROUP BY key, p.depth
), linked AS (
    SELECT n.*, up.key AS parent_key
    FROM nodes n LEFT JOIN prefixes up ON up.conv_id = n.conv_id AND up.depth = n.depth - 1
), children AS (
    SELECT parent_key AS key, count(*) AS n_children FROM linked
    WHERE depth > 0 GROUP BY parent_key
), subtrees AS (
    SELECT up.key, sum(n.saved) AS saved_tokens, count(*) FILTER (c.key IS NULL) AS n_leaves
    FROM nodes n LEFT JOIN children c ON c.key = n.key
    JOIN prefixes up ON up.conv_id = n.conv_id AND up.depth <= n.depth
    GROUP BY up.key
)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs,
    coalesce(c.n_children, 0) AS n_children, s.n_leaves,
    s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM linked n JOIN subtrees s ON s.key = n.key
LEFT JOIN children c ON c.key = n.key
LEFT JOIN nodes up ON up.key = n.parent_key
"""

_OP12 = r"""
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
    FROM documents
), cut AS (
    SELECT doc_id, t, regexp_extract_all(
            t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
        [('0x' || h[8 * i + 1 : 8 * i + 8])::BIGINT FOR i IN range(4)] AS draws
    FROM drawn
), placed AS (
    SELECT *, len(units) AS n,
        least(draws[1] % (n + 1), draws[2] % (n + 1)) AS low,
        greatest(draws[1] % (n + 1), draws[2] % (n + 1)) AS high,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                OR draws[3] % 100 >= 50 THEN 'plain'
            WHEN draws[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM cut
), parts AS (
    SELECT *, array_to_string(units[1 : low], '') AS p,
        array_to_string(units[low + 1 : high], '') AS m,
        array_to_string(units[high + 1 :], '') AS s
    FROM placed
)
SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t
        WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parts
"""


_OP13 = r"""
WITH texts AS (
    SELECT doc_id, length(coalesce(text, '')) AS points,
        regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
    FROM documents
), ranked AS (
    SELECT doc_id, sha256(norm) AS text_sha256,
        row_number() OVER class AS place,
        first_value(doc_id) OVER class AS keep_id,
        count(*) OVER (PARTITION BY norm) AS group_size
    FROM texts
    WINDOW class AS (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked
"""


ORACLES = {
    "op2_chat": _OP2,
    "op11_prefixes": _OP11,
    "op12_middle": _OP12,
    "op13_exact": _OP13,
}
