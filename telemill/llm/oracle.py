"""DuckDB SQL for the queries of the subpackage that SQL can express."""

from __future__ import annotations

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

NEAREST = """
WITH v AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::DOUBLE) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 10
"""

_RULES = """
rules(verdict, host, path) AS (
    VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
)
"""

URLS = f"""
WITH {_RULES}, cut AS (
    SELECT page_id, url,
        translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), {_LOWER}) AS host,
        regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
    FROM pages
), fitted AS (
    SELECT c.page_id, arg_max(r.verdict, length(r.host || r.path)) AS verdict, arg_max(r.host || r.path, length(r.host || r.path)) AS rule
    FROM cut c JOIN rules r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path)
    GROUP BY c.page_id
), named AS (
    SELECT c.*, f.verdict, f.rule, CASE WHEN contains(url, '://') THEN
        regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)\\.([^.]+\\.)', '\\2')
        || regexp_replace(regexp_replace(path, '(/index)?\\.html?$', ''), '/+$', '') END AS plain
    FROM cut c LEFT JOIN fitted f USING (page_id)
), resource AS (
    SELECT plain, bool_or(coalesce(verdict = 'allow', false)) AS allowed, bool_or(coalesce(verdict = 'block', false)) AS blocked
    FROM named WHERE plain IS NOT NULL GROUP BY plain
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN blocked AND NOT allowed THEN 'block' END, 'allow') AS verdict
FROM named LEFT JOIN resource USING (plain)
"""

SIMILAR = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s
    FROM words
), tokens AS (
    SELECT doc_id, unnest(s) AS token, len(s) AS n FROM sets
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k
    FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    GROUP BY ALL
), links AS (
    SELECT a, b FROM common WHERE 100 * k >= 90 * (n + m - k)
), both_ways AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, (SELECT min(r.b) FROM reach r WHERE r.a = s.doc_id) AS component_id FROM sets s
"""

LINKED = f"""
{SIMILAR.rpartition("SELECT s.doc_id")[0]}
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, (SELECT count(*) FROM both_ways l WHERE l.a = s.doc_id) AS n_links,
    (SELECT min(r.b) FROM reach r WHERE r.a = s.doc_id) AS component_id
FROM sets s
"""

#: crc32 of every byte, by its rule
_CRC = """
crc AS (
    SELECT list(list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t
    FROM range(256) AS bytes(n)
)
"""


def _crc32(text: str) -> str:
    """The unsigned crc32 of an ASCII text; needs the table ``crc``."""
    codes = f"list_transform(range(length({text})), lambda k: ascii(substring({text}, k::INTEGER + 1, 1))::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


LEVELS = 5  # levels of parents that are written out: up to 16^5 rows of a source, and as many sources


def _leaf(text: str) -> str:
    values = [f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(values)})"


def _tree(name: str, nodes: str) -> str:
    """CTEs ``{name}0..``: nodes (g, pos, node) of every level, and ``{name}_runs``: what stands under each parent (level, g, up, run)."""
    ctes = [f"{name}0 AS ({nodes})"]
    for k in range(LEVELS):
        ctes.append(
            f"{name}r{k} AS (SELECT {k} AS level, g, pos // 16 AS up, string_agg(node, '' ORDER BY pos) AS run, any_value(n) AS n "
            f"FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}{k}) GROUP BY g, up)"
        )
        ctes.append(f"{name}{k + 1} AS (SELECT g, up AS pos, CASE WHEN n > 1 THEN sha256(run) ELSE run END AS node FROM {name}r{k})")
    union = " UNION ALL ".join(f"SELECT * FROM {name}r{k} WHERE n > 1" for k in range(LEVELS))
    return ",\n".join([*ctes, f"{name}_runs AS ({union})"])


def _paths(name: str, of: str) -> str:
    """Rows of ``of`` (g, pos) with the runs above them: level, what is left and right of their node."""
    return (
        f"SELECT o.g, o.pos, r.level, left(r.run, 64 * (o.pos // (16 ** r.level)::BIGINT % 16)::INTEGER) AS lower, "
        f"substring(r.run, 64 * (o.pos // (16 ** r.level)::BIGINT % 16)::INTEGER + 65) AS upper "
        f"FROM {of} o JOIN {name}_runs r ON o.g IS NOT DISTINCT FROM r.g AND o.pos // (16 ** (r.level + 1))::BIGINT = r.up"
    )


MANIFEST = f"""
WITH {_CRC}, leaves AS (
    SELECT doc_id, source AS g, {_leaf("text")} AS leaf,
        CASE WHEN doc_id IS NOT NULL AND {_crc32("doc_id::VARCHAR")} % 5 = 0 THEN {_leaf(f"translate(text, {_LOWER})")} ELSE {_leaf("text")} END AS claimed
    FROM documents, crc
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
), {_tree("a", "SELECT g, pos, leaf AS node FROM placed")},
subroots AS (SELECT g AS of, node, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos FROM a{LEVELS}),
{_tree("b", "SELECT 0 AS g, pos, node FROM subroots")},
steps AS (
    {_paths("a", "placed")}
    UNION ALL
    SELECT p.g, p.pos, 100 + s.level, s.lower, s.upper
    FROM placed p JOIN subroots r ON p.g IS NOT DISTINCT FROM r.of
    JOIN ({_paths("b", "(SELECT 0 AS g, pos FROM subroots)")}) s ON s.pos = r.pos
), ways AS (
    SELECT g, pos, list({{'lower': lower, 'upper': upper}} ORDER BY level) AS way, string_agg(lower || upper, '' ORDER BY level) AS siblings
    FROM steps GROUP BY g, pos
), proved AS (
    SELECT p.doc_id, p.leaf, r.node AS subroot, (SELECT node FROM b{LEVELS}) AS root, sha256(coalesce(w.siblings, '')) AS proof_sha256,
        list_reduce(list_prepend(p.claimed, list_transform(coalesce(w.way, []), lambda s: s.lower || '|' || s.upper)),
            lambda node, s: sha256(split_part(s, '|', 1) || node || split_part(s, '|', 2))) AS folded_root
    FROM placed p JOIN subroots r ON p.g IS NOT DISTINCT FROM r.of LEFT JOIN ways w ON w.g IS NOT DISTINCT FROM p.g AND w.pos = p.pos
)
SELECT *, folded_root = root AS verified FROM proved
"""

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _way(cost: str, edit: str, rest: str) -> str:
    """A way (ten digits of cost, then the audit) with an edit before it; null where there is none."""
    return f"lpad((left({rest}, 10)::BIGINT + {cost})::VARCHAR, 10, '0') || '{edit}' || substring({rest}, 11)"


def _after(state: int) -> str:
    """The cheapest way from a row on in a state of the grammar, without rows put before it."""
    made, to = ("a", 3) if state == 2 else ("u", 2)
    ways = [
        _way("2", "D", f"w{state}"), f"CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {_way('1 + extra', 'R', f'w{to}')} END",
        f"CASE WHEN fault NOT IN ('blank', 'duplicate') AND initial = '{made}' THEN {_way('extra', 'K', f'w{to}')} END",
    ]
    if state == 0:
        ways.append(f"CASE WHEN fault NOT IN ('blank', 'duplicate') AND initial = 's' THEN {_way('extra', 'K', 'w1')} END")
    return f"least({', '.join(ways)})"


REPAIR = f"""
WITH RECURSIVE {_CRC}, keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id
    FROM conversations
), fated AS (
    SELECT keyed.*, {_crc32("id")} % 20 AS fate FROM keyed, crc
), damaged AS (
    SELECT conv_id AS c, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
        CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
    FROM fated WHERE fate <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos, left(role, 1) AS initial,
        rtrim(text, {_SPACE}) AS body
    FROM damaged
), said AS (
    SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY pos) > 1 THEN 'duplicate'
            WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        lag(initial) OVER (PARTITION BY c ORDER BY pos) || initial AS pair, count(*) OVER (PARTITION BY c) AS n
    FROM placed
), rows_of AS (
    SELECT *, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM said
), found AS (
    SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(fault = 'blank')::BIGINT AS blank,
        count_if(fault = 'duplicate')::BIGINT AS duplicate, count_if(fault = 'truncated')::BIGINT AS truncated,
        count_if(pair NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
    FROM said GROUP BY c
), ways AS (
    SELECT c, max(pos) + 1 AS pos, '0000000000' AS w0, '0000000010II' AS w1, '0000000005I' AS w2, '0000000000' AS w3 FROM said GROUP BY c
    UNION ALL
    SELECT c, pos, least(p0, {_way("5", "I", "p2")}, {_way("10", "II", "p3")}), least(p1, {_way("5", "I", "p2")}, {_way("10", "II", "p3")}),
        least(p2, {_way("5", "I", "p3")}), least(p3, {_way("5", "I", "p2")})
    FROM (
        SELECT w.c, r.pos, {", ".join(f"{_after(s)} AS p{s}" for s in range(4))}
        FROM ways w JOIN rows_of r ON r.c IS NOT DISTINCT FROM w.c AND r.pos = w.pos - 1
    )
), best AS (
    SELECT c, left(w0, 10)::BIGINT AS cost, substring(w0, 11) AS audit FROM ways WHERE pos = 1
), walked AS (
    SELECT c, audit, 1 AS k, 1::BIGINT AS pos, 0 AS state, NULL::VARCHAR AS line FROM best
    UNION ALL
    SELECT w.c, w.audit, w.k + 1, w.pos + CASE WHEN e = 'I' THEN 0 ELSE 1 END,
        CASE WHEN e = 'D' THEN w.state WHEN e = 'K' AND r.initial = 's' THEN 1 WHEN w.state = 2 THEN 3 ELSE 2 END,
        CASE e WHEN 'D' THEN NULL WHEN 'K' THEN r.role || ':' || r.text
            ELSE CASE WHEN w.state = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN e = 'R' THEN r.text ELSE '' END END
    FROM (SELECT *, substring(audit, k, 1) AS e FROM walked) w LEFT JOIN rows_of r ON r.c IS NOT DISTINCT FROM w.c AND r.pos = w.pos
    WHERE w.k <= length(w.audit)
), lines AS (
    SELECT c, string_agg(line, chr(10) ORDER BY k) AS said FROM walked GROUP BY c
), every AS (
    SELECT DISTINCT conv_id FROM conversations
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
    coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM every LEFT JOIN found f ON f.c IS NOT DISTINCT FROM conv_id LEFT JOIN best b ON b.c IS NOT DISTINCT FROM conv_id
LEFT JOIN lines l ON l.c IS NOT DISTINCT FROM conv_id
"""

SQL: dict[str, str] = {
    "op7_pivot_distance_search": NEAREST,
    "op8_redirect_equivalence": URLS,
    "op9_ngram_jaccard_join": SIMILAR,
    "op9_ngram_jaccard_links": LINKED,
    "op11_merkle_manifest": MANIFEST,
    "op12_conversation_repair": REPAIR,
}
