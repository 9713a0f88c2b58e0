"""DuckDB SQL of the exact text and vector queries, by plain comparison of everything with everything."""

REACH = """,
r(a, b) AS (SELECT DISTINCT id, id FROM every UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS root FROM r GROUP BY a)"""

NEAR_DOCUMENTS = (
    """WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
every AS (SELECT doc_id AS id FROM documents)"""
    + REACH
    + """
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id FROM documents d JOIN c ON d.doc_id = c.a LEFT JOIN n USING (doc_id)"""
)

NEAR_VECTORS = (
    """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
every AS (SELECT vec_id AS id FROM embeddings)"""
    + REACH
    + """
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, c.root AS component_id, v.vec_id = c.root AS kept FROM v JOIN c ON v.vec_id = c.a"""
)

FILL_IN_MIDDLE = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS c2, CAST('0x' || h[17:24] AS BIGINT) % 100 AS u3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS u4 FROM d),
f AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR u3 >= 90 THEN 'plain' WHEN u4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def manifest(levels: int = 9, over: int = 4) -> str:
    """Hash trees with up to 8^levels leaves each and 8^over trees; a level whose tree has one node passes it on."""
    fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)")
    said = lambda f: f"coalesce(CAST(octet_length(encode({f})) AS VARCHAR) || ':' || {f}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(said(f) for f in (*fields, text)) + ")"
    shift = "list_reduce(list_prepend(xor({c}, {b}), range(8)), lambda x, _: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, b: {shift.format(c='c', b='b')}), 4294967295)"
    text = f"CASE WHEN {crc} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    steps = [
        f"""WITH d AS (SELECT doc_id, lang, {leaf('text')} AS leaf, {leaf(text)} AS seen FROM documents),
g0 AS (SELECT coalesce('+' || lang, '') AS g, doc_id, leaf, seen, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
a0 AS (SELECT g, i, leaf AS h, n FROM g0),
t0 AS (SELECT g, i, doc_id, leaf, seen AS f, '' AS pr FROM g0)"""
    ]

    def climb(nodes: str, rows: str, count: int) -> None:
        for k in range(count):
            steps.append(f"""{nodes}p{k} AS (SELECT g, i, n, coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {nodes}{k}),
{nodes}{k + 1} AS (SELECT g, i // 8 AS i, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, CAST(ceil(max(n) / 8.0) AS BIGINT) AS n FROM {nodes}{k} GROUP BY g, i // 8),
{rows}{k + 1} AS (SELECT g, i // 8 AS i, {rows}{k}.* EXCLUDE (g, i, f, pr), CASE WHEN n = 1 THEN f ELSE sha256(b || f || a) END AS f, pr || b || a AS pr FROM {rows}{k} JOIN {nodes}p{k} USING (g, i))""")

    climb("a", "t", levels)
    steps.append(f"""b0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, count(*) OVER () AS n, g AS tree FROM a{levels}),
u0 AS (SELECT 0 AS g, b0.i, doc_id, leaf, b0.h AS subroot, f, pr FROM t{levels} t JOIN b0 ON t.g = b0.tree)""")
    climb("b", "u", over)
    return ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, h AS root, sha256(pr) AS proof_sha256, f AS folded_root, f = h AS verified FROM u{over} JOIN b{over} USING (g, i)"
