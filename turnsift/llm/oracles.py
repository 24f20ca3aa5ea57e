"""DuckDB SQL for the queries that SQL can express on whole tables.  The others are held
against brute force in tests/llm."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, ws FROM w WHERE len(ws) >= 20),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS n FROM p),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM f WHERE n > 1),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM w),
y AS (SELECT x.doc_id, count(*) AS n_words, count(r.k) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY x.k) FILTER (WHERE r.k IS NULL), '') AS kept
      FROM x LEFT JOIN r ON r.doc_id = x.doc_id AND r.k = x.k GROUP BY 1)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN y USING (doc_id)
"""

OP3 = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(turn, -1), coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT conv_id, max(i) FILTER (WHERE role = 'assistant') AS last_i FROM t GROUP BY 1),
b AS (SELECT a.conv_id, last_i, text AS answer FROM a JOIN t ON t.conv_id = a.conv_id AND t.i = a.last_i),
c AS (SELECT *, coalesce(lead(answer) OVER (ORDER BY conv_id), first_value(answer) OVER (ORDER BY conv_id)) AS following FROM b),
d AS (SELECT conv_id, i, role, text, CASE WHEN i = last_i THEN following ELSE text END AS other FROM t JOIN c USING (conv_id)),
n AS (SELECT conv_id, coalesce(min(i) FILTER (WHERE text <> other) - 1, count(*)) AS n FROM d GROUP BY 1),
e AS (SELECT conv_id, i, n, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS x, '<|' || role || '|>' || chr(10) || other || '<|end|>' || chr(10) AS y, length(role) + 5 AS head FROM d JOIN n USING (conv_id)),
g AS (SELECT *, sum(CASE WHEN i > n THEN length(x) ELSE 0 END) OVER w AS xs, sum(CASE WHEN i > n THEN length(y) ELSE 0 END) OVER w AS ys FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY i))
SELECT conv_id AS pair_id, CAST(any_value(n) AS INTEGER) AS n_prompt_turns, coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE i <= n), '') AS prompt,
 coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE i > n), '') AS chosen,
 coalesce(string_agg((xs - length(x) + head) || ':' || xs, ',' ORDER BY i) FILTER (WHERE i > n AND role = 'assistant'), '') AS chosen_mask,
 coalesce(string_agg(y, '' ORDER BY i) FILTER (WHERE i > n), '') AS rejected,
 coalesce(string_agg((ys - length(y) + head) || ':' || ys, ',' ORDER BY i) FILTER (WHERE i > n AND role = 'assistant'), '') AS rejected_mask
FROM g GROUP BY 1
"""

OP5 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN z a ON a.doc_id = x JOIN z b ON b.doc_id = y WHERE 100 * common >= 90 * (a.n + b.n - common)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT w.doc_id, coalesce(z.n, 0) AS n_shingles, c AS component_id FROM w LEFT JOIN z USING (doc_id) JOIN (SELECT x, min(y) AS c FROM r GROUP BY 1) q ON q.x = w.doc_id
"""

_WORDS6 = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6 = rf"""
WITH b AS (SELECT item_id, {_WORDS6} AS ws FROM benchmark),
m AS (SELECT item_id, least(10, len(ws)) AS m, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i, ws FROM b WHERE len(ws) > 0),
q AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS win FROM m),
w AS (SELECT doc_id, {_WORDS6} AS ws FROM documents),
d AS (SELECT doc_id, k.m, unnest(range(1, len(ws) - k.m + 2)) AS i, ws FROM w, (SELECT DISTINCT m FROM q) k WHERE len(ws) >= k.m),
h AS (SELECT doc_id, d.m, i, item_id FROM (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS win FROM d) d JOIN q ON q.m = d.m AND q.win = d.win),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY 1),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id)
"""

_LEAF = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}"))
_STEP = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))"
#: 2 divides the CRC-32 if its complement is odd.
_BENDS = f"list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: {_STEP}) % 2 = 1"
_KIDS = "string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos {} a.pos)"


def _siblings(nodes: str) -> str:
    return f"""SELECT a.tree, a.level, a.pos, coalesce({_KIDS.format("<")}, '') AS l, coalesce({_KIDS.format(">")}, '') AS r
  FROM {nodes} a JOIN {nodes} b ON a.tree = b.tree AND a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.level < (SELECT max(level) FROM {nodes} c WHERE c.tree = a.tree) GROUP BY 1, 2, 3"""


_UP = "SELECT tree, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS m FROM {0}) WHERE m > 1 GROUP BY tree, level, pos // 3"
_FOLD = "SELECT id, f.tree, f.level + 1, f.pos // 3, proof || l || r, sha256(l || h || r) FROM {0} f JOIN {1} s ON s.tree = f.tree AND s.level = f.level AND s.pos = f.pos"
OP11 = f"""
WITH RECURSIVE a AS (SELECT row_number() OVER () AS id, doc_id, source, sha256({_LEAF.format(text="text")}) AS leaf, CASE WHEN {_BENDS} THEN sha256({_LEAF.format(text="replace(text, chr(10), '')")}) END AS bent FROM documents),
d AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM a),
n(tree, level, pos, h) AS (SELECT tree, 0, pos, leaf FROM d UNION ALL {_UP.format("n")}),
u AS (SELECT tree, arg_max(h, level) AS subroot FROM n GROUP BY 1),
t(tree, level, pos, h) AS (SELECT -1, 0, tree, subroot FROM u UNION ALL {_UP.format("t")}),
ns AS ({_siblings("n")}),
ts AS ({_siblings("t")}),
f(id, tree, level, pos, proof, h) AS (SELECT id, tree, 0, pos, '', coalesce(bent, leaf) FROM d UNION ALL {_FOLD.format("f", "ns")}),
g(id, tree, level, pos, proof, h) AS (SELECT id, -1, 0, arg_max(tree, level), arg_max(proof, level), arg_max(h, level) FROM f GROUP BY 1 UNION ALL {_FOLD.format("g", "ts")}),
k AS (SELECT id, arg_max(proof, level) AS proof, arg_max(h, level) AS folded_root FROM g GROUP BY 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM d JOIN u USING (tree) JOIN k USING (id), (SELECT arg_max(h, level) AS root FROM t)
"""

_FAR = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _op12(rounds: int = 6) -> str:
    nearest = "a{0} AS MATERIALIZED (SELECT q.vec_id, q.p, any_value(q.part) AS part, min(struct_pack(d := " + _FAR.format("q.part", "b.part") + ", e := b.e)) AS m FROM q JOIN b{0} b ON b.p = q.p GROUP BY 1, 2)"
    update = """c{0} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS part FROM (SELECT p, m.e AS e, i, count(*) AS n, sum(part[i]) AS s FROM (SELECT p, m, part, unnest(range(1, len(part) + 1)) AS i FROM a{0}) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(c.part, b.part) AS part FROM b{0} b LEFT JOIN c{0} c ON c.p = b.p AND c.e = b.e)"""
    steps = ",\n".join(x for k in range(rounds) for x in (nearest.format(k), update.format(k, k + 1)))
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS part FROM v, range(8) r(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, part FROM q WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16)),
{steps},
{nearest.format(rounds)},
o AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN v USING (vec_id), h
"""


OP12 = _op12()
ORACLE_SQL = {"op1_substring_dedup": OP1, "op3_preference": OP3, "op5_jaccard_join": OP5, "op6_decontamination": OP6, "op11_merkle": OP11, "op12_vector_codes": OP12}
