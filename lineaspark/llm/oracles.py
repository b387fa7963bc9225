"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .chat_format import CONTROLS
from .license_scan import sql as license_sql

_WORDS = r"regexp_extract_all(coalesce(\"text\", ''), '[^\x20\x09-\x0D]+')".replace("\\\"", '"')

_LOWER = """translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""

OP4 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(len(ws), 3) - 1], ' ') AS s FROM w, unnest(generate_series(1, greatest(len(ws) - 2, 1))) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS (SELECT u, v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL) JOIN n na ON na.doc_id = u JOIN n nb ON nb.doc_id = v WHERE 100 * k >= 85 * (na.n + nb.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.v FROM reach r JOIN link l ON l.u = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)"""

OP13 = rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT r, array_to_string(ws[i:i + least(len(ws), 5) - 1], ' ') AS s FROM w, unnest(generate_series(1, greatest(len(ws) - 4, 1))) t(i) WHERE len(ws) > 0),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
link AS (SELECT u, v FROM (SELECT a.r AS u, b.r AS v, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.r <> b.r GROUP BY ALL) JOIN n na ON na.r = u JOIN n nb ON nb.r = v WHERE 100 * k >= 80 * (na.n + nb.n - k)),
reach AS (SELECT r AS a, r AS b FROM w UNION SELECT x.a, l.v FROM reach x JOIN link l ON l.u = x.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (r) JOIN (SELECT a AS r, min(w.doc_id) AS component_id FROM reach JOIN w ON w.r = reach.b GROUP BY a) c USING (r)"""

OP6 = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM w, unnest(generate_series(1, len(ws) - 34)) t(i)),
cov AS (SELECT DISTINCT r, unnest(generate_series(i, i + 34)) AS i FROM s SEMI JOIN (SELECT h FROM s GROUP BY h HAVING count(*) > 1) USING (h)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS k FROM (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w) ANTI JOIN cov USING (r, i) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(c, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT r, count(*) AS c FROM cov GROUP BY r) USING (r) LEFT JOIN kept USING (r)"""




def op11(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Plain assignment of every part to every entry, round by round."""
    squares = "list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, e.v) + list_inner_product(e.v, e.v)"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT r, part, arg_min(entry, d * {entries} + entry) AS entry, min(d) AS d
  FROM (SELECT p.r, p.part, e.entry, {squares} AS d FROM p JOIN e{r} e USING (part)) GROUP BY r, part)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT part, entry, list(m ORDER BY i) AS v FROM (SELECT part, entry, i, floor(sum(x) / count(*)) AS m
  FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM p JOIN a{r} USING (r, part)) GROUP BY part, entry, i) GROUP BY part, entry),
e{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, e.v) AS v FROM e{r} e LEFT JOIN m{r} m USING (part, entry))""")
    steps = ",\n".join(steps)
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS v FROM kept, range({parts}) t(part)),
e0 AS MATERIALIZED (SELECT part, r - 1 AS entry, v FROM p WHERE r <= {entries}),
{steps},
c AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
book AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS s FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM kept JOIN c USING (r), book"""


OP12 = rf"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
w AS (SELECT true AS own, row_number() OVER () AS r, doc_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL SELECT false, 0, 0, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
b AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT))), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS b
  FROM (SELECT DISTINCT w, hex(encode(w)) AS h FROM w), t),
n AS (SELECT b, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM w JOIN b USING (w) GROUP BY b),
g AS (SELECT b, floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (sum(s) OVER () + 10000) / (CAST(s + 1 AS DOUBLE) * (sum(t) OVER () + 10000)))) AS gain FROM n),
f AS (SELECT r, count(*) AS n, sum(gain) AS weight FROM w JOIN b USING (w) JOIN g USING (b) WHERE own GROUP BY r),
d AS (SELECT doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS draw
  FROM (SELECT row_number() OVER () AS r, doc_id FROM documents) LEFT JOIN f USING (r)),
k AS (SELECT *, weight + draw AS score, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + draw DESC, doc_id) END AS place FROM d)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM d WHERE n_features >= 20) * 10 // 100 THEN place END AS rank FROM k"""


def op3() -> str:
    """Turns and losses as they are; the formatted length from the template's frames and the escaped texts."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    escaped = lambda x: f"replace({x}, chr(92), chr(92) || chr(92))"

    def length(x: str) -> str:
        out = f"length({escaped(x)})"
        for k in CONTROLS:
            out += f" + (length({x}) - length(replace({x}, {quote(k)}, ''))) // {len(k)}"
        return out

    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce("text", '') AS x FROM conversations
  UNION ALL SELECT -1, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, role, x)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(x) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN x END, '' ORDER BY turn NULLS FIRST, role, x), '')) AS loss_sha256,
  CAST(3 + sum({length("x")} + CASE WHEN role = 'user' THEN 13 WHEN role = 'assistant' THEN 4 ELSE 18 + {length("role")} END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": op3(), "op4_minhash_dedup": OP4, "op5_license_scan": license_sql(), "op6_substring_dedup": OP6, "op11_vector_codes": op11(), "op12_resampling": OP12, "op13_ngram_join": OP13}
