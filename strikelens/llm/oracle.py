"""DuckDB SQL for the operators that SQL can express over whole tables."""

from __future__ import annotations

from strikelens.llm import licenses
from strikelens.llm.queries import BLOCK_TOKENS, REPEAT

WORDS = r"[^\x20\x09-\x0D]+"


def _licences() -> str:
    known = ", ".join(f"('{s}', {n})" for s, n in licenses._KNOWN.items())
    told = " OR ".join(f"contains(lower(text), '{s}')" for s in licenses.SIGNS)
    hits, steps = [], []
    for k, (name, ids) in enumerate(licenses.RULES):
        pattern = "u?".join(f"<{i}>" for i in ids)
        hits.append(f"CASE WHEN regexp_matches(l{k}, '{pattern}') THEN '{name}' END")
        steps.append(f"s{k + 1} AS (SELECT *, regexp_replace(l{k}, '{pattern}', '#', 'g') AS l{k + 1} FROM s{k})")
    last = len(licenses.RULES)
    longest = max(map(len, licenses._KNOWN))
    return rf"""
WITH known(s, n) AS (VALUES {known}),
lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS p FROM (
    SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l
    FROM documents WHERE {told})),
bare AS (
  SELECT doc_id, p, regexp_replace(regexp_replace(line, '{licenses.TRAILERS}', ''), '{licenses.LEADERS}', '') AS line FROM lines),
spdx AS (
  SELECT doc_id, p, regexp_replace(CASE WHEN regexp_matches(line, '{licenses.SPDX_LINE}') THEN replace(line, '+', '-or-later') ELSE line END,
    '{licenses.SPDX_LINE}', chr(1) || 'spdx \1' || chr(1), 'g') AS line FROM bare),
alone AS (
  SELECT doc_id, p, CASE WHEN n IS NOT NULL THEN chr(1) || line || chr(1) WHEN trim(line) = '' THEN chr(1) ELSE line END AS line
  FROM (SELECT *, trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')) AS s FROM spdx) LEFT JOIN known USING (s)),
whole AS (SELECT doc_id, string_agg(line, chr(2) ORDER BY p) AS text FROM alone GROUP BY doc_id),
cut AS (
  SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS p FROM (
    SELECT doc_id, string_split(regexp_replace(text, '([.!?;:])[ \t\x02]+', '\1' || chr(1), 'g'), chr(1)) AS l FROM whole)),
plain AS (
  SELECT doc_id, p, trim(regexp_replace(regexp_replace(lower(s), '[^a-z0-9\x02]+', ' ', 'g'), ' ?\x02[ \x02]*', chr(2), 'g'), ' ' || chr(2)) AS s FROM cut),
kept AS (SELECT *, string_split(right(s, {longest + 1}), chr(2)) AS parts FROM plain WHERE s != ''),
tails AS (
  SELECT doc_id, p, i, n FROM (
    SELECT doc_id, p, i, array_to_string(parts[i:], ' ') AS s FROM (SELECT *, unnest(range(2, len(parts) + 1)) AS i FROM kept)) JOIN known USING (s)),
best AS (SELECT doc_id, p, arg_min(n, i) AS n FROM tails GROUP BY doc_id, p),
numbers AS (
  SELECT k.doc_id, k.p, CASE WHEN w.n IS NOT NULL THEN '<' || w.n || '>' WHEN b.n IS NOT NULL THEN 'u<' || b.n || '>' ELSE 'u' END AS said,
    coalesce(w.n, b.n) AS n
  FROM (SELECT doc_id, p, replace(s, chr(2), ' ') AS s FROM kept) k LEFT JOIN known w ON w.s = k.s LEFT JOIN best b ON b.doc_id = k.doc_id AND b.p = k.p),
said AS (
  SELECT doc_id, CASE WHEN count(n) > 0 THEN string_agg(said, '' ORDER BY p) ELSE '' END AS said FROM numbers GROUP BY doc_id),
s0 AS (
  SELECT doc_id, line, line AS l0 FROM (
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(said, ''), '^u+|u+$', '', 'g'), 'u{{3,}}', 'U', 'g'), 'u+', 'u', 'g') AS line
    FROM documents LEFT JOIN said USING (doc_id))),
{", ".join(steps)},
hits AS (SELECT doc_id, unnest(h) AS name, generate_subscripts(h, 1) AS k FROM (SELECT doc_id, [{", ".join(hits)}] AS h FROM s{last})),
named AS (
  SELECT doc_id, string_agg(name, ',' ORDER BY k) AS licenses
  FROM (SELECT doc_id, name, min(k) AS k FROM hits WHERE name IS NOT NULL GROUP BY doc_id, name) GROUP BY doc_id)
SELECT doc_id,
  regexp_replace(regexp_replace(upper(line), '<([0-9]+)>|(U)', '\1\2,', 'g'), ',+$', '') AS sentence_ids,
  coalesce(licenses, '') AS licenses,
  (length(l{last}) - length(replace(l{last}, '<', '')))::BIGINT AS unmatched
FROM s{last} LEFT JOIN named USING (doc_id)
"""


def _order(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT"


_MIXING = f"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, sum(len(regexp_extract_all(coalesce(text, ''), '{WORDS}')))::BIGINT AS tokens
  FROM documents GROUP BY doc_id, source),
shares AS (SELECT source, sum(tokens)::BIGINT AS tokens FROM sizes GROUP BY source),
ends AS (SELECT max(tokens)::DOUBLE AS top, min(tokens) / max(tokens)::DOUBLE AS least FROM shares WHERE tokens > 0),
search(lo, hi, least) AS (
  SELECT -1::BIGINT, {(1 << 30) + 1}::BIGINT, least FROM ends
  UNION ALL
  SELECT CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END, least
  FROM (SELECT *, pow(least, mid / {float(1 << 30)} - 1) <= {REPEAT} AS ok
        FROM (SELECT *, (lo + hi) // 2 AS mid FROM search WHERE hi - lo > 1))),
exponent AS (SELECT least(min(hi), {1 << 30}) / {float(1 << 30)} AS a FROM search),
plan AS (
  SELECT source AS of, tokens AS t, CASE WHEN tokens > 0 THEN floor(tokens * pow(tokens / top, a - 1) + 1e-6)::BIGINT ELSE 0 END AS budget
  FROM shares, ends, exponent),
plans AS (
  SELECT of, CASE WHEN t > 0 THEN budget // t ELSE 1 END AS whole, CASE WHEN t > 0 THEN budget % t ELSE 0 END AS rest,
    greatest(1, ceil(t / {BLOCK_TOKENS}.0))::BIGINT AS n_blocks FROM plan),
docs AS (
  SELECT doc_id, source, tokens, whole, rest, coalesce('s' || source, 'null') AS name,
    {_order("'0|block'", "coalesce(doc_id::VARCHAR, 'null')")} % n_blocks AS block
  FROM sizes JOIN plans ON source IS NOT DISTINCT FROM of),
blocks AS (
  SELECT *, {_order("'0|epoch'", "name", "epoch::VARCHAR", "block::VARCHAR")} AS h
  FROM (SELECT name, block, whole, rest, sum(tokens)::BIGINT AS size, unnest(range(0, whole + CASE WHEN rest > 0 THEN 1 ELSE 0 END)) AS epoch
        FROM docs GROUP BY name, block, whole, rest)),
placed AS (
  SELECT name, block, epoch, size, coalesce(sum(size) OVER (PARTITION BY name, epoch ORDER BY h, block
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM blocks),
put AS (SELECT * FROM docs JOIN placed USING (name, block)),
fitting AS (
  SELECT *, place + sum(tokens) OVER (PARTITION BY name, epoch ORDER BY doc_hash RANGE UNBOUNDED PRECEDING) AS upto
  FROM (SELECT *, {_order("'0|doc'", "name", "epoch::VARCHAR", "coalesce(doc_id::VARCHAR, 'null')")} AS doc_hash
        FROM put WHERE epoch = whole AND place < rest AND place + size > rest))
SELECT doc_id, source, epoch::INTEGER AS epoch, block, place FROM put WHERE epoch < whole OR place + size <= rest
UNION ALL
SELECT doc_id, source, epoch::INTEGER, block, place FROM fitting WHERE upto <= rest
"""

_SUBSTRINGS = f"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
windows AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS p FROM words)),
first AS (SELECT h, min(doc_id) AS least FROM windows GROUP BY h),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i
  FROM windows JOIN first USING (h) WHERE least < doc_id),
lists AS (SELECT doc_id, count(*) AS n, list(i) AS l FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words) ANTI JOIN gone USING (doc_id, i)
  GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(l.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM words w LEFT JOIN lists l USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

_TOPK = """
WITH usable AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id != c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
"""

#: The CRC-32 of a conversation's decimal id, bit by bit.
_CRC = """xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], [ascii(d)::BIGINT for d in string_split(conv_id::VARCHAR, '')]),
  lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda k, i: CASE WHEN k & 1 = 1 THEN xor(k >> 1, 3988292384::BIGINT) ELSE k >> 1 END)))"""

_TRIE = f"""
WITH plain AS (
  SELECT conv_id, turn, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS t,
    len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, t) - 1 AS p FROM plain),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM plain)),
joined AS (
  SELECT c.conv_id, o.p, o.t, o.words FROM convs c JOIN ordered o ON o.conv_id = c.base AND o.p < c.h
  UNION ALL
  SELECT c.conv_id, o.p, o.t, o.words FROM convs c JOIN ordered o ON o.conv_id = c.conv_id AND o.p >= c.h),
steps AS (
  SELECT conv_id, words, row_number() OVER w AS d, md5(string_agg(t, ',') OVER (w ROWS UNBOUNDED PRECEDING)) AS node,
    coalesce(md5(string_agg(t, ',') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 'root') AS parent
  FROM joined WINDOW w AS (PARTITION BY conv_id ORDER BY p)
  UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM convs),
nodes AS (
  SELECT node, any_value(parent) AS parent, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(words) AS saved
  FROM steps GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
under AS (
  SELECT s.node, sum(v.saved) AS saved_tokens, sum(CASE WHEN k.node IS NULL THEN 1 ELSE 0 END) AS n_leaves
  FROM nodes v JOIN steps s ON s.conv_id = v.conv_id AND s.d <= v.d LEFT JOIN kids k ON k.node = v.node GROUP BY s.node),
ends AS (
  SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM steps s JOIN (SELECT conv_id, max(d) AS d FROM steps GROUP BY conv_id) USING (conv_id, d) GROUP BY node)
SELECT v.conv_id, v.d::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n::BIGINT AS n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children,
  b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes v LEFT JOIN nodes u ON u.node = v.parent LEFT JOIN kids k ON k.node = v.node
  JOIN under b ON b.node = v.node LEFT JOIN ends e ON e.node = v.node
"""

_WARC = """
WITH records AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
tops AS (SELECT payload_digest, payload_bytes, max(page_id) AS top FROM records WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN top IS NULL OR page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM records LEFT JOIN tops USING (payload_digest, payload_bytes)
"""


def _clusters(k: int = 40, rounds: int = 5) -> str:
    def assigned(centroids: str) -> str:
        gap = "list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        return f"""SELECT i, c, d FROM (
          SELECT i, c, d, row_number() OVER (PARTITION BY i ORDER BY d, c) AS r FROM (SELECT v.i, c.c, {gap} AS d FROM vectors v, {centroids} c))
        WHERE r = 1"""

    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({assigned(f'c{r}')})")
        steps.append(f"""c{r + 1} AS MATERIALIZED (
          SELECT c.c, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN (
            SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM (
              SELECT a.c, j, sum(v.v[j])::BIGINT AS s, count(*) AS n FROM a{r} a JOIN vectors v USING (i), range(1, 65) t(j) GROUP BY a.c, j) GROUP BY c) n
          USING (c))""")
    return f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR) NULLS LAST, v) - 1 AS c, v FROM vectors QUALIFY c < {k}),
{", ".join(steps)},
last AS MATERIALIZED ({assigned(f"c{rounds}")})
SELECT vec_id, last.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY last.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM last JOIN vectors USING (i) JOIN c{rounds} c ON c.c = last.c
"""


ORACLE = {
    "op3_licenses": _licences(),
    "op5_mixing": _MIXING,
    "op6_substrings": _SUBSTRINGS,
    "op8_topk": _TOPK,
    "op11_prefix_trie": _TRIE,
    "op12_warc": _WARC,
    "op13_centroids": _clusters(),
}
