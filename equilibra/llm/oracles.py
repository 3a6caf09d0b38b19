"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from equilibra.llm.known_licences import TEXTS, WHOLE
from equilibra.llm.licences import SPELLINGS

_TOPK = """
WITH w AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)::BIGINT) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM w q JOIN w c ON c.vec_id <> q.vec_id AND len(c.w) = len(q.w)
  WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

_CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g'))
      + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + length('<|im_start|>') + length('<|im_end|>') + 2) AS chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM g
"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    # RE2: (?m) anchors match at line breaks as in the other engine
    out = f"lower(coalesce({text}, ''))"
    out = (f"regexp_replace({out}, '(?m)^[\\x20\\x09*#/;%!-]*(?:copyright|\\(c\\)|©)"
           "(?:[\\x20\\x09]+(?:copyright|\\(c\\)|©|[0-9])|[\\x20\\x09]*$)[^\\n]*$', ' ', 'g')")
    out = f"regexp_replace({out}, '(?m)^[\\x20\\x09*#/;%!-]*all rights reserved\\.?[\\x20\\x09]*$', ' ', 'g')"
    for a, b in SPELLINGS:
        out = f"replace({out}, {_q(a)}, {_q(b)})"
    return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _paragraphs(rows: str, key: str) -> str:
    """(key, p, k, n) of the canonical paragraphs of ``rows`` (key, text): the k-th of n."""
    return f"""SELECT {key}, p, row_number() OVER (PARTITION BY {key} ORDER BY g) AS k, count(*) OVER (PARTITION BY {key}) AS n FROM (
    SELECT {key}, g, string_agg(c, ' ' ORDER BY i) AS p FROM (
      SELECT *, sum(CASE WHEN c = '' THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY i) AS g FROM ({_lines(rows, key)}))
    WHERE c <> '' GROUP BY {key}, g)"""


def _lines(rows: str, key: str) -> str:
    return f"""SELECT {key}, i, {_canonical('line')} AS c FROM (
      SELECT {key}, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM {rows})"""


# lines and runs of paragraphs by joins
_LICENSE = f"""
WITH t AS (SELECT * FROM (VALUES {', '.join(f'({i}, {_q(a)}, {_q(b)})' for i, (a, b) in enumerate(TEXTS))}) v(id, license, text)),
tp AS ({_paragraphs('t', 'id')}),
e AS (
  SELECT t.license, max(CASE WHEN k = 1 THEN sha256(p) END) AS head, max(n) AS n, sha256(string_agg(p, ' ' ORDER BY k)) AS digest
  FROM tp JOIN t USING (id) GROUP BY id, t.license
  UNION ALL SELECT * FROM (VALUES {', '.join(f'({_q(a)}, {_q(h)}, {n}, {_q(d)})' for a, h, n, d in WHOLE)})),
k AS (SELECT digest, min(license) AS license FROM e GROUP BY digest),
h AS (SELECT DISTINCT head, n FROM e),
d AS (SELECT doc_id, coalesce(text, '') AS text, sha256({_canonical('text')}) AS digest FROM documents),
dp AS ({_paragraphs('d', 'doc_id')}),
r AS (
  SELECT a.doc_id, sha256(string_agg(b.p, ' ' ORDER BY b.k)) AS digest
  FROM dp a JOIN h ON h.head = sha256(a.p) JOIN dp b ON b.doc_id = a.doc_id AND b.k >= a.k AND b.k < a.k + h.n
  GROUP BY a.doc_id, a.k, h.n),
l AS (
  SELECT doc_id, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS line_licenses
  FROM (SELECT doc_id, sha256(c) AS digest FROM ({_lines('d', 'doc_id')}) WHERE c <> '' UNION ALL SELECT doc_id, digest FROM r) x
  JOIN k USING (digest) GROUP BY doc_id)
SELECT d.doc_id, d.digest, k.license, coalesce(l.line_licenses, '') AS line_licenses
FROM d LEFT JOIN k ON k.digest = d.digest LEFT JOIN l ON l.doc_id = d.doc_id
"""

# the mix by sorting: running sums in order of draw stand in for the nested histograms
_MIX = r"""
WITH d AS (
  SELECT doc_id, source, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS draw,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w,
             source_size * 3.0::DOUBLE AS lim FROM s),
o AS (SELECT *, sum(source_size) OVER () ::DOUBLE AS total, sum(w) OVER () AS all_w,
             sum(lim) OVER r - lim AS lim_before, sum(w) OVER r - w AS w_before
      FROM w WINDOW r AS (ORDER BY lim / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, lim_before + lim / w * (all_w - w_before) <= total AS filled FROM o),
x AS (SELECT *, total - sum(CASE WHEN filled THEN lim ELSE 0 END) OVER () AS rest,
             sum(CASE WHEN filled THEN 0 ELSE w END) OVER () AS rest_w FROM f),
t AS (SELECT source, source_size, CASE WHEN filled THEN lim ELSE w * (rest / rest_w) END AS target FROM x),
g AS (SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS BIGINT) AS copies FROM t),
h AS (SELECT source, draw, sum(size) AS mass, sum(sum(size)) OVER (PARTITION BY source ORDER BY draw) AS upto
      FROM d GROUP BY source, draw)
SELECT d.doc_id, d.size, g.source_size, g.target,
       CAST(d.size * (g.copies + CASE WHEN 2 * (h.upto - h.mass) + h.mass <= 2 * (g.target - g.copies * g.source_size)
                                       AND g.target - g.copies * g.source_size > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
JOIN h ON h.source IS NOT DISTINCT FROM d.source AND h.draw = d.draw
"""

# units as a list; the cuts slice it
_FILL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u
  FROM documents),
c AS (
  SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
           OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
         WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS pre, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS mid,
         array_to_string(u[greatest(a, b) + 1:n], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

# every order played out step by step; no coalitions
_AUDIT = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(k.good, 0) AS good, coalesce(k.toxic, 0) AS toxic,
    (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails
  FROM t LEFT JOIN k ON k.doc_id = t.doc_id),
h AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, substr(filter_order, CAST(i AS INTEGER), 1) AS own,
             substr(filter_order, 1, CAST(i AS INTEGER) - 1) AS earlier FROM o, range(1, 6) r(i)),
x AS (
  SELECT part, filter_order, step, own, n, good, toxic, contains(fails, own) AS hit, fails = own AS only_this,
         translate(fails, earlier, '') <> fails AS gone
  FROM h, s),
g AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant, sum(CASE WHEN only_this THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND hit THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND hit THEN toxic ELSE 0 END) AS toxic_lost
  FROM x GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM g
"""

SQL: dict[str, str] = {"op5_block_topk": _TOPK, "op7_chat_format": _CHAT, "op8_license_scan": _LICENSE, "op10_mixing": _MIX,
                       "op12_fill_middle": _FILL, "op13_filter_audit": _AUDIT}
