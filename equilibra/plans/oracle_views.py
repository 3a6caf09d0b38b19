"""Portable SQL for the input views (FIXTURES.md §2) as common table expressions.

The same definitions as :mod:`equilibra.sources.views`, written for a second
SQL engine (DuckDB) that has the driver tables registered as views.  Query
oracles prepend the views they need with :func:`with_views`.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "notes": """
SELECT d.doc_id AS row_id,
  CASE WHEN d.doc_id % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
  concat(CASE WHEN d.doc_id % 2 = 0
              THEN 'Sex:  F. She said her mood is low, the woman is 98 F. '
              ELSE 'Sex:  M. He said his mood is low, the man is with him. ' END,
         CASE WHEN d.doc_id % 7 = 0 THEN 'History of Depression. ' ELSE '' END, d.text) AS text,
  d.lang AS lang,
  CASE WHEN l.quality = 0 THEN 1 ELSE 0 END AS label,
  CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 1 ELSE 0 END AS none_mental
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "features": """
SELECT n.row_id, n.gender, n.label, n.none_mental, e.embedding AS features
FROM notes n JOIN embeddings e ON e.vec_id = n.row_id % (SELECT count(*) FROM embeddings)""",
    "predictions": """
SELECT row_id, fold, embedding, variant, gender, label, probability,
  CASE WHEN probability >= 0.35 THEN 1 ELSE 0 END AS preds
FROM (
  SELECT e.event_id AS row_id, CAST(e.event_id % 5 AS INT) AS fold,
    CASE WHEN e.event_id % 3 = 0 THEN 'emb_a' ELSE 'emb_b' END AS embedding, v.variant AS variant,
    CASE WHEN (e.user_id + v.flip) % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
    CASE WHEN e.event_type IN ('error', 'purchase') THEN 1 ELSE 0 END AS label,
    (e.value + v.flip * (e.event_id % 11)) / (e.value + v.flip * (e.event_id % 11) + 50.0) AS probability
  FROM events e CROSS JOIN (SELECT 'orig' AS variant, 0 AS flip
                            UNION ALL SELECT 'swapped' AS variant, 1 AS flip) v) t""",
    "tokens": """
SELECT doc_id AS row_id, unnest(string_split(text, ' ')) AS word FROM documents""",
    "word_vectors": """
SELECT w.word AS word, e.embedding AS vector
FROM (SELECT word, row_number() OVER (ORDER BY word) - 1 AS k
      FROM (SELECT DISTINCT lower(word) AS word FROM tokens) b
      WHERE length(word) > 0) w
JOIN embeddings e ON e.vec_id = w.k % (SELECT count(*) FROM embeddings)
WHERE w.k % 3 <> 0""",
}

# a view may use earlier ones
DEPENDS = {"features": ["notes"], "word_vectors": ["tokens"]}


def with_views(body: str, *names: str) -> str:
    """``WITH <views> <body>``; ``body`` may start with its own CTEs (``, x AS (..)``)."""
    ordered: list[str] = []

    def add(n: str) -> None:
        for dep in DEPENDS.get(n, []):
            add(dep)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]}\n)" for n in ordered)
    body = body.strip()
    if not ctes:
        return "WITH " + body[1:].lstrip() if body.startswith(",") else body
    if body.startswith(","):
        return f"WITH {ctes}{body}"
    return f"WITH {ctes}\n{body}"
