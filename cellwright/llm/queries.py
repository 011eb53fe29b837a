"""The queries of this subpackage and, where SQL can express them, what DuckDB says to the same tables."""

from __future__ import annotations

from cellwright.llm.ann import op2_balanced_ann
from cellwright.llm.chat_format import OP5_SQL, op5_chat_format
from cellwright.llm.decontaminate import op6_decontaminate
from cellwright.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from cellwright.llm.line_dedup import OP4_SQL, op4_line_dedup
from cellwright.llm.mixture import OP10_SQL, op10_poisson_mix
from cellwright.llm.near_dedup import op9_near_dedup
from cellwright.llm.packing import op11_packing
from cellwright.llm.secret_scan import op1_secret_scan
from cellwright.llm.substring_dedup import op7_substring_dedup
from cellwright.llm.suffix_dedup import op3_suffix_dedup
from cellwright.llm.toxicity import op8_toxicity
from cellwright.llm.whitening import op13_whitening

OP2_SQL = """
WITH good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])))) AS score
  FROM good q JOIN good c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs) WHERE rank <= 10
"""

OP3_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
starts AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 100)) AS g FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS i FROM d)),
least AS (SELECT g, min(doc_id) AS m FROM starts GROUP BY g HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT s.doc_id, s.i, lag(s.i) OVER (PARTITION BY s.doc_id ORDER BY s.i) AS p FROM starts s JOIN least l USING (g) WHERE s.doc_id > l.m),
runs AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS k FROM runs GROUP BY doc_id, r),
kept AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
    string_agg(substr(x, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY k) AS head
  FROM (SELECT s.*, d.x, coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY k), 0) AS prev FROM spans s JOIN d USING (doc_id)) GROUP BY doc_id
)
SELECT d.doc_id AS doc_id, CAST(len(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN d.x ELSE head || substr(d.x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
wins AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i + 1 : i + least(13, len(w))], ' ') AS g FROM (SELECT *, unnest(range(0, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM wins),
runs AS (SELECT doc_id, size, i, array_to_string(w[i + 1 : i + size], ' ') AS g FROM (SELECT *, unnest(range(0, len(w) - size + 1)) AS i FROM d, sizes)),
hits AS (SELECT r.doc_id, r.i, r.size, x.item_id FROM runs r JOIN wins x USING (size, g)),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS g FROM (SELECT *, unnest(range(0, len(w) - 49)) AS i FROM d)),
least AS (SELECT g, min(doc_id) AS m FROM starts GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM (SELECT s.doc_id, s.i FROM starts s JOIN least l USING (g) WHERE s.doc_id > l.m)),
every AS (SELECT doc_id, j, w[j + 1] AS word FROM (SELECT *, unnest(range(0, len(w))) AS j FROM d)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t FROM every e ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def queries() -> dict:
    ops = (op1_secret_scan, op2_balanced_ann, op3_suffix_dedup, op4_line_dedup, op5_chat_format, op6_decontaminate, op7_substring_dedup, op8_toxicity, op9_near_dedup, op10_poisson_mix, op11_packing, op12_hard_negatives, op13_whitening)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_suffix_dedup": OP3_SQL,
        "op4_line_dedup": OP4_SQL,
        "op5_chat_format": OP5_SQL,
        "op6_decontaminate": OP6_SQL,
        "op7_substring_dedup": OP7_SQL,
        "op10_poisson_mix": OP10_SQL,
        "op12_hard_negatives": OP12_SQL,
    }
