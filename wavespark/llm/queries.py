"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe import op1_bpe
from .conversations import op11_conversations
from .langid import op3_language
from .lines import op6_lines
from .lm import op5_lm
from .matroska import op8_matroska
from .neighbours import op12_neighbours
from .packing import op7_packing
from .simhash import op9_simhash
from .spelling import OP13_SQL, op13_spelling
from .substring import op4_substring
from .topk import OP10_SQL, op10_topk
from .toxicity import op2_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_bpe, op2_toxicity, op3_language, op4_substring, op5_lm, op6_lines, op7_packing, op8_matroska, op9_simhash, op10_topk, op11_conversations, op12_neighbours, op13_spelling)
}

#: Windows of 50 words as lists, and the words that a window of a smaller document covers.
OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), p AS (
  SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS k FROM w, unnest(generate_series(1, len(ws) - 49)) AS t(i) WHERE len(ws) >= 50
), m AS (SELECT k, min(doc_id) AS first FROM p GROUP BY k HAVING count(*) > 1),
g AS (
  SELECT doc_id, list(DISTINCT j) AS gone FROM (
    SELECT p.doc_id, unnest(generate_series(p.i, p.i + 49)) AS j FROM p JOIN m USING (k) WHERE p.doc_id > m.first
  ) GROUP BY doc_id
), f AS (
  SELECT w.doc_id, ws, coalesce(gone, []) AS gone FROM w LEFT JOIN g USING (doc_id)
)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
FROM f
"""

ORACLE_SQL = {"op4_substring": OP4_SQL, "op10_topk": OP10_SQL, "op13_spelling": OP13_SQL}
