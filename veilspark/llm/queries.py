"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op5_bpe
from .caps import op13_caps
from .chat import SQL as _OP9
from .chat import op9_chat
from .divergence import SQL as _OP12
from .divergence import op12_divergence
from .html import op1_html
from .jaccard import op10_jaccard
from .media import op7_media
from .packing import op4_packing
from .quality import op8_quality
from .runs import op11_runs
from .shards import op6_sharding
from .token_files import op2_token_file
from .toxicity import op3_toxicity

QUERIES = {
    "op1_html": op1_html,
    "op2_token_file": op2_token_file,
    "op3_toxicity": op3_toxicity,
    "op4_packing": op4_packing,
    "op5_bpe": op5_bpe,
    "op6_sharding": op6_sharding,
    "op7_media": op7_media,
    "op8_quality": op8_quality,
    "op9_chat": op9_chat,
    "op10_jaccard": op10_jaccard,
    "op11_runs": op11_runs,
    "op12_divergence": op12_divergence,
    "op13_caps": op13_caps,
}

#: Words, lines and 3-word windows as lists; windows are compared as text, not by hash.
_OP8 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, unnest(generate_series(1, len(words) - 2)) AS i, words FROM w WHERE len(words) >= 4),
k AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win FROM g),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM k) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM c, (VALUES (0), (1), (2)) o(j) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             len(lines) AS n_lines, length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g')) AS n_upper,
             length(t) - length(regexp_replace(t, '\p{L}+', '', 'g')) AS n_letters,
             length(t) - length(regexp_replace(t, '!+', '', 'g')) AS n_exclaim FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
       + CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END
       + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
       + CASE WHEN word_chars < 3 * n_words OR word_chars > 12 * n_words THEN 16 ELSE 0 END
       + CASE WHEN 100 * n_upper > 60 * n_letters THEN 32 ELSE 0 END + CASE WHEN 100 * n_exclaim > 30 * n_words THEN 64 ELSE 0 END
       + CASE WHEN 100 * n_letters < 55 * word_chars THEN 128 ELSE 0 END AS failure_bits FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, (failure_bits & 3) <> 0 AS base_failed,
       failure_bits = 0 AS kept, failure_bits::INTEGER AS failure_bits, n_lines::BIGINT AS n_lines, n_upper::BIGINT AS n_upper,
       n_letters::BIGINT AS n_letters, n_exclaim::BIGINT AS n_exclaim FROM b
"""

ORACLES = {"op8_quality": _OP8, "op9_chat": _OP9, "op12_divergence": _OP12}
