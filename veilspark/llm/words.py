"""Words of whole texts, cut in Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = r"[\x20\x09-\x0D]+"  # what stands between words
NO_LETTERS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"  # what stands between terms


def split_words(texts: pa.Array, between: str = SPACES) -> tuple[pa.Array, np.ndarray]:
    """(all words in order, the number of words of each text); a null text has none."""
    lists = pc.split_pattern_regex(pc.fill_null(texts, ""), pattern=between)
    words, row = lists.flatten(), pc.list_parent_indices(lists)
    real = pc.not_equal(words, "")
    counts = np.bincount(row.filter(real).to_numpy(zero_copy_only=False), minlength=len(texts))
    return words.filter(real), counts


def join_words(words: pa.Array, counts: np.ndarray) -> pa.Array:
    """The words of each text joined by one space."""
    at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(at), words), " ")
