"""Exact, fast use of the ``tokenizers`` library on executors.

Both public files split a text with a pattern and encode each match alone, so each distinct match goes to the library
once for as long as it is remembered. Texts with characters outside the range in which Python's and the library's Unicode rules are known
to agree go to the library whole, as does every text when a file has another shape.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Outside: other scripts, combining marks, separators on which the libraries may differ, and dotted capital I.
ODD = r"[^\x01-\x1b\x20-\x{12f}\x{131}-\x{24f}]"


#: A space between two white characters: only there can a match of the byte pattern span the start of a space.
UNSAFE = r"[\t-\r \x{85}\x{a0}] [\t-\r \x{85}\x{a0}]"


class Encoder:
    """Texts to little-endian 32-bit ids. At most ``capacity`` chunks are remembered between batches.

    A text is cut into chunks that no match crosses: at every space for the byte pattern, at white space for the word
    pattern. Arrow finds the distinct chunks of a batch; new ones are cut into matches. Matches that are a space and
    letters (byte pattern) or letters (word pattern) go to the library joined, as joining leaves their borders in place
    and the ids show where each begins or ends; others go alone.
    """

    def __init__(self, path: str, capacity: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [p["type"] for p in (spec["pre_tokenizer"].get("pretokenizers") or [spec["pre_tokenizer"]])]
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        byte_kind = kinds == ["ByteLevel"] and spec["normalizer"] is None and spec["pre_tokenizer"]["use_regex"] and not spec["pre_tokenizer"]["add_prefix_space"]
        word_kind = kinds == ["Split", "ByteLevel"] and steps == ["NFC", "Replace", "Lowercase"] and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex") == WORD_PATTERN
        self.words = word_kind
        self.find = regex.compile(WORD_PATTERN if word_kind else BYTE_PATTERN).findall if byte_kind or word_kind else None
        vocab = spec["model"]["vocab"]
        # the library finds added tokens in a text before it cuts it: texts that hold one go to it whole
        added = spec.get("added_tokens") or []
        self.added = [t["content"] for t in added]
        if any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
            self.find = None  # such tokens also match otherwise than as they are written
        self.border = np.zeros(max(vocab.values()) + 1, bool)
        self.border[[i for t, i in vocab.items() if (t.endswith("</w>") if word_kind else t.startswith("\u0120"))]] = True
        self.line = vocab.get("\u010a")
        self.capacity, self.memo = capacity, {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str], size: int = 64) -> list[bytes]:
        """Ids of matches of letters; ``words`` are without their space."""
        out: list[bytes] = []
        for k in range(0, len(words), size):
            part = words[k : k + size]
            ids = np.asarray(self.library.encode_batch_fast([" ".join(part) if self.words else " " + " ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.border[ids])
            cuts = [0, *(4 * (at + 1)).tolist()] if self.words else [*(4 * at).tolist(), 4 * len(ids)]
            if len(cuts) != len(part) + 1:
                out += self._library(part if self.words else [f" {w}" for w in part])
                continue
            raw = ids.tobytes()
            out += [raw[b:e] for b, e in zip(cuts, cuts[1:])]
        return out

    def _bare(self, words: list[str], size: int = 64) -> list[bytes]:
        """Ids of matches of letters without a space (byte pattern), joined by line ends, which are matches and ids of their own."""
        out: list[bytes] = []
        for k in range(0, len(words), size):
            part = words[k : k + size]
            ids = np.asarray(self.library.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(ids == self.line).tolist() if self.line is not None else []
            if len(at) + 1 != len(part):
                out += self._library(part)
                continue
            raw = ids.tobytes()
            out += [raw[4 * b : 4 * e] for b, e in zip([0, *(i + 1 for i in at)], [*at, len(ids)])]
        return out

    def _resolve(self, new: list[str], lead: str) -> list[bytes]:
        """Ids of chunks; ``lead`` is the space before each, if any."""
        memo = self.memo if lead or self.words else {}
        letters, ended, other = [], [], []
        for x in new if lead or self.words else ():
            (letters if x.isalpha() else ended if x[:-1].isalpha() else other).append(x)
        stems = dict.fromkeys(x[:-1] for x in ended)
        got = {}
        for w in stems:
            if (known := memo.get(w)) is not None:
                got[w] = known
        letters = list(dict.fromkeys([*letters, *(w for w in stems if w not in got)]))
        got.update(zip(letters, self._joined(letters)))
        # one more character after letters is a match of its own
        signs = list({x[-1] for x in ended})
        sign = dict(zip(signs, self._library(signs) if signs else ()))
        for x in ended:
            got[x] = got[x[:-1]] + sign[x[-1]]
        mixed = {x: self.find(lead + x) for x in (other if lead or self.words else new)}
        plain = lambda m: (m[1:] if m[:1] == " " else None) if lead else (m if self.words else None)
        alone: dict[str, bytes] = {}
        words: dict[str, None] = {}
        for m in set().union(*mixed.values()):
            w = plain(m)
            if w is not None and w.isalpha():
                known = got.get(w) or memo.get(w)
                if known is None:
                    words[w] = None
                else:
                    alone[m] = known
            else:
                alone[m] = b""
        rest = [m for m, ids in alone.items() if not ids and (self.words or not m.isalpha())]
        alone.update(zip(rest, self._library(rest)))
        bare = [m for m, ids in alone.items() if not ids]
        alone.update(zip(bare, self._bare(bare)))
        for w, ids in zip(words, self._joined(list(words))):
            alone[lead + w] = ids
        for x, found in mixed.items():
            got[x] = b"".join(map(alone.__getitem__, found))
        return [got[x] for x in new]

    def _chunks(self, texts: pa.Array) -> tuple[list[str], pa.Array, np.ndarray]:
        """The text before the first cut of each text, the chunks after it, and where each text's chunks begin."""
        if self.words:
            lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
            return [""] * len(texts), lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        lists = pc.split_pattern(texts, " ")
        offsets, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
        # what stands before the first space is no chunk
        keep = np.ones(len(flat), bool)
        keep[offsets[:-1]] = False
        return flat.take(pa.array(offsets[:-1])).to_pylist(), flat.filter(pa.array(keep)), offsets - np.arange(len(offsets))

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each whole text; null counts as empty."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "").cast(pa.large_string())
        if self.find is None:
            easy = np.zeros(len(texts), bool)
        else:
            hard = pc.match_substring_regex(texts, ODD)
            if not self.words:
                hard = pc.or_(hard, pc.match_substring_regex(texts, UNSAFE))
            for content in self.added:
                hard = pc.or_(hard, pc.match_substring(texts, content))
            easy = ~hard.to_numpy(zero_copy_only=False)
        out: list[bytes | None] = [None] * len(texts)
        if easy.any():
            heads, flat, offsets = self._chunks(texts if easy.all() else texts.filter(pa.array(easy)))
            coded = flat.dictionary_encode()
            seen = coded.dictionary.to_pylist()
            memo = self.memo
            new = [x for x in seen if x not in memo]
            if len(memo) + len(new) > self.capacity:
                memo.clear()
                new = seen
            memo.update(zip(new, self._resolve(new, "" if self.words else " ")))
            taken = pa.array(list(map(memo.__getitem__, seen)), pa.large_binary()).take(coded.indices)
            _, ends, data = taken.buffers()
            ids = data.to_pybytes() if data is not None else b""
            cuts = np.frombuffer(ends, np.int64)[offsets].tolist() if len(taken) else [0] * (len(heads) + 1)
            first = heads if self.words else self._resolve(heads, "")
            for i, h, b, e in zip(np.flatnonzero(easy).tolist(), first, cuts, cuts[1:]):
                out[i] = ids[b:e] if self.words else h + ids[b:e]
            if len(memo) > self.capacity:
                memo.clear()
        hard = np.flatnonzero(~easy)
        for i, ids in zip(hard.tolist(), self._library(texts.take(pa.array(hard)).to_pylist()) if len(hard) else ()):
            out[i] = ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str, capacity: int = 600_000) -> Encoder:
    """One encoder for each file and Python worker; a remembered chunk takes some 200 bytes."""
    return Encoder(path, capacity)
