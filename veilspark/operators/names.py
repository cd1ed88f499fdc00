"""Recognizers of names around a batch model, which stays a plug-in: windows, islands of English, labels, places.

A model gets the windows of a text as one array and gives, for each window, an array of (label, start, end, score) with
places in that window. What stands around it is native: a text is cut into overlapping windows (or first into islands of
Latin script), padding is taken out, and found places are put back into the whole text.

- A window owns the names that begin in it before the middle of its overlap with the next and after that with the
  one before; others are the neighbour's. A name longer than half an overlap, which both windows see in part, is kept from
  both, and the parts join when spans of one type are merged.
- Labels outside the map are dropped, as are names of one character, and English names right before an ``@``.
- A full-width space after a single Han character (中　華　民　國) is taken out before the model and counted in after it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import cut, each, hits, keep, let, lit, none, pieces, pin, scan, span

FOUND = "array<array<struct<label:string,start:int,end:int,score:double>>>"
#: A model: from SQL text of an array of strings to a column of FOUND, e.g. ``lambda texts: my_pandas_udf(F.expr(texts))``.
Model = Callable[[str], Column]

# Labels of models and the types they stand for, what an island of English is, scores.
LABELS = {"PERSON": "PERSON", "PER": "PERSON", "ORG": "ORG", "LOC": "LOCATION", "GPE": "LOCATION", "FAC": "LOCATION"}
ENGLISH_LABELS = {"PERSON": "PERSON", "ORG": "ORG", "GPE": "LOCATION", "LOC": "LOCATION", "FAC": "LOCATION"}
ISLAND = r"[A-Za-z][A-Za-z0-9 .'\-]{1,}[A-Za-z0-9.]"
SCORE, ENGLISH_SCORE = 0.85, 0.80

#: A full-width space after a Han character that stands alone, and before another.
PAD = r"(?<=(?:^|[^\p{IsHan}])\p{IsHan})\x{3000}(?=\p{IsHan})"


class ModelNames:
    """Adds the names that a model finds as a column of spans.

    labels: from the model's labels to types. score: of all names; None takes the model's own. window, overlap: in
    characters. islands: only runs of Latin script go to the model, and names before ``@`` are dropped.
    """

    def __init__(self, model: Model, labels: Mapping[str, str] = LABELS, score: float | None = SCORE, window: int = 480, overlap: int = 96, islands: bool = False):
        if not 0 <= overlap < window:
            raise ValueError("a window must be longer than its overlap")
        self.model, self.labels, self.score, self.window, self.overlap, self.islands = model, dict(labels), score, window, overlap, islands

    def windows(self, text: str) -> str:
        """SQL text: (start, first, last, text, cuts) of a text's windows; cuts are the places in it where a space was taken out."""

        def padded(raw: str, rest: str) -> str:
            parts = lambda segments: scan(segments, "0", "int", lambda at, x: (f"{at} + length({x})", None))
            cuts = lambda segments: f"named_struct({rest}, 'text', array_join({segments}, ''), 'cuts', slice({parts(segments)}.o, 1, size({segments}) - 1))"
            return f"CASE WHEN contains({raw}, '　') THEN {let(f'split({raw}, {lit(PAD)}, -1)', cuts)} ELSE named_struct({rest}, 'text', {raw}, 'cuts', {none('int')}) END"

        def of(parts: str, r: str) -> str:
            starts = f"sequence({r}.start, greatest({r}.start, {r}.end - {self.overlap + 1}), {self.window - self.overlap})"
            rest = lambda s: f"'start', {s}, 'first', {s} = {r}.start, 'last', {s} + {self.window} >= {r}.end"
            return each(starts, lambda s: let(cut(parts, s, f"least({self.window}, {r}.end - {s})"), lambda raw: padded(raw, rest(s))))

        whole = f"array(named_struct('start', 0, 'end', length({text})))"
        ranges = each(hits(text, [(ISLAND, 0, None)]), lambda h: f"named_struct('start', {h}.start, 'end', {h}.end)") if self.islands else whole
        every = let(pieces(text), lambda parts: f"flatten({each(ranges, lambda r: of(parts, r))})")
        return f"CASE WHEN length({text}) > 0 THEN {every} ELSE {none('struct<start:int,first:boolean,last:boolean,text:string,cuts:array<int>>')} END"

    def spans(self, text: str, windows: str, found: str) -> str:
        """SQL text: what the model found in the windows, as spans of the text."""
        kinds = f"map({', '.join(lit(x) for kv in self.labels.items() for x in kv)})"
        half = self.overlap // 2

        def of(parts: str, kind: str, w: str, f: str) -> str:
            shift = lambda place, sign: f"({w}.start + {f}.{place} + size(filter({w}.cuts, c -> c {sign} {f}.{place})))"
            start, end = shift("start", "<="), shift("end", "<")
            owned = f"({f}.start = 0 OR (({w}.first OR {start} >= {w}.start + {half}) AND ({w}.last OR {start} < {w}.start + {self.window - half})))"
            at = f"AND {cut(parts, end, '1')} <> '@'" if self.islands else ""
            one = span(kind, start, end, f"{f}.score" if self.score is None else str(self.score))
            return f"CASE WHEN {kind} IS NOT NULL AND {f}.end - {f}.start > 1 AND {owned} {at} THEN {one} END"

        def each_window(parts: str, labels: str) -> str:
            rows = lambda w, fs: each(fs, lambda f: of(parts, f"try_element_at({labels}, {f}.label)", w, f))
            return f"flatten(zip_with({windows}, {found}, (w, fs) -> coalesce({rows('w', 'fs')}, array())))"

        every = let(pieces(text), lambda parts: let(kinds, lambda labels: keep(each_window(parts, labels), lambda s: f"{s} IS NOT NULL")))
        return f"CASE WHEN size({windows}) > 0 THEN {every} ELSE {none('struct<entity_type:string,start:int,end:int,score:double>')} END"

    def add(self, df: DataFrame, text: str, name: str) -> DataFrame:
        """Add the spans as a column ``name``; a null text has none."""
        df = pin(df, "_windows", self.windows(f"coalesce(`{text}`, '')"))
        df = df.withColumn("_found", self.model("_windows.text"))
        return pin(df, name, self.spans(f"coalesce(`{text}`, '')", "_windows", f"cast(_found as {FOUND})")).drop("_windows", "_found")


def english_names(model: Model, window: int = 480, overlap: int = 96) -> ModelNames:
    """A recognizer of English names within any text."""
    return ModelNames(model, ENGLISH_LABELS, ENGLISH_SCORE, window, overlap, islands=True)


class Names:
    """Several recognizers as one."""

    def __init__(self, *recognizers: ModelNames):
        self.recognizers = recognizers

    def add(self, df: DataFrame, text: str, name: str) -> DataFrame:
        """Add the spans of all."""
        own = [f"{name}_{i}" for i in range(len(self.recognizers))]
        for column, r in zip(own, self.recognizers):
            df = r.add(df, text, column)
        return pin(df, name, f"concat({', '.join(own)})").drop(*own)


def pattern_model(labels: Mapping[str, str]) -> Model:
    """A model of patterns by label: a stand-in where no model is at hand."""
    names = f"array({', '.join(map(lit, labels))})"
    found = lambda t: each(hits(t, [(p, 0, None) for p in labels.values()]), lambda h: f"named_struct('label', {names}[{h}.r], 'start', {h}.start, 'end', {h}.end, 'score', 0.5D)")
    return lambda texts: F.expr(each(texts, found))
