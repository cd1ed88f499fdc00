"""The de-identification engine. Every step is a column of the same row: no shuffle, so it also runs on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import SPAN, SPANS, cut, each, hits, keep, let, lit, none, pieces, pin, span
from . import span_algebra as A
from .address import address_spans
from .rules import ADDRESS_SCORE, DISPLAY_NAMES, ENTITIES, RULES, Facts, Rule, Soft, rule_spans

#: A recognizer of names: a column of texts to a column of spans (``SPANS``), or an object whose ``add(df, text, name)``
#: adds such a column (``names.ModelNames``). Models are not part of the library.
Ner = Callable[[Column], Column]


@lru_cache(maxsize=64)
def _rule_spans(rules: tuple[Rule, ...], addresses: bool, text: str, soft: Soft | None, threshold: float) -> str:
    """SQL text of all spans of the rules: built once for equal engines."""

    def found(facts: Facts, han: str) -> str:
        own = rule_spans(rules, text, facts, soft, threshold)
        return f"concat({own}, {address_spans(text, han)})" if addresses else own

    # facts that several rules ask for, each found once
    eight, four, low, han = f"{text} rlike {lit(chr(92) + 'p{Nd}{7}')}", f"{text} rlike {lit(chr(92) + 'p{Nd}{3}')}", f"lower({text})", f"{text} rlike '[\u4e00-\u9fff]'"
    return let(eight, lambda e: let(four, lambda f: let(low, lambda w: let(han, lambda h: found(Facts(e, f, w), h)))))


class DeidEngine:
    """Finds, replaces and restores personal data.

    entities: the types to look for; others cost nothing, as their expressions are never built. threshold: the least
    score. ner: optional recognizer of PERSON, ORG and LOCATION. numbering: ``reverse`` (from the text's end) or
    ``forward``. sweep: also replace undetected further occurrences of found values. soft: how words near a match raise
    its score, before the threshold is applied and overlaps are cut; None for scores of patterns alone. allow: values that
    are left as they are; a person lists them, so they are few (``allowed`` takes a table of them).

    A null text gives null results and an empty dictionary. Filters on the input's columns pass below all that is added
    here, down to the scan; filters on added columns never compute these twice.
    """

    def __init__(self, entities: Iterable[str] = ENTITIES, threshold: float = 0.5, rules: Iterable[Rule] = RULES, ner: Ner | None = None, numbering: str = "reverse", sweep: bool = False, soft: Soft | None = Soft(), allow: Iterable[str] = ()):
        if numbering not in ("reverse", "forward"):
            raise ValueError(f"unknown numbering {numbering}")
        self.entities, self.threshold, self.ner, self.numbering, self.sweep, self.soft, self.allow = tuple(entities), threshold, ner, numbering, sweep, soft, tuple(dict.fromkeys(allow))
        self.rules = tuple(r for r in rules if r.entity in self.entities and r.best(soft) >= threshold)

    def detect(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Add ``spans``: sorted by type and start, merged per type; different types may overlap."""
        found = _rule_spans(self.rules, "TW_ADDRESS" in self.entities and self.threshold <= ADDRESS_SCORE, f"`{text}`", self.soft, self.threshold)
        if self.ner is not None:
            df = self.ner.add(df, text, "_names") if hasattr(self.ner, "add") else pin(df, "_names", self.ner(F.col(text)))
            asked = ", ".join(lit(e) for e in self.entities) or "''"
            names = keep(f"coalesce(_names, {none(SPAN)})", lambda s: f"{s}.entity_type IN ({asked}) AND {s}.score >= {self.threshold}D")
            found = f"concat({found}, {names})"
        merged = let(found, lambda raw: f"CASE WHEN size({raw}) > 0 THEN {A.drop_persons_in_dates(A.merge_touching(raw))} ELSE {raw} END")
        if self.allow:
            kept = lambda rows, parts: keep(rows, lambda s: f"NOT ({cut(parts, f'{s}.start', f'{s}.end - {s}.start')} IN ({', '.join(map(lit, self.allow))}))")
            merged = let(merged, lambda rows: f"CASE WHEN size({rows}) > 0 THEN {let(pieces(f'`{text}`'), lambda parts: kept(rows, parts))} ELSE {rows} END")
        return pin(df, "spans", f"CASE WHEN `{text}` IS NOT NULL THEN {merged} END").drop("_names")

    def resolve(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Add ``resolved``: the disjoint spans, in order, that replacement uses."""
        return pin(df, "resolved", A.resolve(f"`{text}`", "spans"))

    def anonymize(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Add ``spans``, ``resolved``, ``entries``, ``anonymized``, ``entity_count`` and ``roundtrip_ok``.

        ``roundtrip_ok`` is false if restoring does not give the text back, e.g. if it held a placeholder before.
        """
        df = self.resolve(self.detect(df, text), text)
        df = pin(df, "_done", A.replaced(f"`{text}`", "resolved", self.numbering == "reverse"))
        out = "_done.anonymized"
        if self.sweep:
            out = A.replace_values(out, each("_done.entries", lambda e: f"named_struct('from', {e}.original, 'to', {e}.placeholder)"))
        checked = lambda x: f"named_struct('anonymized', {x}, 'roundtrip_ok', {A.restore_once(x, A.as_entries('_done.entries'))} = `{text}`)"
        df = pin(df, "_checked", let(out, checked))
        every = [c for c in df.columns if c not in ("_done", "_checked", "entries", "anonymized", "entity_count", "roundtrip_ok")]
        return df.select(*[F.col(f"`{c}`") for c in every], F.col("_done.entries").alias("entries"), F.col("_checked.anonymized").alias("anonymized"), F.size("_done.entries").alias("entity_count"), F.col("_checked.roundtrip_ok").alias("roundtrip_ok"))


def mapping_of(entries: Column) -> Column:
    """Placeholder to original, as a map."""
    return F.map_from_entries(F.transform(entries, lambda d: F.struct(d["placeholder"].alias("k"), d["original"].alias("v"))))


def mapping_rows(df: DataFrame, *keys: str) -> DataFrame:
    """The dictionary as rows: keys, placeholder, entity_type, ordinal, original."""
    return df.select(*keys, F.explode("entries").alias("e")).select(*keys, "e.placeholder", "e.entity_type", "e.ordinal", "e.original")


def span_rows(df: DataFrame, *keys: str, column: str = "spans", text: str = "text") -> DataFrame:
    """Spans as rows with their values."""
    return df.select(*keys, F.col(text).alias("_t"), F.explode(column).alias("s")).select(*keys, "s.entity_type", "s.start", "s.end", "s.score", F.expr(A.value_of("_t", "s")).alias("value"))


def allowed(df: DataFrame, values: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Take the spans whose value is in a table (value) out of ``spans``, by an anti-join of span rows; other columns stay.

    ``key`` tells rows apart; one of them may be null. A hot value is no hot task: the table's side is distinct, and the
    rows stay where they are if it is small enough to broadcast. ``df`` is read twice: store what is costly first.
    """
    rows = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.explode("spans").alias("s"))
    rows = rows.select("_k", "s", F.expr(A.value_of("_t", "s")).alias("value")).join(values.select("value").distinct(), "value", "left_anti")
    kept = rows.groupBy("_k").agg(F.array_sort(F.collect_list("s")).alias("_spans"))
    out = df.join(kept, F.col(key).eqNullSafe(F.col("_k")), "left").withColumn("spans", F.when(F.col("spans").isNotNull(), F.coalesce("_spans", F.array().cast(SPANS))))
    return out.drop("_k", "_spans")


def with_session(df: DataFrame) -> DataFrame:
    """Give each row a session_id under which its mapping is kept."""
    return df.withColumn("session_id", F.uuid())


def restore(df: DataFrame, mapping: DataFrame, key: str, text: str = "anonymized") -> DataFrame:
    """Add ``restored`` by mapping rows with the same key (a document or a session). One shuffle, on the key.

    Rows without any mapping keep their text and have ``known`` false.
    """
    maps = mapping.groupBy(key).agg(F.collect_set(F.struct(F.col("placeholder").alias("key"), F.col("original").alias("value"))).alias("_map"))
    joined = df.join(maps, key, "left").withColumn("known", F.col("_map").isNotNull())
    return joined.withColumn("restored", F.expr(f"CASE WHEN known THEN {A.restore_once(f'`{text}`', '_map')} ELSE `{text}` END")).drop("_map")


def unknown_sessions(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows whose session has no mapping: what a service reports as not found."""
    return df.join(mapping.select("session_id").distinct(), "session_id", "left_anti")


def mask_terms(df: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """Add ``masked``: each term replaced everywhere by <MANUAL_n>, longest first. Terms come from a person, so they are few."""
    pairs = ", ".join(f"named_struct('from', {lit(t)}, 'to', '<MANUAL_{i}>')" for i, t in enumerate(dict.fromkeys(t for t in terms if t), 1))
    return df.withColumn("masked", F.expr(A.replace_values(f"`{text}`", f"array({pairs})")) if pairs else F.col(text))


def report(df: DataFrame) -> DataFrame:
    """(entity_type, name, found, documents) over all spans, most frequent first. Partial sums come before the shuffle."""
    rows = df.select(F.explode(F.filter(F.transform("spans", lambda s: s["entity_type"]), lambda t: t.isNotNull())).alias("entity_type"))
    names = F.create_map(*[F.lit(x) for kv in DISPLAY_NAMES.items() for x in kv])
    out = rows.groupBy("entity_type").agg(F.count("*").alias("found"))
    return out.select("entity_type", F.coalesce(names[F.col("entity_type")], F.col("entity_type")).alias("name"), "found").orderBy(F.desc("found"), "entity_type")


def decision(df: DataFrame, path: str = "path") -> DataFrame:
    """Before a file is read by a tool: JSON that asks, with counts by type, for each text that holds personal data."""
    kinds = F.array_distinct(F.transform("spans", lambda s: s["entity_type"]))
    counts = F.transform(kinds, lambda k: F.struct((-F.size(F.filter("spans", lambda s: s["entity_type"] == k))).alias("n"), k.alias("k")))
    names = F.create_map(*[F.lit(x) for kv in DISPLAY_NAMES.items() for x in kv])
    listed = F.array_join(F.transform(F.array_sort(counts), lambda c: F.format_string("%s: %d", F.coalesce(names[c["k"]], c["k"]), -c["n"])), ", ")
    reason = F.format_string("%s holds %d items of personal data (%s)", F.col(path), F.size("spans"), listed)
    body = F.struct(F.struct(F.lit("PreToolUse").alias("hookEventName"), F.lit("ask").alias("permissionDecision"), reason.alias("permissionDecisionReason")).alias("hookSpecificOutput"))
    return df.withColumn("response", F.when(F.size("spans") > 0, F.to_json(body)))


class Gazetteer:
    """A recognizer for a fixed list of names: a stand-in where no model is at hand."""

    def __init__(self, names: dict[str, str], score: float = 0.85):
        self.names, self.score = names, score

    def sql(self, text: str) -> str:
        """Its spans in a text."""
        kinds = list(dict.fromkeys(self.names.values()))
        own = [sorted((n for n, k in self.names.items() if k == kind), key=lambda n: (-len(n), n)) for kind in kinds]
        rows = hits(text, [("|".join("\\Q" + n + "\\E" for n in names), 0, None) for names in own])
        listed = f"array({', '.join(map(lit, kinds))})" if kinds else none("string")
        return each(rows, lambda h: span(f"{listed}[{h}.r]", f"{h}.start", f"{h}.end", str(self.score)))

    def add(self, df: DataFrame, text: str, name: str) -> DataFrame:
        """Add the spans as a column."""
        return pin(df, name, self.sql(f"`{text}`"))


def gazetteer(names: dict[str, str], score: float = 0.85) -> Gazetteer:
    """A recognizer of these names (name: type)."""
    return Gazetteer(names, score)
