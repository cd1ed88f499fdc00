"""Operator 12, source divergence audit: how far the word use of each source lies from that of the others of its language.

Every source of a language is a distribution over the language's kept terms (those in at least ``least`` of its
documents), smoothed and scaled to integers: p = 1 + floor(SCALE * (count + ADD) / (N + ADD * V)). The distance of two
sources is the sum of |p - q| over all V terms, which is split by how many sources have a term.

Heavy terms (in at least a quarter of the language's sources) fill dense numpy tiles of terms by sources, of which each
pair of columns gives a partial sum. Light terms stay posting lists. There a source without the term has its floor value
z, so the sum over V_light terms is V_light * |z_a - z_b|, plus for each posting of a what |p_a - z_b| differs from that,
plus for each two postings of one list what |p_a - p_b| differs from the two corrections made. All of it is in integers,
so the partial sums of both kinds and of all tasks add up exactly.

Counting sums within Arrow batches and within tasks before the shuffle, so a very common term or a source with a third
of all documents is a row a task. Posting lists are bounded by the number of sources of a language, as is what the
driver gets (one row a source and language: the result has the square of that). Tiles hold TILE cells; partial sums of a
task are sent on when they pass HELD cells. Top lists are kept for each task, then joined.

Edge cases: null text, language and source count as ''; a group without terms still has its rows; V = 0 gives sums of 0;
repeated rows are documents of their own; an empty table gives no rows; doc_id and all other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, staged, table, text_slices
from .words import NO_LETTERS, split_words

SCALE, ADD, LEAST, TOP = 1_000_000_000, 5, 30, 50
HEAVY = 4  # a term is heavy if HEAVY times its sources are at least all sources
TILE = 1 << 20  # cells of a dense tile
HELD = 1 << 22  # cells of partial sums that a task keeps
COUNTS = "lang string, source string, term string, n long, docs long"
PARTS = "part string, lang string, source string, item string, value long"


def _count(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term) of a slice of documents."""
    for batch in text_slices(batches):
        terms, counts = split_words(pc.ascii_lower(batch.column("text")), NO_LETTERS)
        if not len(terms):
            continue
        coded = terms.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        groups = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
        langs, sources = groups.field(0).dictionary_encode(), groups.field(1).dictionary_encode()
        group = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy(zero_copy_only=False)
        width = len(coded.dictionary)
        in_doc, n = np.unique(np.repeat(np.arange(len(counts)), counts) * width + code, return_counts=True)
        key, at = np.unique(group[in_doc // width] * width + in_doc % width, return_inverse=True)
        total = np.bincount(at, weights=n, minlength=len(key)).astype(np.int64)
        docs = np.bincount(at, minlength=len(key)).astype(np.int64)
        g = key // width
        yield pa.RecordBatch.from_arrays(
            [langs.dictionary.take(pa.array(g // len(sources.dictionary))), sources.dictionary.take(pa.array(g % len(sources.dictionary))), coded.dictionary.take(pa.array(key % width)), pa.array(total), pa.array(docs)],
            ["lang", "source", "term", "n", "docs"],
        )


def postings(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, total, list of (source, n)) of the terms in at least ``least`` documents of a language."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    counts = map_arrow(docs.select(blank("text"), blank("lang"), blank("source")), _count, COUNTS)
    by_source = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    lists = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("list"))
    return lists.filter(F.col("docs") >= least).select("lang", "term", "total", "list")


def share(count: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(SCALE * (count + ADD) / (n + ADD * v)), by long division, as the product can pass 64 bits."""
    whole = np.asarray(n, np.int64) + ADD * v
    rest, out = np.asarray(count, np.int64) + ADD, np.int64(0)
    for _ in range(3):  # SCALE is 1000 ** 3
        q, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + q
    return 1 + out


@dataclass
class Language:
    """The sources of one language, in order, with the occurrences and the floor value of each."""

    sources: list[str]
    n: np.ndarray
    v: int
    whole: int

    def __post_init__(self):
        self.place = {s: i for i, s in enumerate(self.sources)}
        self.z = share(np.zeros(len(self.n), np.int64), self.n, self.v) if self.v else np.zeros(len(self.n), np.int64)


def _dense(counts: np.ndarray, lang: Language, into: np.ndarray) -> None:
    """Add the sums of |p - q| over a tile of terms (rows) by sources (columns)."""
    p = np.ascontiguousarray(counts.T)
    for a in range(len(p) - 1):
        into[a, a + 1 :] += np.abs(p[a + 1 :] - p[a]).sum(1)


def _sparse(owner: np.ndarray, source: np.ndarray, p: np.ndarray, terms: int, lang: Language, into: np.ndarray) -> None:
    """Add the sums over ``terms`` light terms with postings (owner, source, p), in order of owners."""
    z, m = lang.z, len(lang.z)
    apart = np.abs(z[:, None] - z[None, :])
    full = terms * apart
    # each posting against the floor of all sources; equal values of a source are taken together
    kinds, times = np.unique(np.stack([source, p], 1), axis=0, return_counts=True)
    for start in range(0, len(kinds), step := max(1, TILE // m)):
        own, value, many = kinds[start : start + step, 0], kinds[start : start + step, 1], times[start : start + step]
        more = (np.abs(value[:, None] - z[None, :]) - apart[own]) * many[:, None]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        summed = np.add.reduceat(more, first, axis=0)
        full[own[first]] += summed
        full[:, own[first]] += summed.T
    # two postings of one list
    size = np.bincount(owner)
    size = size[size > 0]
    begin = np.cumsum(size) - size
    for k in np.unique(size[size > 1]):
        i, j = np.triu_indices(k, 1)
        lists = begin[size == k]
        for start in range(0, len(lists), step := max(1, TILE // len(i))):
            at = lists[start : start + step, None]
            x, y = (at + i).ravel(), (at + j).ravel()
            a, b, p_a, p_b = source[x], source[y], p[x], p[y]
            more = np.abs(p_a - p_b) - np.abs(p_a - z[b]) - np.abs(p_b - z[a]) + apart[a, b]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.add.at(full, (low, high), more)
    into += np.triu(full, 1)


def _sums(batches: Iterable[pa.RecordBatch], langs: dict[str, Language], top: int) -> Iterable[pa.RecordBatch]:
    """Partial sums of all pairs of sources, and the terms that stand out most in each source."""
    sums: dict[str, np.ndarray] = {}
    best: dict[str, tuple[np.ndarray, np.ndarray, pa.Array]] = {}

    def rows(part: str, name: str, a: Iterable[str], item, value: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part] * len(value)), pa.array([name] * len(value)), pa.array(a, pa.string()), pa.array(item, pa.string()), pa.array(value)], ["part", "lang", "source", "item", "value"])

    def sent() -> Iterable[pa.RecordBatch]:
        for name, m in sums.items():
            own = langs[name].sources
            for a in range(len(own) - 1):
                yield rows("pair", name, [own[a]] * (len(own) - a - 1), own[a + 1 :], m[a, a + 1 :])
        sums.clear()

    for batch in batches:
        every = batch.column("lang").to_numpy(zero_copy_only=False)
        for name in dict.fromkeys(every.tolist()):
            lang = langs[name]
            own = batch.filter(pa.array(every == name))
            lists, total = own.column("list"), own.column("total").to_numpy()
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            owner = np.repeat(np.arange(len(size)), size)
            names = flat.field(0).dictionary_encode()
            source = np.array([lang.place[s] for s in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy(zero_copy_only=False)]
            n = flat.field(1).to_numpy(zero_copy_only=False)
            p, m = share(n, lang.n[source], lang.v), len(lang.sources)
            if name not in sums:
                if sum(x.size for x in sums.values()) + m * m > HELD:
                    yield from sent()
                sums[name] = np.zeros((m, m), np.int64)
            heavy = HEAVY * size >= m
            terms = np.flatnonzero(heavy)
            for start in range(0, len(terms), step := max(1, TILE // m)):
                some = terms[start : start + step]
                at = np.full(len(size), -1)
                at[some] = np.arange(len(some))
                mine = at[owner] >= 0
                tile = np.repeat(lang.z[None, :], len(some), 0)
                tile[at[owner[mine]], source[mine]] = p[mine]
                _dense(tile, lang, sums[name])
            light = ~heavy[owner]
            if (~heavy).any():
                _sparse(owner[light], source[light], p[light], int((~heavy).sum()), lang, sums[name])
            over = p - share(total, np.int64(lang.whole), lang.v)[owner]
            up = np.flatnonzero(over > 0)
            held = best.get(name)
            a, value, term = source[up], over[up], own.column("term").take(pa.array(owner[up]))
            if held is not None:
                a, value, term = np.concatenate([held[0], a]), np.concatenate([held[1], value]), pa.concat_arrays([held[2], term])
            order = np.empty(len(term), np.int64)
            order[pc.sort_indices(term.cast(pa.binary())).to_numpy()] = np.arange(len(term))
            by = np.lexsort((order, -value, a))
            first = np.concatenate([[True], a[by][1:] != a[by][:-1]]) if len(by) else np.empty(0, bool)
            place = np.arange(len(by)) - np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
            by = by[place < top]
            best[name] = a[by], value[by], term.take(pa.array(by))
    yield from sent()
    for name, (a, value, term) in best.items():
        yield rows("term", name, [langs[name].sources[i] for i in a], term, value)


def _languages(groups: DataFrame, lists: DataFrame) -> dict[str, Language]:
    """By language. One row a source and language comes to the driver; the audit returns the square of that."""
    totals = lists.select("lang", F.explode("list").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"))
    sizes = {r["lang"]: (r["v"], r["whole"]) for r in lists.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("whole")).collect()}
    out: dict[str, dict[str, int]] = {}
    for r in groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")).collect():
        out.setdefault(r["lang"], {})[r["source"]] = r["n"]
    return {k: Language(sorted(x, key=str.encode), np.array([x[s] for s in sorted(x, key=str.encode)], np.int64), *sizes.get(k, (0, 0))) for k, x in out.items()}


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to all other sources, and the terms used more than in the language."""
    lists = staged(postings(docs, least), "postings")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = staged(docs.select(blank("lang"), blank("source")).distinct(), "groups")
    langs = groups.sparkSession.sparkContext.broadcast(_languages(groups, lists))
    parts = staged(map_arrow(lists, lambda batches: _sums(batches, langs.value, top), PARTS), "parts")
    half = parts.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = half.union(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    other = groups.select(F.col("lang").alias("l"), F.col("source").alias("item"))
    every = groups.join(other, (F.col("lang") == F.col("l")) & (F.col("source") != F.col("item"))).drop("l")  # rows of the result
    pairs = every.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    rows = pairs.union(parts.filter("part = 'term'").select("lang", "source", "part", "item", "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return rows.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= top))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all sources of all languages of ``documents``."""
    return divergence(table(spark, sf_dir, "documents")).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


#: The same over all terms of all pairs.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT i) AS docs FROM t GROUP BY lang, source, term),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
s AS (SELECT DISTINCT lang, source FROM d),
g AS (SELECT s.lang, s.source, sum(coalesce(c.n, 0)) AS n FROM s LEFT JOIN (SELECT c.lang, c.source, c.n FROM c JOIN k ON c.lang = k.lang AND c.term = k.term) c ON s.lang = c.lang AND s.source = c.source GROUP BY s.lang, s.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.n + 5 * v.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (v.n + 5 * v.v) AS q
      FROM g JOIN v ON g.lang = v.lang JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM o WHERE part = 'pair' OR rank <= 50
"""
