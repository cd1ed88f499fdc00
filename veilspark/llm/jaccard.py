"""Operator 10, n-gram Jaccard self-join by vertical partitioning.

Global order: the distinct word n-grams of a document are ordered by a 64-bit hash, the same for all documents.
Fragments: the order is cut into F equal ranges. Two documents of a pair may differ in at most D n-grams, a bound that
follows from the similarity and the size level; each of those spoils one fragment, so with F > D some fragment holds
exactly the same n-grams in both. Documents therefore meet only on a fragment's digest.
Common n-grams: those found HOT_IN times or more in a sample of about SAMPLE documents are left out of the fragments, so
that a passage that many documents share does not make them meet. Any set of n-grams may be left out without losing a
pair, as sets without them differ no more than before; the sample only decides how much work is saved. A document left
with more empty fragments than the slack also gives the digests of its whole fragments (``signatures``).
Partial overlaps: a pair that met is first held against a bound on its difference (``odd_sketch``), then counted in
fragments, each pair and fragment apart, and summed per pair; the sum decides exactly.

Groups: equal sets are one class before any pairing. In a bucket of equal digests, rounds link members to one pivot,
not to each other; a pivot that has met its bucket leaves it, and a bucket within one component is done. Members that are in different components after ``ROUNDS`` rounds become queries, which go in blocks
against the rest of their buckets, again fragment by fragment (``rest_links``). So every link that joins components
counts, and no pairs of a group are ever rows.

Edge cases: null or empty text has an empty set, n_shingles 0, and is its own component; fewer words than the n-gram
length form one n-gram; rows that share a doc_id are documents of their own, each with its own set and component (equal
ids are then two names for different rows); null doc_ids likewise, and null sorts first, so it names its components;
an empty table gives no rows; other columns are dropped. Sets are compared by 64-bit digests of their n-grams.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import _mix
from .common import map_arrow, partitions, ship, staged, table, text_slices
from .components import components

GRAM, PERCENT, ROUNDS, COUNTED = 4, 85, 3, 4
SAMPLE, HOT_IN, HOT_MOST = 5000, 3, 2_000_000  # documents looked at for common n-grams; how often is common; 16 MB of them at most
BLOCK, SALTED, GRID = 512, 2000, 4000  # queries and nodes of a task in rest_links, nodes of a block in families
SLACK = 15  # per cent of the fragments that may be empty
NO_ID = -(1 << 63)  # stands for a null doc_id
BROADCAST_ROWS = 500_000  # of 8 bytes: 4 MB; beyond it the join shuffles
_U = np.uint64
_K = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[_U(1)], np.full(max(0, n - 1), base, _U)]))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts, A-Z lower-cased, and the first word of each text (one more entry at the end)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8).copy()
    upper = (data >= 65) & (data <= 90)
    data[upper] += 32
    white = (data == 32) | ((data >= 9) & (data <= 13))
    begin = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    end = np.flatnonzero(~white[:-1] & white[1:]) + 1
    total = np.concatenate([[_U(0)], np.cumsum((data.astype(_U) + _U(1)) * _powers(_K, len(data)))])
    words = _mix((total[end] - total[begin]) * _powers(_INVERSE, len(data))[begin] + (end - begin).astype(_U) * _K)
    places = np.cumsum([1] + [len(r) + 1 for r in raw])
    return words, np.searchsorted(begin, places, side="left")


def shingle_sets(texts: list[str], gram: int = GRAM) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    words, first = word_hashes(texts)
    n = max(0, len(words) - gram + 1)
    grams = np.zeros(n, _U)
    for k in range(gram if n else 0):
        grams = _mix(grams + _K) * _U(3) + words[k : k + n]
    grams = _mix(grams)
    out = []
    for b, e in zip(first[:-1].tolist(), first[1:].tolist()):
        if e - b >= gram:
            g = np.sort(grams[b : e - gram + 1])
            out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif e > b:
            short = np.array([e - b], _U)
            for w in words[b:e].reshape(-1, 1):
                short = _mix(w + short * _K)
            out.append(short)
        else:
            out.append(np.zeros(0, _U))
    return out


def levels(n: int, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """(level, fragments, slack) at which a set of n meets partners whose size is at most n * 100 / percent, or at least that much less.

    Level k has the sizes from 1.5**k on. A pair meets at the level of its larger set.
    """
    k = int(np.floor(np.log(n) / np.log(1.5) + 1e-9))
    out = []
    for level in (k, k + 1):
        if level == k or n * 100 >= percent * int(np.ceil(1.5 ** (k + 1) - 1e-9)):
            most = int(np.ceil(1.5 ** (level + 1) - 1e-9))
            if d := (2 * most * (100 - percent)) // (100 + percent):
                slack = 1 + d * SLACK // 100
                out.append((level, d + 1 + slack, slack))
    return out


def _digests(grams: np.ndarray, level: int, cuts: int, scheme: int) -> tuple[np.ndarray, np.ndarray]:
    """Digest and size of each of ``cuts`` fragments."""
    sums = np.concatenate([[_U(0)], np.cumsum(_mix(grams + _K))])
    at = np.searchsorted(((grams >> _U(32)) * _U(cuts)) >> _U(32), np.arange(cuts + 1, dtype=_U))
    size = np.diff(at)
    seeds = _mix(np.arange(cuts, dtype=_U) * _U(1000) + _U(2 * level + scheme))
    return _mix((sums[at[1:]] - sums[at[:-1]] + size.astype(_U) * _K) ^ seeds), size


def _common(grams: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which n-grams are in the sorted ``hot``."""
    if not len(hot):
        return np.zeros(len(grams), bool)
    return hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] == grams


def signatures(grams: np.ndarray, percent: int = PERCENT, hot: np.ndarray = np.zeros(0, _U)) -> np.ndarray:
    """Digests of a set's fragments, for each of its levels.

    First the fragments without the n-grams of ``hot``, empty ones left out. Of a pair's F fragments at least 1 + slack
    are equal, so if either set has at most ``slack`` empty ones, the pair meets there. A set with more of them also
    gives its whole fragments; so a pair in which both have more meets on these. There the same holds: empty fragments
    count only if the set has more of them than the slack.
    """
    out = []
    rest = grams[~_common(grams, hot)]
    for level, cuts, slack in levels(len(grams), percent) if len(grams) else ():
        digest, size = _digests(rest, level, cuts, 0)
        out.append(digest[size > 0])
        if (size == 0).sum() > slack:
            digest, size = _digests(grams, level, cuts, 1)
            out.append(digest[size > 0] if (size == 0).sum() <= slack else digest)
    return np.concatenate(out) if out else np.zeros(0, _U)


def odd_sketch(grams: np.ndarray) -> np.ndarray:
    """Bits of a power of two, 4 to 8 for an n-gram, each the parity of the n-grams that hash to it, as 64-bit words.

    Each n-gram in which two sets differ flips one bit, so the number of different bits is at most that of n-grams.
    A sketch is made half as long by the xor of its halves.
    """
    words = 1 << max(0, int(np.ceil(np.log2(max(1, len(grams)) / 16))))
    place = (_mix(grams ^ _K) & _U(64 * words - 1)).astype(np.int64)
    odd = (np.bincount(place, minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<u8")


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def node_of(grams: np.ndarray) -> int:
    """The digest that stands for a whole set."""
    return int(_long(_mix(_mix(grams).sum(dtype=_U, keepdims=True) + np.array([grams.size], _U) * _K))[0])


def _slim(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.col("text").cast("string").alias("text"))


def _texts(batches: Iterable[pa.RecordBatch], gram: int) -> Iterable[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches of about 2 MB of text with their sets."""
    for b in text_slices(batches, 2_000_000):
        yield b, shingle_sets([t or "" for t in b.column("text").to_pylist()], gram)


def document_sets(docs: DataFrame, gram: int = GRAM, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, n, node): size and digest of each document's set. ``keep``: further columns of longs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b, sets in _texts(batches, gram):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(b.column, keep), pa.array([len(x) for x in sets], pa.int64()), pa.array([node_of(x) for x in sets], pa.int64())], ["doc_id", *keep, "n", "node"])

    kept = "".join(f"{c} long, " for c in keep)
    return map_arrow(_slim(docs, keep), run, f"doc_id long, {kept}n long, node long")


def common_grams(docs: DataFrame, rows: int, gram: int = GRAM) -> np.ndarray:
    """Sorted n-grams that HOT_IN or more of about SAMPLE documents hold: at most HOT_MOST, the most frequent ones.

    They save work and change no result, so neither the sample nor the bound loses anything.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for _, sets in _texts(batches, gram):
            yield pa.RecordBatch.from_arrays([pa.array(_long(np.concatenate([*sets, np.zeros(0, _U)])), pa.int64())], ["gram"])

    step = max(1, -(-rows // SAMPLE))
    sample = _slim(docs).filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(step)) == 0)
    found = map_arrow(sample, run, "gram long").groupBy("gram").agg(F.count("*").alias("k")).filter(F.col("k") >= HOT_IN)
    got = found.orderBy(F.desc("k"), "gram").limit(HOT_MOST).select("gram").toArrow().column("gram").to_numpy()
    return np.sort(np.ascontiguousarray(got).view(_U))


def document_signatures(docs: DataFrame, hot: np.ndarray, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """(sig, node) of all documents; once for each set and task, so a text with very many copies gives few rows."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)  # HOT_MOST numbers at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _texts(batches, gram):
            sigs, nodes = [np.zeros(0, _U)], []
            for x in sets:
                if len(x) and (node := node_of(x)) not in seen:
                    seen.add(node)
                    sigs.append(signatures(x, percent, shared.value))
                    nodes.append(node)
            many = [len(x) for x in sigs[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(_long(np.concatenate(sigs))), pa.array(np.repeat(np.array(nodes, np.int64), many))], ["sig", "node"])

    return map_arrow(_slim(docs), run, "sig long, node long")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table of longs if a count shows that it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def node_fragments(docs: DataFrame, wanted: DataFrame, gram: int = GRAM) -> DataFrame:
    """(node, frag, n, grams) for the wanted (rep, node): the n-grams of each node in each of the COUNTED fragments.

    The row of fragment -1 holds the odd sketch. Rows that share a doc_id and a text may give a node once for each task;
    what reads the fragments allows for that.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        seen: set[int] = set()
        for b, sets in _texts(batches, gram):
            rows = []
            for node, x in zip(b.column("node").to_pylist(), sets):
                if node in seen or node_of(x) != node:
                    continue  # a repeated row, or another text under the same doc_id
                seen.add(node)
                at = np.searchsorted(((x >> _U(32)) * _U(COUNTED)) >> _U(32), np.arange(COUNTED + 1, dtype=_U))
                rows += [(node, f, len(x), _long(x[at[f] : at[f + 1]])) for f in range(COUNTED)]
                rows.append((node, -1, len(x), _long(odd_sketch(x))))
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(list(cols[3]), pa.list_(pa.int64()))], ["node", "frag", "n", "grams"])

    slim = _slim(docs).join(_small(wanted.select(F.col("rep").alias("doc_id"), "node")), "doc_id")
    return map_arrow(slim.select("text", "node"), run, "node long, frag int, n long, grams array<long>")


def sketches(fragments: DataFrame) -> DataFrame:
    """(node, sketch), once for each node."""
    return fragments.filter("frag = -1").groupBy("node").agg(F.first("grams").alias("sketch"))


def sized(pairs: DataFrame, sizes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, na, nb): the pairs (a, b) whose sizes allow a link, for sizes (node, n)."""
    side = lambda x: sizes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)


def possible(pairs: DataFrame, sketched: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b, na, nb) whose odd sketches allow a link: a bound that loses none."""
    side = lambda x: sketched.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    half = lambda s: F.zip_with(F.slice(s, F.lit(1), (F.size(s) / 2).cast("int")), F.slice(s, (F.size(s) / 2).cast("int") + 1, (F.size(s) / 2).cast("int")), lambda x, y: x.bitwiseXOR(y))
    fit = lambda s, o: F.when(F.size(s) > F.size(o), half(s)).otherwise(s)  # noqa: E731  sizes of a pair are at most a factor of two apart
    both = both.select("a", "b", "na", "nb", fit(F.col("sa"), F.col("sb")).alias("sa"), fit(F.col("sb"), F.col("sa")).alias("sb"))
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return both.filter(apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)).select("a", "b")


def overlaps(pairs: DataFrame, fragments: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, linked) of pairs: partial overlaps by fragment, summed per pair."""
    few = pairs.count() <= BROADCAST_ROWS
    held = F.broadcast if few else lambda d: d
    fragments = fragments.filter("frag >= 0")
    left = fragments.select(F.col("node").alias("a"), "frag", F.col("n").alias("na"), F.col("grams").alias("ga")).join(held(pairs.select("a", "b")), "a")
    right = fragments.select(F.col("node").alias("b"), "frag", F.col("n").alias("nb"), F.col("grams").alias("gb")).join(held(pairs.select("b").distinct()), "b", "left_semi")
    met = left.join(right, ["b", "frag"])
    part = met.select("a", "b", "na", "nb", "frag", F.size(F.array_intersect("ga", "gb")).cast("long").alias("part"))
    parts = [F.max(F.when(F.col("frag") == f, F.col("part"))) for f in range(COUNTED)]  # a repeated fragment counts once
    summed = part.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), sum(F.coalesce(p, F.lit(0)) for p in parts).alias("both"))
    return summed.select("a", "b", (F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).alias("linked"))


def families(rest: DataFrame, met: DataFrame, sketched: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, family): nodes of open buckets (sig, node, label) that may still have links, by who may link with whom.

    Two sets of a level with F fragments, of which D + 1 + slack = F, that differ in d n-grams share at least F - d
    fragments, so at least D + 1 - d with n-grams. First, buckets that share members form a group. A group goes in
    blocks of GRID nodes against its other blocks; a task gets two blocks with their digests and sketches only, counts
    what each node shares with all others, and gives one row for each two parts that a pair joins that has enough shares
    and sketches near enough.
    """
    star = rest.select("node", F.min("node").over(Window.partitionBy("sig")).alias("b"))
    group = components(star.select(F.col("node").alias("a"), "b")).withColumnRenamed("label", "grp")
    nodes = rest.groupBy("node", "label").agg(F.collect_set("sig").alias("sigs")).join(group, "node").join(met.select("node", "n"), "node").join(sketched, "node")
    nodes = staged(nodes, "open-nodes")
    blocks = nodes.groupBy("grp").agg(F.ceil(F.count("*") / GRID).cast("int").alias("blocks"))
    own = nodes.join(blocks, "grp").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label", "n", "sigs", "sketch")

    def run(t: pa.Table) -> pa.Table:
        node, label, size, own = (t.column(c).to_numpy() for c in ("node", "label", "n", "own"))
        lists = t.column("sigs").combine_chunks()
        many = np.diff(lists.offsets.to_numpy())
        bits = [np.asarray(x, np.int64).view(_U) for x in t.column("sketch").to_pylist()]
        words = np.array([len(x) for x in bits])
        fold = lambda x: x[: len(x) // 2] ^ x[len(x) // 2 :]
        own_row, shelf = np.zeros(len(node), np.int64), {}
        for w in np.unique(words).tolist():
            rows = np.flatnonzero(words == w)
            own_row[rows], shelf[w] = np.arange(len(rows)), np.stack([bits[i] for i in rows])
        _, at = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        owner = np.repeat(np.arange(len(node)), many)
        order = np.argsort(at, kind="stable")
        members, ptr = owner[order], np.concatenate([[0], np.cumsum(np.bincount(at))]) if len(at) else np.zeros(1, np.int64)
        begin = np.concatenate([[0], np.cumsum(many)])
        _, label = np.unique(label, return_inverse=True)
        root = np.arange(len(node))
        cross = t.column("i")[0].as_py() != t.column("j")[0].as_py()
        bound = {k: (d[1], d[2]) for k in np.unique(size).tolist() for d in [levels(k, percent)[0] if levels(k, percent) else (0, 1, 0)]}
        most = np.array([bound[k][0] - bound[k][1] for k in size.tolist()])  # D + 1 at the node's own level
        out = []
        for x in range(len(node)):
            sigs = at[begin[x] : begin[x + 1]]
            k = ptr[sigs + 1] - ptr[sigs]
            shared = np.bincount(members[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(ptr[sigs], k)], minlength=len(node))
            ys = np.flatnonzero(shared)
            ys = ys[(label[ys] != label[x]) & (size[ys] <= size[x]) & (root[ys] != root[x])]  # x is the larger, so its level counts
            if cross:
                ys = ys[own[ys] != own[x]]
            apart = (size[ys] + size[x]) * (100 - percent) // (100 + percent)
            ys = ys[(shared[ys] >= np.maximum(1, most[x] - apart)) & (size[ys] * 100 >= size[x] * percent)]
            apart = (size[ys] + size[x]) * (100 - percent) // (100 + percent)
            far = np.full(len(ys), 1 << 40)
            for w, mine in ((words[x], bits[x]), (words[x] // 2, fold(bits[x]))):  # y is no larger, and at most a factor of two
                if len(k := np.flatnonzero(words[ys] == w)):
                    far[k] = np.bitwise_count(shelf[w][own_row[ys[k]]] ^ mine).sum(axis=1)
            ys = ys[far <= apart]
            for r in np.unique(root[ys]).tolist():
                out.append((int(node[x]), int(node[r])))
                root[root == r] = root[x]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    spread = dealt.repartition(partitions(dealt.sparkSession), "grp", "i", "j")  # few bytes but much work: not to be coalesced
    edges = staged(spread.groupBy("grp", "i", "j").applyInArrow(run, "a long, b long"), "family-edges")
    return components(edges).withColumnRenamed("label", "family")


def rest_links(rest: DataFrame, met: DataFrame, sketched: DataFrame, fragments: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links between the components that remain in open buckets (sig, node, label).

    In each of the ``families`` the nodes outside its largest component are queries; they
    go in blocks against all nodes of the family, which are dealt over salts. A task holds BLOCK queries and about
    SALTED nodes, counts the partial overlaps of each fragment apart through an index of the queries' n-grams in it, sums
    them per pair, and gives one link for each query and other component. Pairs are never rows.
    """
    family = families(rest, met, sketched, percent)
    nodes = staged(rest.select("node", "label").distinct().join(family, "node"), "family-nodes")
    sizes = nodes.groupBy("family", "label").agg(F.count("*").alias("k")).groupBy("family").agg(F.max(F.struct("k", "label")).getField("label").alias("main"), F.sum("k").alias("all"), (F.sum("k") - F.max("k")).alias("asked"))
    shape = sizes.select("family", "main", F.ceil(F.col("all") / SALTED).cast("int").alias("salts"), F.ceil(F.col("asked") / BLOCK).cast("int").alias("blocks"))
    parts = fragments.filter("frag >= 0").join(_small(nodes.select("node").distinct()), "node", "left_semi")
    dealt = nodes.join(shape, "family")
    spot = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    asked = dealt.filter("label != main").withColumn("block", spot("blocks")).withColumn("salt", every("salts")).withColumn("asks", F.lit(True))
    held = dealt.withColumn("salt", spot("salts")).withColumn("block", every("blocks")).withColumn("asks", F.lit(False))
    cols = ["family", "block", "salt", "asks", "node", "label"]
    both = asked.select(*cols).union(held.select(*cols)).join(parts, "node")

    def run(t: pa.Table) -> pa.Table:
        asks, frag, ids = (t.column(c).to_numpy() for c in ("asks", "frag", "node"))
        facts = {i: (n, k) for i, n, k in zip(ids.tolist(), t.column("n").to_pylist(), t.column("label").to_pylist())}
        lists = t.column("grams").combine_chunks()
        begin, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy()
        begin = begin - begin[0]
        q, m = np.unique(ids[asks]), np.unique(ids[~asks])
        both = np.zeros((len(m), len(q)), np.int32)
        for f in range(COUNTED):  # partial overlaps of one fragment; a node that comes twice counts once
            rows = {a: {i: r for r, i in zip(np.flatnonzero((frag == f) & (asks == a)).tolist(), ids[(frag == f) & (asks == a)].tolist())} for a in (True, False)}
            held = [flat[begin[rows[True][i]] : begin[rows[True][i] + 1]] if i in rows[True] else flat[:0] for i in q.tolist()]
            if not sum(map(len, held)):
                continue
            known, at = np.unique(np.concatenate(held), return_inverse=True)
            owner = np.repeat(np.arange(len(q)), [len(g) for g in held])[np.argsort(at, kind="stable")]
            ptr = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(known)))])
            for j, i in enumerate(m.tolist()):
                g = flat[begin[rows[False][i]] : begin[rows[False][i] + 1]] if i in rows[False] else flat[:0]
                k = np.minimum(np.searchsorted(known, g), len(known) - 1)
                k = k[known[k] == g]
                n = ptr[k + 1] - ptr[k]
                both[j] += np.bincount(owner[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ptr[k], n)], minlength=len(q)).astype(np.int32)
        out: dict[tuple[int, int], int] = {}
        if len(q) and len(m):
            nq, kq = np.array([facts[i] for i in q.tolist()]).T
            for j, i in enumerate(m.tolist()):
                n, k = facts[i]
                for x in np.flatnonzero((both[j].astype(np.int64) * 100 >= (nq + n - both[j]) * percent) & (kq != k)):
                    out.setdefault((int(q[x]), k), i)
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array(list(out.values()), pa.int64())})

    return both.groupBy("family", "block", "salt").applyInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    return labelled_rows(docs, gram, percent).select("doc_id", "n_shingles", "component_id")


def labelled_rows(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, n_shingles, component_id, label) of every row.

    ``label`` is one number for each component, also where doc_ids are null or repeated; null for empty sets, whose rows
    are components of their own. ``keep``: columns of longs to carry.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), *keep, F.col("text").cast("string").alias("text"))
    sets = staged(document_sets(docs, gram, keep), "sets")
    nodes = staged(sets.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "nodes")
    hot = common_grams(docs, sets.count(), gram)
    by_sig = Window.partitionBy("sig").orderBy("node")
    near = document_signatures(docs, hot, gram, percent).select("sig", "node", F.lag("node").over(by_sig).alias("p"), F.lead("node").over(by_sig).alias("q"))
    buckets = staged(near.filter("p != node or q != node").select("sig", "node").distinct(), "buckets")
    met = staged(buckets.select("node").distinct().join(nodes, "node"), "met")
    fragments = staged(node_fragments(docs, met, gram), "fragments")
    sketched = sketches(fragments)

    held = F.broadcast if met.count() <= BROADCAST_ROWS else lambda d: d  # for tables of two longs a node
    labels = met.select("node", F.col("node").alias("label"))
    tested = spark.createDataFrame([], "a long, b long, linked boolean")
    last = 0

    def still_open(buckets: DataFrame, order: Column) -> DataFrame:
        """(sig, node, label, p, p_label) of buckets with several components, p being the pivot. Found by partial sums, so a large bucket is no single task."""
        rows = buckets.join(held(labels), "node")
        ranked = rows.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.struct(order, "node", "label")).alias("pivot")).filter("lo != hi")
        return rows.join(ranked.select("sig", F.col("pivot.node").alias("p"), F.col("pivot.label").alias("p_label")), "sig")

    for k in range(ROUNDS):
        links = tested.filter("linked")
        degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("links"))
        labels = labels.select("node", "label").join(held(degree), "node", "left")
        opened = staged(still_open(buckets, F.struct(-F.coalesce("links", F.lit(0)), F.xxhash64(F.lit(k), "node"))), "open")
        buckets = opened.filter("node != p").select("sig", "node")  # the pivot meets all of its bucket in this round
        pairs = opened.filter("p_label != label").select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b")).distinct()
        pairs = sized(pairs, held(met.select("node", "n")), percent)
        pairs = staged(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            break
        close = staged(possible(pairs, sketched, percent), "close")
        far = pairs.select("a", "b").join(close, ["a", "b"], "left_anti").withColumn("linked", F.lit(False))
        tested = staged(tested.union(far).union(overlaps(close, fragments, percent)), "tested")
        found = tested.filter("linked")
        n = found.count()
        if n > last:
            got = components(found)
            labels = staged(met.select("node").join(got, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
        last = n
    labels = labels.select("node", "label")
    rest = staged(still_open(buckets, F.lit(0)).select("sig", "node", "label"), "open")
    if not rest.isEmpty():
        more = staged(rest_links(rest, met, sketched, fragments, percent), "rest-links")
        got = components(tested.filter("linked").select("a", "b").union(more))
        labels = staged(met.select("node").join(got, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
    # smallest doc_id of each component, then of each row's class
    grouped = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = grouped.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = staged(grouped.join(smallest, "label").select("node", "label", "component_id"), "named")
    # rows with an empty set share a digest but no class
    some = sets.filter("n > 0").join(named, "node").select("doc_id", *keep, "n", "component_id", "label")
    none = sets.filter("n = 0").select("doc_id", *keep, "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("label"))
    known = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return some.union(none).select(known("doc_id"), *keep, F.col("n").alias("n_shingles"), known("component_id"), "label")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: components of all documents."""
    return jaccard_components(table(spark, sf_dir, "documents"))
