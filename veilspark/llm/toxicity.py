"""Operator 3, toxicity by a support vector machine on a gap-weighted subsequence string kernel.

Kernel: two strings are compared by their common subsequences of three letters, each weighted by DECAY to the length it
spans, normalised. A unit's end counts as a letter, so that a clean word is told from longer ones that begin with it.
Characters that are not letters only lengthen spans, so "i-d-i-o-t" stays close to "idiot", and an
inserted letter costs little.
Nyström: landmarks are words of the training sentences; a string's features are its kernels with the landmarks, times
the inverse root of the landmarks' own kernel matrix. A linear SVM (squared hinge) is trained on them.
Sentences end at a line's end, or at . ! ? before white space. Their units are words, and runs of single letters
("i d i o t"); a sentence's score is its highest unit's (``score_sentences``), a document's its highest sentence's. One
kernel vector of a whole sentence lets an insult drown among other words; README has the figures.
Labels belong to whole documents, so which of a toxic document's sentences are toxic is learnt: training alternates: fit on all units that mark toxic documents against those of clean ones, then add
the clean units that score highest, and for each toxic document without a mark its highest unit that no clean document
holds (a document without such a unit gives no row). A logistic curve fitted on the training documents gives the final score.

Because the machine is linear in the landmarks' subsequences, scoring needs one table of 32**3 weights, whatever the
number of landmarks; that table is all that executors get.

Training reads at most TRAIN_DOCUMENTS labelled documents, chosen by a hash of doc_id, and never those whose
crc32(doc_id as text) mod 5 is 0. It runs in one task on an executor, which that number bounds; the driver gets the model.

Edge cases: null or empty text scores as a text without units; without labels of both kinds every score is 0.0 (no
toxic label known) or the share of toxic labels; null labels are ignored; a doc_id that is labelled twice counts
twice; repeated rows stay; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import itertools
import math
import pickle
import random
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, ship, table, text_slices

TRAIN_DOCUMENTS, LANDMARKS, DECAY, LONGEST = 4000, 96, 0.7, 20
MARKS, FALSE_MARKS = 256, 0.05  # landmarks among the marks (all marks are positive rows); share of marks that are so by chance
_WORD = re.compile(r"\w(?:[^\x20\x09-\x0D]*\w)?")
_SPELLED = re.compile(r"\b\w(?:(?:[ \-_*]|\.(?!\s)){1,3}\w\b){2,}")  # as no sentence's end does, it never spans one
_SENTENCE = re.compile(r"(?:[^.!?\n]|[.!?](?!\s|$))+")
GAP, END = 31, 30
_END = "\x1f"  # stands after a unit


def _codes(units: list[str]) -> np.ndarray:
    """Letters of equally long units as codes: a to z, four classes of other letters, GAP."""
    x = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(units), -1)
    letters = np.array([c.isalpha() for c in map(chr, range(0x250))])
    out = np.where(x >= 0x250, 26 + x % 4, np.where(letters[np.minimum(x, 0x24F)], 26 + x % 4, GAP))
    return np.where((x >= 97) & (x <= 122), x - 97, np.where(x == ord(_END), END, out)).astype(np.int64)


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All places of three letters in n, and the weight of each."""
    at = np.array(list(itertools.combinations(range(n), 3)), np.int64).reshape(-1, 3)
    return at, DECAY ** (at[:, 2] - at[:, 0] + 1).astype(float)


def pieces(unit: str) -> list[str]:
    """A unit, or overlapping windows of a very long one: no part of it is left out."""
    if len(unit) <= LONGEST:
        return [unit]
    half = LONGEST // 2
    return [unit[i : i + LONGEST] for i in range(0, len(unit) - half, half)]


def features(unit: str) -> dict[int, float]:
    """The normalised weights of a unit's subsequences, by code."""
    unit += _END
    if len(unit) < 3:
        return {}
    at, weight = _triples(len(unit))
    c = _codes([unit])[0][at]
    good = (c != GAP).all(axis=1)
    out: Counter = Counter()
    for u, w in zip((c[good] @ np.array([1024, 32, 1])).tolist(), weight[good].tolist()):
        out[u] += w
    norm = sum(v * v for v in out.values()) ** 0.5
    return {u: v / norm for u, v in out.items()} if norm else {}


class Kernel:
    """Scores units by a table of subsequence weights, with a bounded memory of earlier units."""

    def __init__(self, weights: np.ndarray, bias: float, capacity: int = 300_000):
        self.weights, self.bias, self.capacity, self.memo, self.places = weights.ravel(), bias, capacity, {}, {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}, "places": {}}

    def fresh(self, units: list[str]) -> np.ndarray:
        """Scores of units of any length."""
        out = np.full(len(units), self.bias)
        by: dict[int, list[int]] = {}
        for i, u in enumerate(units):
            by.setdefault(len(u) + 1, []).append(i)
        for n, rows in by.items():
            if n < 3:
                continue
            if n > LONGEST + 1:
                for i in rows:
                    out[i] = self.fresh(pieces(units[i])).max()
                continue
            at, weight = self.places.setdefault(n, _triples(n))
            step = max(1, 500_000 // len(at))
            for k in range(0, len(rows), step):
                pick = rows[k : k + step]
                c = _codes([units[i] + _END for i in pick])
                key = (c[:, at[:, 0]] << 10) + (c[:, at[:, 1]] << 5) + c[:, at[:, 2]]
                w = np.where((c[:, at] == GAP).any(axis=2), 0.0, weight) if (c == GAP).any() else np.broadcast_to(weight, key.shape)
                raw = (self.weights[key] * w).sum(axis=1)
                # the norm needs the sums of equal subsequences
                order = np.argsort(key, axis=1)
                ks, ws = np.take_along_axis(key, order, 1), np.take_along_axis(w, order, 1)
                total = np.cumsum(ws, axis=1)
                last = np.concatenate([ks[:, 1:] != ks[:, :-1], np.ones((len(ks), 1), bool)], axis=1)
                held = np.where(last, total, 0.0)
                before = np.maximum.accumulate(held, axis=1)
                run = np.where(last, total - np.concatenate([np.zeros((len(ks), 1)), before[:, :-1]], axis=1), 0.0)
                norm = np.sqrt((run * run).sum(axis=1))
                out[pick] = raw / np.where(norm > 0, norm, 1.0) + self.bias
        return out

    def documents(self, units: list[set[str]]) -> list[float]:
        """The highest unit score of each document."""
        seen = set().union(*units)
        memo = self.memo
        if new := [u for u in seen if u not in memo]:
            if len(memo) + len(new) > self.capacity:
                memo.clear()
                new = list(seen)
            memo.update(zip(new, self.fresh(new).tolist()))
        out = [max(map(memo.__getitem__, u), default=self.bias) for u in units]
        if len(memo) > self.capacity:
            memo.clear()
        return out


def units_of(text: str) -> set[str]:
    """The distinct units of a whole text."""
    low = text.lower()
    out = set(_WORD.findall(low))
    out.update(re.sub(r"[ .\-_*]", "", x) for x in _SPELLED.findall(low))
    return out


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence that is not blank. No unit spans two of them."""
    return [m.span() for m in _SENTENCE.finditer(text) if not m[0].isspace()]


class Model:
    """A fitted kernel and the logistic curve (slope, offset) from its score to a probability."""

    def __init__(self, kernel: Kernel, slope: float, offset: float):
        self.kernel, self.slope, self.offset = kernel, slope, offset

    def scores(self, texts: list[str]) -> list[float]:
        top = np.array(self.kernel.documents([units_of(t) for t in texts])) if texts else np.zeros(0)
        return (1 / (1 + np.exp(-np.clip(self.slope * top + self.offset, -30, 30)))).tolist()


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 20.0, steps: int = 30) -> np.ndarray:
    """Weights (bias last) of a linear SVM with squared hinge, by Newton steps on its active rows."""
    w = np.zeros(x.shape[1] + 1)
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        left, right = ridge.copy(), np.zeros(len(w))
        for k in range(0, len(x), 1000):  # few rows at a time: the driver holds no copy of x
            part = np.concatenate([x[k : k + 1000], np.ones((len(x[k : k + 1000]), 1))], axis=1, dtype=np.float64)
            on = y[k : k + 1000] * (part @ w) < 1
            a = part[on] * weight[k : k + 1000][on, None]
            left += c * (a.T @ part[on])
            right += c * (a.T @ y[k : k + 1000][on])
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def _tail(k: int, n: int, p: float) -> float:
    """The chance of k or more toxic documents among n."""
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k, n + 1))


def _noisy(unit: str, rng: random.Random, letters: str) -> list[str]:
    """A unit with one letter put in, and with gaps."""
    i, j = rng.randrange(1, len(unit)), rng.randrange(1, len(unit))
    return [unit[:i] + rng.choice(letters) + unit[i:], "-".join(unit), unit[:j] + "*" + unit[j:]]


def fit(rows: list[tuple[str, int]], seed: int = 7) -> Model:
    """Train on (text, toxic) pairs: at most TRAIN_DOCUMENTS."""
    flat = lambda p: Model(Kernel(np.zeros(32768), 0.0), 0.0, float(np.log(p / (1 - p))) if 0 < p < 1 else (-30.0 if p <= 0 else 30.0))
    rows = sorted(rows)
    total = [sum(1 for _, t in rows if t == k) for k in (0, 1)]
    if not all(total):
        return flat(total[1] / max(1, sum(total)))
    rng, bags = random.Random(seed), [units_of(t) for t, _ in rows]
    seen = [Counter(), Counter()]
    for bag, (_, t) in zip(bags, rows):
        seen[t].update(u for u in bag if 3 <= len(u) <= LONGEST)
    share = total[1] / sum(total)
    surprise = {u: (k - (k + seen[0][u]) * share) / ((k + seen[0][u]) * share * (1 - share)) ** 0.5 for u, k in seen[1].items()}
    marks = sorted((u for u, z in surprise.items() if z >= 4 and seen[1][u] >= 2 and seen[1][u] >= 4 * seen[0][u]), key=lambda u: (-surprise[u], u))
    # of the thousands of units some pass by chance: keep those whose false share is expected to be at most FALSE_MARKS
    tested = sum(1 for u in surprise if seen[1][u] + seen[0][u] >= 2)
    odds = {u: _tail(seen[1][u], seen[1][u] + seen[0][u], share) for u in marks}
    limit = max((p for i, p in enumerate(sorted(odds.values()), 1) if p * tested <= FALSE_MARKS * i), default=0.0)
    marks = [u for u in marks if odds[u] <= limit]
    if not marks:
        return flat(share)
    letters = "".join(sorted({c for u in seen[0] for c in u if c.isalpha()})) or "x"
    known = set(marks)
    clean = sorted(u for u in seen[0] if u not in known)
    rng.shuffle(clean)
    # the marks that cover most toxic documents are landmarks, documents covered less often first; so are as many clean
    # units: half of them at random, half of them those most like the marks
    held = [bag & known for bag, (_, t) in zip(bags, rows) if t and bag & known]
    at = {u: i for i, u in enumerate(marks)}
    inside = np.zeros((len(marks), len(held)), np.float32)
    for j, own in enumerate(held):
        inside[[at[u] for u in own], j] = 1
    need, chosen = np.ones(len(held), np.float32), []
    for _ in range(min(MARKS, len(marks))):
        gain = inside @ need
        gain[chosen] = -1
        chosen.append(int(np.argmax(gain)))
        need *= 1 - inside[chosen[-1]] / 2
    picked = [marks[i] for i in chosen]
    sums = np.zeros(32768)
    for u in marks:
        f = features(u)
        sums[list(f)] += list(f.values())
    most = max(LANDMARKS - len(picked), len(picked))
    like = Kernel(sums, 0.0).fresh(clean)
    close = [clean[i] for i in np.argsort(-like, kind="stable")[: most // 2]]
    landmarks = picked + close + [u for u in clean if u not in set(close)][: most - len(close)]
    maps = [features(u) for u in landmarks]
    dense = np.zeros((len(maps), 32768), np.float32)
    for i, m in enumerate(maps):
        dense[i, list(m)] = list(m.values())
    values, vectors = np.linalg.eigh(dense @ dense.T)
    good = values > 1e-6
    root = vectors[:, good] / np.sqrt(values[good])  # K_mm ** -1/2
    embed = lambda units: np.array([dense[:, list(f)] @ np.array(list(f.values())) if f else np.zeros(len(maps)) for f in map(features, units)], np.float32) @ root.astype(np.float32)
    positive = marks + [v for u in marks for _ in range(3) for v in _noisy(u, rng, letters)]
    negative = clean[:1500]
    xp, xn = embed(positive), embed(negative)
    # toxic documents without a mark: units that no clean document holds, of which the highest is a positive row
    unmarked = [own for bag, (_, t) in zip(bags, rows) if t and not bag & known and (own := sorted(u for u in bag if 3 <= len(u) <= LONGEST and u not in seen[0]))]
    for turn in range(6):
        x = np.concatenate([xp, xn], dtype=np.float32)
        y = np.concatenate([np.ones(len(xp)), -np.ones(len(xn))])
        # a row weighs as the documents that hold its unit: a common clean word must not pass for a rare mark's kin
        w = _svm(x, y, np.array([max(1, seen[1][u]) for u in positive] + [seen[0][u] for u in negative], float))
        kernel = Kernel((root @ w[:-1]) @ dense, float(w[-1]))
        if turn < 5:
            witness = {own[int(np.argmax(kernel.fresh(own)))] for own in unmarked} - set(positive)
            if witness:
                positive += sorted(witness)
                xp = np.concatenate([xp, embed(sorted(witness))])
            score = kernel.fresh(clean)
            hard = [clean[i] for i in np.argsort(-score)[:3000] if score[i] > -1]
            hard = sorted(set(hard) - set(negative))
            if not hard and not witness:
                break
            if hard:
                negative += hard
                xn = np.concatenate([xn, embed(hard)])
    # the curve's slope comes from disguised units, too, of which the documents may hold none; its middle from documents alone
    top = np.concatenate([kernel.documents(bags), kernel.fresh(positive)])
    kernel.memo.clear()
    y = np.concatenate([[t for _, t in rows], np.ones(len(positive))]).astype(float)
    # the units together weigh no more than the toxic documents: their number must not move the curve
    mass = np.concatenate([np.ones(len(rows)), np.full(len(positive), min(1.0, total[1] / len(positive)))])
    slope, offset = 1.0, 0.0
    for _ in range(50):  # logistic curve by damped Newton steps
        p = 1 / (1 + np.exp(-np.clip(slope * top + offset, -30, 30)))
        g = np.array([(mass * (p - y) * top).sum() + 0.01 * slope, (mass * (p - y)).sum()])
        q = mass * np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(q * top * top).sum() + 0.01, (q * top).sum()], [(q * top).sum(), q.sum() + 1e-9]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, offset = slope - move[0], offset - move[1]
    return Model(kernel, slope, -slope * _cut(top[: len(rows)], y[: len(rows)]))


def _cut(top: np.ndarray, y: np.ndarray, slack: float = 0.005) -> float:
    """Where to part the scores ``top`` of documents: in the middle of the stretch around the best place that is as good within ``slack``.

    Good is the share of toxic documents above plus the share of clean ones below, so a common clean word that scores near
    the toxic ones moves the place, which the number of either kind does not.
    """
    order = np.argsort(top, kind="stable")
    top, y = top[order], y[order]
    below = np.cumsum(y == 0) / (y == 0).sum() - np.cumsum(y > 0) / (y > 0).sum()
    ends = np.flatnonzero(top[1:] > top[:-1])  # the last row of each score but the highest
    if not len(ends):
        return float(top[0])
    good = below[ends] >= below[ends].max() - slack
    first = last = int(np.argmax(below[ends]))
    while first > 0 and good[first - 1]:
        first -= 1
    while last + 1 < len(ends) and good[last + 1]:
        last += 1
    return float(top[ends[first]] + top[ends[last] + 1]) / 2


def held_out(doc_id) -> F.Column:
    """Whether labels of a row must not be learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCUMENTS) -> Model:
    """Fit on at most ``most`` labelled documents, in a task of its own."""
    chosen = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(most)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", "text").limit(most).select("text", "toxic")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held = [(t, int(k > 0)) for b in batches for t, k in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist())]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(held))], pa.binary())], ["model"])

    got = map_arrow(rows.coalesce(1), run, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else fit([])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row. The model is one table of 32768 weights."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in text_slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.scores([t or "" for t in b.column("text").to_pylist()]), pa.float64())], ["doc_id", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(slim, run, "doc_id long, score double")


def score_sentences(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, start, end, score) of every sentence, in code points; a document's score is its highest."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in text_slices(batches):
            rows = [(i, x, y, t[x:y]) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for x, y in sentences(t or "")]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(shared.value.scores(list(cols[3])), pa.float64())], ["doc_id", "start", "end", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(slim, run, "doc_id long, start long, end long, score double")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose score is below 0.5, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in text_slices(batches):
            yield b.filter(pa.array([s < 0.5 for s in shared.value.scores([t or "" for t in b.column("text").to_pylist()])], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: scores of all documents."""
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = score_documents(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
