"""Periodic runs, source divergence and near-duplicate vectors against brute force, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from veilspark.llm import caps, divergence, runs
from veilspark.llm.divergence import Language, divergence as audit, share

WORD = r"[^\x20\x09-\x0D]+"


def brute_runs(w, least=12):
    out = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(least, 2 * p):
                out.setdefault((s, i + p), p)
    return sorted((s, e - s, p) for (s, e), p in out.items())


def sequences(rng, n):
    out = []
    for _ in range(n):
        size, k = rng.randrange(90), rng.choice([1, 2, 3, 6])
        w = [rng.randrange(k) for _ in range(size)]
        a, p = rng.randrange(size + 1), rng.randrange(1, 9)
        out.append([x if i < a or rng.random() < 0.03 else w[min(a + (i - a) % p, size - 1)] for i, x in enumerate(w)])
    return out


@pytest.mark.parametrize("least", [2, 12])
@pytest.mark.parametrize("pairs", [7, 1 << 20])
def test_runs_of_many_texts(monkeypatch, least, pairs):
    monkeypatch.setattr(runs, "PAIRS", pairs)
    rng = random.Random(least)
    for _ in range(15):
        some = sequences(rng, rng.randrange(6))
        got = runs.find_runs(np.array([x for w in some for x in w], np.int32), np.array([len(w) for w in some], np.int64), least)
        assert [tuple(r) for r in got.tolist()] == [(i, s, n, p) for i, w in enumerate(some) for s, n, p in sorted(brute_runs(w, least), key=lambda r: (r[0], r[2]))]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    made = ["".join(f"w{x}" + rng.choice([" ", "\n", "\t\x0b", "\x0c "]) for x in w) for w in sequences(rng, 60)]
    return [None, "", " \n\x0b", "a", "word " * 20000, "a b c " * 5, " ".join(f"u{i}" for i in range(3000)) * 3, "中 文　x " * 9, *made]


def test_runs_query(spark, texts, tmp_path):
    rows = [(i, t, "en", 1) for i, t in enumerate(texts)] + [(None, "a b " * 9, "en", 1), (3, "a", "en", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, runs int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in runs.op11_runs(spark, str(tmp_path)).collect())
    want = []
    for i, t, _, _ in rows:
        w = re.findall(WORD, t or "")
        h, n = zlib.crc32(b"" if i is None else str(i).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if j < a else w[a + (j - a) % p] for j, x in enumerate(w)]
        found = [(0, n, 1)] if n > 9000 and len(set(w)) == 1 else brute_runs(w)
        kept = [x for j, x in enumerate(w) if not any(s + p <= j < s + m for s, m, p in found)]
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{m},{p}\n" for s, m, p in sorted(found, key=lambda r: (r[0], r[2])))
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), sha(" ".join(kept))))
    assert got == Counter(want) and sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))) > 2
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_audit(rows, least, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang in {k for k, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = sorted(s for k, s in groups if k == lang)
        dist = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p = {s: dist(counts[lang, s]) for s in own}
        q = dist(sum((counts[lang, s] for s in own), Counter()))
        for s in own:
            far = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in own if o != s))
            out |= {(lang, s, "pair", o.decode(), -v, i) for i, (v, o) in enumerate(far, 1)}
            over = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            out |= {(lang, s, "term", t.decode(), -v, i) for i, (v, t) in enumerate(over[:top], 1)}
    return out


@pytest.mark.parametrize("heavy", [0, 4, 10**6])  # all light, both kinds, all heavy
def test_audit(spark, monkeypatch, heavy):
    rng = random.Random(4)
    names = "Äpfel und BIRNEN été l'eau x1y 中文 alpha beta Gamma delta_epsilon ſ K".split()
    rows = [(" ".join(rng.choice(names) + rng.choice(["", "", str(rng.randrange(3)), "ab"]) for _ in range(rng.randrange(30))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s10", "s2", None, "Ü", "t" * 30, "q", "r"])) for _ in range(300)]
    rows += [(None, "en", "s1"), ("", "xx", "only"), ("a b", "xx", "two"), ("hot " * 9000, "en", "s1"), ("same", "en", "s1"), ("same", "en", "s1")]
    monkeypatch.setattr(divergence, "HEAVY", heavy)
    monkeypatch.setattr(divergence, "TILE", 40)
    monkeypatch.setattr(divergence, "HELD", 100)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, source string, term string, n int")
    got = audit(df.repartition(4), least=5, top=3).select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_audit(rows, 5, 3)
    if heavy == 4:
        assert audit(df.limit(0)).count() == 0


def test_shares_beyond_64_bits():
    for count, n, v in ((10**14, 4 * 10**14, 10**6), (0, 0, 1), (7, 7, 3), (10**12 + 3, 10**15, 10**9)):
        assert int(share(np.array([count]), np.array([n]), v)[0]) == 1 + 10**9 * (count + 5) // (n + 5 * v)
    assert Language(["a"], np.array([0]), 0, 0).z.tolist() == [0]


def brute_links(rows):
    unit = []
    for _, x, label in rows:
        ok = x is not None and len(x) and label is not None and all(e is not None and np.isfinite(e) for e in x) and any(x)
        unit.append(np.array(x, float) / np.abs(x).max() if ok else None)
    root, n = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            a, b = unit[i], unit[j]
            if a is None or b is None or len(a) != len(b) or rows[i][2] != rows[j][2] or a @ b / np.linalg.norm(a) / np.linalg.norm(b) < 0.98:
                continue
            n[i] += 1
            n[j] += 1
            old, new = root[i], root[j]
            root = [new if r == old else r for r in root]
    low = defaultdict(list)
    for (v, _, _), r in zip(rows, root):
        low[r] += [v] * (v is not None)
    return Counter((v, k, c := min(low[r], default=None), v is not None and v == c) for (v, _, _), k, r in zip(rows, n, root))


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(caps, "BLOCK", 16)  # so that filters are cut
    rng = np.random.default_rng(5)
    rows: list[tuple] = []

    def near(x, cosine):
        z = rng.standard_normal(len(x))
        z -= (z @ x) / (x @ x) * x
        return cosine * x / np.linalg.norm(x) + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z)

    for _ in range(60):
        x = rng.standard_normal(24)
        rows += [(len(rows), x.tolist(), 1), (len(rows) + 1, (5 * near(x, rng.choice([0.981, 0.979, 0.995]))).tolist(), int(rng.choice([1, 1, 2])))]
    x = rng.standard_normal(24)
    rows += [(1000 + i, near(x, 0.992).tolist(), 3) for i in range(90)]  # near copies, of which not all are linked
    rows += [(2000 + i % 7, x.tolist(), 3) for i in range(40)]  # copies, repeated ids
    odd = [None, [], [0.0] * 24, [None] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0], [1e300, 2e300], [1.0] * 24]
    rows += [(3000 + i, v, 4) for i, v in enumerate(odd)] + [(3100, [1.0] * 24, None), (3101, [1.0] * 24, None), (None, [1.0] * 24, 4), (None, [9.0] * 24, 5)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, label int, node string, n int").repartition(5)
    assert Counter(tuple(r) for r in caps.link_vectors(df).collect()) == brute_links(rows)
    assert caps.link_vectors(df.limit(0)).count() == 0


def test_recall_of_filters_at_the_limit():
    rng = np.random.default_rng(6)
    for d in (3, 64, 200):
        x = caps.unit_vectors(rng.standard_normal((400, d)))
        z = rng.standard_normal((400, d))
        z = caps.unit_vectors(z - (z * x).sum(1, keepdims=True) * x)
        a, b = (set(zip(*(c.tolist() for c in caps.cap_filters(v)))) for v in (x, 0.98 * x + np.sqrt(1 - 0.98**2) * z))
        assert len({v for v, _ in a & b}) >= 398
