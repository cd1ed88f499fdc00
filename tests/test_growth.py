"""Work that grows with the input: rows over all cores, scans that copy little, patterns that are tried where they can match."""

import random

import pytest
from pyspark.sql import functions as F

from veilspark.functions.spans import CHUNK, PIECE, cut, lit, pieces, scan, spread, words_near
from veilspark.operators.address import address_tokens
from veilspark.operators.rules import TIER_SIGNS, TIERS
from veilspark.plans import queries as Q


def test_keys_go_over_all_cores(spark, tmp_path):
    """A file that is one split of a scan is many tasks of the engine; filters still reach the scan."""
    spark.range(1000).selectExpr("id AS c_custkey", "'x' AS c_name").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    made = Q._made(spark, str(tmp_path), Q._MIX)
    sizes = made.rdd.glom().map(len).collect()
    assert len(sizes) >= 2 * spark.sparkContext.defaultParallelism and sum(sizes) == 1000 and max(sizes) < 300
    assert "EqualTo(c_custkey,5)" in made.filter("doc_id = 5")._jdf.queryExecution().executedPlan().toString()


def test_scan_over_chunks(spark):
    """Running sums and the odd ones of them, at sizes around the bounds of chunks."""
    df = spark.createDataFrame([([*range(n)],) for n in (0, 1, CHUNK - 1, CHUNK, CHUNK + 1, 3 * CHUNK, 3 * CHUNK + 5)], "a array<int>")
    every = scan("a", "0", "int", lambda c, x: (f"{c} + {x}", None))
    odd = scan("a", "0", "int", lambda c, x: (f"{c} + {x}", f"CASE WHEN ({c} + {x}) % 2 = 1 THEN {c} + {x} END"))
    for a, e, o in df.select("a", F.expr(every), F.expr(odd)).collect():
        sums = [sum(a[: i + 1]) for i in range(len(a))]
        assert (e["c"], e["o"]) == (sum(a), sums) and (o["c"], o["o"]) == (sum(a), [s for s in sums if s % 2])


def test_cuts_at_bounds_of_pieces(spark):
    text = "".join(chr(0x4E00 + i) if i % 3 else "𠮷" for i in range(2 * PIECE + 7))
    places = [(a, n) for a in (0, 1, PIECE - 1, PIECE, PIECE + 1, 2 * PIECE + 6, 2 * PIECE + 7, 3 * PIECE) for n in (-1, 0, 1, PIECE - 1, PIECE, PIECE + 1, 3 * PIECE)]
    rows = spark.createDataFrame(places, "a int, n int").select("a", "n", F.expr(cut(pieces(lit(text)), "a", "n")).alias("got")).collect()
    assert len(rows) == len(places) and all(r["got"] == text[r["a"] : r["a"] + max(r["n"], 0)] for r in rows)


def test_words_ahead_from_either_end(spark):
    """The words ahead of a hit are those that a pattern anchored at its end finds in the text as it runs."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab1護照字 ，-é𠮷") for _ in range(rng.randrange(70))) for _ in range(400)]
    word, between = r"(?:[\p{L}\p{Nd}&&[^\p{IsHan}]]++|\p{IsHan}{1,2}+)", r"[^\p{L}\p{Nd}]*+"
    ahead = f"lower(concat(regexp_extract(substring(t, greatest(h.start - 60, 0) + 1, 60), {lit(f'(?:{word}{between}){{0,5}}' + chr(92) + 'z')}, 0), '\\n', ''))"
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.expr("named_struct('start', length(t), 'end', length(t)) AS h"))
    rows = df.select("t", F.expr(words_near(pieces("t"), "h", 5, 0)).alias("got"), F.expr(ahead).alias("want")).collect()
    assert [r for r in rows if r["got"] != r["want"]] == []


def test_signs_lose_no_token(spark):
    """Each tier is searched only in texts with one of its signs, which all its tokens have."""
    rng = random.Random(7)
    parts = "台北市|新竹縣|大安|區|鄉|路|大道|五段|街|12|巷|弄|３|之1|號|大樓|大廈|社區|中心|廣場|園區|A|棟|座|館|樓|層|F7|f1|室|房|第二單元|，|中文|x".split("|")
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for tier, pattern in TIERS:
        assert df.filter(F.expr(f"t rlike {lit(pattern)} AND NOT t rlike {lit(TIER_SIGNS[tier])}")).count() == 0, tier
    assert df.select(F.explode(F.expr(address_tokens("t", "true")))).count() > 500


@pytest.mark.parametrize("n", [1, 40])
def test_spread_keeps_rows(spark, n):
    assert sorted(r[0] for r in spread(spark.range(n).coalesce(1)).collect()) == list(range(n))


def test_addresses_before_a_full_stop(spark):
    """E-mail addresses are those that a search without look-around finds, in time that grows with the text."""
    from veilspark.operators.engine import DeidEngine, span_rows

    texts = ["write to ann@example.com.", "ann@mail7.example.</p>", "ann@example.com1", "ann@example.com@x.org", "@ann@example.com", "no@valid", "a" * 300000, "x@y.org..z@y.org, q@y.org"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = span_rows(DeidEngine(entities=["EMAIL_ADDRESS"]).detect(df), "doc_id").orderBy("doc_id", "start").collect()
    assert [(r["doc_id"], r["value"]) for r in rows] == [(0, "ann@example.com"), (1, "ann@mail7.example"), (2, "ann@example.com"), (3, "ann@example.com"), (4, "ann@example.com"), (7, "x@y.org..z@y.org"), (7, "q@y.org")]


def test_shortcuts_of_disjoint_spans(spark):
    """Spans that are apart keep their places in order; those that meet, are empty or lie in another are resolved as ever."""
    from veilspark.functions.spans import SPANS
    from veilspark.operators import span_algebra as A

    rng, text, rows = random.Random(11), "ab  cd ef   gh", []
    for _ in range(600):
        starts = [rng.randrange(len(text)) for _ in range(rng.randrange(6))]
        rows.append(([(rng.choice("AB"), a, min(a + rng.randrange(4), len(text)), rng.choice([0.5, 0.9])) for a in starts],))
    df = spark.createDataFrame(rows, f"s {SPANS}")
    whole = lambda s: A.clip_overlaps(A.drop_contained(s))
    got = df.select("s", F.expr(A.resolve(lit(text), "s")).alias("r"), F.expr(whole("s")).alias("w"), F.expr(A.merge_touching("s")).alias("m")).collect()
    for r in got:
        want = []
        for x in map(tuple, r["w"]):
            gap = text[want[-1][2] : x[1]] if want else ""
            if want and want[-1][0] == x[0] and gap and not gap.strip(" "):
                want[-1] = (x[0], want[-1][1], x[2], max(want[-1][3], x[3]))
            else:
                want.append(x)
        assert [tuple(x) for x in r["r"]] == want
        merged = []
        for x in sorted(map(tuple, r["s"])):
            if merged and merged[-1][0] == x[0] and x[1] <= merged[-1][2]:
                merged[-1] = (x[0], merged[-1][1], max(merged[-1][2], x[2]), max(merged[-1][3], x[3]))
            else:
                merged.append(x)
        assert [tuple(x) for x in r["m"]] == merged


def test_scan_over_levels(spark):
    """Running sums at sizes around the bounds of blocks of chunks."""
    sizes = [b + k for b in (CHUNK**2, 2 * CHUNK**2) for k in (-CHUNK, -1, 0, 1, CHUNK + 1)] + [5000]
    df = spark.createDataFrame([([*range(n)],) for n in sizes], "a array<int>")
    third = scan("a", "0L", "bigint", lambda c, x: (f"{c} + {x}", f"CASE WHEN {x} % 3 = 0 THEN {c} + {x} END"))
    for a, t in df.select("a", F.expr(third)).collect():
        sums = [i * (i + 1) // 2 for i in a]
        assert (t["c"], t["o"]) == (sums[-1], sums[::3])


def test_long_texts_grow_with_their_values(spark):
    """Carried results are not copied at each chunk: four times the elements take much less than sixteen times as long."""
    import time

    def took(n: int) -> float:
        df = spark.range(1).selectExpr(f"transform(sequence(1, {n}), x -> repeat('x', 20 + cast(x % 7 as int))) AS a")
        out = df.select(F.expr(scan("a", "cast(null as string)", "string", lambda c, x: (x, x))).alias("s")).select(F.size("s.o"))
        begin = time.perf_counter()
        assert out.collect() == [(n,)]
        return time.perf_counter() - begin

    took(1000)
    assert took(64000) < 9 * max(took(16000), 0.05)


def test_numbers_of_few_and_many_values(spark):
    """Looking values up and sorting them give the same numbers."""
    from veilspark.operators import span_algebra as A

    rng = random.Random(13)
    rows = [([(rng.choice("abcdé𠮷") * rng.randrange(1, 3), rng.choice("XYZ")) for _ in range(rng.randrange(40))],) for _ in range(300)]
    df = spark.createDataFrame(rows, "v array<struct<value:string,entity_type:string>>")
    for v, few, many in df.select("v", F.expr(A.numbered_few("v")), F.expr(A.numbered_many("v"))).collect():
        kinds, numbers, counts, want = {}, {}, {}, []
        for i, (value, kind) in enumerate(map(tuple, v)):
            new = value not in kinds
            if new:
                kinds[value] = kind
                numbers[value] = counts[kind] = counts.get(kind, 0) + 1
            want.append((i, value, kinds[value], numbers[value], new))
        assert [tuple(x) for x in few] == [tuple(x) for x in many] == want


def test_originals_of_few_and_many_entries(spark):
    """Marks without an entry stay, of two values for a mark the last counts, a null value counts as none."""
    from veilspark.operators import span_algebra as A

    rng = random.Random(17)
    entries = [[(f"<A_{rng.randrange(6)}>" if rng.random() < 0.95 else None, rng.choice(["x", "y", None, "<A_1>"])) for _ in range(rng.randrange(8))] for _ in range(300)]
    rows = [([f"<A_{rng.randrange(8)}>" for _ in range(rng.randrange(6))], e) for e in entries]
    df = spark.createDataFrame(rows, "m array<string>, e array<struct<key:string,value:string>>")
    for m, e, few, many in df.select("m", "e", F.expr(A.originals_few("m", "e")), F.expr(A.originals_many("m", "e"))).collect():
        last = {k: max((v for q, v in map(tuple, e) if q == k and v is not None), default=k) for k, _ in map(tuple, e)}
        assert few == many == [last.get(x, x) for x in m]


def test_offsets_of_several_patterns(spark):
    """Each pattern's places count from the text's begin, also with groups, over chunks, and after patterns that do not end it."""
    import re

    from veilspark.functions.spans import hits

    text = "".join(f"k{i}={i * 7},字𠮷" for i in range(60))
    own = [(r"k[0-9]+", 0), (r"=([0-9]+)", 1), (r"nothing", 0), (r"𠮷", 0)]
    got = spark.createDataFrame([(text,)], "t string").select(F.explode(F.expr(hits("t", [(p, g, None) for p, g in own])))).select("col.*").collect()
    assert [tuple(r) for r in got] == [(r, m.start(g), m.end(g), m[g]) for r, (p, g) in enumerate(own) for m in re.finditer(p, text)]


def test_words_that_hold_others_are_not_looked_for():
    from veilspark.functions.spans import has_any, shortest

    assert shortest(("車牌", "牌照", "車", "車號", "車")) == ("牌照", "車") and has_any("t", ("ab", "b")).count("contains") == 1


@pytest.mark.parametrize("name", ["allow_list", "partial_unmask", "unmask_audit"])
def test_texts_are_searched_once(spark, tmp_path, name):
    """What is joined with itself comes from stored rows: no plan holds the search for spans."""
    spark.range(100).selectExpr("id AS c_custkey", "'x' AS c_name").write.parquet(f"{tmp_path}/customer.parquet")
    plan = Q.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(text" not in plan


def test_purge_searches_no_text(spark, tmp_path, monkeypatch):
    from veilspark.operators.store import MappingStore

    plans = []
    monkeypatch.setattr(MappingStore, "purge", lambda self, s, purge=MappingStore.purge: (plans.append(s._jdf.queryExecution().optimizedPlan().toString()), purge(self, s))[1])
    spark.range(100).selectExpr("id AS c_custkey", "'x' AS c_name").write.parquet(f"{tmp_path}/customer.parquet")
    assert [tuple(r) for r in Q.session_store(spark, str(tmp_path)).collect()] == [(1, 50, 100), (2, 100, 200), (3, 80, 160)]
    assert len(plans) == 1 and "regexp_extract_all" not in plans[0]


def test_allowed_with_a_null_key(spark):
    """A row without a key keeps the spans that are not allowed."""
    from veilspark.operators.engine import DeidEngine, allowed, span_rows

    df = spark.createDataFrame([(1, "手機0911222333"), (None, "手機0911222333，手機0911222444")], "k int, text string")
    values = spark.createDataFrame([("0911222333",)], "value string")
    assert [tuple(r) for r in span_rows(allowed(DeidEngine().detect(df), values, "k"), "k").select("k", "value").collect()] == [(None, "0911222444")]
