"""Operator 9, chat formatting with cumulative-snapshot collapse.

A log often holds a conversation many times, each time one turn longer. Every turn gets the digest of the conversation
up to it (a rolling hash); a conversation whose whole digest is a prefix digest of a longer one is dropped by an
anti-join, equal conversations leave the one with the smallest conv_id, and only what remains is rendered.

The rolling hash is the xor of hashes of (position, role, text), two of 64 bits, so prefixes can be built in chunks of
CHUNK turns and a conversation that holds a large share of all turns is no single task. Prefix digests are made
distinct with partial aggregation before the join, so a very common first turn is one row for each task.

Order of turns: turn, then role, then text; null turns first. Exactly repeated rows count once.
Edge cases: null role and null text count as empty; a null conv_id is a conversation of its own; an empty table gives
no rows; other columns are ignored. Rendering makes one string of one conversation, which is what the operator returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

CHUNK = 1024
TEMPLATE = "<|{role}|>\n{text}<|end|>\n"


def _clean(conversations: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.xxhash64(text).alias("h"))


def turn_prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, k, p, q): digest (p, q) of the first k turns of each conversation."""
    rows = _clean(conversations)
    rows = rows.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 60))))
    inside = Window.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    # repeated rows get one place and then meet where they are: texts are moved once, and not stored
    slim = rows.withColumn("rn", F.dense_rank().over(inside)).select("conv_id", "chunk", "turn", "role", "rn", "h", F.xxhash64(F.lit("second"), "text").alias("g")).distinct()
    slim = staged(slim, "turns")
    over = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = slim.groupBy("conv_id", "chunk").agg(F.count("*").alias("n")).select("conv_id", "chunk", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("chunk").alias("d"), "base")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("d"))
    placed = slim.join(firsts, same).select("conv_id", "chunk", (F.col("base") + F.col("rn")).alias("k"), "role", "h", "g")
    placed = placed.select("conv_id", "chunk", "k", F.xxhash64("k", "role", "h").alias("x"), F.xxhash64("g", "role", "k").alias("y"))
    running = Window.partitionBy("conv_id", "chunk").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("conv_id", "chunk", "k", F.bit_xor("x").over(running).alias("x"), F.bit_xor("y").over(running).alias("y"))
    sums = placed.groupBy("conv_id", "chunk").agg(F.bit_xor("x").alias("sx"), F.bit_xor("y").alias("sy"))
    before = sums.select(F.col("conv_id").alias("c"), F.col("chunk").alias("d"), F.coalesce(F.bit_xor("sx").over(over), F.lit(0)).alias("bx"), F.coalesce(F.bit_xor("sy").over(over), F.lit(0)).alias("by"))
    return local.join(before, same).select("conv_id", "k", F.col("x").bitwiseXOR(F.col("bx")).alias("p"), F.col("y").bitwiseXOR(F.col("by")).alias("q"))


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal) of the conversations that no longer one begins with, one for equal ones."""
    steps = staged(turn_prefixes(conversations), "prefixes")
    last = F.max_by(F.struct("p", "q"), "k")
    whole = steps.groupBy("conv_id").agg(F.max("k").alias("n"), last.alias("d")).select("conv_id", "n", "d.p", "d.q")
    kinds = staged(whole.groupBy("n", "p", "q").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal")), "conversation-kinds")
    # inner prefixes: of each kind once, by its first conversation
    reps = kinds.select(F.col("conv_id").alias("c"), "n")
    inner = steps.join(reps, F.col("conv_id").eqNullSafe(F.col("c"))).filter("k < n").select("k", "p", "q").distinct()
    kept = kinds.join(inner.withColumnRenamed("k", "n"), ["n", "p", "q"], "left_anti")
    return kept.select("conv_id", F.col("n").alias("n_turns"), "n_equal")


def render(conversations: DataFrame, kept: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, n_turns, n_equal, rendered): the kept conversations, each turn through ``template``."""
    rows = _clean(conversations)
    chosen = rows.join(kept.select(F.col("conv_id").alias("keep_id"), "n_turns", "n_equal"), rows["conv_id"].eqNullSafe(F.col("keep_id")))
    turn = F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), "role", "text")
    head, mid, tail = template.partition("{role}")[0], template.partition("{role}")[2].partition("{text}")[0], template.partition("{text}")[2]
    one: Column = F.array_join(F.transform(F.array_sort(F.collect_set(turn)), lambda t: F.concat(F.lit(head), t["role"], F.lit(mid), t["text"], F.lit(tail))), "")
    return chosen.groupBy("conv_id", "n_turns", "n_equal").agg(one.alias("rendered"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: maximal conversations of the whole table, rendered."""
    rows = table(spark, sf_dir, "conversations")
    return render(rows, staged(maximal(rows), "maximal"))


#: The same by joined text prefixes.
SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
r AS (SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
p AS (SELECT conv_id, k, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY k) AS prefix, count(*) OVER (PARTITION BY conv_id) AS n FROM r),
w AS (SELECT min(conv_id) AS conv_id, n, prefix, count(*) AS n_equal FROM p WHERE k = n GROUP BY n, prefix)
SELECT conv_id, n::BIGINT AS n_turns, n_equal::BIGINT AS n_equal, prefix AS rendered FROM w
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k = w.n AND p.n > w.n AND p.prefix = w.prefix)
"""
