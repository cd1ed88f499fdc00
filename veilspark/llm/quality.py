"""Operator 8, quality rules as a bitmask ledger (DataFrame functions only).

The ledger evaluates every rule once for each document and stores its measurements and a failure bit per rule. Policies
are versioned masks over those bits: applying one, or asking what each rule alone costs, never reads a text again.

Repeated windows inside one text, without a shuffle: each 3-word window is hashed to 64 bits, the low bits are replaced
by the position, and one primitive sort puts equal windows side by side.

Edge cases: null text counts as empty (no words: fails); repeated rows stay; an empty table gives no rows; columns other
than doc_id and text are carried only by ``apply_policy`` on a ledger made with ``keep``; names of the ledger win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

WHITE = "[\\x20\\x09-\\x0D]+"

#: Rules by bit. The first two are the base; the others are the method's verdict. True: the document fails.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 30 * n_words"),
    ("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "word_chars < 3 * n_words or word_chars > 12 * n_words"),
    ("shouting", "100 * n_upper > 60 * n_letters"),
    ("exclamation", "100 * n_exclaim > 30 * n_words"),
    ("few_letters", "100 * n_letters < 55 * word_chars"),
]
#: Policy versions: the rules that count. Version 1 is the base alone.
POLICIES: dict[int, tuple[str, ...]] = {1: ("few_words", "repeated_words"), 2: tuple(n for n, _ in RULES)}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_exclaim"]


def policy_mask(version: int) -> int:
    """The bits that a policy version enforces."""
    return sum(1 << i for i, (name, _) in enumerate(RULES) if name in POLICIES[version])


def _without(text: Column, pattern: str) -> Column:
    """How many characters a pattern takes from a text."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def measure(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the kept columns and MEASURES for each document."""
    text, words, lines = F.col("_text"), F.col("_words"), F.col("_lines")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    d = d.withColumn("_words", F.array_remove(F.split(text, WHITE), "")).withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]"))))
    d = d.withColumn("n_words", F.size(words).cast("long"))
    d = d.withColumn("_bits", F.ceil(F.log2(F.col("n_words") + 2)).cast("int"))
    # hash | position in the low bits; the top bits are lost to the shift
    key = lambda i: F.call_function("shiftleft", F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), F.col("_bits")).bitwiseOR(i.cast("long"))
    d = d.withColumn("_keys", F.when(F.col("n_words") >= 4, F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), key))).otherwise(F.array().cast("array<bigint>")))
    top = lambda x: F.call_function("shiftright", x, F.col("_bits"))
    same = lambda x, i: (top(x) == F.coalesce(top(F.get(F.col("_keys"), i + 1)), F.lit(None))) | (top(x) == top(F.get(F.col("_keys"), i - 1)))
    d = d.withColumn("_twice", F.filter("_keys", same))
    low = lambda x: (x - F.call_function("shiftleft", top(x), F.col("_bits"))).cast("int")
    covered = F.size(F.array_distinct(F.flatten(F.transform("_twice", lambda x: F.array(low(x), low(x) + 1, low(x) + 2)))))
    return d.select(
        "doc_id", *keep, "n_words",
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        _without(text, "[#*$%&|<>]+").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        _without(text, "\\p{Lu}+").alias("n_upper"),
        _without(text, "\\p{L}+").alias("n_letters"),
        _without(text, "!+").alias("n_exclaim"),
    )


def judged(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Measurements and ``failure_bits`` of each document, not stored: for a caller that needs one verdict only.

    The condition on the bits always holds but is not deterministic to Catalyst, which would otherwise push a filter on
    them into the measuring and repeat that for each word. It is a sum, as Catalyst replaces a bare ``rand() >= 0`` by true.
    """
    bits = F.lit(0)
    for i, (_, rule) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)))
    return measure(docs, keep).withColumn("failure_bits", F.when(F.rand(0) + 1 > 0, bits))


def ledger(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Measurements and ``failure_bits`` of each document, stored in the shared folder: policies and ablations read only this."""
    return staged(judged(docs, keep), "quality-ledger")


def apply_policy(rows: DataFrame, version: int = 2) -> DataFrame:
    """A ledger with base_failed and kept."""
    failed = lambda v: F.col("failure_bits").bitwiseAND(F.lit(policy_mask(v))) != 0
    return rows.withColumn("base_failed", failed(1)).withColumn("kept", ~failed(1) & ~failed(version))


def ablations(rows: DataFrame, version: int = 2) -> DataFrame:
    """(rule, failed, only): documents that fail a rule of the policy, and those that it alone rejects.

    One pass: documents are first counted by failure bits, so at most 2**rules rows are shuffled for each task.
    """
    counts = rows.select(F.col("failure_bits").bitwiseAND(F.lit(policy_mask(version))).alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << i).alias("bit")) for i, (n, _) in enumerate(RULES) if n in POLICIES[version]])
    each = counts.select("bits", "n", F.explode(rules).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"), F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("only"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the ledger of all documents under policy 2."""
    rows = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failure_bits", "n_lines", "n_upper", "n_letters", "n_exclaim")
