"""Gold spans and how well found ones match them: corpora, precision, recall and F1 of exact spans, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "id string, text string, annotations array<struct<entity_type:string,start:int,end:int,text:string>>"
KEY = ["doc_id", "entity_type", "start", "end"]


def metrics(found: DataFrame, gold: DataFrame) -> DataFrame:
    """(entity_type, tp, fp, fn, precision, recall, f1), one row for each type and ``__total__``.

    Sides are distinct spans. Without anything found precision is 1, without anything to find recall is 1; F1 is 0 if
    both are 0. One full outer join on the span; the total is there without any row, too.
    """
    a = found.select(*KEY).distinct().withColumn("f", F.lit(1))
    b = gold.select(*KEY).distinct().withColumn("g", F.lit(1))
    both = a.join(b, KEY, "full_outer").select("entity_type", F.coalesce("f", F.lit(0)).alias("f"), F.coalesce("g", F.lit(0)).alias("g"))
    parts = [F.sum(F.col("f") * F.col("g")).alias("tp"), F.sum(F.col("f") * (1 - F.col("g"))).alias("fp"), F.sum(F.col("g") * (1 - F.col("f"))).alias("fn")]
    # not a rollup, as that gives no total for no rows
    sums = both.groupBy("entity_type").agg(*parts).union(both.groupBy().agg(*parts).select(F.lit("__total__"), "tp", "fp", "fn"))
    tp, fp, fn = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("tp", "fp", "fn"))
    share = lambda x, y: F.when(x + y == 0, F.lit(1.0)).otherwise(x / (x + y))
    rows = sums.select("entity_type", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), share(tp, fp).alias("precision"), share(tp, fn).alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return rows.withColumn("f1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))


def aligned(gold: DataFrame, texts: DataFrame) -> DataFrame:
    """Gold spans whose ``value`` is not the text at their place: none if a corpus is sound."""
    return gold.join(texts, "doc_id").filter(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("value"))


def summary(rows: DataFrame) -> DataFrame:
    """Metrics as printable lines."""
    return rows.select("entity_type", F.format_string("%-24s P=%.3f R=%.3f F1=%.3f (tp=%d fp=%d fn=%d)", "entity_type", "precision", "recall", "f1", "tp", "fp", "fn").alias("line"))


def load_corpus(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(texts, gold) of a JSON corpus (CORPUS): (doc_id, text) and (doc_id, entity_type, start, end, value).

    With ``strict``, a gold span whose value is not the text at its place fails the query that meets it.
    """
    rows = spark.read.schema(CORPUS).json(path, multiLine=True).withColumnRenamed("id", "doc_id")
    gold = rows.select("doc_id", "text", F.explode("annotations").alias("a")).select("doc_id", "text", "a.entity_type", "a.start", "a.end", F.col("a.text").alias("value"))
    if strict:
        there = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
        wrong = F.concat(F.lit("sample "), "doc_id", F.lit(": expected "), "value", F.lit(" at ["), "start", F.lit(", "), "end", F.lit("), got "), there)
        gold = gold.withColumn("value", F.when(there == F.col("value"), F.col("value")).otherwise(F.raise_error(wrong).cast("string")))
    return rows.select("doc_id", "text"), gold.drop("text")


def align(gold: DataFrame, texts: DataFrame) -> DataFrame:
    """Places for gold values that say only which occurrence they are: (doc_id, entity_type, value, nth) with nth from 1.

    Gives start and end in code points, null where the text has fewer occurrences (which do not overlap). The place
    comes from the text before the n-th one, so occurrences are neither listed nor paired. One join on doc_id.
    """
    before = F.expr("CASE WHEN nth > 0 AND length(value) > 0 THEN length(substring_index(text, value, nth)) END")
    rows = gold.join(texts.select("doc_id", "text"), "doc_id", "left").withColumn("_at", before)
    real = F.expr("substring(text, _at + 1, length(value)) = value")
    rows = rows.withColumn("start", F.when(real, F.col("_at"))).withColumn("end", F.col("start") + F.length("value"))
    return rows.drop("text", "_at")


def gate(rows: DataFrame, precision: float = 0.9, recall: float = 0.9, by_type: dict[str, tuple[float, float]] | None = None, strict: bool = True) -> DataFrame:
    """Add ``passed`` to rows of ``metrics``: whether a type (or ``__total__``) reaches its least precision and recall.

    ``by_type`` has limits of their own for some types; others and the total have ``precision`` and ``recall``. With
    ``strict``, a row that does not pass fails the query, naming the type and its figures; so does a type of ``by_type``
    that has no row.
    """
    by_type = by_type or {}
    limit = lambda i, other: F.coalesce(F.create_map(*[F.lit(x) for k, v in by_type.items() for x in (k, float(v[i]))])[F.col("entity_type")], F.lit(float(other))) if by_type else F.lit(float(other))
    if by_type:
        asked = rows.sparkSession.createDataFrame([(k,) for k in by_type], "entity_type string")
        rows = rows.join(asked, "entity_type", "full_outer")
    passed = F.coalesce((F.col("precision") >= limit(0, precision)) & (F.col("recall") >= limit(1, recall)), F.lit(False))
    if strict:
        figure = lambda c: F.when(F.col(c).isNull(), "none").otherwise(F.format_string("%.3f", c))
        told = F.format_string("%s: precision %s, recall %s", "entity_type", figure("precision"), figure("recall"))
        passed = F.when(passed, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("below the gate: "), told)).cast("boolean"))
    return rows.withColumn("passed", passed)
