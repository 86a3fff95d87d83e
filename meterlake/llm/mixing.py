"""Mixing sources to target weights with DataFrame operations only.

Every document has a hash-random key. Keys are ranged into buckets within each source; bucket sums give distributed
prefix sums of sizes, so only the bucket in which a source's budget ends is looked at row by row. That yields one cut
a source: a place in the order and the words to take there. One pass over the documents then applies the cuts, without
shuffling texts. A target over the source's size repeats whole epochs first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterlake.llm.scratch import Scratch

#: Rows of one bucket, on average: that of a source in which its budget ends is sorted in one task.
BUCKET_ROWS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``target`` to (source, source_size), one row a source.

    Sources in code point order, null last, have ``weights`` in turn and share ``share`` times all sizes by weight.
    No target exceeds ``most`` times its source's size; the excess goes to the others by weight. Sizes are filled like
    water: sources are capped in order of cap / weight until the level of the rest is below every remaining cap.
    """
    everyone = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(everyone) - 1) % len(weights)
    rows = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1)).withColumn("place", F.row_number().over(everyone))
    rows = rows.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    total = Window.partitionBy()
    up_to = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(share) * F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(up_to), F.lit(0.0))) / (F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(up_to), F.lit(0)))
    rows = rows.withColumn("level", level).withColumn("final", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(total))
    capped = F.struct("ratio", "place") < F.struct("final.ratio", "final.place")
    return rows.select("source", "source_size", F.when(capped, F.col("cap")).otherwise(F.col("final.level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, carry: tuple[str, ...] = (), seed: str = "", digits: int | None = None) -> DataFrame:
    """(``carry``, doc_id, size, source_size, target, taken): one row per input row.

    ``size``: words of the text (null: 0). ``taken``: words that the mix takes, repeats counted, at most ``most``
    times the size; a source's taken words sum to its rounded target. The order within a source is that of
    md5(seed + id), id, size; rows alike in all of them share the words at the cut evenly, rounded down. Null is a
    source and an id of its own. Carried columns keep their names unless one of the five results has it. An empty
    table gives an empty one. ``digits``: hexadecimal digits of the key that name a bucket; None: as many as give
    buckets of some BUCKET_ROWS rows, three at least.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    results = ("doc_id", "size", "source_size", "target", "taken")
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    carried = [F.col(f"`{c}`").alias(f"kept_{k}") for k, c in enumerate(carry) if c not in results]
    sized = docs.select(*carried, F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.md5(F.concat(F.lit(seed), name)).alias("key"), name.alias("name"))
    slim = scratch.keep(sized.select("source", "size", "key", "name", "doc_id"), "sized")
    if digits is None:
        digits = max(3, math.ceil(math.log(max(1, slim.count() / BUCKET_ROWS), 16)))
    buckets = slim.groupBy("source", F.substring("key", 1, digits).alias("bucket")).agg(F.sum("size").alias("words"))
    buckets = scratch.keep(buckets, "buckets")
    goals = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    budget = F.least(F.floor(F.col("target") + 0.5).cast("double"), F.lit(most) * F.col("source_size")).cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("bigint")
    goals = goals.withColumn("budget", budget).withColumn("epochs", epochs).withColumn("rest", F.expr("budget - epochs * source_size"))
    goals = scratch.keep(goals, "goals")
    # the bucket in which the rest of a source's budget ends, and what its buckets before hold
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranged = buckets.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    ends = ranged.join(goals, same(ranged, goals)).where("before < rest and rest <= before + words").select(ranged["source"], "bucket", "before", "rest")
    ends = scratch.keep(ends, "ends")
    # rows of those buckets only, rows alike in all of the order as one
    inside = slim.join(ends, same(slim, ends) & (F.substring(slim["key"], 1, digits) == ends["bucket"]))
    inside = inside.groupBy(slim["source"], "key", "name", "size", "before", "rest").agg(F.count("*").alias("copies"))
    place = Window.partitionBy("source").orderBy("key", "name", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("start", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(place), F.lit(0)))
    cut = inside.where("start < rest and rest <= start + size * copies").select("source", F.struct("key", "name", "size").alias("cut"), F.expr("(rest - start) div copies").alias("part"))
    goals = goals.withColumnRenamed("source", "of")
    cuts = scratch.keep(goals.join(cut, goals["of"].eqNullSafe(cut["source"]), "left").select("of", "source_size", "target", "epochs", "cut", "part"), "cuts")
    rows = sized if carry else slim
    at = F.struct("key", "name", "size")
    last = F.when(F.col("cut").isNull() | (at > F.col("cut")), F.lit(0)).when(at < F.col("cut"), F.col("size")).otherwise(F.col("part"))
    mixed = rows.join(cuts, rows["source"].eqNullSafe(cuts["of"]))
    back = [F.col(f"kept_{k}").alias(c) for k, c in enumerate(carry) if c not in results]
    return mixed.select(*back, "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).cast("bigint").alias("taken"))


#: The same rows in DuckDB, over ``documents`` with the default parameters.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(CAST(doc_id AS VARCHAR), '') AS name, md5(COALESCE(CAST(doc_id AS VARCHAR), '')) AS key,
    CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place
  FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, CAST(2 AS DOUBLE) * source_size AS cap FROM sources),
levels AS (
  SELECT *, cap / weight AS ratio,
    (CAST(1.5 AS DOUBLE) * CAST(SUM(source_size) OVER () AS DOUBLE)
      - COALESCE(SUM(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / CAST(SUM(weight) OVER () - COALESCE(SUM(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM weighted),
final AS (SELECT ratio, place, level FROM levels WHERE level <= ratio ORDER BY ratio, place LIMIT 1),
goals AS (
  SELECT l.source, l.source_size,
    CASE WHEN (l.ratio, l.place) < (f.ratio, f.place) THEN l.cap ELSE f.level * l.weight END AS target
  FROM levels l, final f),
budgets AS (
  SELECT *, CAST(LEAST(floor(target + 0.5), CAST(2 AS DOUBLE) * source_size) AS BIGINT) AS budget FROM goals),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM budgets),
grouped AS (
  SELECT source, key, name, size, COUNT(*) AS copies FROM sized GROUP BY source, key, name, size),
placed AS (
  SELECT *, COALESCE(SUM(size * copies) OVER (PARTITION BY source ORDER BY key, name, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM grouped)
SELECT s.doc_id, s.size, e.source_size, e.target,
  CAST(e.epochs * s.size + CASE
    WHEN e.budget - e.epochs * e.source_size <= p.start THEN 0
    WHEN e.budget - e.epochs * e.source_size >= p.start + p.size * p.copies THEN s.size
    ELSE (e.budget - e.epochs * e.source_size - p.start) // p.copies END AS BIGINT) AS taken
FROM sized s
JOIN epochs e ON s.source IS NOT DISTINCT FROM e.source
JOIN placed p ON s.source IS NOT DISTINCT FROM p.source AND s.key = p.key AND s.name = p.name AND s.size = p.size
"""
