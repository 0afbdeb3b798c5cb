"""Mixing sources to target weights.

Every document gets a hash-random key. The keys' leading bits cut each source into ranges of equal expected
size, which is a range sort without a sampling pass and gives the same ranges on every run. Prefix sums of the
word counts are taken inside each range and shifted by the ranges before it, so a source that holds a third of
all rows is spread over many tasks. A source's budget is cut exactly, at a word of one document; a budget above
the source's size repeats whole epochs first, each in the same order.

Defined cases: null and empty texts have size 0 and nothing is taken of them; a null source is a source of its
own, last in order; rows with equal ids have equal keys and follow one another, ordered by size; if all texts are
empty every target is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.storage import materialize, sized, spread

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
#: Expected documents in one range.
RANGE_ROWS = 50_000


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """(id, source, size, key)."""
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key_of(F.col(id_col), seed).alias("key"))


def targets(per_source: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Filling by weight until no source is above its cap is filling to one level L with min(cap * size, L * weight):
    ordered by cap * size / weight, a first part of the sources is full and the rest shares what is left. Sources are
    labels of the corpus, so this table has one row for each and is ordered in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    w = per_source.withColumn("weight", pick).withColumn("most", cap * F.col("source_size"))
    everything = Window.partitionBy()
    up = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    w = w.withColumn("goal", F.sum("source_size").over(everything) * F.lit(share))
    w = w.withColumn("left", F.col("goal") - F.sum("most").over(up)).withColumn("open", F.sum("weight").over(everything) - F.sum("weight").over(up))
    # the level if just the sources before this one are full; it rises until the right number of them is, then falls
    before = (F.col("left") + F.col("most")).cast("double") / (F.col("open") + F.col("weight")).cast("double")
    w = w.withColumn("level", F.max(before).over(everything))
    return w.select("source", "source_size", F.round(F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")), 6).alias("target"))


def shares(slim: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(id, source, size, key, source_size, target, epochs, rest): each document is taken ``epochs`` times whole, and ``rest`` of its words once more."""
    rows = slim.count()
    ranges = max(1, -(-rows // RANGE_ROWS))
    cut = slim.withColumn("range", F.shiftright("key", 40) * ranges / (1 << 20)).withColumn("range", F.floor("range").cast("int"))
    same = F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull()
    cut = cut.withColumn("s", same[0]).withColumn("sn", same[1])
    totals = materialize(cut.groupBy("s", "sn", "source", "range").agg(F.sum("size").alias("in_range")), "mix-ranges")
    goal = targets(totals.groupBy("source").agg(F.sum("in_range").alias("source_size")), weights, share, cap)
    goal = goal.withColumn("s", F.coalesce("source", F.lit(""))).withColumn("sn", F.col("source").isNull()).drop("source")
    before = totals.withColumn("before", F.sum("in_range").over(Window.partitionBy("s", "sn").orderBy("range")) - F.col("in_range"))
    plan = materialize(before.join(goal, ["s", "sn"]).select("s", "sn", "range", "before", "source_size", "target"), "mix-plan")
    inner = Window.partitionBy("s", "sn", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = cut.withColumn("upto", F.sum("size").over(inner)).join(sized(plan, plan.count(), 96), ["s", "sn", "range"])
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0).cast("long"))
    rest = F.greatest(F.lit(0).cast("long"), F.least("size", budget - epochs * F.col("source_size") - (F.col("before") + F.col("upto") - F.col("size"))))
    return placed.select("id", "source", "size", "key", "source_size", "target", epochs.alias("epochs"), rest.alias("rest"))


def mix(slim: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(id, source, size, source_size, target, taken) from sizes(), which should be materialised."""
    return shares(slim, weights, share, cap).select("id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("rest")).alias("taken"))


def cuts(slim: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, epochs, cut_key, cut_id, rest): one row a source, from which what the mix takes of any document follows.

    Each is taken ``epochs`` times whole, those before the cut in order of (key, id) once more, and of the one at the cut ``rest``
    words. Without a cut nothing is taken beyond the epochs. Rows equal in id are at the cut together. ``slim`` is sizes(), materialised."""
    got = materialize(shares(slim, weights, share, cap).select("id", "source", "key", "epochs", "rest"), "mix-shares")
    last = got.groupBy("source").agg(F.max("epochs").alias("epochs"), F.max(F.when(F.col("rest") > 0, F.col("key"))).alias("cut_key"))
    last = last.withColumnRenamed("source", "s")
    at = got.filter("rest > 0").join(last.filter("cut_key is not null").drop("epochs"), F.col("source").eqNullSafe(F.col("s")) & (F.col("key") == F.col("cut_key")))
    at = at.groupBy("s").agg(F.max(F.struct("id", "rest")).alias("at")).withColumnRenamed("s", "s2")
    return last.join(at, F.col("s").eqNullSafe(F.col("s2")), "left").select(F.col("s").alias("source"), "epochs", "cut_key", F.col("at.id").alias("cut_id"), F.col("at.rest").alias("rest"))


def key_of(id_: Column, seed: str = "mix") -> Column:
    """60 bits of md5 over seed and id, in [0, 2**60)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    slim = materialize(sizes(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))), "mix-sizes")
    return mix(slim).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP3_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source),
r AS (SELECT *, 2 * source_size / CAST(weight AS DOUBLE) AS ratio FROM s),
c AS (
  SELECT *, sum(source_size) OVER () * 1.5 - (sum(2 * source_size) OVER w - 2 * source_size) AS lft,
         sum(weight) OVER () - (sum(weight) OVER w - weight) AS opn
  FROM r WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
v AS (SELECT max(CAST(lft AS DOUBLE) / CAST(opn AS DOUBLE)) AS lvl FROM c),
t AS (SELECT source, source_size, round(least(CAST(2 * source_size AS DOUBLE), lvl * weight), 6) AS target FROM r, v),
p AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
         CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM p
"""
