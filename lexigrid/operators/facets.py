"""Facets and keywords: how features relate to a set of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.operators.index import Index
from lexigrid.spec import RANGE, SEQUENCE, SET


def field_features(index: Index, field: str, min_docs: int = 1, top_k: int | None = None) -> DataFrame:
    """(value, doc_count, location_count, relative_doc_count) by count; ranges have no locations."""
    n = index.docs.agg(F.count(F.lit(1)).alias("n_docs"))
    got = index.features(field, min_docs).crossJoin(F.broadcast(n))  # one row
    got = got.select("value", "doc_count", *([] if index.kinds[field] == RANGE else ["location_count"]), (F.col("doc_count") / F.col("n_docs")).alias("relative_doc_count"))
    return got.orderBy(F.desc("doc_count"), "value").limit(top_k) if top_k is not None else got


def ratio(a: Column, b: Column) -> Column:
    """Null where the divisor is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def statistics(d: Column, h: Column, q: Column, n: Column) -> list[Column]:
    return [
        d.alias("doc_count"), ratio(d, n).alias("relative_doc_count"), h.alias("hits"), ratio(h, n).alias("relative_hits"),
        ratio(h, d + q - h).alias("jaccard_similarity"), ratio(h, d).alias("feature_proportion"), ratio(h, q).alias("query_proportion"),
    ]


def facet(index: Index, query: Column, *fields: str) -> DataFrame:
    """Statistics of every feature of the fields against the documents that match the predicate: one scan, one shuffle.

    Whether a document matches travels with its features, so no join is needed."""
    flagged = Index(index.docs.withColumn("_q", query.cast("int")), index.kinds)
    made = [F.array_distinct(F.col(f).cast("array<string>")) if index.kinds[f] in (SEQUENCE, SET) else F.array_compact(F.array(F.col(f).cast("string"))) for f in fields]
    rows = F.array(*[F.struct(F.lit(f).alias("field"), m.alias("values")) for f, m in zip(fields, made)])
    long = flagged.docs.select("_q", F.explode(rows).alias("r")).select("_q", "r.field", F.explode("r.values").alias("value"))
    got = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("d"), F.sum("_q").alias("h"))
    totals = flagged.docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_q"), F.lit(0)).cast("long").alias("q"))
    return got.crossJoin(F.broadcast(totals)).select("field", "value", *statistics(F.col("d"), F.col("h"), F.col("q"), F.col("n")))  # one row


def facet_by_ids(index: Index, ids: DataFrame, *fields: str) -> DataFrame:
    """The same for any table (doc_id) of documents."""
    marked = index.docs.join(ids.select("doc_id").distinct().withColumn("_hit", F.lit(True)), "doc_id", "left")
    return facet(Index(marked, index.kinds, index.passage_size), F.coalesce("_hit", F.lit(False)), *fields)


def table_filter(df: DataFrame, order_by: str | None = None, reverse: bool = True, first_k: int | None = None, keep_above: float | None = None, ties: tuple[str, ...] = ("field", "value")) -> DataFrame:
    """Rows above a threshold of a statistic, ordered by it, the first k. Threshold and k have no meaning without an order."""
    if order_by is None:
        return df
    if keep_above is not None:
        df = df.filter(F.col(order_by) > keep_above)
    df = df.orderBy(F.desc(order_by) if reverse else F.asc(order_by), *[t for t in ties if t in df.columns])
    return df.limit(first_k) if first_k is not None else df


def contingency(index: Index, group: str, field: str, min_docs: int = 10) -> DataFrame:
    """(grp, value, a, f, g, n): documents of feature and group, of the feature, of the group, and all."""
    pairs = index.docs.select(F.col(group).cast("string").alias("grp"), F.explode(F.array_distinct(F.col(field))).alias("value"))
    cells = pairs.groupBy("grp", "value").agg(F.count(F.lit(1)).alias("a"))
    f = cells.groupBy("value").agg(F.sum("a").alias("f")).filter(F.col("f") >= min_docs)
    g = index.docs.groupBy(F.col(group).cast("string").alias("grp")).agg(F.count(F.lit(1)).alias("g"))
    n = index.docs.agg(F.count(F.lit(1)).alias("n"))
    return cells.join(f, "value").join(g, "grp").crossJoin(F.broadcast(n))


def keywords(index: Index, group: str, field: str, min_docs: int = 10, k: int = 45) -> DataFrame:
    """(grp, value, chi2, rank): the k features with the highest chi-squared of each group."""
    t = contingency(index, group, field, min_docs)
    a, b, c = F.col("a").cast("double"), (F.col("f") - F.col("a")).cast("double"), (F.col("g") - F.col("a")).cast("double")
    d = (F.col("n") - F.col("f") - F.col("g") + F.col("a")).cast("double")
    chi = (a * d - b * c) * (a * d - b * c) * (a + b + c + d) / F.nullif((a + b) * (c + d) * (b + d) * (a + c), F.lit(0.0))
    top = Window.partitionBy("grp").orderBy(F.desc("chi2"), F.desc("value"))
    return t.select("grp", "value", chi.alias("chi2")).filter("chi2 is not null").withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)


def crosstab(index: Index, group: str, field: str, min_docs: int = 10, k: int = 10) -> DataFrame:
    """(grp, value, hits, jaccard_similarity, rank): the k features most like each group."""
    t = contingency(index, group, field, min_docs).select("grp", "value", F.col("a").alias("hits"), ratio(F.col("a"), F.col("f") + F.col("g") - F.col("a")).alias("jaccard_similarity"))
    top = Window.partitionBy("grp").orderBy(F.desc("jaccard_similarity"), "value")
    return t.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)


def co_occurring(index: Index, group: str, k: int = 4) -> DataFrame:
    """(grp, other, hits, rank): the k groups that most documents of each group have too; the group itself is left out. A document has as many
    pairs as its groups have, squared, and they are combined before they travel."""
    kept = index.docs.select(F.array_distinct(F.col(group).cast("array<string>")).alias("g")) if index.kinds[group] in (SEQUENCE, SET) else index.docs.select(F.array(F.col(group).cast("string")).alias("g"))
    pairs = kept.select("g", F.explode("g").alias("grp")).select("grp", F.explode("g").alias("other")).filter("grp <> other")
    counts = pairs.groupBy("grp", "other").agg(F.count(F.lit(1)).alias("hits"))
    top = Window.partitionBy("grp").orderBy(F.desc("hits"), "other")
    return counts.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)


def sample_docs(index: Index, k: int, seed: int = 0) -> DataFrame:
    """Up to k documents, uniformly without replacement, in random order: least hashes of seed and id."""
    return index.docs.orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id").limit(k)
