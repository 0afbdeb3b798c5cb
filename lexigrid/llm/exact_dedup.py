"""Exact duplicates by skew-safe combining.

Rows are first told apart by the SHA-256 of their text in a slim table. Texts are then compared by full content in three
stages that are the same at every size: each map task combines its own equal texts, salted digest groups are merged, and the
salts' winners are combined globally. Digests that occur once are left out first if the table of the others is small enough
to be broadcast; else every text takes part. Salts are drawn from the map task, before any shuffle, and only for digests with more
than a fixed share of the rows. No stage holds more than one row per distinct text, salt and map task, so a text that fills
a third of the table costs no more than any other.

Defined cases: null text counts as empty and all empty texts are one group; ties of ``id`` (repeated rows)
keep every row in the output, each marked kept when its id is the largest; a null id is never the one
that stays unless all ids of the group are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.storage import materialize, sized, small, spread

#: Salts for a digest that is hot, and the share of rows from which it counts as such; at most 1 / HOT_SHARE digests do.
SALTS = 32
HOT_SHARE = 1e-4
#: Measured bytes of a digest in a broadcast table.
DIGEST_BYTES = 120


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): one slim row per document."""
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"))


def repeated(slim: DataFrame) -> tuple[DataFrame, int, DataFrame]:
    """Digests (digest, n) that occur more than once, how many they are, and the hot ones (digest)."""
    counts = materialize(slim.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "dup-digests")
    n_dup, total = (r := counts.agg(F.count(F.lit(1)), F.sum("n")).first())[0], r[1] or 0
    return counts, n_dup, counts.filter(F.col("n") > total * HOT_SHARE).select("digest")


def combine(rows: DataFrame, hot: DataFrame, best: Column, least: int = 2) -> DataFrame:
    """(digest, body, best, group_size) of the texts that occur ``least`` times or more in rows (digest, body, ...)."""
    # at most 1 / HOT_SHARE digests of 32 bytes, whatever the input
    flag = F.broadcast(hot.select("digest", F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.spark_partition_id() % SALTS).otherwise(F.lit(-1)).alias("_salt")
    rows = rows.join(flag, "digest", "left").withColumn("_salt", salt)
    # partial aggregation is the local stage: a map task sends one row for each of its texts
    salted = rows.groupBy("digest", "_salt", "body").agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("group_size"))
    salted = materialize(salted.filter((F.col("_salt") >= 0) | (F.col("group_size") >= least)), "dup-salted")
    of_salts = salted.filter("_salt >= 0").groupBy("digest", "body").agg(F.max("best").alias("best"), F.sum("group_size").alias("group_size"))
    return salted.filter("_salt < 0").select("digest", "body", "best", "group_size").unionByName(of_salts).filter(F.col("group_size") >= least)


def _bodies(docs: DataFrame, text_col: str, *columns: Column) -> DataFrame:
    return docs.select(*columns, F.coalesce(F.col(text_col), F.lit("")).alias("body")).withColumn("digest", F.unhex(F.sha2("body", 256)))


def groups(docs: DataFrame, slim: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, check, keep_id, group_size) of every text that occurs more than once; ``slim`` is digests(), materialised."""
    counts, n_dup, hot = repeated(slim)
    rows = _bodies(docs, text_col, F.col(id_col).alias("id"))
    if small(n_dup, DIGEST_BYTES):
        rows = rows.join(F.broadcast(counts.select("digest")), "digest", "left_semi")
    return combine(rows, hot, F.col("id")).select("digest", F.xxhash64("body").alias("check"), F.col("best").alias("keep_id"), "group_size")


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one for each distinct text: that with the largest id, of equal ids with the largest other columns. A null
    id is the least. Nothing is joined by id, so repeated ids lose no text. Null and empty texts are equal."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    whole = F.struct(F.col(id_col).alias("id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)], F.col(text_col).isNull().alias("blank"))
    counts, n_dup, hot = repeated(materialize(digests(docs, id_col, text_col), "digests"))
    rows = _bodies(docs, text_col, whole.alias("row"))
    if small(n_dup, DIGEST_BYTES):
        listed = F.broadcast(counts.select("digest"))
        once, rows = rows.join(listed, "digest", "left_anti"), rows.join(listed, "digest", "left_semi")
        picked = combine(rows, hot, F.col("row")).select("body", F.col("best").alias("row"))
        picked = picked.unionByName(once.select("body", "row"))
    else:
        picked = combine(rows, hot, F.col("row"), 1).select("body", F.col("best").alias("row"))
    named = {id_col: F.col("row.id"), text_col: F.when(~F.col("row.blank"), F.col("body"))} | {c: F.col(f"row.c{i}") for i, c in enumerate(others)}
    return picked.select(*[named[c].alias(c) for c in docs.columns])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, digest (binary SHA-256), keep_id, group_size, kept."""
    slim = materialize(digests(docs, id_col, text_col), "digests")
    found = materialize(groups(docs, slim, id_col, text_col), "dup-groups")
    n, distinct = found.agg(F.count(F.lit(1)), F.count_distinct("digest")).first()
    on = ["digest"]
    if n != distinct:  # two texts with one SHA-256: tell their rows apart by a second hash of the text
        slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).select("id", F.unhex(F.sha2("body", 256)).alias("digest"), F.xxhash64("body").alias("check"))
        on = ["digest", "check"]
    else:
        found = found.drop("check")
    out = slim.join(sized(found, n, DIGEST_BYTES), on, "left")
    keep = F.coalesce("keep_id", "id")
    return out.select("id", "digest", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.coalesce(F.col("id").eqNullSafe(keep), F.lit(True)).alias("kept"))


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    found = exact_dedup(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       CAST(count(*) OVER (PARTITION BY coalesce(text, '')) AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
