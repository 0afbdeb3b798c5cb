"""From raw documents to token ids, as stages that each read what the one before wrote.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return the columns of
``documents``. A stage decides on rows, by their texts, and never on an id that other rows may share. Mixing repeats documents and cuts one document a source at its budget, so ids recur after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm import exact_dedup, mixing, near_dedup, quality, spm
from lexigrid.llm.textkit import python_stage, slices, texts
from lexigrid.storage import materialize, sized

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that the classifier rejects; labels of held-out documents are not learned from.

    Each row is judged by its own text: null and repeated ids, and equal rows, make no difference. Null and empty texts are scored like any
    other. Without labels every score is 0.5, so all rows go. No rows give none."""
    return quality.accepted(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row: that with the largest doc_id, of equal ids the one with the largest other columns.

    A null id is the least. Null and empty texts are equal. A text stays whatever ids its rows have. No rows give none."""
    return exact_dedup.distinct_rows(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row: that with the smallest doc_id, any other if none has one.

    Rows are told apart by id and text together, so a text goes only for one that it is linked with; rows equal in both are one. Rows
    without a word all stay. No rows give none."""
    return near_dedup.representatives(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document; of the last one of a source it may hold only the first words.

    What is taken follows from one cut a source, so texts stay where they are. Rows equal in id, text and source are taken alike, which may exceed a
    budget by copies of the text at the cut. Rows without a word are never taken; a null source is a source. No rows give none."""
    row = F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text", "source").cast("string"))
    keyed = docs.select(*COLUMNS).withColumn("row", row)
    found = materialize(mixing.cuts(materialize(mixing.sizes(keyed, id_col="row"), "mix-sizes")), "mix-cuts").withColumnRenamed("source", "of")
    rows = keyed.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("key", mixing.key_of(F.col("row")))
    rows = rows.join(sized(found, found.count(), 256), F.col("source").eqNullSafe(F.col("of")))
    order = lambda key, id_: F.struct(F.col(key).alias("key"), F.col(id_).alias("id"))
    whole = F.col("epochs") + F.coalesce(order("key", "row") < order("cut_key", "cut_id"), F.lit(False)).cast("long")
    names = [F.col("doc_id"), F.col("text"), F.col("lang"), F.col("source"), F.length("text").cast("long").alias("n_chars")]
    times = rows.withColumn("times", F.explode(F.array_repeat(F.lit(1), whole.cast("int")))).select(*names)
    last = rows.filter((F.col("key") == F.col("cut_key")) & (F.col("row") == F.col("cut_id"))).select(*names, F.col("rest").alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            out = [cut(t, n) for t, n in zip(texts(part.column("text")), part.column("words").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.string()), part.column("lang"), part.column("source"), pa.array(map(len, out), pa.int64())], list(COLUMNS))

    return times.unionByName(last.transform(python_stage, run, times.schema.simpleString()[7:-1].replace(":", " ")))


def cut(text: str, n: int) -> str:
    """The text up to the end of its n-th word."""
    raw, at = text.encode("utf-8", "surrogatepass"), 0
    for w in raw.split(None, n)[:n]:
        at = raw.index(w, at) + len(w)
    return raw[:at].decode("utf-8", "surrogatepass")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, n_tokens, decoded_same, parity, ids) of every row, repeated ones too; null text has no ids. No rows give none."""
    both = docs.select(F.struct("doc_id", "lang", "source").alias("row"), "text")
    got = spm.encode(both, id_col="row")
    return got.select("id.doc_id", "id.lang", "id.source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "decoded_same", "parity", "ids")


STAGES = [("quality classifier", keep_quality), ("exact dedup", drop_copies), ("MinHash near-dedup", drop_near_copies), ("mixing sources", mix_sources), ("SentencePiece", tokenize)]

#: A trained classifier and a tokeniser model can't be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
