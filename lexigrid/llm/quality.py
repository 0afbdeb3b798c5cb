"""Document quality by regularised quadratic discriminant.

Each text becomes a vector of transformed statistics (logarithms of counts, logits of shares). Both classes get a
mean and a covariance from all labelled rows, by sums that Spark aggregates; covariances are shrunk towards the pooled
one and a ridge. The score is the logistic of the difference of the two log densities, from Mahalanobis distances with
Cholesky factors that are inverted once.

Defined cases: null text counts as empty, and empty texts are scored like any other, from their statistics; rows of
``labels`` with a null label or id, or without a document, are left out, a document labelled twice counts twice; with
no labels at all every score is 0.5, and with one class only it is 1 or 0; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.textkit import python_stage, SPACE, flat, segments, slices, span_hash, words
from lexigrid.shipping import ship
from lexigrid.storage import materialize, spread

NAMES = ("bytes", "words", "word_len", "word_len_sd", "distinct_words", "lines", "distinct_lines", "line_len", "upper", "digit", "stop_marks", "shout_marks", "symbols", "pipes", "other_marks", "not_ascii", "space", "caps_words", "symbol_ends", "one_letter")
SHRINK, RIDGE, THRESHOLD = 0.15, 0.02, 0.7

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop_marks": b".,;:", "shout_marks": b"!?", "symbols": b"#$%&*@^~+=<>", "pipes": b"|_\\/", "other_marks": b"'\"()[]{}-`"}


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[list(chars)] = 1
    return t


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each row."""
    key = np.sort((row.astype(np.uint64) << np.uint64(42)) | (h >> np.uint64(22)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(42)).astype(np.int64), minlength=n)


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each text."""
    n = len(off) - 1
    size = np.diff(off).astype(float)
    out = np.zeros((n, len(NAMES)))
    starts, ends, first = words(buf, off)
    row, length = segments(first), (ends - starts).astype(float)
    count = np.diff(first).astype(float)
    some, chars = np.maximum(count, 1), np.maximum(size, 1)
    total = lambda v: np.bincount(row, v, minlength=n)
    share = lambda part, whole: np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5)) * (whole > 0)
    mean = total(length) / some
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(size), np.log1p(count), np.log1p(mean)
    out[:, 3] = np.log1p(np.sqrt(np.maximum(total(length**2) / some - mean**2, 0)))
    if len(starts):
        out[:, 4] = (np.log1p(_distinct(row, span_hash(buf, starts, ends), n)) - np.log1p(count)) * (count > 0)
    cut = np.flatnonzero(buf == 10) if len(buf) else np.zeros(0, np.int64)
    edges = np.unique(np.concatenate([off[:-1][size > 0], cut + 1, off[1:]])) if len(buf) else np.zeros(1, np.int64)
    ls, le = edges[:-1], edges[1:]
    if len(ls):
        lrow = np.searchsorted(off, ls, "right") - 1
        while len(lrow) and (bad := size[lrow] == 0).any():  # empty rows share an offset with the next full one
            lrow[bad] += 1
        nl = np.bincount(lrow, minlength=n).astype(float)
        out[:, 5] = np.log1p(nl)
        # a line's break is not part of it, so that a last line equals an earlier one
        ends_in_break = (buf[le - 1] == 10) & (le > ls)
        out[:, 6] = (np.log1p(_distinct(lrow, span_hash(buf, ls, le - ends_in_break), n)) - np.log1p(nl)) * (nl > 0)
        out[:, 7] = np.log1p(size / np.maximum(nl, 1))
    full = np.flatnonzero(size > 0)
    at = off[:-1][full]

    def tally(mark: np.ndarray) -> np.ndarray:
        got = np.zeros(n)
        if len(full):
            got[full] = np.add.reduceat(mark, at, dtype=np.int64)
        return got

    for k, (name, members) in enumerate(_CLASSES.items(), 8):
        out[:, k] = share(tally(_table(members)[buf]), chars * (size > 0)) - share(0, chars * (size > 0))
    out[:, 15] = share(tally((buf >= 128).astype(np.uint8)), chars * (size > 0)) - share(0, chars * (size > 0))
    out[:, 16] = share(tally(SPACE[buf].astype(np.uint8)), chars * (size > 0))
    if len(starts):
        up = _table(_CLASSES["upper"])[buf]
        caps = (up[starts] == 1) & (up[np.minimum(starts + 1, ends - 1)] == 1) & (ends - starts > 1)
        mark = _table(_CLASSES["symbols"] + _CLASSES["shout_marks"] + _CLASSES["pipes"])[buf]
        for k, flag in ((17, caps), (18, mark[ends - 1] == 1), (19, ends - starts == 1)):
            out[:, k] = share(total(flag.astype(float)), some * (count > 0)) - share(0, some * (count > 0))
    return out


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): x holds the statistics as little-endian doubles."""
    kind = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x = statistics(*flat(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "x"])

    return kind.transform(python_stage, run, f"id {kind.schema['id'].dataType.simpleString()}, x binary")


def fit(rows: DataFrame, shrink: float = SHRINK, ridge: float = RIDGE) -> dict:
    """Model from (x, label 0 or 1): per-class sums of x and of its products are aggregated by Spark, and only they reach the driver."""
    d = len(NAMES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((2, 1 + d + d * d))
        for b in batches:
            y = b.column("label").to_numpy(zero_copy_only=False)
            x = np.frombuffer(b"".join(b.column("x").to_pylist()), float).reshape(len(y), d)
            for c in (0, 1):
                own = x[y == c]
                acc[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        for c in (0, 1):
            if acc[c, 0]:
                yield pa.RecordBatch.from_arrays([pa.array([c] * acc.shape[1], pa.int32()), pa.array(range(acc.shape[1]), pa.int32()), pa.array(acc[c])], ["label", "at", "v"])

    got = rows.select("x", F.col("label").cast("int").alias("label")).transform(python_stage, sums, "label int, at int, v double").groupBy("label", "at").agg(F.sum("v").alias("v")).collect()
    acc = np.zeros((2, 1 + d + d * d))
    for r in got:
        acc[r["label"], r["at"]] = r["v"]
    n = acc[:, 0]
    if not n.all():
        return {"constant": 0.5 if not n.any() else float(n[1] > 0)}
    mean = acc[:, 1 : 1 + d] / n[:, None]
    scatter = [acc[c, 1 + d :].reshape(d, d) / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)]
    pooled = (n[0] * scatter[0] + n[1] * scatter[1]) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    model: dict = {"scale": scale, "prior": float(np.log(n[1] / n[0])), "mean": mean, "inverse": [], "logdet": []}
    for c in (0, 1):
        a = shrink + (1 - shrink) * d / (n[c] + d)
        cov = ((1 - a) * scatter[c] + a * pooled) / np.outer(scale, scale) + ridge * np.eye(d)
        chol = np.linalg.cholesky(cov)
        model["inverse"].append(np.linalg.inv(chol))
        model["logdet"].append(2 * float(np.log(np.diag(chol)).sum()))
    return model


def score(x: np.ndarray, model: dict) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    log = []
    for c in (0, 1):
        z = ((x - model["mean"][c]) / model["scale"]) @ model["inverse"][c].T
        log.append(-0.5 * ((z * z).sum(1) + model["logdet"][c]))
    return np.round(1 / (1 + np.exp(-np.clip(log[1] - log[0] + model["prior"], -500, 500))), 9)


def apply(feats: DataFrame, model: dict) -> DataFrame:
    """(id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column("x").to_pylist()), float).reshape(b.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(score(x, model))], ["id", "score"])

    return feats.select("id", "x").transform(python_stage, run, f"id {feats.schema['id'].dataType.simpleString()}, score double")


def bucket(col, of: int):
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % of


def learn(feats: DataFrame, labels: DataFrame) -> dict:
    """Model from features() and the labels (doc_id, quality) of documents that are not held out."""
    marked = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label")).filter("id is not null and label in (0, 1)").filter(bucket(F.col("id"), 4) != 2)
    return fit(feats.select("id", "x").join(marked, "id"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of every document of ``docs``; learns from labels whose id is not held out."""
    feats = materialize(features(docs), "quality-features")
    return apply(feats, learn(feats, labels)).select("id", (bucket(F.col("id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that classify() would predict 1. Each row is judged by its own text, whatever its id. Texts are read a second
    time to be scored where they are, so none is shuffled or comes back from Python."""
    model = learn(materialize(features(docs, id_col, text_col), "quality-features"), labels)
    ship(docs.sparkSession)

    def grade(column: pa.Array) -> pa.Array:
        parts = [score(statistics(*flat(part.column("text"))), model) for part in slices(iter([pa.RecordBatch.from_arrays([column], ["text"])]), "text")]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.filter(F.arrow_udf(grade, "double")(F.col(text_col).cast("string")) >= threshold)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    got = classify(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return got.withColumnRenamed("id", "doc_id")
