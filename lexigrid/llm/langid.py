"""Language identification by words first, with backoff to character n-grams.

A known word scores its smoothed log frequency in each language. An unseen word falls back to the longest
length at which any of its character n-grams (over the word with edge marks) is known, and scores the mean log frequency of those;
a word with none known says nothing. The text's score is the sum over its words; the result's is the posterior
of the best language.

Learning reads a bounded sample of labelled rows: at most ``sample_docs`` documents a language in expectation, taken by
a hash of id; tables hold each language's ``max_words`` most frequent words and, of each length, ``max_grams`` most frequent
n-grams, with their counts in all languages. Prediction reads every whole text.

Defined cases: null text or a text without a letter is ``und`` with score 0; rows without a lang are never learned
from; with no learned language at all every text is ``und``; ties go to the first language in code-point order; a null id
counts as an empty one in the fold; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.llm.textkit import python_stage, slices, texts
from lexigrid.storage import materialize, sized, spread

LETTERS = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)
SAMPLE_DOCS, MAX_WORDS, MAX_GRAMS, SMOOTH = 1500, 40_000, 40_000, 0.5
#: Unseen words that one task remembers before it starts anew.
MEMORY = 200_000


def grams(word: str, n: int) -> list[str]:
    s = f"\x02{word}\x03" if n > 1 else word
    return [s[i : i + n] for i in range(len(s) - n + 1)]


def count_table(train: DataFrame) -> DataFrame:
    """(kind, lang, entry, n): kind 0 for words, else the length of the n-gram. Counted inside each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, Counter] = {}
        for part in slices(batches, "text"):
            for text, lang in zip(texts(part.column("text")), part.column("lang").to_pylist()):
                by.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
        for lang, found in by.items():
            pieces: list[Counter] = [found, *(Counter() for _ in range(max(ORDERS)))]
            for w, c in found.items():
                for n in ORDERS:
                    for g in grams(w, n):
                        pieces[n][g] += c
            for kind, piece in enumerate(pieces):
                keys = list(piece)
                for at in range(0, len(keys), 20_000):
                    k = keys[at : at + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(k), pa.int32()), pa.array([lang] * len(k), pa.string()), pa.array(k, pa.string()), pa.array([piece[x] for x in k], pa.int64())], ["kind", "lang", "entry", "n"])

    got = train.select("text", "lang").transform(python_stage, run, "kind int, lang string, entry string, n bigint")
    return got.groupBy("kind", "lang", "entry").agg(F.sum("n").alias("n"))


def fit(train: DataFrame, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> dict:
    """Model from (text, lang): languages and log frequencies of each one's most frequent words and n-grams."""
    table = materialize(count_table(train), "langid-counts")
    rank = F.row_number().over(Window.partitionBy("kind", "lang").orderBy(F.desc("n"), "entry"))
    top = table.withColumn("rank", rank).filter(F.col("rank") <= F.when(F.col("kind") == 0, max_words).otherwise(max_grams))
    got = table.join(top.select("kind", "entry").distinct(), ["kind", "entry"]).orderBy("kind", "entry", "lang")
    got = got.select("kind", "entry", "lang", "n").toArrow()  # at most max_words + 5 max_grams entries a language, with a count for each
    langs = sorted(set(got["lang"].to_pylist()))
    at = {x: i for i, x in enumerate(langs)}
    entries: dict[int, dict[str, int]] = {}
    row, kinds_ = [], []
    for kind, entry in zip(got["kind"].to_pylist(), got["entry"].to_pylist()):
        own_ = entries.setdefault(kind, {})
        if entry not in own_:
            own_[entry] = len(kinds_)
            kinds_.append(kind)
        row.append(own_[entry])
    table_ = np.zeros((len(kinds_), len(langs)))
    table_[np.array(row, int), np.array([at[x] for x in got["lang"].to_pylist()], int)] = got["n"].to_numpy()
    kinds = np.array(kinds_, int)
    for k in set(kinds):
        own = kinds == k
        total = table_[own].sum(0) + SMOOTH * own.sum()
        table_[own] = np.log((table_[own] + SMOOTH) / total)
    return {"langs": langs, "entries": entries, "table": table_}


class Lookup(dict):
    """Word to row of ``rows``; an unseen word gets a row of its own by backoff."""

    def __init__(self, model: dict):
        super().__init__(model["entries"].get(0, {}))
        self.model, self.n = model, len(model["table"]) + 1
        self.rows = np.zeros((2 * self.n + 1024, len(model["langs"])))
        self.rows[: self.n - 1] = model["table"]
        self.none = self.n - 1

    def __missing__(self, word: str) -> int:
        self[word] = at = self.back_off(word)
        return at

    def back_off(self, word: str) -> int:
        for n in ORDERS:
            known = self.model["entries"].get(n)
            if known and (ids := [known[g] for g in grams(word, n) if g in known]):
                if self.n == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[self.n] = self.rows[ids].mean(0)
                self.n += 1
                return self.n - 1
        return self.none


def predict(texts_: list[str], model: dict, lookup: Lookup) -> tuple[list[str], np.ndarray]:
    langs = model["langs"]
    ids: list[int] = []
    first = [0]
    for t in texts_:
        ids.extend(map(lookup.__getitem__, LETTERS.findall(t.lower())))
        first.append(len(ids))
    total = np.zeros((len(texts_) + 1, len(langs)))
    if ids and langs:
        row = np.repeat(np.arange(len(texts_)), np.diff(first))
        at = np.array(ids)
        for k in range(len(langs)):
            total[:-1, k] = np.bincount(row, lookup.rows[at, k], minlength=len(texts_))
    total = total[:-1]
    if not langs:
        return ["und"] * len(texts_), np.zeros(len(texts_))
    total -= total.max(1, keepdims=True)
    p = np.exp(total)
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    und = np.array([not any(map(str.isalpha, t)) for t in texts_], bool)
    return ["und" if u else langs[b] for u, b in zip(und, best)], np.where(und, 0.0, np.round(p.max(1), 9))


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text; the model is broadcast, bounded by its table sizes a language."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(shared.value)
        for part in slices(batches, "text"):
            if len(lookup) > MEMORY + len(shared.value["entries"].get(0, ())):
                lookup = Lookup(shared.value)
            lang, score = predict(texts(part.column("text")), shared.value, lookup)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    return rows.transform(python_stage, run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")


def sample(docs: DataFrame, per_lang: int = SAMPLE_DOCS, id_col: str = "doc_id") -> DataFrame:
    """(text, lang) of about ``per_lang`` rows of each language, or all of a smaller one, by a hash of the id."""
    known = docs.filter(F.col("lang").isNotNull())
    share = materialize(known.groupBy("lang").agg((F.lit(float(per_lang)) / F.count(F.lit(1))).alias("share")), "langid-shares")
    at = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # one row a language: rows are dropped where they are read, and no text travels
    return known.join(sized(share, share.count(), 128), "lang").filter(at < F.col("share")).select("text", "lang")


def op1_langid(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    model = fit(sample(docs.filter(~held)))
    got = identify(docs, model).withColumnRenamed("id", "doc_id")
    return got.select("doc_id", held.alias("held_out"), "lang_pred", "score")
