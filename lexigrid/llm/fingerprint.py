"""Document fingerprints: bottom-k sketches of character shingles.

A sketch holds the k smallest distinct 48-bit hashes of a text's shingles of ``WIDTH`` code points. Sketches of parts merge
into the sketch of the whole set of shingles; two of them estimate resemblance, containment and their distinct counts.

The query needs each document's neighbour in descending id. Ids are cut into ranges at approximate quantiles, as many as the
number of rows asks for, rows go to their range in one exchange, and the first row of each range is also sent to the range
before it, so no global order and no task over all rows is needed. An id, or null, that fills several ranges is cut by the hash
of the text, which orders equal ids; only rows equal in id and text stay together.

Defined cases: null text counts as empty; the empty text has an empty sketch, alike (1) to an empty one and unlike (0) any
other; a text shorter than a shingle is one shingle; rows with equal ids are ordered by a hash of their text, a null id comes
last; with a single row it is its own neighbour; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.ranges import range_of
from lexigrid.llm.textkit import python_stage, mix, slices, texts
from lexigrid.storage import spread

WIDTH, K = 8, 128
#: Documents of a range in the query's order, and the most ranges: beyond, ranges grow, and each is sorted on disk and read as a stream.
RANGE_ROWS, MOST_RANGES = 20_000, 20_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingles(text: str) -> np.ndarray:
    """48-bit hashes of the shingles of a text of at least WIDTH code points, in order; one of the whole text if it is shorter."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(cp) < WIDTH:
        return mix(np.array([int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")], np.uint64)) >> np.uint64(16) if len(cp) else np.zeros(0, np.uint64)
    h = mix(cp[:-1] * _A + cp[1:])
    h = h[:-2] * _B + h[2:]
    h = h[:-4] * _C + h[4:]
    return mix(h) >> np.uint64(16)


def bottom(h: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct values, in order."""
    if len(h) > 8 * k:
        near = np.unique(h[h < np.uint64(int(2.0**48 * 3 * k / len(h)))])
        if len(near) >= k:
            return near[:k]
    return np.unique(h)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of both shingle sets together."""
    return np.unique(np.concatenate([a, b]))[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**48 / (float(a[-1]) + 1)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness of two shingle sets."""
    both = np.sort(np.concatenate([a, b]))
    if not len(both):
        return 1.0
    again = np.zeros(len(both), bool)
    again[1:] = both[1:] == both[:-1]
    n = np.cumsum(~again)
    within = n <= k
    return float((again & within).sum() / min(k, int(n[-1])))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    r = resemblance(a, b, k)
    return min(1.0, r * distinct(merge(a, b, k), k) / distinct(a, k))


def pack(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def unpack(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(id, n_chars, fingerprint) of every whole text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            t = texts(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(map(len, t), pa.int64()), pa.array([pack(bottom(shingles(x), k)) for x in t], pa.string())], ["id", "n_chars", "fingerprint"])

    return rows.transform(python_stage, run, f"id {rows.schema['id'].dataType.simpleString()}, n_chars bigint, fingerprint string")


class _Text:
    """A text with its shingle hashes and sketch, made once for its two roles."""

    def __init__(self, id_, text: str):
        self.id, self.text, self.hashes = id_, text, shingles(text)
        self.sketch = bottom(self.hashes)


def edit(a: _Text, b: _Text) -> tuple[str, np.ndarray]:
    """a with its last half replaced by the start of b, and that text's sketch, from the hashes at hand."""
    m = len(a.text) // 2
    n = len(a.text) - m
    tail = b.text[:m]
    edited = a.text[:n] + tail
    if n < WIDTH or len(tail) < WIDTH:
        return edited, bottom(shingles(edited))
    seam = shingles(a.text[n - WIDTH + 1 : n] + tail[: WIDTH - 1])
    return edited, bottom(np.concatenate([a.hashes[: n - WIDTH + 1], seam, b.hashes[: len(tail) - WIDTH + 1]]))


def merge_sketches(sketches: DataFrame, by: str, sketch_col: str = "fingerprint", k: int = K) -> DataFrame:
    """(by, fingerprint, distinct) of each group of sketches: the sketch of all its parts together, and its estimated number of shingles.

    A map task merges its own sketches first, so a group of a third of all rows sends one row a task. Null sketches count for
    nothing; null is a group of its own; an empty table gives an empty result."""
    rows = sketches.select(F.col(by).alias("by"), F.col(sketch_col).alias("sketch")).filter("sketch is not null")
    schema = f"by {rows.schema['by'].dataType.simpleString()}, sketch string"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(made), kind), pa.array([pack(a) for a in made.values()], pa.string())], ["by", "sketch"])

        for b in batches:
            kind = b.column("by").type
            for g, s in zip(b.column("by").to_pylist(), b.column("sketch").to_pylist()):
                made[g] = merge(made[g], unpack(s), k) if g in made else unpack(s)[:k]
            if len(made) > 20_000:
                yield out()
                made.clear()
        if made:
            yield out()

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            done: list[tuple] = []
            for g, s in zip(b.column("by").to_pylist(), b.column("sketch").to_pylist()):
                if held is not None and held[0] == g:
                    held = (g, merge(held[1], unpack(s), k))
                else:
                    done += [held] if held else []
                    held = (g, unpack(s))
            kind = b.column("by").type
            yield _merged(done, kind, k)
        if held:
            yield _merged([held], kind, k)

    parts = rows.transform(python_stage, local, schema)
    got = parts.repartition("by").sortWithinPartitions("by").transform(python_stage, final, schema.replace("sketch string", "fingerprint string, distinct double"))
    return got.withColumnRenamed("by", by)


def _merged(groups: list[tuple], kind: pa.DataType, k: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([g for g, _ in groups], kind), pa.array([pack(a) for _, a in groups], pa.string()), pa.array([distinct(a, k) for _, a in groups], pa.float64())], ["by", "fingerprint", "distinct"])


def likeness(pairs: DataFrame, a: str, b: str, k: int = K) -> DataFrame:
    """``pairs`` with estimates from two columns of sketches: resemblance, the share of a's shingles in b, that of b's in a, and both
    distinct counts. All are null if a sketch is."""
    names = ["resemblance", "a_in_b", "b_in_a", "distinct_a", "distinct_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = []
            for x, y in zip(part.column(a).to_pylist(), part.column(b).to_pylist()):
                if x is None or y is None:
                    rows.append((None,) * 5)
                else:
                    u, v = unpack(x), unpack(y)
                    rows.append((resemblance(u, v, k), containment(u, v, k), containment(v, u, k), distinct(u, k), distinct(v, k)))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, pa.float64()) for c in cols)], [*part.schema.names, *names])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.transform(python_stage, run, f"{shape}, " + ", ".join(f"{n} double" for n in names))


def ranges(ids: DataFrame, rows_each: int = RANGE_ROWS) -> tuple[list[int], list[int]]:
    """(cuts, parts): increasing cuts of ``id`` into ranges of about ``rows_each`` rows, and into how many parts each range, from the
    greatest ids down to the null ones, is cut by a hash of its texts. That is one, unless an id alone fills several ranges."""
    total, nulls = ids.agg(F.count(F.lit(1)), F.count_if(F.col("id").isNull())).first()
    least = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = min(MOST_RANGES, max(least, -(-(total - nulls) // rows_each)))
    each = max(1, (total - nulls) // n)
    found = [int(c) for c in ids.filter("id is not null").approxQuantile("id", [i / n for i in range(1, n)], max(0.2 / n, 1e-5))] if n > 1 and total > nulls else []
    hot = {v: c + 1 for v, c in Counter(found).items() if c > 1 and each * c > rows_each}
    cuts = sorted({*found, *(v - 1 for v in hot)})
    upper = [*cuts, None]  # each range's greatest id
    return cuts, [hot.get(u, 1) for u in reversed(upper)] + [max(1, -(-nulls // rows_each))]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_each: int = RANGE_ROWS) -> DataFrame:
    """Rows (range, halo, id, tie, text) so placed and sorted that a row's neighbour in descending id follows it in its partition."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts, parts = ranges(rows.select("id"), rows_each)
    offsets = [0, *accumulate(parts)]
    at = F.when(F.col("id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - range_of(F.col("id"), [float(c) for c in cuts]))
    split = offsets[-1] > len(parts)
    # the order of equal ids; read from texts only where they are cut by it
    tie = F.xxhash64("text")
    part = F.floor((F.shiftright(tie, 32) + (1 << 31)) * F.element_at(F.lit(parts), at + 1) / float(1 << 32)) if split else F.lit(0)
    rng = (F.element_at(F.lit(offsets), at + 1) + part).cast("int")
    head = F.min(F.struct(-F.col("id"), tie if split else F.lit(0).cast("long"))) if split else F.struct(-F.max("id"), F.lit(0).cast("long"))
    heads = rows.select("id", *(["text"] if split else [])).withColumn("range", rng).groupBy("range").agg(head.alias("head")).orderBy("range").collect()  # one row a range
    first = [(h["range"], None if h["head"][0] is None else -h["head"][0], h["head"][1]) for h in heads]
    halo = [(first[i - 1][0], *first[i]) for i in range(len(first))]
    send = spark.createDataFrame(halo or [(0, 0, 0, 0)], "before int, range int, head long, head_tie long")
    placed = rows.withColumn("range", rng).join(F.broadcast(send), "range")
    leads = F.col("id").eqNullSafe(F.col("head")) & (tie == F.col("head_tie") if split else F.lit(True))
    here = F.struct(F.col("range").alias("range"), F.lit(False).alias("halo"))
    copies = F.when(leads, F.array(here, F.struct(F.col("before").alias("range"), F.lit(True).alias("halo")))).otherwise(F.array(here))
    placed = placed.select("id", "text", F.explode(copies).alias("c")).select("c.range", "c.halo", "id", tie.alias("tie"), "text")
    return placed.repartitionById(offsets[-1], F.col("range")).sortWithinPartitions("range", "halo", F.desc_nulls_last("id"), "tie", "text")


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_each: int = RANGE_ROWS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Text | None = None
        held_range = None
        done = False
        for part in slices(batches, "text", 1 << 20):
            out: list[tuple] = []
            for rng, is_halo, id_, text in zip(part.column("range").to_pylist(), part.column("halo").to_pylist(), part.column("id").to_pylist(), texts(part.column("text"))):
                if rng != held_range:
                    held, held_range, done = None, rng, False
                if done:
                    continue
                now = _Text(id_, text)
                if held is not None:
                    edited, s = edit(held, now)
                    out.append((held.id, len(held.text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), pack(held.sketch), pack(s), resemblance(held.sketch, s), resemblance(held.sketch, now.sketch)))
                held, done = now, is_halo
            cols = list(zip(*out)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_col, text_col, rows_each).transform(python_stage, run, schema)


def op2_fingerprint(spark, sf_dir: str) -> DataFrame:
    return compare_neighbours(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
