"""Features meet clusters document by document: each document's features are one row of numbers, and clusters of features are one array of numbers.

An entry is a feature of a clustering (run). Entries are numbered in order of run, field and value; a clustering is an array with each entry's cluster,
which every worker gets (4 bytes an entry), so a changed clustering costs one pass over the kept documents without a join or a shuffle of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.shipping import ship
from lexigrid.storage import DICTIONARY_BYTES, materialize, release, sized

FEATURE = ["field", "value"]
#: Cells of a block's table of documents and clusters; entries met before they are added up.
CELLS, PENDING = 1 << 22, 1 << 21
ANY, SHARED, ALONE = range(3)
MET = pa.schema([("kind", pa.int32()), ("id", pa.int32()), ("clusters", pa.binary()), ("n", pa.int64())])


def met(kind: int, ids: np.ndarray, n: np.ndarray, clusters: pa.Array | None = None) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids.astype(np.int32)), pa.nulls(len(ids), pa.binary()) if clusters is None else clusters, pa.array(n.astype(np.int64))], schema=MET)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, doc_id, entry), where a document's rows mostly follow one another, as rows (run, doc_id, entries)."""
    for batch in batches:
        run, doc, entry = (batch.column(c) for c in ("run", "doc_id", "entry"))
        if not len(entry):
            continue
        new = np.zeros(len(entry), bool)
        new[0] = True
        for x in (run, doc.fill_null(0), doc.is_valid().cast(pa.int8())):
            x = x.to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
        first = np.flatnonzero(new)
        at = pa.array(first)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(entry)].astype(np.int32)), entry)
        yield pa.record_batch([run.take(at), doc.take(at), lists], names=["run", "doc_id", "entries"])


def meet(batches: Iterator[pa.RecordBatch], cluster: np.ndarray, picked: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """Of documents (known, entries): how many have each cluster; of the picked entries how many documents have which set of clusters (as bits), and in how
    many of them the entry is alone in its cluster. Counts are partial. Documents without an id count for clusters only."""
    docs_any = np.zeros(width, np.int64)
    sets: dict[bytes, int] = {}
    keys: list[np.ndarray] = []
    alone: list[np.ndarray] = []

    def added_up() -> Iterator[pa.RecordBatch]:
        if keys:
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            yield met(SHARED, key >> 32, n, pa.array(list(sets), pa.binary()).take(pa.array(key & 0xFFFFFFFF)))
            entry, n = np.unique(np.concatenate(alone), return_counts=True)
            yield met(ALONE, entry, n)
        sets.clear(), keys.clear(), alone.clear()

    for batch in batches:
        lists, known = batch.column("entries"), batch.column("known").to_numpy(zero_copy_only=False)
        step = max(1, CELLS // width)
        for at in range(0, len(lists), step):
            part = lists.slice(at, step)
            entry = part.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(part)), np.diff(part.offsets.to_numpy()))
            times = np.bincount(row * width + cluster[entry], minlength=len(part) * width).reshape(-1, width)
            has = times > 0
            docs_any += has.sum(0)
            pick = picked[entry] & known[at : at + step][row]
            entry, row = entry[pick], row[pick]
            bits = np.packbits(has, axis=1)
            own, which = np.unique(bits.view(np.dtype((np.void, bits.shape[1]))).ravel(), return_inverse=True)
            number = np.array([sets.setdefault(s.tobytes(), len(sets)) for s in own], np.int64)
            keys.append(entry.astype(np.int64) << 32 | number[which][row])
            alone.append(entry[times[row, cluster[entry]] == 1])
            if sum(map(len, keys)) > PENDING:
                yield from added_up()
    yield from added_up()
    yield met(ANY, np.arange(width), docs_any)


def best(batches: Iterator[pa.RecordBatch], cluster: np.ndarray, doc_count: np.ndarray, n: np.ndarray, total: np.ndarray, docs_any: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, best) from all counts of an entry: the cluster with the greatest delta, of equal ones the last. Its own cluster is judged by what it loses, others by
    what they gain, and only if they share documents."""
    got = [b for b in batches if len(b)]
    if not got:
        return
    t = pa.Table.from_batches(got).sort_by("id")
    width = len(n)
    entry, at = np.unique(t["id"].to_numpy(), return_inverse=True)
    kind, count = t["kind"].to_numpy(), t["n"].to_numpy()
    alone = np.bincount(at, weights=np.where(kind == ALONE, count, 0), minlength=len(entry))
    shared = np.zeros((len(entry), width), np.int64)
    rows = np.flatnonzero(kind == SHARED)
    names = pa.concat_arrays(t["clusters"].filter(pa.array(kind == SHARED)).cast(pa.binary((width + 7) // 8)).chunks or [pa.array([], pa.binary((width + 7) // 8))])
    names = np.frombuffer(names.buffers()[1], np.uint8)[: len(names) * names.type.byte_width].reshape(len(names), -1)
    step = max(1, CELLS // width)
    for k in range(0, len(rows), step):
        r = rows[k : k + step]
        has = np.unpackbits(names[k : k + step], axis=1)[:, :width]
        first = np.flatnonzero(np.r_[True, np.diff(at[r]) > 0])
        shared[at[r][first]] += np.add.reduceat(has * count[r][:, None], first, axis=0)
    own, d = cluster[entry], doc_count[entry].astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        objective = total / (docs_any + n)
        delta = (total + d[:, None]) / (docs_any + d[:, None] - shared + n + 1) - objective
        left = docs_any[own] - alone
        stay = np.where((left > 0) & (alone < d), objective[own] - (total[own] - d) / (left + n[own] - 1), -1.0)
    delta[shared == 0] = -np.inf
    delta[np.arange(len(entry)), own] = stay
    last = width - 1 - np.argmax(delta[:, ::-1], axis=1)
    yield pa.record_batch([pa.array(entry.astype(np.int32)), pa.array(last.astype(np.int32))], names=["id", "best"])


class Meetings:
    """``entries`` (entry, run, cluster_id, field, value, doc_count) is a table; ``run``, ``cluster`` and ``doc_count`` are arrays by entry, where a cluster is its
    place in ``clusters`` (run, cluster_id). The driver holds 24 bytes an entry, the documents stay in Spark."""

    def __init__(self, members: DataFrame, state: DataFrame):
        self.spark = spark = state.sparkSession
        ship(spark)
        raw = state.select("run", "cluster_id", *FEATURE, "doc_count").orderBy("run", *FEATURE).withColumn("_at", F.monotonically_increasing_id())
        raw = materialize(raw, "cluster-order").withColumn("_part", F.shiftright("_at", 33))
        before, upto = [], 0
        for part, n in sorted(map(tuple, raw.groupBy("_part").count().collect())):  # one row a partition
            before.append((part, upto))
            upto += n
        before = spark.createDataFrame(before, "_part bigint, _before bigint")
        entry = (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("int")
        self.entries = materialize(raw.join(F.broadcast(before), "_part").select(entry.alias("entry"), "run", "cluster_id", *FEATURE, "doc_count"), "cluster-entries")
        got = self.entries.select("entry", "run", "cluster_id", "doc_count").toArrow().sort_by("entry")
        self.run, ids, self.doc_count = (got[c].to_numpy() for c in ("run", "cluster_id", "doc_count"))
        pairs, place = np.unique(np.stack([self.run, ids], axis=1), axis=0, return_inverse=True)
        self.clusters, self.cluster = pairs, place.ravel().astype(np.int32)
        known = sized(self.entries.select(*FEATURE, "run", "entry"), upto, 112, DICTIONARY_BYTES)
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
        rows = members.join(known, FEATURE).select("run", F.col("doc_id").cast("long").alias("doc_id"), "entry").mapInArrow(gathered, "run bigint, doc_id bigint, entries array<int>")
        docs = rows.repartition(parts, "run", "doc_id").groupBy("run", "doc_id").agg(F.flatten(F.collect_list("entries")).alias("entries"))
        self.docs = materialize(docs.select(F.col("doc_id").isNotNull().alias("known"), "entries"), "cluster-documents", "snappy")

    def best(self, cluster: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The picked entries and each one's best cluster, if the clustering is ``cluster``. Entries whose cluster has no documents are left out."""
        width = len(self.clusters)
        sent = self.spark.sparkContext.broadcast((cluster, picked, self.doc_count))
        counts = materialize(self.docs.mapInArrow(lambda it: meet(it, sent.value[0], sent.value[1], width), "kind int, id int, clusters binary, n bigint"), "cluster-meetings", "snappy")
        got = counts.filter(F.col("kind") == ANY).groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # one row a cluster
        docs_any = np.zeros(width, np.int64)
        docs_any[got["id"].to_numpy()] = got["n"].to_numpy()
        n, total = np.bincount(cluster, minlength=width), np.bincount(cluster, weights=self.doc_count, minlength=width)
        done = counts.filter(F.col("kind") != ANY).repartition("id").mapInArrow(lambda it: best(it, sent.value[0], sent.value[2], n, total, docs_any), "id int, best int").toArrow()
        release(counts)
        sent.destroy()
        out = cluster.copy()
        out[done["id"].to_numpy()] = done["best"].to_numpy()
        entries = np.flatnonzero(picked & (docs_any[cluster] > 0))
        return entries, out[entries]
