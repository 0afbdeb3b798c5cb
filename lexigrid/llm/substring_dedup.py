"""Passages that repeat across documents, by prefix-partitioned suffix trees.

A suffix starts at every window of LENGTH words. Suffixes are partitioned by an anchor, the least hashed GRAM-word group of
the window: equal windows have equal anchors, so no deep node spans two partitions, and suffixes whose anchor occurs in one
document only have none and don't travel. Neighbouring windows share an anchor, so a partition's suffixes are shipped as
contexts, the words of all windows that have the anchor in common; equal contexts are one leaf, with the smallest id that has it.

Anchors have variable lengths. Where the contexts of one are more than GROUP_BYTES, it is lengthened: each window
holds some more words right of the anchor or, if it ends before them, left of it, so the partition splits into two kinds of finer ones, and
again until each fits or the anchor is the window itself, whose equal suffixes are then one leaf. Partitions are worked off in
memory-sized groups. Each group's suffixes are sorted to depth LENGTH by doubling; the tree's internal nodes of that depth are the
intervals of sorted suffixes that agree so far. The smallest document under such a node says which windows came
earlier, and runs of such windows are the maximal repeats.

A gram, a context or a passage in a third of all rows is combined inside the map tasks before it travels.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+``; null text has none; documents of fewer than LENGTH words lose nothing; rows
with equal ids never take words from each other, nor do rows with null ids, which come after all others; equal rows give equal
results and their places are taken once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.textkit import flat, mix, python_stage, segments, slices, span_hash, texts, words
from lexigrid.storage import materialize, release, spread

LENGTH, GRAM = 50, 12
#: Bytes of contexts from which a group of subtrees is worked off, and beyond which one anchor is lengthened.
GROUP_BYTES = 4 << 20
LAST = (1 << 63) - 1
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n items from each position on, by doubling."""
    g, width, made = h, 1, {1: h}
    while width * 2 <= n:
        g = mix(g[: len(g) - width] * _M[0] + g[width:])
        width *= 2
        made[width] = g
    at = width
    for w in sorted(made, reverse=True):
        if at + w <= n:
            m = max(0, len(h) - at - w + 1)
            g = mix(g[:m] * _M[1] + made[w][at : at + m])
            at += w
    return g


def argmin_windows(g: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value in each window of ``width`` items."""
    i, w = np.arange(len(g)), 1

    def less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(g[a] <= g[b], a, b)

    while w * 2 <= width:
        i = less(i[: len(i) - w], i[w:])
        w *= 2
    d = width - w
    return less(i[: len(i) - d], i[d:]) if d else i


def anchors(h: np.ndarray, first: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of every window that lies in one document: gram hashes, and first and last start of the windows that have it."""
    none = np.zeros(0, np.int64)
    if len(h) < length:
        return np.zeros(0, np.uint64), none, none
    g = grams(h, gram)
    best = argmin_windows(g, length - gram + 1)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(h))
    start = np.flatnonzero(left[: len(best)] >= length)
    if not len(start):
        return np.zeros(0, np.uint64), none, none
    best = best[start]
    # leftmost minima never move back, so an anchor's windows are consecutive
    new = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    last = np.concatenate([new[1:], [len(start)]]) - 1
    return g[best[new]], start[new], start[last]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(ord, tag, id, text): ord orders documents, ord and tag tell rows of different text apart."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("ord"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tag"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def anchor_table(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            starts, ends, first = words(*(bo := flat(part.column("text"))))
            g, at, to = anchors(span_hash(bo[0], starts, ends), first, length, gram)
            row = segments(first)[at]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), part.column("ord").take(take), part.column("tag").take(take), pa.array((at - first[row]).astype(np.int32)), pa.array((to + length - at).astype(np.int32))], ["h", "ord", "tag", "at", "n"])

    return rows.select("ord", "tag", "text").transform(python_stage, run, "h bigint, ord bigint, tag bigint, at int, n int")


def contexts(rows: DataFrame) -> DataFrame:
    """(h, ctx, ord, tag, at, n) of (ord, tag, text, anchors): the words of each anchor's windows, joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "ctx", "ord", "tag", "at", "n"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        for part in slices(batches, "text", 1 << 18):
            out: list[tuple] = []
            for o, t, text, anchors_ in zip(part.column("ord").to_pylist(), part.column("tag").to_pylist(), texts(part.column("text")), part.column("anchors").to_pylist()):
                w = text.encode("utf-8", "surrogatepass").split()
                out += [(x["h"], b" ".join(w[x["at"] : x["at"] + x["n"]]), o, t, x["at"], x["n"]) for x in anchors_]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k if k != pa.string() else pa.binary()).cast(k) for c, k in zip(zip(*out), kinds)], names)

    return rows.select("ord", "tag", "text", "anchors").transform(python_stage, run, "h bigint, ctx string, ord bigint, tag bigint, at int, n int")


def deep_nodes(contexts_: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tree of all suffixes of ``length`` words of the contexts, cut at that depth: (suffixes in sorted order, first suffix of
    each deepest node in that order, context and offset of each suffix)."""
    ids: dict[bytes, int] = {}
    split = [c.split(b" ") for c in contexts_]
    rank = np.array([ids.setdefault(w, len(ids)) for s in split for w in s], np.int64)
    count = np.array([len(s) for s in split], np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    depth = 1

    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]

    while depth * 2 <= length:
        rank = pair(rank[: len(rank) - depth], rank[depth:])
        depth *= 2
    if depth < length:
        rank = pair(rank[: len(rank) - (length - depth)], rank[length - depth :])
    left = np.repeat(first[1:], count) - np.arange(first[-1])
    inside = np.flatnonzero(left[: len(rank)] >= length)
    rank = rank[inside]
    order = np.argsort(rank, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = rank[order[1:]] != rank[order[:-1]]
    owner = np.repeat(np.arange(len(split)), count)[inside]
    return order, np.flatnonzero(new), owner, inside - first[owner]


def runs(owner: np.ndarray, offset: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, end) of the union of the windows at the offsets; rows are in order."""
    if not len(owner):
        return owner, offset, offset
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (offset[1:] > offset[:-1] + length)
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(owner)]]) - 1
    return owner[at], offset[at], offset[last] + length


def earlier_runs(contexts_: list[bytes], low: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, end) of the maximal repeats that start in a smaller document than the context's own."""
    order, node, owner, offset = deep_nodes(contexts_, length)
    if not len(order):
        return runs(owner, offset, length)
    doc = low[owner]
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(doc[order], node), np.diff(np.append(node, len(order))))
    hit = least < doc
    return runs(owner[hit], offset[hit], length)


def subtree_runs(groups: DataFrame, length: int = LENGTH, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(h, cid, s, e) of the maximal repeats inside the contexts (h, cid, ctx, low), which come whole anchors at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def work(rows: list[tuple]) -> pa.RecordBatch:
            c, s, e = earlier_runs([r[2] for r in rows], np.array([r[3] for r in rows], np.int64), length)
            return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in c], pa.int64()), pa.array([rows[i][1] for i in c], pa.int64()), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["h", "cid", "s", "e"])

        for part in slices(batches, "ctx", 1 << 19):
            for row in zip(part.column("h").to_pylist(), part.column("cid").to_pylist(), part.column("ctx").cast(pa.binary()).to_pylist(), part.column("low").to_pylist()):
                if size >= group_bytes and row[0] != held[-1][0]:
                    yield work(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield work(held)

    return groups.select("h", "cid", "ctx", "low").transform(python_stage, run, "h bigint, cid bigint, s int, e int")


def pieces(n: int, g: int, size: int, to: int, length: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """(start, end, anchor's start) of the parts into which a context of n words falls when its anchor of ``size`` words at g becomes one
    of ``to``: windows that hold the words after it, and those that hold the words before it. Each window is in one part."""
    last = min(g, n - length)
    if to == length:
        for s in range(max(0, g + size - length), last + 1):
            yield s, s + length, s
        return
    more = to - size
    right = max(0, g + to - length)
    if right <= last:
        yield right, last + length, g
    if (end := min(right - 1, last)) >= 0:
        yield 0, end + length, g - more


def lengthen(big: DataFrame, size: int, to: int, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(h0, cid0, base, h, ctx, g, low): the parts of contexts (h, cid, ctx, g, low) by anchors of ``to`` words; base is a part's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
        for part in slices(batches, "ctx", 1 << 18):
            out: list[tuple] = []
            at = part.column("g").to_pylist()
            if size == gram:  # an anchor is where it is in the first window of its context
                starts, ends, first = words(*(bo := flat(part.column("ctx"))))
                h = span_hash(bo[0], starts, ends)
                at = [int(np.argmin(grams(h[a : a + length], gram))) for a in first[:-1]]
            for h0, c0, ctx, g, low in zip(part.column("h").to_pylist(), part.column("cid").to_pylist(), part.column("ctx").cast(pa.binary()).to_pylist(), at, part.column("low").to_pylist()):
                w = ctx.split(b" ")
                for s, e, new in pieces(len(w), g, size, to, length):
                    key = hashlib.blake2b(b" ".join(w[new : new + to]), digest_size=8).digest()
                    out.append((h0, c0, s, int.from_bytes(key, "little", signed=True), b" ".join(w[s:e]), new - s, low))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k).cast(pa.string()) if k == pa.binary() else pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["h0", "cid0", "base", "h", "ctx", "g", "low"])

    return big.select("h", "cid", "ctx", "g", "low").transform(python_stage, run, "h0 bigint, cid0 bigint, base int, h bigint, ctx string, g int, low bigint")


def tree_runs(one: DataFrame, size: int = GRAM, length: int = LENGTH, gram: int = GRAM, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(h, cid, s, e) of the maximal repeats of the distinct contexts (h, cid, ctx, g, low), whose anchors have ``size`` words."""
    sizes = materialize(one.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.sum(F.octet_length("ctx")).alias("bytes")).filter("k > 1").select("h", (F.col("bytes") > group_bytes).alias("big")), "anchor-sizes")
    in_groups = one.join(sizes.filter("not big").select("h"), "h", "left_semi")
    part = subtree_runs(in_groups.repartition("h").sortWithinPartitions("h"), length, group_bytes)
    if not sizes.filter("big").limit(1).count():
        return materialize(part, "context-runs")
    # beyond what a step of this length lets a window hold on one of its sides, windows stand alone
    step = (length - gram) // 3
    to = size + step if size + 2 * step <= length + 1 else length
    big = one.join(sizes.filter("big").select("h"), "h", "left_semi")
    parts = materialize(lengthen(big, size, to, length, gram).withColumn("cid", F.xxhash64("ctx")).withColumn("n", F.size(F.split("ctx", " "))), "contexts-parts")
    finer = materialize(parts.groupBy("h", "cid", "ctx", "g").agg(F.min("low").alias("low"), F.count(F.lit(1)).alias("copies")), "contexts-once")
    below = tree_runs(finer, to, length, gram, group_bytes)
    own = parts.join(below, ["h", "cid"]).select("h0", "cid0", (F.col("base") + F.col("s")).alias("s"), (F.col("base") + F.col("e")).alias("e"))
    # a leaf with several documents
    leaf = finer.filter("copies > 1").select("h", "cid", F.col("low").alias("least"))
    later = parts.join(leaf, ["h", "cid"]).filter("low > least").select("h0", "cid0", F.col("base").alias("s"), (F.col("base") + F.col("n")).alias("e"))
    found = own.union(later).select(F.col("h0").alias("h"), F.col("cid0").alias("cid"), "s", "e").distinct()
    return materialize(part.unionByName(found), "context-runs")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_bytes: int = GROUP_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(ord, tag, spans): for each row that loses words, the word ranges [s, e) that some earlier document has."""
    rows = _rows(docs, id_col, text_col)
    table = materialize(anchor_table(rows, length, gram), "anchors")
    shared = table.groupBy("h").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).filter("lo < hi").select("h")
    # sets, so that equal rows, which share ord and tag, give their places once
    places = table.join(shared, "h", "left_semi").groupBy("ord", "tag").agg(F.collect_set(F.struct("h", "at", "n")).alias("anchors"))
    places = materialize(places, "anchor-places")
    release(table)
    # places and spans grow with the corpus, so texts are always met by a shuffle
    ctx = materialize(contexts(rows.join(places, ["ord", "tag"])).withColumn("cid", F.xxhash64("ctx")), "contexts")
    one = materialize(ctx.groupBy("h", "cid", "ctx").agg(F.min("ord").alias("low"), F.count(F.lit(1)).alias("copies")).withColumn("g", F.lit(0)), "contexts-once")
    part = tree_runs(one, gram, length, gram, group_bytes)
    of = ctx.select("h", "cid", "ord", "tag", "at", "n")
    later = of.join(one.filter("copies > 1").select("h", "cid", "low"), ["h", "cid"]).filter("ord > low").select("ord", "tag", F.col("at").alias("s"), (F.col("at") + F.col("n")).alias("e"))
    own = of.join(part, ["h", "cid"]).select("ord", "tag", (F.col("at") + F.col("s")).alias("s"), (F.col("at") + F.col("e")).alias("e"))
    return later.union(own).groupBy("ord", "tag").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def remove(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_text) from repeats(), materialised."""
    rows = _rows(docs, id_col, text_col).join(spans, ["ord", "tag"], "left").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            total, gone, kept = [], [], []
            for text, cut in zip(texts(part.column("text")), part.column("spans").to_pylist()):
                w = text.encode("utf-8", "surrogatepass").split()
                total.append(len(w))
                if cut:
                    keep = np.ones(len(w), bool)
                    for c in cut:
                        keep[c["s"] : c["e"]] = False
                    w = [w[i] for i in np.flatnonzero(keep)]
                gone.append(total[-1] - len(w))
                kept.append(b" ".join(w))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept_text"])

    return rows.transform(python_stage, run, "id bigint, n_words bigint, n_removed bigint, kept_text string")


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_bytes: int = GROUP_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return remove(docs, materialize(repeats(docs, length, gram, group_bytes, id_col, text_col), "repeats"), id_col, text_col)


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    got = substring_dedup(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return got.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS a FROM documents),
p AS (SELECT doc_id, i, list_slice(a, i, i + 49) AS win FROM (SELECT doc_id, a, unnest(generate_series(1, len(a) - 49)) AS i FROM w WHERE len(a) >= 50)),
q AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY md5(array_to_string(win, ' '))) AS low FROM p),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS k FROM q WHERE low < doc_id),
t AS (SELECT w.doc_id, u.k, a[u.k] AS v, g.k IS NULL AS stays
      FROM w CROSS JOIN unnest(generate_series(1, len(a))) AS u(k) LEFT JOIN g ON g.doc_id = w.doc_id AND g.k = u.k)
SELECT w.doc_id, CAST(len(a) AS BIGINT) AS n_words, CAST(coalesce(x.gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(x.kept, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) FILTER (NOT stays) AS gone, string_agg(v, ' ' ORDER BY k) FILTER (stays) AS kept FROM t GROUP BY doc_id) x ON x.doc_id = w.doc_id
"""
