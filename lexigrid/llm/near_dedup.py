"""Near-duplicate documents by a multi-index Hamming join over b-bit MinHash signatures.

A document's set of word shingles becomes a signature of SLOTS values of 16 bits. The signature is cut into chunks. If two
signatures differ in at most MAX_DISTANCE slots, the pigeonhole principle leaves one chunk with at most CHUNK_ERRORS
differing slots, so every way to leave out that many slots of a chunk gives a key, and each pair within the distance shares
one. That covers all pairs of the signature distance, and all but about one in a million of the pairs that are just at the
likeness threshold, since their chunks fail independently.

Documents with equal shingle sets are one class, so copies are never paired. Pairs come from a key's smallest class to
its other ones; links among them are confirmed on full sets and joined to components. Keys whose classes are then still in
different components have those classes compared too, unless they were already, so no link between classes that share a
key is lost, while a group of any number of near copies gives as many pairs as members, not their square. A key that more than
MANY classes share, such as pages of one template that are alike but not alike enough, would still give all pairs of them. Its
classes meet by an exact way instead, with no regard to signatures: sets that are alike enough share one of the rarest
shingles of each, a quarter of the set, so only classes with such a shingle in common are compared.
No pair is dropped before its full sets are compared, unless their sizes alone rule the likeness out.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; null or blank texts have no shingles, link with
nothing and are their own component; fewer words than a shingle are one shingle; a document with a null id is linked, by a hash
of its text in place of the id, and has a component, but none is named after it (null if nothing else is there); rows with equal
ids are one node, so what any of them is linked with is in one component; equal rows give equal results; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.llm.components import components
from lexigrid.llm.textkit import LOWER, flat, mix, python_stage, slices, span_hash, texts, words
from lexigrid.storage import materialize, sized, spread

CHUNKS, CHUNK_SLOTS, CHUNK_ERRORS = 14, 5, 1
SLOTS = CHUNKS * CHUNK_SLOTS
MAX_DISTANCE = CHUNKS * (CHUNK_ERRORS + 1) - 1
#: A key of more classes than this has no pairs made of it.
MANY = 16
LIKE_NUM, LIKE_DEN, SHINGLE = 75, 100, 2

_rng = np.random.default_rng(20240229)
_A, _B, _C = ((_rng.integers(0, 1 << 31, SLOTS, dtype=np.uint32) << np.uint32(1) | np.uint32(1))[:, None] for _ in range(3))


def shingle_hashes(h: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of a document's n-word shingles, from its words' hashes."""
    if not len(h):
        return h
    m = max(1, len(h) - n + 1)
    s = np.full(m, np.uint64(min(n, len(h))))
    for k in range(min(n, len(h))):
        s = mix(s * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m])
    return np.unique(s)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Hashes of the shingles of each text, none for null or blank ones."""
    buf, off = flat(column)
    buf = LOWER[buf]
    starts, ends, first = words(buf, off)
    h = span_hash(buf, starts, ends)
    return (shingle_hashes(h[a:b]) for a, b in zip(first[:-1], first[1:]))


def signature(s: np.ndarray) -> bytes:
    """SLOTS least values of independent 32-bit permutations over the set, 16 bits of each."""
    low = np.full(SLOTS, np.uint32(0xFFFFFFFF))
    x = (s >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 1024):
        v = (x[None, at : at + 1024] ^ _B) * _A
        v ^= v >> np.uint32(15)
        v *= _C
        np.minimum(low, v.min(1), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16).tobytes()


def with_node(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``_node``, which tells texts apart: the id where just one row has it, else a hash of id and text."""
    key = F.col(id_col).cast("long")
    again = materialize(docs.select(key.alias("_again")).filter("_again is not null").groupBy("_again").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_again"), "near-repeated-ids")
    named = F.xxhash64(key, F.coalesce(F.col(text_col), F.lit("")))
    if not (n := again.count()):
        return docs.withColumn("_node", F.coalesce(key, named))
    got = docs.join(sized(again, n, 48), key == F.col("_again"), "left")
    return got.withColumn("_node", F.when(key.isNull() | F.col("_again").isNotNull(), named).otherwise(key)).drop("_again")


def nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, node, text) of with_node()."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col("_node").alias("node"), F.col(text_col).alias("text"))


def one_each(body: DataFrame, plain: bool) -> DataFrame:
    """One row an id: rows with both id and text in common share a node, but in ``plain`` tables there are none."""
    return body if plain else body.dropDuplicates(["id"])


def signatures(rows: DataFrame) -> DataFrame:
    """(id, node, n_shingles, s1, s2, sig) of nodes(): set size, 128 bits that name the set, signature (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            n, s1, s2, sig = [], [], [], []
            for s in shingle_sets(part.column("text")):
                n.append(len(s))
                s1.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                s2.append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)))
                sig.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("node"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sig, pa.binary())], ["id", "node", "n_shingles", "s1", "s2", "sig"])

    return rows.transform(python_stage, run, "id bigint, node bigint, n_shingles bigint, s1 bigint, s2 bigint, sig binary")


def keys(classes: DataFrame) -> DataFrame:
    """(key, id): every chunk with each allowed set of slots left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = list(combinations(range(CHUNK_SLOTS), CHUNK_SLOTS - CHUNK_ERRORS))
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(part.num_rows, SLOTS).astype(np.uint64)
                ids = part.column("id").to_numpy()
                made = []
                for c in range(CHUNKS):
                    for o, use in enumerate(kept):
                        k = np.full(part.num_rows, np.uint64(c * len(kept) + o + 1))
                        for slot in use:
                            k = mix(k * np.uint64(0x9E3779B97F4A7C15) + sig[:, c * CHUNK_SLOTS + slot])
                        made.append(k.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made)), pa.array(np.tile(ids, len(made)))], ["key", "id"])

    return classes.select("id", "sig").transform(python_stage, run, "key bigint, id bigint")


def like_sizes(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are of such sizes that they may be alike enough."""
    n = classes.select("id", "n_shingles")
    both = pairs.join(n.withColumnsRenamed({"id": "a", "n_shingles": "x"}), "a").join(n.withColumnsRenamed({"id": "b", "n_shingles": "y"}), "b")
    return both.filter(LIKE_DEN * F.least("x", "y") >= LIKE_NUM * F.greatest("x", "y")).select("a", "b")


def across(groups: DataFrame, by: str) -> DataFrame:
    """Pairs (a, b), a < b, of ids of different components in one group of (by, id, component)."""
    parts = groups.groupBy(by, "component").agg(F.count(F.lit(1)).alias("m")).groupBy(by).agg(F.max(F.struct("m", "component"))["component"].alias("largest"), F.count(F.lit(1)).alias("k"))
    mixed = groups.join(parts.filter("k > 1").select(by, "largest"), by)
    # such a pair has a member outside the group's largest component: those few meet the group's others
    few = mixed.filter("component <> largest").select(by, F.col("id").alias("x"), F.col("component").alias("cx"))
    return few.join(mixed.select(by, "id", "component"), by).filter("component <> cx").select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct()


def rare_prefixes(ids: DataFrame, rows: DataFrame, plain: bool) -> DataFrame:
    """(h, id, component): of each class of ids (id, component) the shingles that one of any class alike enough must be among.

    Shingles are ordered by how many of the classes have them, then by hash. Sets of sizes n and m have a likeness of t only if
    they share t * n of the first; leaving out all but one of these from the end, the rest of both meets."""
    ids = ids.withColumnRenamed("id", "class")
    body = rows.join(sized(ids, ids.count(), 64), rows["node"] == ids["class"]).select(F.col("class").alias("id"), "component", "text")
    body = one_each(body, plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = list(shingle_sets(part.column("text")))
            take = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
            size = np.repeat([len(s) for s in sets], [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).astype(np.int64)), part.column("id").take(take), part.column("component").take(take), pa.array(size.astype(np.int64))], ["h", "id", "component", "n"])

    all_ = materialize(body.transform(python_stage, run, "h bigint, id bigint, component bigint, n bigint"), "near-shingles")
    often = all_.groupBy("h").agg(F.count(F.lit(1)).alias("often"))
    ranked = all_.join(often, "h").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("often", "h")))
    return ranked.filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * LIKE_NUM / LIKE_DEN) + 1).select("h", "id", "component")


def _set(text: str) -> frozenset:
    buf = LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)].tobytes()
    w = buf.split()  # bytes split at exactly \x20 and \x09-\x0D
    return frozenset(zip(*[w[k:] for k in range(SHINGLE)])) if len(w) >= SHINGLE else frozenset([tuple(w)] if w else [])


def confirm(pairs: DataFrame, docs: DataFrame, plain: bool = True) -> DataFrame:
    """The pairs (a, b) of nodes that are alike enough on their full sets of shingles."""
    wanted = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "near-ids")
    rows = docs.select(F.col("node").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    body = materialize(one_each(rows.join(sized(wanted, wanted.count(), 48), "id", "left_semi"), plain), "near-texts")
    # the second text is looked up for runs of rows with one first text, whose set is then made once
    both = pairs.join(body.withColumnsRenamed({"id": "a", "text": "x"}), "a").join(body.withColumnsRenamed({"id": "b", "text": "y"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "x"):
            a, b, keep = part.column("a").to_pylist(), part.column("b").to_pylist(), []
            made: dict[str, frozenset] = {}
            for x, y in zip(texts(part.column("x")), texts(part.column("y"))):
                sx, sy = (made.get(t) or made.setdefault(t, _set(t)) for t in (x, y))
                both_ = len(sx & sy)
                keep.append(bool(both_) and LIKE_DEN * both_ >= LIKE_NUM * (len(sx) + len(sy) - both_))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "x", "y").transform(python_stage, run, "a bigint, b bigint").distinct()


def signed(rows: DataFrame) -> tuple[DataFrame, bool]:
    """signatures(), materialised, and whether every node is its row's id."""
    sigs = materialize(signatures(rows), "signatures")
    return sigs, not sigs.filter("not id <=> node").limit(1).count()


def labels(rows: DataFrame, sigs: DataFrame, plain: bool, one_node: bool) -> tuple[DataFrame, DataFrame]:
    """(classes, label): classes of equal sets (s1, s2, n_shingles, sig, id, real), and (id, component) of the linked ones."""
    classes = materialize(sigs.filter("n_shingles > 0").groupBy("s1", "s2", "n_shingles", "sig").agg(F.min("node").alias("id"), F.min("id").alias("real")), "near-classes")
    k = keys(classes)
    buckets = materialize(k.groupBy("key").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-buckets")
    members = materialize(k.join(buckets, "key"), "near-members")
    first = materialize(members.filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), "near-pairs")
    links = materialize(confirm(materialize(like_sizes(first, classes), "near-pairs"), rows, plain), "near-links")
    label = components(links)
    # keys of three or more classes that are not all in one component by now
    at = members.filter("n > 2").select("key", "id", "n").join(label, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    mixed = materialize(at.join(at.groupBy("key").agg((F.min("component") < F.max("component")).alias("_more")).filter("_more").select("key"), "key", "left_semi"), "near-mixed")
    rest = across(mixed.filter(F.col("n") <= MANY).select("key", "id", "component"), "key")
    crowd = materialize(mixed.filter(F.col("n") > MANY).select("id", "component").distinct(), "near-crowd")
    if crowd.limit(1).count():
        rest = rest.union(across(materialize(rare_prefixes(crowd, rows, plain), "near-prefixes"), "h")).distinct()
    rest = materialize(like_sizes(rest.join(first, ["a", "b"], "left_anti"), classes), "near-rest")
    if rest.limit(1).count():
        links = links.union(materialize(confirm(rest, rows, plain), "near-links"))
        label = None
    if one_node and not plain:
        again = sigs.filter("id <> node and n_shingles > 0").select("id", "s1", "s2", "n_shingles")
        of_id = materialize(again.join(classes.select("s1", "s2", "n_shingles", F.col("id").alias("class")), ["s1", "s2", "n_shingles"]).select("id", "class").distinct(), "near-same-id")
        same = of_id.join(of_id.groupBy("id").agg(F.min("class").alias("a")), "id").filter("a <> class").select("a", F.col("class").alias("b"))
        if same.limit(1).count():
            links = links.union(same)
            label = None
    return classes, label if label is not None else components(links)


def by_row(sigs: DataFrame, classes: DataFrame, label: DataFrame) -> DataFrame:
    """(id, node, n_shingles, component, real) of every row; the first two of a blank text are its own."""
    of = classes.join(label, "id", "left").select("s1", "s2", "n_shingles", F.coalesce("component", "id").alias("component"), "real")
    got = sigs.drop("sig").join(of, ["s1", "s2", "n_shingles"], "left")
    return got.select("id", "node", "n_shingles", F.coalesce("component", "node").alias("component"), "real")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every document."""
    rows = nodes(with_node(docs, id_col, text_col), id_col, text_col)
    sigs, plain = signed(rows)
    classes, label = labels(rows, sigs, plain, True)
    out = by_row(sigs, classes, label)
    if not plain:  # a component may be labelled by a hash: it is named after its least real id
        out = materialize(out, "near-rows")
        names = out.filter("n_shingles > 0").groupBy("component").agg(F.min("real").alias("name"))
        # a hot component meets one row of names; adaptive skew joins split it
        out = out.join(names, "component", "left").select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("name")).otherwise(F.col("id")).alias("component_id"))
    else:
        out = out.select("id", "n_shingles", F.col("component").alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each group of near copies: that with the least id, any other if no row has one.

    Here rows are told apart by id and text, not by id alone, so a text is lost only to one that it is linked with. Rows that have both in
    common are one if the text isn't blank; rows with blank texts stay."""
    keyed = with_node(docs, id_col, text_col)
    rows = nodes(keyed, id_col, text_col)
    sigs, plain = signed(rows)
    classes, label = labels(rows, sigs, plain, False)
    placed = by_row(sigs, classes, label).filter("n_shingles > 0")
    stay = placed.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node"))["node"].alias("stay"))
    gone = materialize(placed.join(stay, "component").filter("node <> stay").select(F.col("node").alias("_node")).distinct(), "near-gone")
    left = keyed.join(sized(gone, gone.count(), 48), "_node", "left_anti")
    if not plain:
        shared = F.coalesce(F.col("_node") != F.col(id_col).cast("long"), F.lit(True)) & F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        left = left.filter(~shared).unionByName(left.filter(shared).dropDuplicates(["_node"]))
    return left.select(*docs.columns)


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))).withColumnRenamed("id", "doc_id")


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (
  SELECT DISTINCT doc_id, a[i] || ' ' || a[i + 1] AS g FROM (SELECT doc_id, a, unnest(generate_series(1, len(a) - 1)) AS i FROM w WHERE len(a) > 1)
  UNION SELECT doc_id, a[1] FROM w WHERE len(a) = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(c.low, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""
