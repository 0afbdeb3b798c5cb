"""Clusters of features: editing, scoring and refinement.

A clustering is a table (cluster_id, field, value, doc_count) in which a feature occurs once; ``members`` is the index's table
(field, value, doc_id) of the features in question. For a cluster with n features, H is the sum of their document counts, U
the number of documents that have any of them, and the objective H / (U + n). Features and clusters meet only through the
documents that they share, by joins on doc_id after each cluster's documents are counted once.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.operators.facets import statistics
from lexigrid.operators.index import Index
from lexigrid.operators.meetings import Meetings
from lexigrid.operators.plugins import Migration, Plugin
from lexigrid.spec import RANGE
from lexigrid.storage import DICTIONARY_BYTES, materialize, sized

FEATURE = ["field", "value"]
STATE = ["cluster_id", "field", "value", "doc_count"]


def hash_key(seed: int = 0) -> Column:
    """60 bits that order features at random, but always alike."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("field"), F.lit(":"), F.col("value"))), 1, 15), 16, 10).cast("long")


def initial(index: Index, k: int, min_docs: int = 10, fields: list[str] | None = None, seed: int = 0) -> DataFrame:
    """Features with enough documents, in hash order, dealt round the clusters 1..k. Ranks come from ranges of the hash, not one sort."""
    fields = fields or index.suggested_clustering_fields()
    for f in fields:
        if f not in index.kinds:
            raise ValueError(f"no field {f}")
        if index.kinds[f] == RANGE:
            raise ValueError(f"{f} is a range and can't be clustered")
    df = None
    for f in fields:
        part = index.doc_counts(f, min_docs).select(F.lit(f).alias("field"), F.col("value").cast("string").alias("value"), "doc_count")
        df = part if df is None else df.unionByName(part)
    # kept, since what follows reads it twice, and a condition on the hash would else be asked of every token before they are counted
    df = materialize(df, "features").withColumn("_h", hash_key(seed)).withColumn("_r", F.shiftright("_h", 52))  # 256 ranges
    before = df.groupBy("_r").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_r")) - F.col("_n"))
    inner = F.row_number().over(Window.partitionBy("_r").orderBy("_h", "field", "value"))
    ranked = df.withColumn("_i", inner).join(F.broadcast(before), "_r")
    return ranked.select(((F.col("_before") + F.col("_i") - 1) % k + 1).cast("long").alias("cluster_id"), "field", "value", "doc_count")


def named(state: DataFrame, *columns: str) -> DataFrame:
    """(field, value, columns) of a clustering, marked for broadcast if it is small enough: its counted features are the dictionary that postings meet."""
    found = state.select(*FEATURE, *columns)
    return sized(found, state.count(), 96, DICTIONARY_BYTES)


def members_of(index: Index, state: DataFrame, *fields: str) -> DataFrame:
    """The index's members of the features in a clustering; with a dictionary of them no posting is shuffled."""
    return index.membership(*fields).join(named(state), FEATURE, "left_semi")


# --- editing ---


def delete_clusters(state: DataFrame, ids: list[int]) -> DataFrame:
    return state.filter(~F.col("cluster_id").isin(list(ids)))


def delete_features(state: DataFrame, features: DataFrame) -> DataFrame:
    return state.join(features.select(*FEATURE), FEATURE, "left_anti")


def next_id(state: DataFrame) -> int:
    return (state.agg(F.max("cluster_id")).first()[0] or 0) + 1


def create(state: DataFrame, features: DataFrame) -> DataFrame:
    """A new cluster of the features (field, value, doc_count), which leave the clusters that had them."""
    if not features.limit(1).count():
        raise ValueError("a cluster needs a feature")
    new = features.select(F.lit(next_id(state)).cast("long").alias("cluster_id"), *FEATURE, "doc_count")
    return delete_features(state, features).select(*STATE).unionByName(new)


def replace(state: DataFrame, new: DataFrame) -> DataFrame:
    """The clusters of ``new`` in place of theirs; features of other clusters that it has move."""
    others = state.join(new.select("cluster_id").distinct(), "cluster_id", "left_anti")
    return delete_features(others, new).select(*STATE).unionByName(new.select(*STATE))


def merge(state: DataFrame, ids: list[int]) -> DataFrame:
    """All features of the clusters go to the first one."""
    return state.withColumn("cluster_id", F.when(F.col("cluster_id").isin(list(ids)), F.lit(ids[0]).cast("long")).otherwise(F.col("cluster_id")))


def edit(members: DataFrame, state: DataFrame, action: str, ids: list[int] = (), features: DataFrame | None = None, k: int = 2, iterations: int = 10, seed: int = 0) -> DataFrame:
    """One edit by its name, as a form or a script gives it: the clusters in question, or the features (field, value, doc_count)."""
    ids = list(ids)
    if action in ("create", "delete_features", "replace") and features is None:
        raise ValueError(f"{action} needs features")
    if action in ("delete", "merge", "split", "dissolve") and not ids:
        raise ValueError(f"{action} needs clusters")
    does = {
        "create": lambda: create(state, features), "delete_features": lambda: delete_features(state, features), "replace": lambda: replace(state, features),
        "delete": lambda: delete_clusters(state, ids), "merge": lambda: merge(state, ids), "split": lambda: split(members, state, ids[0], k), "dissolve": lambda: dissolve(members, state, ids),
        "refine": lambda: refine_only(members, state, ids, iterations, seed) if ids else refine(members, state, iterations, seed),
    }
    if action not in does:
        raise ValueError(f"no such edit: {action}")
    return does[action]()


# --- reading ---


def cluster_features(state: DataFrame, cluster_id: int, top_k: int | None = None) -> DataFrame:
    got = state.filter(F.col("cluster_id") == cluster_id).orderBy(F.desc("doc_count"), *FEATURE)
    return got.limit(top_k) if top_k is not None else got


def clustering(state: DataFrame, top_k: int) -> DataFrame:
    """The most frequent features of every cluster, ranked."""
    w = Window.partitionBy("cluster_id").orderBy(F.desc("doc_count"), *FEATURE)
    return state.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)


def label(state: DataFrame, k: int = 3) -> DataFrame:
    """(cluster_id, label): the cluster's most frequent features."""
    top = clustering(state, k)
    return top.groupBy("cluster_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]), ", ").alias("label"))


def coverage(members: DataFrame, state: DataFrame) -> DataFrame:
    """(cluster_id, doc_id, times): how many features of the cluster a document has."""
    return members.join(named(state, "cluster_id"), FEATURE).groupBy("cluster_id", "doc_id").agg(F.count(F.lit(1)).alias("times"))


def cluster_docs(members: DataFrame, state: DataFrame) -> DataFrame:
    return coverage(members, state).select("cluster_id", "doc_id")


def summary(members: DataFrame, state: DataFrame, total: int) -> DataFrame:
    """(cluster_id, feature_count, hits, doc_count, relative_doc_count)."""
    docs = coverage(members, state).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("doc_count"))
    feats = state.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("feature_count"), F.sum("doc_count").alias("hits"))
    return feats.join(docs, "cluster_id", "left").select("cluster_id", "feature_count", "hits", F.coalesce("doc_count", F.lit(0)).alias("doc_count"), (F.coalesce("doc_count", F.lit(0)) / F.lit(total)).alias("relative_doc_count"))


def facet_clusters(members: DataFrame, state: DataFrame, ids: DataFrame, total: int) -> DataFrame:
    """Statistics of each cluster's documents against a table (doc_id)."""
    q = materialize(ids.select("doc_id").distinct(), "cluster-query")
    n = q.count()
    got = cluster_docs(members, state).join(sized(q, n, 48).withColumn("_hit", F.lit(1)), "doc_id", "left").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("d"), F.count("_hit").alias("h"))
    s = statistics(F.col("d"), F.col("h"), F.lit(n).cast("long"), F.lit(total))
    return got.select("cluster_id", *[c for i, c in enumerate(s) if i != 3])


def facet_features(members: DataFrame, state: DataFrame, ids: DataFrame, total: int) -> DataFrame:
    """Statistics of each feature inside its cluster."""
    q = materialize(ids.select("doc_id").distinct(), "cluster-query")
    n = q.count()
    all_ = numbered(state)
    h = members.join(named(all_, "fid"), FEATURE).select("fid", "doc_id").join(sized(q, n, 48), "doc_id", "left_semi").groupBy("fid").agg(F.count(F.lit(1)).alias("h"))
    got = all_.join(h, "fid", "left").withColumn("h", F.coalesce("h", F.lit(0).cast("long")))
    return got.select("cluster_id", *FEATURE, *statistics(F.col("doc_count"), F.col("h"), F.lit(n).cast("long"), F.lit(total)))


def matching_features(faceted: DataFrame) -> DataFrame:
    """(cluster_id, matching_feature_count): features with hits."""
    return faceted.groupBy("cluster_id").agg(F.count_if(F.col("hits") > 0).alias("matching_feature_count"))


# --- scoring ---


def cluster_stats(cov: DataFrame, state: DataFrame) -> DataFrame:
    """(cluster_id, n, total, docs_any, objective)."""
    docs = cov.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("docs_any"))
    feats = state.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_count").alias("total"))
    return feats.join(docs, "cluster_id").withColumn("objective", F.col("total") / (F.col("docs_any") + F.col("n")))


def numbered(features: DataFrame) -> DataFrame:
    """The features, kept, with a number ``fid`` that stands for the two strings in joins and groups."""
    return materialize(features.withColumn("fid", F.monotonically_increasing_id()), "cluster-features")


def removal_deltas(members: DataFrame, state: DataFrame) -> DataFrame:
    """(cluster_id, field, value, delta): what a cluster's objective owes to each of its features.

    Of a document that has one feature of a cluster, the least number of these is that feature's: no pair of them meets."""
    ids = numbered(state.select(*STATE))
    cov = members.join(named(ids, "cluster_id", "fid"), FEATURE).groupBy("cluster_id", "doc_id").agg(F.count(F.lit(1)).alias("times"), F.min("fid").alias("fid"))
    cov = materialize(cov, "cluster-coverage")
    own = cov.filter("times = 1 and doc_id is not null").groupBy("fid").agg(F.count(F.lit(1)).alias("o"))
    t = ids.join(own, "fid", "left").withColumn("o", F.coalesce("o", F.lit(0))).join(F.broadcast(cluster_stats(cov, state)), "cluster_id")  # one row a cluster
    left = F.col("docs_any") - F.col("o")
    d = F.when((left > 0) & (F.col("o") < F.col("doc_count")), F.col("objective") - (F.col("total") - F.col("doc_count")) / (left + F.col("n") - 1)).otherwise(F.lit(-1.0))
    return t.select("cluster_id", *FEATURE, d.alias("delta"))


def shared(members: DataFrame, features: DataFrame, cov: DataFrame) -> DataFrame:
    """(cluster_id, features' columns, x): in how many of a feature's documents (cluster_id, doc_id) has each cluster; none without any.

    Documents with the same set of clusters are alike here, so a feature's documents are counted by set, and the counts meet the clusters."""
    ids = numbered(features)
    docs = cov.filter("doc_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set("cluster_id")).alias("set"))
    docs = materialize(docs, "cluster-sets")
    sets = materialize(docs.select("set").distinct().withColumn("sid", F.monotonically_increasing_id()), "cluster-set-ids")
    docs = docs.join(sized(sets, sets.count(), 256), "set").select("doc_id", "sid")
    times = members.join(named(ids, "fid"), FEATURE).select("fid", "doc_id").join(docs, "doc_id").groupBy("fid", "sid").agg(F.count(F.lit(1)).alias("x"))
    x = times.join(sized(sets, sets.count(), 256), "sid").select("fid", "x", F.explode("set").alias("cluster_id")).groupBy("fid", "cluster_id").agg(F.sum("x").alias("x"))
    return x.join(ids, "fid").drop("fid")


def addition_deltas(members: DataFrame, state: DataFrame) -> DataFrame:
    """(cluster_id, field, value, delta) for every cluster that shares a document with a feature of another one."""
    cov = materialize(coverage(members, state), "cluster-coverage")
    x = shared(members, state.select(F.col("cluster_id").alias("own"), *FEATURE, "doc_count"), cov).filter("own <> cluster_id")
    x = x.join(F.broadcast(cluster_stats(cov, state)), "cluster_id")  # one row a cluster
    d = (F.col("total") + F.col("doc_count")) / (F.col("docs_any") + F.col("doc_count") - F.col("x") + F.col("n") + 1) - F.col("objective")
    return x.select("cluster_id", *FEATURE, d.alias("delta"))


def best_moves(members: DataFrame, state: DataFrame) -> DataFrame:
    """(own, field, value, best): the cluster with the greatest (delta, id) for each feature."""
    all_ = removal_deltas(members, state).unionByName(addition_deltas(members, state))
    best = all_.groupBy(*FEATURE).agg(F.max(F.struct("delta", "cluster_id")).alias("b"))
    return state.select(F.col("cluster_id").alias("own"), *FEATURE).join(best, FEATURE).select("own", *FEATURE, F.col("b.cluster_id").alias("best"))


def propose(members: DataFrame, state: DataFrame, features: DataFrame) -> DataFrame:
    """(field, value, cluster_id): the next best cluster of ``state`` for features (field, value, doc_count), by gain.

    Only pairs that share documents are scored one by one. Clusters that share none are candidates too: their gain depends on the feature's
    document count alone, so the best one is found for each different count. It is no more than the pair's own gain where documents are shared."""
    cov = materialize(coverage(members, state), "cluster-coverage")
    x = shared(members, features.select(*FEATURE, "doc_count"), cov)
    stats = materialize(cluster_stats(cov, state).select("cluster_id", "n", "total", "docs_any"), "cluster-stats")

    def gain(shared: Column) -> Column:
        u = F.col("docs_any") + F.col("doc_count") - shared
        return (F.col("total") + F.col("doc_count")) / (F.col("n") + 1 + u) - F.col("total") / (F.col("n") + F.col("docs_any"))

    stats = sized(stats, stats.count(), 96)
    near = x.join(stats, "cluster_id").select(*FEATURE, gain(F.col("x")).alias("gain"), "cluster_id")
    far = features.select("doc_count").distinct().join(stats, F.lit(True)).select("doc_count", F.struct(gain(F.lit(0)).alias("gain"), "cluster_id").alias("g")).groupBy("doc_count").agg(F.max("g").alias("g"))
    all_ = near.unionByName(features.select(*FEATURE, "doc_count").join(far, "doc_count").select(*FEATURE, "g.gain", "g.cluster_id"))
    return all_.groupBy(*FEATURE).agg(F.max(F.struct("gain", "cluster_id"))["cluster_id"].alias("cluster_id"))


def dissolve(members: DataFrame, state: DataFrame, ids: list[int]) -> DataFrame:
    """The clusters go, and each of their features moves to its next best."""
    gone = state.filter(F.col("cluster_id").isin(list(ids)))
    rest = delete_clusters(state, ids)
    moved = propose(members, rest, gone).join(gone.select(*FEATURE, "doc_count"), FEATURE)
    return rest.select(*STATE).unionByName(moved.select(*STATE))


def split(members: DataFrame, state: DataFrame, cluster_id: int, k: int) -> DataFrame:
    """Features of the cluster are grouped by the other cluster that they'd go to next; the k - 1 largest groups become clusters."""
    mine = state.filter(F.col("cluster_id") == cluster_id)
    goal = propose(members, delete_clusters(state, [cluster_id]), mine).withColumnRenamed("cluster_id", "goal")
    size = goal.groupBy("goal").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("goal")).limit(k - 1)
    new = next_id(state)
    place = size.withColumn("_id", F.row_number().over(Window.orderBy(F.desc("n"), F.desc("goal"))) - 1 + F.lit(new).cast("long")).select("goal", "_id")
    moved = mine.join(goal, FEATURE).join(F.broadcast(place), "goal", "left").withColumn("cluster_id", F.coalesce("_id", "cluster_id"))  # k - 1 rows
    return delete_clusters(state, [cluster_id]).select(*STATE).unionByName(moved.select(*STATE))


# --- refinement ---


def apply_moves(rows: list[tuple], rng: random.Random, size: dict[int, int] | None = None) -> tuple[dict, int, int]:
    """({feature: cluster}, possible, made) of rows (own, field, value, best): in shuffled order, a move is made with a chance
    that falls as its cluster empties, so a cluster is never left without features. ``size`` has each cluster's features, counted from the rows if
    they are all there are."""
    rows = sorted(rows, key=lambda r: (r[1], r[2]))
    rng.shuffle(rows)
    if size is None:
        size = {}
        for own, *_ in rows:
            size[own] = size.get(own, 0) + 1
    at, possible, made = {}, 0, 0
    for own, f, v, best in rows:
        at[f, v] = own
        if best == own:
            continue
        possible += 1
        to = size.get(best, 0)
        if (size[own] - 1) / (size[own] + to) >= rng.random() and size[own] > 1:
            size[own] -= 1
            size[best] = to + 1
            at[f, v] = best
            made += 1
    return at, possible, made


RUN = ["run", *FEATURE]


def checks(features: int, clusters: int, sampling_rate: float | None = None) -> int:
    """How many features one iteration looks at: by default a share of one in the root of the number of clusters, rounded up."""
    if sampling_rate is None:
        sampling_rate = 1 / max(1, clusters) ** 0.5
    elif not 0 < sampling_rate <= 1:
        raise ValueError(f"sampling_rate must be None or above 0 and at most 1, not {sampling_rate}")
    return math.ceil(sampling_rate * features)


def sampled_moves(members: DataFrame, state: DataFrame, picked: DataFrame) -> DataFrame:
    """(run, own, field, value, best) of the features ``picked`` from a state (run, cluster_id, field, value, doc_count) of several clusterings.

    Only their documents meet the clusters; clusterings never meet each other."""
    m = Meetings(members, state)
    flags = np.zeros(len(m.cluster), bool)
    flags[picked.select(*RUN).join(m.entries, RUN).select("entry").toArrow()["entry"].to_numpy()] = True
    entries, best = m.best(m.cluster, flags)
    to = state.sparkSession.createDataFrame(pa.table({"entry": entries.astype(np.int32), "best": m.clusters[best, 1]}))
    return m.entries.join(to, "entry").select("run", F.col("cluster_id").alias("own"), *FEATURE, "best")


def refine_runs(members: DataFrame, state: DataFrame, iterations: int = 10, seed: int = 0, sampling_rate: float | None = None) -> DataFrame:
    """Refines the clusterings of a state (run, cluster_id, field, value, doc_count) side by side, in the same jobs.

    An iteration looks at a sample of each run's features, least by a hash that changes each time, see checks(). The sample meets the clusters in the
    workers, see Meetings; the sampled features' best clusters come to the driver as numbers, where the moves depend on one another, and the changed
    clustering goes out as an array. A run ends when none of its sample would move with a full sample, or by the iterations."""
    m = Meetings(members, state)
    cluster, count = m.cluster.copy(), {}
    runs, first = np.unique(m.run, return_index=True)
    for run, start, end in zip(runs.tolist(), first.tolist(), [*first[1:].tolist(), len(cluster)]):
        count[run] = (start, end, len(np.unique(cluster[start:end])))
    budget = {run: checks(end - start, k, sampling_rate) for run, (start, end, k) in count.items()}
    rng = {run: random.Random(f"{seed}:{run}") for run in budget}
    for i in range(iterations):
        if not budget:
            break
        got = m.entries.select("entry", F.xxhash64(F.lit(seed), F.lit(i), *FEATURE).alias("h")).toArrow().sort_by("entry")
        picked = np.zeros(len(cluster), bool)
        for run, most in budget.items():
            start, end, _ = count[run]
            picked[start + np.argsort(got["h"].to_numpy()[start:end], kind="stable")[:most]] = True
        entries, best = m.best(cluster, picked)
        size = dict(enumerate(np.bincount(cluster, minlength=len(m.clusters)).tolist()))
        for run in list(budget):
            start, end, _ = count[run]
            a, b = np.searchsorted(entries, [start, end])
            if a == b:
                continue
            at, possible, _ = apply_moves([(own, 0, e, to) for own, e, to in zip(cluster[entries[a:b]].tolist(), entries[a:b].tolist(), best[a:b].tolist())], rng[run], size)
            if not possible and budget[run] == end - start:
                del budget[run]
            for (_, e), c in at.items():
                cluster[e] = c
    moved = np.flatnonzero(cluster != m.cluster)
    to = state.sparkSession.createDataFrame(pa.table({"entry": moved.astype(np.int32), "_to": m.clusters[cluster[moved], 1]}))
    new = m.entries.join(sized(to, len(moved), 64), "entry", "left")
    return materialize(new.select("run", F.coalesce("_to", "cluster_id").alias("cluster_id"), *FEATURE, "doc_count"), "clusters")


def refine(members: DataFrame, state: DataFrame, iterations: int = 10, seed: int = 0, sampling_rate: float | None = None) -> DataFrame:
    """Moves features to their best clusters, some at a time, see refine_runs(). The new state starts a new lineage."""
    return refine_runs(members, state.withColumn("run", F.lit(0).cast("long")), iterations, seed, sampling_rate).select(*STATE)


def refine_only(members: DataFrame, state: DataFrame, ids: list[int], iterations: int = 10, seed: int = 0, sampling_rate: float | None = None) -> DataFrame:
    """Refine some clusters among themselves."""
    some = state.filter(F.col("cluster_id").isin(list(ids)))
    return replace(state, refine(members, some, iterations, seed, sampling_rate))


def refine_many(members: DataFrame, states: dict[str, DataFrame], iterations: int = 10, seed: int = 0, sampling_rate: float | None = None) -> dict[str, DataFrame]:
    """Several clusterings, each refined on its own, all in the same jobs."""
    both = None
    for run, s in enumerate(states.values()):
        part = s.select(F.lit(run).cast("long").alias("run"), *STATE)
        both = part if both is None else both.unionByName(part)
    done = refine_runs(members, both, iterations, seed, sampling_rate) if both is not None else None
    return {name: done.filter(F.col("run") == run).select(*STATE) for run, name in enumerate(states)}


def as_features(members: DataFrame, state: DataFrame, field: str = "cluster") -> DataFrame:
    """Clusters as features: (field, value, doc_id), by the union of their documents."""
    return cluster_docs(members, state).select(F.lit(field).alias("field"), F.col("cluster_id").cast("string").alias("value"), "doc_id")


def cluster_clusters(items: DataFrame, k: int, iterations: int = 10, seed: int = 0) -> DataFrame:
    """A clustering into k of items (field, value, doc_id) that are clusters themselves."""
    items = materialize(items, "cluster-items")
    counts = items.groupBy(*FEATURE).agg(F.count(F.lit(1)).alias("doc_count"))
    start = counts.withColumn("cluster_id", (F.row_number().over(Window.orderBy(hash_key(seed), *FEATURE)) - 1) % k + 1)  # one row a cluster
    return refine(items, start.select(F.col("cluster_id").cast("long").alias("cluster_id"), *FEATURE, "doc_count"), iterations, seed)


def consensus(members: DataFrame, states: list[DataFrame], k: int, iterations: int = 10, seed: int = 0) -> DataFrame:
    """The clusters of several clusterings, clustered together."""
    items = None
    for i, s in enumerate(states):
        part = as_features(members, s, f"run{i}")
        items = part if items is None else items.unionByName(part)
    return cluster_clusters(items, k, iterations, seed)


def subdivide(members: DataFrame, state: DataFrame, k: int, iterations: int = 10, seed: int = 0, sampling_rate: float | None = None) -> DataFrame:
    """Each cluster split into k on its own, all in the same jobs: ids are old id * k + part."""
    part = (F.row_number().over(Window.partitionBy("cluster_id").orderBy(hash_key(seed), *FEATURE)) - 1) % k
    runs = state.select(F.col("cluster_id").alias("run"), (F.col("cluster_id") * k + part).cast("long").alias("cluster_id"), *FEATURE, "doc_count")
    return refine_runs(members, runs, iterations, seed, sampling_rate).select(*STATE)


def split_then_refine(members: DataFrame, state: DataFrame, k: int, larger: int, iterations: int = 5, seed: int = 0) -> DataFrame:
    """Halve the largest clusters by hash until there are ``larger``, refine, then group those into k and return the features' groups."""
    n = state.select("cluster_id").distinct().count()
    while n < larger:
        big = state.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cluster_id").limit(min(n, larger - n)).filter("n > 1")
        new = next_id(state)
        place = F.broadcast(big.withColumn("_new", F.row_number().over(Window.orderBy(F.desc("n"), "cluster_id")) - 1 + F.lit(new)).select("cluster_id", "_new"))
        half = F.pmod(hash_key(seed + n), F.lit(2)) == 1
        state = materialize(state.join(place, "cluster_id", "left").withColumn("cluster_id", F.when(F.col("_new").isNotNull() & half, F.col("_new").cast("long")).otherwise(F.col("cluster_id"))).select(*STATE), "clusters")
        if (now := state.select("cluster_id").distinct().count()) == n:
            break
        n = now
    state = refine(members, state, iterations, seed)
    groups = cluster_clusters(as_features(members, state), k, iterations, seed).select(F.col("cluster_id").alias("grp"), F.col("value").cast("long").alias("cluster_id"))
    return state.join(groups, "cluster_id").select(F.col("grp").alias("cluster_id"), *FEATURE, "doc_count")


# --- after changes of the index ---


def recount(members: DataFrame, state: DataFrame) -> DataFrame:
    """The clusters with document counts of another index's members; a feature that it lacks keeps its place with a count of 0."""
    now = members.join(named(state), FEATURE, "left_semi").groupBy(*FEATURE).agg(F.count(F.lit(1)).alias("_now"))
    return state.join(now, FEATURE, "left").select("cluster_id", *FEATURE, F.coalesce("_now", F.lit(0).cast("long")).alias("doc_count"))


class Clusterings(Plugin):
    """Keeps a clustering in step with its index: after a rebuild counts and documents of all clusters are made anew, after edits those of the
    clusters that changed. ``state`` and ``docs`` (cluster_id, doc_id) are the current tables."""

    name, current = "clusterings", "1"
    migrations = (Migration(None, "1", ()),)

    def __init__(self, state: DataFrame):
        super().__init__()
        self.state, self.docs = state, None
        self.changed: set[int] = set()

    def edit(self, state: DataFrame, ids: list[int]) -> None:
        """A new state, in which the clusters ``ids`` are not what they were."""
        self.state = state
        self.changed |= set(ids)

    def post_index_rebuild(self, index: Index) -> None:
        members = index.membership(*[f for f in index.kinds if index.kinds[f] != RANGE])
        self.state = materialize(recount(members, self.state), "clusters")
        self.docs = materialize(cluster_docs(members, self.state), "cluster-docs")
        self.changed = set()

    def post_transaction(self, index: Index) -> None:
        if self.docs is None:
            return self.post_index_rebuild(index)
        if self.changed:
            ids = F.col("cluster_id").isin(sorted(self.changed))
            members = index.membership(*[f for f in index.kinds if index.kinds[f] != RANGE])
            self.docs = materialize(self.docs.filter(~ids).unionByName(cluster_docs(members, self.state.filter(ids))), "cluster-docs")
            self.changed = set()


# --- cross-tabs ---


def crosstab(index: Index, members: DataFrame, state: DataFrame, group: str, clusters: int = 3, features: int = 10) -> DataFrame:
    """(grp, cluster_id, cluster_rank, field, value, hits, jaccard_similarity, rank): of each group the clusters most like its documents, and in each
    of those the features most like them."""
    groups = index.docs.select("doc_id", F.col(group).cast("string").alias("grp")).filter("grp is not null")
    g = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("g"))
    cov = cluster_docs(members, state)
    d = cov.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("d"))
    like = lambda: (F.col("hits") / (F.col("d") + F.col("g") - F.col("hits"))).alias("jaccard_similarity")
    x = cov.join(groups, "doc_id").groupBy("grp", "cluster_id").agg(F.count(F.lit(1)).alias("hits")).join(g, "grp").join(d, "cluster_id").select("grp", "cluster_id", like())
    top = x.withColumn("cluster_rank", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("jaccard_similarity"), "cluster_id"))).filter(F.col("cluster_rank") <= clusters)
    h = members.join(named(state.withColumnRenamed("doc_count", "d"), "cluster_id", "d"), FEATURE).join(groups, "doc_id").groupBy("grp", "cluster_id", *FEATURE, "d").agg(F.count(F.lit(1)).alias("hits"))
    y = h.join(top.select("grp", "cluster_id", "cluster_rank"), ["grp", "cluster_id"]).join(g, "grp").select("grp", "cluster_id", "cluster_rank", *FEATURE, "hits", like())
    return y.withColumn("rank", F.row_number().over(Window.partitionBy("grp", "cluster_id").orderBy(F.desc("jaccard_similarity"), *FEATURE))).filter(F.col("rank") <= features)
