"""Operators on documents against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexigrid import storage
from lexigrid.llm import components, exact_dedup, mixing, near_dedup, substring_dedup

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute_components(rows):
    sets = {}
    for d, t, *_ in rows:
        w = W.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)]) if w else frozenset()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 75 * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in sets}


def brute_repeats(rows, length=50):
    low = {}
    for d, t, *_ in rows:
        w = W.findall(t or "")
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            low[k] = min(low.get(k, d), d)
    out = {}
    for d, t, *_ in rows:
        w = W.findall(t or "")
        gone = set()
        for i in range(len(w) - length + 1):
            if low[tuple(w[i : i + length])] < d:
                gone |= set(range(i, i + length))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def test_exact_dedup(docs, rows, empty):
    by = defaultdict(list)
    for d, t, *_ in rows:
        by[t or ""].append(d)
    want = {d: (max(v), len(v), d == max(v), hashlib.sha256(t.encode()).hexdigest()) for t, v in by.items() for d in v}
    got = {r["id"]: (r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"]).hex()) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == want
    assert exact_dedup.exact_dedup(empty).count() == 0


@pytest.mark.parametrize("limit", [24 << 20, 0])
def test_exact_dedup_hot_group(spark, monkeypatch, limit):
    """A text in two thirds of the rows, with a broadcast of the repeated digests and without."""
    monkeypatch.setattr(storage, "BROADCAST_BYTES", limit)
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"cold {i // 6}") for i in range(600)] + [(None, "hot")], "doc_id bigint, text string").repartition(8)
    got = exact_dedup.exact_dedup(df).collect()
    assert len(got) == 601
    assert {(r["keep_id"], r["group_size"]) for r in got if r["group_size"] > 10} == {(599, 401)}
    assert sum(r["kept"] for r in got) == 101
    _, _, hot = exact_dedup.repeated(exact_dedup.digests(df))
    made = df.select(F.col("doc_id").alias("id"), F.col("text").alias("body")).withColumn("digest", F.unhex(F.sha2("body", 256)))
    plan = exact_dedup.combine(made, hot, F.col("id"))
    assert plan.filter("body = 'hot'").count() == 1
    left = exact_dedup.distinct_rows(df)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {r["id"] for r in got if r["kept"]}


def test_exact_dedup_salts_before_it_shuffles(spark, monkeypatch):
    """Rows of a hot text get a salt for each map task, even with no broadcast of digests."""
    seen = []
    kept = exact_dedup.materialize
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(exact_dedup, "materialize", lambda df, label: seen.append((label, kept(df, label))) or seen[-1][1])
    df = spark.range(4000, numPartitions=8).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("text"))
    assert exact_dedup.exact_dedup(df).filter("group_size > 1").count() == 2666
    salted = next(d for n, d in seen if n == "dup-salted").collect()
    assert {r["_salt"] for r in salted} == set(range(8)) and sum(r["group_size"] for r in salted) == 2666


@pytest.mark.parametrize("limit", [24 << 20, 0])
def test_distinct_rows_with_repeated_and_null_ids(spark, monkeypatch, limit):
    monkeypatch.setattr(storage, "BROADCAST_BYTES", limit)
    rows = [(5, "A", "x"), (9, "A", "y"), (5, "B", "x"), (7, "C", "a"), (7, "C", "b"), (7, "C", "b"), (None, "D", "z"), (None, "D", "z"), (None, "A", "q"), (1, None, "n"), (2, "", "n"), (None, "E", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, digest string").repartition(3)
    got = sorted(map(tuple, exact_dedup.distinct_rows(df).collect()), key=str)
    assert got == sorted([(9, "A", "y"), (5, "B", "x"), (7, "C", "b"), (None, "D", "z"), (2, "", "n"), (None, "E", None)], key=str)


def test_mixing(docs, rows, empty):
    got = {r["id"]: r for r in mixing.mix(mixing.sizes(docs)).collect()}
    size = {d: len(W.findall(t or "")) for d, t, *_ in rows}
    assert {d: r["size"] for d, r in got.items()} == size
    per = Counter()
    for d, _, _, s, *_ in rows:
        per[s] += size[d]
    weight = {"a": 5, "b": 2, None: 1}
    goal, left, open_ = {}, 1.5 * sum(per.values()), set(per)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * per[s] < level * weight[s]}
        if not full:
            goal |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            goal[s] = 2.0 * per[s]
            left -= goal[s]
        open_ -= full
    taken = Counter()
    for d, _, _, s, *_ in rows:
        assert got[d]["target"] == pytest.approx(goal[s])
        assert 0 <= got[d]["taken"] <= 2 * size[d]
        taken[s] += got[d]["taken"]
    assert {s: int(g + 1e-6) for s, g in goal.items()} == dict(taken)
    assert sorted(mixing.mix(mixing.sizes(docs.repartition(7))).collect()) == sorted(got.values())
    assert mixing.mix(mixing.sizes(empty)).count() == 0


def test_mixing_edge_cases(spark):
    """Texts without a word, rows repeated as they are, one source alone, ids that are null."""
    blank = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, " \n", None)], "doc_id bigint, text string, source string")
    assert {(r["id"], r["size"], r["target"], r["taken"]) for r in mixing.mix(mixing.sizes(blank)).collect()} == {(i, 0, 0.0, 0) for i in (1, 2, 3)}
    rows = [(7, "x y z", "a")] * 4 + [(None, "p q", "b"), (None, "p q", "b"), (8, "one", "b"), (9, None, "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    got = mixing.mix(mixing.sizes(df)).collect()
    assert len(got) == 8 and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    for s in "ab":
        own = [r for r in got if r["source"] == s]
        assert own[0]["source_size"] == sum(r["size"] for r in own) and sum(r["taken"] for r in own) == int(own[0]["target"] + 1e-6)
    one = mixing.mix(mixing.sizes(df.filter("source = 'a'"))).collect()
    assert sum(r["taken"] for r in one) == 18


def test_mixing_many_ranges(docs, monkeypatch):
    want = sorted(mixing.mix(mixing.sizes(docs)).collect())
    monkeypatch.setattr(mixing, "RANGE_ROWS", 4)
    assert sorted(mixing.mix(mixing.sizes(docs)).collect()) == want


def test_near_dedup(docs, rows, empty):
    got = {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(docs).collect()}
    assert got == brute_components(rows)
    assert near_dedup.near_dedup(empty).count() == 0


def test_near_dedup_chains_and_rounds(spark, monkeypatch):
    """A hot group of near copies and drifting chains, whose ends are linked over others only; with joins in place of the driver."""
    import random

    rng = random.Random(1)
    rows, i = [], 0
    for _ in range(6):
        w = [f"a{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(12):
            w[rng.randrange(120)] = f"b{rng.randrange(10**6)}"
            w[rng.randrange(120)] = f"b{rng.randrange(10**6)}"
            rows.append((i, " ".join(w)))
            i += 1
    w = [f"h{k}" for k in range(200)]
    for k in range(150):
        v = list(w)
        v[rng.randrange(200)] = f"x{k}"
        rows.append((i, " ".join(v)))
        i += 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_components(rows)
    got = {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(df).collect()}
    assert got == want
    edges = spark.createDataFrame([(a, a + 1) for a in range(40) if a % 8 != 7] + [(50, k) for k in range(51, 80)], "a bigint, b bigint")
    by_driver = {tuple(r) for r in components.components(edges).collect()}
    assert {tuple(r) for r in components.components(edges, 0).collect()} == by_driver


def test_near_dedup_pages_of_a_template(spark, monkeypatch):
    """Pages alike but not alike enough make no pairs of each other; the few that are linked are found, also beyond MANY classes a key."""
    import random

    rng = random.Random(3)
    frame = [f"f{k}" for k in range(150)]
    rows = [(i, " ".join(frame + [f"u{i}x{k}" for k in range(50)])) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + f" more{i}") for i in range(0, 40, 7)]
    rows += [(2000 + i, " ".join([f"p{i % 3}q{k}" for k in range(60)] + [f"v{i}y{k}" for k in range(rng.randrange(8, 30))])) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    compared = []
    kept = near_dedup.materialize
    monkeypatch.setattr(near_dedup, "materialize", lambda d, label, *a: compared.append((label, kept(d, label, *a))) or compared[-1][1])
    got = {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(df).collect()}
    assert got == brute_components(rows)
    pairs = sum(d.filter("a < 2000 and b < 2000").count() for n, d in compared if n in ("near-pairs", "near-rest") and "a" in d.columns)
    assert pairs < 45_000 / 3


def test_near_dedup_at_the_threshold(spark):
    """Pairs of a likeness from 0.75 to 0.79: all are linked. Pairs below it aren't."""
    import random

    rng = random.Random(8)
    rows = []
    for i in range(400):
        n = rng.randrange(40, 160)
        same = [f"d{i}w{k}" for k in range(n)]
        cut = int(n * rng.uniform(0.75, 0.8)) if i % 2 else int(n * rng.uniform(0.66, 0.74))
        rows += [(2 * i, " ".join(same)), (2 * i + 1, " ".join(same[:cut]))]
    got = {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_components(rows)


def test_near_dedup_repeated_ids(spark):
    """Rows with one id are one node of the graph, but no text is lost to another one that it isn't like."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (7, b + " end"), (8, c), (8, c), (8, None), (9, ""), (9, ""), (None, c + " x"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sorted(((r["id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(df).collect()), key=str)
    assert got == sorted([(3, 39, 3, True), (5, 39, 3, False), (5, 39, 3, False), (7, 40, 3, False), (8, 39, 8, True), (8, 39, 8, True), (8, 0, 8, True), (9, 0, 9, True), (9, 0, 9, True), (None, 40, 8, False), (None, 0, None, True)], key=str)
    left = sorted(map(tuple, near_dedup.representatives(df).collect()), key=str)
    assert left == sorted([(3, a), (5, b), (8, c), (8, None), (9, ""), (9, ""), (None, None)], key=str)
    assert near_dedup.representatives(df.limit(0)).count() == 0


def test_signature_pigeonhole():
    import numpy as np

    rng = np.random.default_rng(0)
    s = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    sig = np.frombuffer(near_dedup.signature(s), np.uint16)
    for _ in range(200):
        other = sig.copy()
        other[rng.choice(near_dedup.SLOTS, near_dedup.MAX_DISTANCE, replace=False)] ^= 1
        chunks = (sig != other).reshape(near_dedup.CHUNKS, -1).sum(1)
        assert chunks.min() <= near_dedup.CHUNK_ERRORS


def test_substring_dedup(docs, rows, empty):
    got = {r["id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == brute_repeats(rows)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_anchor_parts():
    """Every window of a context is in one part, where it holds the lengthened anchor."""
    for size, to in ((12, 24), (24, 36), (36, 50)):
        for n in range(50, 89):
            for g in range(max(0, n - 50), min(n - size, 50 - size) + 1):  # windows 0 to n - 50 all hold it
                seen = []
                for s, e, new in substring_dedup.pieces(n, g, size, to):
                    assert 0 <= s and e <= n and e - s >= 50 and new + to <= n
                    seen += range(s, e - 49)
                    assert all(w <= new and new + to <= w + 50 for w in range(s, e - 49))
                assert sorted(seen) == list(range(n - 49))


@pytest.mark.parametrize("group", [4 << 20, 20_000, 3000, 1])
def test_substring_dedup_dense(spark, group):
    """Few different words, so that repeats overlap, nest and start anywhere; anchors of any size, lengthened or not."""
    import random

    rng = random.Random(group)
    pool = [" ".join(rng.choice("ab") if k % 2 else f"w{rng.randrange(9)}" for k in range(60)) for _ in range(6)]
    rows = []
    for d in range(60):
        rows.append((d, " ".join(rng.choice((rng.choice(pool), " ".join(f"u{rng.randrange(50)}" for _ in range(rng.randrange(40)))) ) for _ in range(rng.randrange(1, 5)))))
    rows += [(100, "z " * 200), (101, "z " * 70), (102, "z " * 49)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r["id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.substring_dedup(df, group_bytes=group).collect()}
    assert got == brute_repeats(rows)


def test_substring_dedup_repeated_rows(spark, monkeypatch):
    """Equal rows are worked off once: the anchors of a text that many rows repeat do not multiply."""
    made = []
    kept = substring_dedup.materialize
    monkeypatch.setattr(substring_dedup, "materialize", lambda d, label: made.append((label, kept(d, label))) or made[-1][1])
    text = " ".join(f"w{k}" for k in range(400))
    for i in (5, None):
        made.clear()
        df = spark.createDataFrame([(i, text)] * 100 + [(3, "x " + text)], "doc_id bigint, text string").repartition(5)
        got = sorted({(r["id"] or -1, r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(df).collect()})
        assert got == sorted([(i or -1, 400, 400), (3, 401, 0)])
        assert next(d for n, d in made if n == "contexts").count() <= 101 * 40


def test_null_ids(spark):
    p = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(None, p), (None, p), (5, p), (9, "q " + p)], "doc_id bigint, text string")
    got = sorted((r["id"] or -1, r["n_removed"]) for r in substring_dedup.substring_dedup(df).collect())
    assert got == [(-1, 60), (-1, 60), (5, 0), (9, 60)]
    assert {(r["id"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(df).collect()} == {(None, 5, False), (5, 5, True), (9, 5, False)}


def test_near_dedup_links_through_null_ids(spark):
    """A row without an id links others as any row does, but no component is named after it."""
    w = [f"w{k}" for k in range(100)]
    near, middle, far = w, w[:90] + [f"x{k}" for k in range(10)], w[:80] + [f"y{k}" for k in range(10)] + [f"x{k}" for k in range(10)]
    alone = [f"z{k}" for k in range(50)]
    rows = [(7, near), (None, middle), (3, far), (None, alone), (None, alone[:-1]), (8, w[50:] + alone)]
    df = spark.createDataFrame([(d, " ".join(x)) for d, x in rows], "doc_id bigint, text string")
    got = sorted(((r["id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(df).collect()), key=str)
    assert got == sorted([(7, 99, 3, False), (None, 99, 3, False), (3, 99, 3, True), (None, 49, None, True), (None, 48, None, True), (8, 99, 8, True)], key=str)
