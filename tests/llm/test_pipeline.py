"""The pipeline against its stages done by hand, and the registered queries against their SQL."""

import re

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from lexigrid.llm import catalog, quality
from tests.llm.test_sets import brute_components

W = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, docs, folder, rows):
    read = spark.read.parquet(f"{folder}/documents.parquet")
    columns = list(corpus_pipeline.COLUMNS)
    good = {r["id"] for r in quality.classify(read, spark.read.parquet(f"{folder}/labels.parquet")).filter("predicted = 1").collect()}
    one = corpus_pipeline.keep_quality(spark, read, folder)
    assert one.columns == columns and {r["doc_id"] for r in one.collect()} == good
    # the rest on all rows, so that there are copies
    two = corpus_pipeline.drop_copies(spark, read, folder)
    last = {}
    for d, t, *_ in rows:
        last[t or ""] = max(last.get(t or "", -1), d)
    assert two.columns == columns and {r["doc_id"] for r in two.collect()} == set(last.values())
    three = corpus_pipeline.drop_near_copies(spark, two, folder)
    left = [r for r in rows if r[0] in set(last.values())]
    kept = {d for d, (_, _, k) in brute_components(left).items() if k}
    assert three.columns == columns and {r["doc_id"] for r in three.collect()} == kept
    four = corpus_pipeline.mix_sources(spark, three, folder)
    total = sum(len(W.findall(r["text"] or "")) for r in three.collect())
    by = {}
    for r in four.collect():
        n = len(W.findall(r["text"]))
        by[r["doc_id"]] = by.get(r["doc_id"], 0) + n
        source = next(x[1] for x in rows if x[0] == r["doc_id"])
        assert source.startswith(r["text"]) and r["n_chars"] == len(r["text"])
    assert four.columns == columns and abs(sum(by.values()) - 1.5 * total) <= 3
    assert all(n <= 2 * len(W.findall(next(x[1] for x in rows if x[0] == d))) for d, n in by.items())
    five = corpus_pipeline.tokenize(spark, four, folder).collect()
    assert len(five) == four.count() and all(r["decoded_same"] and r["n_tokens"] == len(r["ids"]) for r in five)


def test_stages_lose_no_text(spark, folder):
    """Rows with null or repeated ids are judged by their texts; equal rows are one where copies go; empty tables give empty ones."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(5, a), (9, a), (5, b), (7, c), (7, c), (None, c), (None, b + " end"), (None, "alone here"), (3, None), (3, ""), (5, "other")]
    df = spark.createDataFrame([(d, t, "en", ["x", None][i % 2], None) for i, (d, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    pairs = lambda d: sorted(((r["doc_id"], r["text"]) for r in d.collect()), key=str)
    one = corpus_pipeline.drop_copies(spark, df, folder)
    got = pairs(one)
    assert len(got) == 7 and {t or "" for _, t in got} == {t or "" for _, t in rows}
    assert {(9, a), (5, b), (7, c), (None, b + " end"), (None, "alone here"), (5, "other")} <= set(got)
    two = corpus_pipeline.drop_near_copies(spark, one, folder)
    assert pairs(two) == [x for x in got if x != (None, b + " end")]
    again = pairs(corpus_pipeline.drop_near_copies(spark, df, folder))
    assert sorted(t for _, t in again if t and t[0] in "abc" and len(t) > 20) == [a, b, c]
    marks = spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.learn(quality.features(df), marks)
    scores = [(r["id"], r["score"]) for r in quality.apply(quality.features(df), model).collect()]
    assert sorted(d or -1 for d, s in scores if s >= 0.7) == sorted(r["doc_id"] or -1 for r in corpus_pipeline.keep_quality(spark, df, folder).collect())
    mixed = corpus_pipeline.mix_sources(spark, two, folder)
    count = lambda d: sum(len(W.findall(r["text"] or "")) for r in d.collect())
    assert abs(count(mixed) - 1.5 * count(two)) <= 2
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), folder).count() == 0


def test_mixing_cuts_agree(spark, docs):
    """The cuts of the sources give what the mix takes of each document."""
    from lexigrid.llm import mixing

    slim = mixing.sizes(docs)
    found = {r["source"]: r for r in mixing.cuts(slim).collect()}
    taken = {r["id"]: r["taken"] for r in mixing.mix(slim).collect()}
    assert len(found) == 3 and any(r["cut_key"] is not None for r in found.values())
    for r in slim.collect():
        c = found[r["source"]]
        at = c["cut_key"] is not None and ((r["key"], r["id"]) > (c["cut_key"], c["cut_id"])) - ((r["key"], r["id"]) < (c["cut_key"], c["cut_id"]))
        more = 0 if c["cut_key"] is None or at > 0 else c["rest"] if at == 0 else r["size"]
        assert taken[r["id"]] == c["epochs"] * r["size"] + more


def test_run_and_contract(spark, folder):
    import importlib.util

    assert [n for n, _ in corpus_pipeline.STAGES] and 4 <= len(corpus_pipeline.STAGES) <= 5
    got = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))
    q = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in q if k.startswith("op")} and "pipeline" in q
    assert importlib.util.find_spec("corpus_pipeline")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracles(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, folder)
    rel = con.sql(catalog.ORACLES[name])
    order = sorted(df.columns)
    assert order == sorted(rel.columns)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=str)
    at = [rel.columns.index(c) for c in order]
    assert got == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)
