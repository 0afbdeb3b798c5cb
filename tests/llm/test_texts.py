"""Operators on single texts: round trips, brute force, held-out accuracy."""

import hashlib
import random
import re

import numpy as np
import pytest

from lexigrid.llm import chat, fingerprint, langid, pii, quality, spm, textkit


def test_words_and_hashes():
    import pyarrow as pa

    texts = [None, "", "a b", " a  b\n", "x" * 400 + " y", "\x1c\x85 é\x0bz", "y " + "x" * 400]
    buf, off = textkit.flat(pa.array(texts).slice(0))
    starts, ends, first = textkit.words(buf, off)
    h = textkit.span_hash(buf, starts, ends)
    by = {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        own = [buf[s:e].tobytes() for s, e in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])]
        assert own == re.findall(rb"[^\x20\x09-\x0D]+", raw) == raw.split()
        for w, v in zip(own, h[first[i] : first[i + 1]]):
            assert by.setdefault(w, v) == v
    assert len(set(by.values())) == len(by)


def test_hash_does_not_depend_on_place(monkeypatch):
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 30))) for _ in range(300)).encode()
    buf = np.frombuffer(text, np.uint8)
    starts, ends, _ = textkit.words(buf, np.array([0, len(buf)]))
    want = textkit.span_hash(buf, starts, ends)
    monkeypatch.setattr(textkit, "_BLOCK", 600)
    monkeypatch.setattr(textkit, "_tables", [])
    assert (textkit.span_hash(buf, starts, ends) == want).all()


# --- language ---


def test_langid(spark, empty):
    rng = random.Random(3)
    stems = {"en": ["the", "and", "tion", "ing"], "fr": ["le", "eau", "ment", "que"], "de": ["der", "ung", "sch", "keit"]}
    word = lambda l: "".join(rng.choice(stems[l]) for _ in range(rng.randrange(1, 4)))
    rows = [(i, " ".join(word(l) for _ in range(20)), l) for i in range(300) for l in [rng.choice(list(stems))]]
    rows += [(1000, None, None), (1001, "123 !!", "en"), (1002, "", None), (1003, "zzzz", None), (1004, "", "en"), (1000, None, "fr")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(langid.sample(df.filter("doc_id % 5 != 0")))
    got = {r["id"]: r for r in langid.identify(df, model).collect()}
    assert all(got[i]["lang_pred"] == l for i, _, l in rows if i < 300)
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert all(0 <= r["score"] <= 1 for r in got.values())
    nothing = langid.fit(langid.sample(empty))
    assert {r["lang_pred"] for r in langid.identify(df, nothing).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


def brute_langid(learn, texts):
    """An independent reading of the method: plain dictionaries, one text and word at a time."""
    import math
    from collections import Counter

    langs = sorted({lang for _, lang in learn})
    words_, pieces = {x: Counter() for x in langs}, {n: {x: Counter() for x in langs} for n in langid.ORDERS}
    for text, lang in learn:
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            words_[lang][w] += 1
            for n in langid.ORDERS:
                edge = f"\x02{w}\x03" if n > 1 else w
                for i in range(len(edge) - n + 1):
                    pieces[n][lang][edge[i : i + n]] += 1

    def logs(counts):
        known = set().union(*counts.values())
        total = {x: sum(counts[x].values()) + langid.SMOOTH * len(known) for x in langs}
        return {k: [math.log((counts[x][k] + langid.SMOOTH) / total[x]) for x in langs] for k in known}

    word_logs, gram_logs = logs(words_), {n: logs(pieces[n]) for n in langid.ORDERS}
    out = []
    for text in texts:
        score = [0.0] * len(langs)
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            hits = [word_logs[w]] if w in word_logs else []
            for n in langid.ORDERS:
                edge = f"\x02{w}\x03" if n > 1 else w
                hits = hits or [gram_logs[n][edge[i : i + n]] for i in range(len(edge) - n + 1) if edge[i : i + n] in gram_logs[n]]
            if hits:
                score = [s + sum(h[k] for h in hits) / len(hits) for k, s in enumerate(score)]
        best = max(range(len(langs)), key=lambda k: (score[k], -k))
        p = 1 / sum(math.exp(max(-700, s - score[best])) for s in score)
        out.append((langs[best], p) if any(map(str.isalpha, text or "")) else ("und", 0.0))
    return out


def test_langid_query(spark, tmp_path):
    """The registered query against the method done by hand: folds, languages and scores, also of null ids, very long and empty texts."""
    import zlib

    rng = random.Random(13)
    stems = {"en": ["the", "and", "tion", "ing", "Of"], "fr": ["le", "eau", "ment", "que", "é"], "de": ["der", "ung", "sch", "keit", "ß"]}
    text = lambda l, n: " ".join("".join(rng.choice(stems[l] if rng.random() < 0.8 else stems["en"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))
    rows = [(i, text(l, rng.randrange(1, 40)), l if rng.random() < 0.8 else None) for i in range(300) for l in [rng.choice(list(stems))]]
    rows += [(400, text("de", 30_000), "de"), (401, None, "en"), (402, "", "fr"), (403, "12 !?", "en"), (404, "qqqq", None), (None, text("fr", 9), "fr"), (None, "the and", "en"), (405, rows[0][1], rows[0][2]), (5, rows[5][1], rows[5][2]), (406, "語 語", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 0
    want = brute_langid([(t, l) for d, t, l in rows if l is not None and not held(d)], [t for _, t, _ in rows])
    got = langid.op1_langid(spark, str(tmp_path)).collect()
    key = lambda r: (str(r[0]), r[1], r[2], r[3])
    got = sorted(((r["doc_id"], r["held_out"], r["lang_pred"], r["score"]) for r in got), key=key)
    want = sorted(((d, held(d), l, p) for (d, _, _), (l, p) in zip(rows, want)), key=key)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-6)
    assert sum(g[2] != "und" for g in got) > 300


def test_backoff_order():
    model = {"langs": ["a", "b"], "entries": {0: {"word": 0}, 3: {"wor": 1}, 1: {"w": 2, "z": 3}}, "table": np.array([[0, -1], [-1, 0], [-2, -3], [-5, -4.0]])}
    look = langid.Lookup(model)
    assert look.rows[look["word"]].tolist() == [0, -1]
    assert look.rows[look["words"]].tolist() == [-1, 0]
    assert look.rows[look["wz"]].tolist() == [-3.5, -3.5]
    assert look.rows[look["qq"]].tolist() == [0, 0]


# --- fingerprints ---


def shingle_set(t):
    return {t[i : i + fingerprint.WIDTH] for i in range(max(1, len(t) - fingerprint.WIDTH + 1))} if t else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprint_query(spark, docs, rows, empty):
    order = sorted(rows, key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in fingerprint.compare_neighbours(docs).collect()}
    assert len(got) == len(rows)
    for i, (d, t, *_) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        m = len(t) // 2
        e = t[: len(t) - m] + nxt[:m]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["fingerprint"] == fingerprint.pack(fingerprint.bottom(fingerprint.shingles(t)))
        assert r["edited_fingerprint"] == fingerprint.pack(fingerprint.bottom(fingerprint.shingles(e)))
        assert r["near_edited"] == pytest.approx(jaccard(shingle_set(t), shingle_set(e)), abs=0.2)
        assert r["near_next"] == pytest.approx(jaccard(shingle_set(t), shingle_set(nxt)), abs=0.2)
    assert fingerprint.compare_neighbours(empty).count() == 0
    one = spark.createDataFrame([(1, "abcdefghijkl")], "doc_id bigint, text string")
    assert fingerprint.compare_neighbours(one).first()["edited_sha256"] == hashlib.sha256(b"abcdefabcdef").hexdigest()
    ties = spark.createDataFrame([(None, "n"), (3, "c"), (3, "c"), (3, "b")], "doc_id bigint, text string")
    assert fingerprint.compare_neighbours(ties).count() == 4


@pytest.mark.parametrize("rows_each", [20_000, 7])
def test_fingerprint_query_ties_and_hot_ids(spark, folder, rows_each):
    """An id of a third of all rows, and rows without one, are cut by the hash of their text, which orders them."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    text = lambda: "".join(rng.choice("abc é") for _ in range(rng.randrange(30)))
    rows = [(rng.choice([50] * 5 + [None] * 4 + list(range(100))), text()) for _ in range(200)] + [(50, "same text")] * 3 + [(None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    order = df.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select("doc_id", "t", F.xxhash64("t").alias("tie")).collect()
    order = sorted(order, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["tie"], r["t"]))
    want = []
    for r, nxt in zip(order, order[1:] + order[:1]):
        t, m = r["t"], len(r["t"]) // 2
        x, y = (fingerprint.bottom(fingerprint.shingles(v)) for v in (t, nxt["t"]))
        e = t[: len(t) - m] + nxt["t"][:m]
        want.append((r["doc_id"], len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint.pack(x), fingerprint.resemblance(x, y)))
    placed = fingerprint.with_next(df, rows_each=rows_each)
    if rows_each == 7:
        assert max(r["count"] for r in placed.groupBy("range").count().collect()) < 35
    got = fingerprint.compare_neighbours(df, rows_each=rows_each).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["near_next"]) for r in got), key=str) == sorted(want, key=str)
    # the registered query, by the same rule
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy(F.desc("doc_id")).collect()
    query = {r["doc_id"]: r for r in fingerprint.op2_fingerprint(spark, folder).collect()}
    for r, nxt in zip(docs, docs[1:] + docs[:1]):
        t, u = r["text"] or "", nxt["text"] or ""
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        q = query[r["doc_id"]]
        assert q["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and q["n_chars"] == len(t)
        x, y = (fingerprint.bottom(fingerprint.shingles(v)) for v in (t, e))
        assert (q["fingerprint"], q["edited_fingerprint"], q["near_edited"]) == (fingerprint.pack(x), fingerprint.pack(y), fingerprint.resemblance(x, y))


def test_sketches_merge_across_rows(spark, docs, rows, empty):
    """A group's merged sketch is that of all its shingles together; pairs get their estimates."""
    sketches = fingerprint.sketch(docs).join(docs.select("doc_id", "lang"), fingerprint.F.col("id") == docs["doc_id"])
    got = {r["lang"]: r for r in fingerprint.merge_sketches(sketches, "lang").collect()}
    assert set(got) == {"en", "fr", None}
    for lang, r in got.items():
        own = [fingerprint.shingles(x[1] or "") for x in rows if x[2] == lang]
        want = fingerprint.bottom(np.concatenate(own))
        assert r["fingerprint"] == fingerprint.pack(want) and r["distinct"] == fingerprint.distinct(want)
    assert fingerprint.merge_sketches(fingerprint.sketch(empty), "id").count() == 0
    s = [fingerprint.pack(fingerprint.bottom(fingerprint.shingles(t))) for t in ("abcdefghijklmnop", "abcdefghijklmnopqrstuvwx", "")]
    pairs = spark.createDataFrame([(1, s[0], s[1]), (2, s[2], s[2]), (3, None, s[0]), (4, s[0], s[2])], "n int, x string, y string")
    got = {r["n"]: r for r in fingerprint.likeness(pairs, "x", "y").collect()}
    assert got[1]["a_in_b"] == 1 and got[1]["resemblance"] == pytest.approx(9 / 17) and got[1]["b_in_a"] == pytest.approx(9 / 17)
    assert (got[1]["distinct_a"], got[1]["distinct_b"]) == (9, 17)
    assert got[2]["resemblance"] == 1 and got[4]["resemblance"] == 0 and got[3]["resemblance"] is None
    assert fingerprint.likeness(pairs.limit(0), "x", "y").count() == 0


def test_sketch_algebra():
    rng = random.Random(4)
    a = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    b = a[3000:] + "".join(rng.choice("abcdefgh ") for _ in range(3000))
    sa, sb = (fingerprint.bottom(fingerprint.shingles(x)) for x in (a, b))
    parts = [fingerprint.bottom(h) for h in np.array_split(fingerprint.shingles(a), 5)]
    whole = parts[0]
    for p in parts[1:]:
        whole = fingerprint.merge(whole, p)
    assert (whole == sa).all() and (fingerprint.unpack(fingerprint.pack(sa)) == sa).all()
    assert fingerprint.resemblance(sa, sb) == pytest.approx(jaccard(shingle_set(a), shingle_set(b)), abs=0.15)
    assert fingerprint.containment(sa, sb) == pytest.approx(0.5, abs=0.2)
    assert fingerprint.distinct(sa) == pytest.approx(len(shingle_set(a)), rel=0.3)


# --- quality ---


def test_quality(spark, docs, empty, folder):
    got = quality.op7_quality(spark, folder).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    rng = random.Random(6)
    rows = []
    for i in range(400):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(5, 120))]
        good = rng.random() < 0.7
        rows.append((i, " ".join(w).capitalize() + "." if good else " ".join(x.upper() + "!!" for x in w), int(good)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    r = {x["id"]: x for x in quality.classify(df, df).collect()}
    held = [(x[2], r[x[0]]["predicted"]) for x in rows if r[x[0]]["held_out"]]
    assert len(held) > 40 and np.mean([a == b for a, b in held]) > 0.95
    assert {x["score"] for x in quality.classify(df, df.limit(0)).collect()} == {0.5}
    assert {x["score"] for x in quality.classify(df, df.filter("quality = 1")).collect()} == {1.0}
    assert quality.classify(empty, df).count() == 0


def test_quality_query_by_hand(spark, tmp_path):
    """The registered query against the fit done in numpy: folds, shrunk covariances, prior, scores; null and repeated ids and labels."""
    import zlib

    rng = random.Random(15)
    rows, marks = [], []
    for i in range(160):
        good = rng.random() < 0.6
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(3, 60))]
        rows.append((i, " ".join(w) + ("." if good else " " + "!! $$ BUY " * rng.randrange(1, 9))))
        marks.append((i, int(good)))
    rows += [(None, "no id here"), (500, None), (501, ""), (502, "word " * 40_000), (7, "another text of id seven, not equal to the first one.")]
    marks += [(3, 1), (3, 0), (None, 1), (501, None), (999, 1), (500, 0), (9, 5)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*m, 0) for m in marks], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 4 == 2
    import pyarrow as pa

    x = quality.statistics(*textkit.flat(pa.array([t for _, t in rows], pa.string())))
    by = {0: [], 1: []}
    for d, y in marks:
        if d is not None and y in (0, 1) and not held(d):
            by[y] += [x[k] for k, r in enumerate(rows) if r[0] == d]
    n = {c: len(v) for c, v in by.items()}
    mean = {c: np.mean(v, 0) for c, v in by.items()}
    cov = {c: np.cov(np.array(v).T, bias=True) for c, v in by.items()}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    d = len(quality.NAMES)
    log = []
    for c in (0, 1):
        a = quality.SHRINK + (1 - quality.SHRINK) * d / (n[c] + d)
        full = ((1 - a) * cov[c] + a * pooled) / np.outer(scale, scale) + quality.RIDGE * np.eye(d)
        z = (x - mean[c]) / scale
        log.append(-0.5 * ((z @ np.linalg.inv(full) * z).sum(1) + np.linalg.slogdet(full)[1]))
    want = 1 / (1 + np.exp(-np.clip(log[1] - log[0] + np.log(n[1] / n[0]), -500, 500)))
    got = sorted(map(tuple, quality.op7_quality(spark, str(tmp_path)).select("doc_id", "held_out", "predicted", "score").collect()), key=lambda r: (str(r[0]), r[3]))
    plain = sorted(((r[0], held(r[0]), int(s >= 0.7), s) for r, s in zip(rows, want)), key=lambda r: (str(r[0]), r[3]))
    assert [g[:3] for g in got] == [p[:3] for p in plain] and len({g[1] for g in got}) == 2
    assert [g[3] for g in got] == pytest.approx([p[3] for p in plain], abs=5e-3)


def test_quality_density():
    """Scores are those of two normal densities."""
    rng = np.random.default_rng(0)
    d = len(quality.NAMES)
    mean = rng.normal(size=(2, d))
    cov = [np.cov(rng.normal(size=(d, 60))) + np.eye(d) for _ in range(2)]
    scale = rng.uniform(0.5, 2, d)
    chol = [np.linalg.cholesky(c) for c in cov]
    model = {"scale": scale, "prior": 0.3, "mean": mean, "inverse": [np.linalg.inv(c) for c in chol], "logdet": [np.linalg.slogdet(c)[1] for c in cov]}
    x = rng.normal(size=(5, d))
    want = []
    for row in x:
        log = [-0.5 * (((row - mean[c]) / scale) @ np.linalg.solve(cov[c], (row - mean[c]) / scale) + np.linalg.slogdet(cov[c])[1]) for c in (0, 1)]
        want.append(1 / (1 + np.exp(-(log[1] - log[0] + 0.3))))
    assert quality.score(x, model) == pytest.approx(want, abs=1e-6)


# --- personal data ---


def naive_base(text):
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return [(s, e, pii.KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


def test_base_patterns_against_plain_regexes():
    rng = random.Random(8)
    bits = ["a@b.c", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-1234", "+", " ", "-", "é", "x.y@", "b.co", "12", "0001.2.3.4.5.6.7.8", "(", ")", "\n", "+4 9"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert pii.base_spans(t) == naive_base(t), t
    assert len(pii.base_spans("a" * 200_000 + "@x " + "1" * 200_000)) == 0


def test_pii_shape_of_long_tokens():
    """A token of over 255 bytes has the shape that its bytes give, wherever it stands."""
    rng = random.Random(12)
    chars = [c for group in pii._FIELDS for chars in group.values() for c in chars]
    words = [bytes(rng.choices(chars, k=n)) for n in (1, 3, 255, 256, 257, 300, 5000, 9)] + [b"a" * 256, b"1" * 512, b"@" + b"a" * 300 + b".", b"+" * 255]
    buf = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = textkit.words(buf, np.array([0, len(buf)]))
    code, shift = pii.shapes(buf, starts, ends), 0
    assert len(code) == len(words)
    for group in pii._FIELDS:
        for name, chars in group.items():
            level = (code >> shift) & ((1 << pii._WIDTHS[name]) - 1)
            n = [sum(c in chars for c in w) for w in words]
            assert level.tolist() == np.searchsorted(pii._BINS[name], n, "right").tolist(), name
            shift += pii._WIDTHS[name]


def test_pii_query(spark, folder, docs, empty):
    texts = ["write to joan.smith@mail.example.com, or call +1 (555) 555-1234.", "address 10.20.30.40 and card 4111 1111 1111 1111!", "reach lena [at] kontor [dot] com today", "dial (555) 123-4567 now", None, "", "plain words only, 42 of them in 1999", "é 4111111111111111"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, spans string")
    got = {r["id"]: r for r in pii.find(df).collect()}
    for i, t in enumerate(texts):
        base = [tuple(s) for s in got[i]["base"]]
        assert base == naive_base(t or "")
        assert set(base) <= {tuple(s) for s in got[i]["spans"]}
    added = [(texts[i][s["start"] : s["end"]], s["kind"]) for i in (2, 3) for s in got[i]["spans"]]
    assert added == [("lena [at] kontor [dot] com", "email"), ("(555) 123-4567", "phone")]
    assert not got[6]["spans"]
    red = {r["id"]: r["text"] for r in pii.redact(df).collect()}
    assert red[0] == "write to [email], or call [phone]." and red[4] is None and red[6] == texts[6]
    query = {r["doc_id"]: r for r in pii.op8_pii(spark, folder).collect()}
    assert len(query) == docs.count()
    for d, t in docs.select("doc_id", "text").collect():
        found = naive_base(t or "")
        assert [query[d][f"n_{k}"] for k in pii.BASE] == [sum(x[2] == k for x in found) for k in pii.BASE]
        assert query[d]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in found).encode()).hexdigest()
    assert pii.find(empty).count() == 0


def test_pii_spans_by_hand(spark):
    """All spans against a slow reading: labels to runs to checks to those that overlap no pattern; long texts take linear time."""
    import time

    model = pii.train()
    rng = random.Random(14)
    bits = ["joan@mail.org", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 555-1234", "(555) 123-4567", "555-123-4567", "lena [at] kontor [dot] com", "ssn 123-45-6789", "é", "words", "12", "at", "call", "999.1.1.1", "x" * 300]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(200)]
    got = [r["spans"] for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("id").collect()]
    for text, spans in zip(texts, got):
        tokens = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        raw = np.frombuffer(text.encode(), np.uint8)
        s, e, f = textkit.words(raw, np.array([0, len(raw)]))
        labels = pii.field_labels(raw, s, e, f, model)
        base, extra, i = naive_base(text), [], 0
        while i < len(tokens):
            j = i
            while labels[i] and j + 1 < len(tokens) and labels[j + 1] == labels[i]:
                j += 1
            if labels[i]:
                a, b = tokens[i][0], tokens[j][1]
                n = [len(text[:k].encode()) for k in (a, b)]
                extra += [(a + x, a + y, k) for x, y, k in pii.field_spans(text[a:b], [(0, n[1] - n[0], int(labels[i]))])]
            i = j + 1
        want = base + [x for x in extra if not any(x[0] < e and s < x[1] for s, e, _ in base)]
        assert [tuple(x) for x in spans] == sorted(want, key=lambda x: (x[0], pii.KINDS.index(x[2])))
    assert sum(len(s) for s in got) > 500
    long = "é (555) 123-4567 or 10.20.30.40 " * 30_000
    took = time.perf_counter()
    n = pii.find(spark.createDataFrame([(1, long)], "doc_id bigint, text string")).first()
    assert time.perf_counter() - took < 60 and len(n["base"]) == 30_000 and len(n["spans"]) == 60_000


def test_viterbi_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(1)
    k = 3
    trans = rng.normal(size=(k, k))
    size = np.array([1, 2, 4])
    e = rng.normal(size=(3, 4, k))
    left, right = np.array([True, False, True]), np.array([False, True, True])
    got = pii.viterbi(e, size, trans, left, right)
    for i, n in enumerate(size):
        best = max(product(range(k), repeat=int(n)), key=lambda p: sum(e[i, t, y] for t, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:])) + left[i] * trans[0, p[0]] + right[i] * trans[p[-1], 0])
        assert tuple(got[i, :n]) == best


def test_field_accuracy():
    """Token labels on sentences of another seed than the training ones."""
    model = pii.train()
    table = pii.labelled(300, seed=99)
    right = total = hit = real = 0
    for tokens, labels in table:
        buf = np.frombuffer(" ".join(tokens).encode(), np.uint8)
        s, e, f = textkit.words(buf, np.array([0, len(buf)]))
        got = [pii.LABELS[x] for x in pii.field_labels(buf, s, e, f, model)]
        right += sum(a == b for a, b in zip(got, labels))
        total += len(labels)
        hit += sum(a == b != "O" for a, b in zip(got, labels))
        real += sum(b != "O" for b in labels)
    assert right / total > 0.99 and hit / real > 0.99


# --- chat ---


def test_guard_round_trip():
    rng = random.Random(9)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "INST]", "a", "é", "\n"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(9)))
        g = chat.guard(t)
        assert chat.unguard(g) == t
        assert not re.search(r"</?s>|\[/?INST\]", g)


def test_chat_query(spark, folder):
    import duckdb

    got = sorted(map(tuple, chat.op9_chat(spark, folder).collect()), key=str)
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{folder}/conversations.parquet/*.parquet'")
    assert got == sorted(con.sql(chat.OP9_SQL).fetchall(), key=str)
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    for r in chat.format_chats(turns).collect():
        read = [(chat.unguard(a), chat.unguard(b)) for a, b in chat.TURN.findall(r["formatted"])]
        want = [(t["role"] or "", t["text"] or "") for t in sorted(turns.filter(turns.conv_id.eqNullSafe(r["conv_id"])).collect(), key=lambda t: (-1 if t["turn"] is None else t["turn"], t["role"] or "", t["text"] or ""))]
        assert read == want
        assert [chat.unguard(r["formatted"][s:e]) for s, e in zip(r["loss_starts"], r["loss_ends"])] == [t for a, t in want if a == "assistant"]
    assert chat.digest_chats(turns.limit(0)).count() == 0


def test_chat_rows_without_an_id(spark):
    """All rows without conv_id are one conversation, however many; repeated rows are turns of their own; it ends where it should."""
    rows = [(None, i, "assistant" if i % 2 else "user", f"t{i} [INST]") for i in range(400)] + [(None, 5, "assistant", "t5 [INST]"), (4, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(6)
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert set(got) == {None, 4}
    turns = [(chat.unguard(a), chat.unguard(b)) for a, b in chat.TURN.findall(got[None]["formatted"])]
    assert len(turns) == 401 and turns.count(("assistant", "t5 [INST]")) == 2 and turns[-1] == ("assistant", "t399 [INST]")
    assert len(got[None]["loss_starts"]) == 201 and len(got[4]["loss_starts"]) == 0


def test_templates():
    t = chat.Template("{% set n = 'x' + 'y' %}{% for m in messages %}{% if loop.first %}[{% elif m.role == 'a' and not loop.last %}a{% else %}-{% endif %}{{ m['text'] | upper | trim }}{{ loop.index }}{% if loop.last %}{{ n }}{% endif %}{% endfor %}")
    assert t.render([{"role": "a", "text": " p "}, {"role": "a", "text": "q"}, {"role": "b", "text": "r"}]).text == "[P1aQ2-R3xy"
    assert chat.fold(chat.parse("{{ 'a' + 'b' }}c{% if 1 == 2 %}no{% else %}{{ 'd' | upper }}{% endif %}")) == [("text", "abcD")]
    assert chat.Template("{{ x.__class__ }}{{ x.y.z }}").render([], x={"y": "s"}).text == ""
    for bad in ("{{ f() }}", "{% for x %}", "{% if 1 %}", "{{ 1 | nosuch }}", "{% endif %}", "{{ }}"):
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)


# --- tokeniser ---


def test_langid_keeps_a_small_language(spark):
    """Each language has its own words and n-grams of each length, however large another one is."""
    big = [(" ".join(f"{a}{b}{c}" for a in "abcdefgh" for b in "aeiou" for c in "klmnp") + " ", "xx")] * 20
    model = langid.fit(spark.createDataFrame([*big, ("zorvut zorvut qwyv", "yy"), (None, "xx")], "text string, lang string"), 50, 50)
    assert model["langs"] == ["xx", "yy"]
    assert {"zorvut", "qwyv"} <= set(model["entries"][0]) and len(model["entries"][0]) == 52
    assert "zorvu" in model["entries"][5] and all(50 <= len(model["entries"][n]) <= 100 for n in (2, 3, 4, 5))
    assert langid.predict(["zorvut", "zorvuten"], model, langid.Lookup(model))[0] == ["yy", "yy"]


def test_spm_parity(spark, docs, rows, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    t = spm.load()
    rng = random.Random(10)
    bits = ["a", " ", "  ", "the", "é", "\n", "語", "▁", "<s>", "</s>", "<0x41>", "ing", ".", "😀", "0", "\t", "token"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(20))) for _ in range(3000)] + [" " * n + "x" for n in range(40)] + ["x" + " " * n + "y" for n in range(40)]
    assert [e.ids for e in t.encode_batch(texts, add_special_tokens=False)] == sp.encode(texts)
    e = spm.Encoder()
    assert e.by_units and e.plain
    for e in (e, spm.Encoder(by_units=False)):  # text by text, too
        ids, off, same = e.batch(texts)
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == sp.encode(texts) and all(same)
    got = {r["id"]: r for r in spm.encode(docs).collect()}
    assert len(got) == len(rows)
    for d, x, *_ in rows:
        assert got[d]["ids"] == sp.encode(x or "") and got[d]["parity"] and got[d]["decoded_same"]
    back = {r["id"]: r["text"] for r in spm.decode(spm.encode(docs, verify=False)).collect()}
    assert all(back[d] == (x or "").replace("▁", " ") for d, x, *_ in rows)
    assert spm.encode(empty).count() == 0


def test_spm_query(spark, docs, folder, rows, tmp_path):
    """The registered query: the library's ids, text by text; repeated rows stay; a wrong id or length shows in the parity column."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    got = {r["doc_id"]: r for r in spm.op4_sentencepiece(spark, folder).collect()}
    assert len(got) == len(rows)
    for d, t, *_ in rows:
        ids = sp.encode(t or "")
        assert (got[d]["ids"], got[d]["n_tokens"], got[d]["n_chars"], got[d]["parity"]) == (ids, len(ids), len(t or ""), True)
        assert got[d]["decoded_same"] == (sp.decode(ids) == (t or "").replace("▁", " "))
    spark.createDataFrame([(1, "a b")] * 3 + [(None, "a b"), (2, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    again = spm.op4_sentencepiece(spark, str(tmp_path)).collect()
    assert sorted(map(len, (r["ids"] for r in again))) == [0, 2, 2, 2, 2] and all(r["parity"] for r in again)
    ids, off = np.array([5, 6, 7], np.int32), np.array([0, 2, 2, 3])
    assert spm.same_ids([[5, 6], [], [7]], ids, off) == [True, True, True]
    assert spm.same_ids([[5, 9], [], [7]], ids, off) == [False, True, True]
    assert spm.same_ids([[5], [6], [7]], ids, off) == [False, False, True]


def test_spm_words_of_nul():
    """A word may start with U+0000, or be nothing else; markers and such words in all orders keep their ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    rng = random.Random(11)
    bits = ["\0", "\0", " ", "  ", "a", "▁", "b", "\1", "é"]
    texts = ["a \0b", " \0b", " \0 ", "\0", "\0\0", "\0b", "a b", "b", "  \0b", "\0▁b", "▁\0"] + ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(3000)]
    e = spm.Encoder()
    for body in (texts, texts[::-1]):
        ids, off, same = e.batch(body)
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == sp.encode(body) and all(same)
    assert spm.Encoder().batch(["a \0b"])[0].tolist() == [264, 28705, 3, 28726]


def test_spm_tasks_share_a_tokenizer(monkeypatch):
    """Encoders of one worker build one tokenizer, as a used one is never given back whole; what one task met is not kept for the next."""
    built, build = [], spm.build
    monkeypatch.setattr(spm, "build", lambda model: built.append(1) or build(model))
    first = spm.Encoder()
    ids = first.batch(["the cat  sat", ""])[0].tolist()
    second = spm.Encoder()
    assert len(built) <= 1 and not second.index and second.used == 0
    assert second.batch(["", "the cat  sat"])[0].tolist() == ids == first.batch(["the cat  sat"])[0].tolist()
    assert spm.Encoder(by_units=False).batch(["the cat  sat"])[0].tolist() == ids


def test_spm_copies_are_encoded_once():
    """Of equal texts in a slice each library gets one, and all have its ids, mark of decoding and parity."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)

    class Other:
        def __init__(self):
            self.seen = []

        def encode(self, body, **how):
            self.seen += body
            return [x[:-1] if t == "one wrong" else x for t, x in zip(body, sp.encode(body, **how))]

    body = ["a b", "a b", "", "one wrong", "c d e", "a b", "one wrong", ""]
    for t in (spm.Encoder(), spm.Encoder(by_units=False)):
        other = Other()
        lists, same, parity = spm.encoded(t, other, body)
        assert other.seen == ["a b", "", "one wrong", "c d e"]
        assert lists.to_pylist() == sp.encode(body) and same == [True] * 8
        assert parity == [x != "one wrong" for x in body]
        lists, same, parity = spm.encoded(t, None, body)
        assert lists.to_pylist() == sp.encode(body) and parity == [None] * 8
        assert spm.encoded(t, other, [])[0].to_pylist() == []


def test_spm_unigram_model():
    """A hand-made unigram model: same ids as the sentencepiece library."""
    import struct

    import sentencepiece

    def field(n, v):
        if isinstance(v, int):
            return bytes([n * 8 % 128 | 128, n * 8 // 128, v]) if n > 15 else bytes([n << 3, v])
        return bytes([n << 3 | 2, len(v)]) + v

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.0, 1), ("▁a", -2.5, 1), ("ab", -3.5, 1), ("▁ab", -4.0, 1)]
    raw = b"".join(field(1, field(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", s) + field(3, k)) for p, s, k in pieces)
    raw += field(2, field(3, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))
    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    t = spm.build(spm.parse_model(raw))
    for x in ("ab", "a b", "abab", "b a ab", "  a"):
        assert t.encode(x, add_special_tokens=False).ids == sp.encode(x), x
