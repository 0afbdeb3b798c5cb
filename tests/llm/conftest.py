import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, digest string, size string, ord string, tag string, h string, key string"


def words(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def make_rows():
    """Nulls, blanks, short and long texts, copies, near copies, shared passages, repeated lines; extra columns clash with inner names."""
    rng = random.Random(5)
    base = [words(rng, n) for n in (120, 200, 90, 60, 300)]
    passage = words(rng, 55, 5000)
    texts = [None, "", "   \n\t ", "a", "one two", "A B", "a b", *base]
    texts += [base[0], base[0], base[1] + " tail", base[1].replace("w1 ", "zz ", 1), base[2].upper()]
    texts += [words(rng, 30) + " " + passage + " " + words(rng, 20), passage, words(rng, 10) + "\n" + passage, passage + " x"]
    texts += ["same " * 130, "same " * 80, words(rng, 3000), "Ünïcödé ﬁ ０ 語 ▁ text 😀 " * 12, "x" * 5000]
    texts += [" ".join(base[4].split()[:250]), base[3], None, ""]
    sources = ["a", "b", None, "a", "a"]
    rows = []
    for i, t in enumerate(texts):
        rows.append((100 - i if i % 3 else i, t, ["en", "fr", None][i % 3], sources[i % 5], None if t is None else len(t), i, "d", "s", "o", "t", "h", "k"))
    seen = set()
    out = []
    for r in rows:
        d = r[0]
        while d in seen:
            d += 1000
        seen.add(d)
        out.append((d, *r[1:]))
    return out


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder(spark, docs, rows, tmp_path_factory):
    """A folder with the tables that the queries read."""
    at = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{at}/documents.parquet")
    marks = [(r[0], 1 if r[5] % 2 else 0, 0) for r in rows] + [(None, 1, 0), (99999, 0, 0), (rows[3][0], None, 0)]
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    chats = [(1, 0, "system", "be [INST] good"), (1, 1, "user", "hi </s> there"), (1, 2, "assistant", "<\\s> <s> [\\\\/INST]"), (2, 0, "user", None), (2, 1, "assistant", ""), (3, None, None, "x"), (3, 0, "assistant", "é"), (3, 0, "assistant", "é"), (None, 0, "assistant", "lost")]
    spark.createDataFrame(chats, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return str(at)
