"""Sources: how rows of many shapes become documents."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrid.functions.tokenize import word_tokens
from lexigrid.operators.index import running_sum
from lexigrid.storage import materialize

BLANK_LINES = r"\n[ \t\r\f\x0B]*\n\s*"


def parquet(spark: SparkSession, path: str, key: str | None = None, ids: Sequence | None = None) -> DataFrame:
    """A lazy Parquet scan, restricted to ids if given; the filter reaches the files."""
    df = spark.read.parquet(path)
    return df.filter(F.col(key).isin(list(ids))) if key and ids is not None else df


def paragraphs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, para_no, text): a paragraph starts at a non-blank line after a blank one; numbered from 0, none is blank."""
    parts = F.filter(F.split(F.regexp_replace(F.col(text_col), r"^\s+|\s+$", ""), BLANK_LINES), lambda p: F.trim(p) != "")
    return df.select(F.col(id_col), F.posexplode(parts).alias("para_no", "text")).withColumn("para_no", F.col("para_no").cast("long"))


def text_file(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(file, para_no, text) of text files by paragraph. A file is one row until it is split, so it must be below 2 GB; larger
    ones are read as lines and go through paragraphs_of_lines()."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.decode("content", encoding).alias("body"))
    return paragraphs(raw.withColumn("body", F.regexp_replace("body", "\r\n", "\n")), "file", "body")


def paragraphs_of_lines(lines: DataFrame, file: str = "file", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """The same from numbered lines, by gaps and islands: (file, para_no, text)."""
    w = Window.partitionBy(file).orderBy(line_no)
    blank = F.trim(F.regexp_replace(F.col(line), r"\s", "")) == ""
    marked = lines.withColumn("_blank", blank).withColumn("_start", (~F.col("_blank")) & F.coalesce(F.lag("_blank").over(w), F.lit(True)))
    marked = marked.withColumn("para_no", F.sum(F.col("_start").cast("long")).over(w) - 1).filter(~F.col("_blank"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(line_no, line))), lambda s: s[line]), "\n")
    return marked.groupBy(file, "para_no").agg(joined.alias("text"))


def unpivot(df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """(doc_id, field, value): entity, attribute, value; nulls count as empty."""
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns])
    return df.select(F.col(id_col).alias("doc_id"), F.explode(rows).alias("r")).select("doc_id", "r.field", "r.value")


def regroup(eav: DataFrame, order: str | None = None) -> DataFrame:
    """(doc_id, field, values): an attribute's values in order."""
    item = F.struct(F.col(order or "value").alias("_o"), F.col("value"))
    return eav.groupBy("doc_id", "field").agg(F.transform(F.sort_array(F.collect_list(item)), lambda s: s["value"]).alias("values"))


def dense_ids(df: DataFrame, key: str, name: str = "doc_id") -> DataFrame:
    """Consecutive ids from 0 in key order, by range totals and offsets. Keys may be of any ordered type; rows equal in key get
    different ids, in any order."""
    if isinstance(df.schema[key].dataType, T.NumericType):
        unique = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").limit(1).count() == 0
        if unique:
            return running_sum(df.withColumn("_one", F.lit(1)), key, "_one", name).withColumn(name, F.col(name) - 1).drop("_one")
    cut = materialize(df.repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "dense-ids")
    before = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")  # one row a range
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return cut.withColumn("_in", inner).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_in") - 1).drop("_part", "_in", "_before")


def eav_documents(eav: DataFrame, text: Sequence[str], sets: Sequence[str], order: str | None = None) -> DataFrame:
    """One row a doc_id of (doc_id, field, value): text fields as sequences, the tokens of all their values in order; the others as sets of
    the values that aren't null. A document without a field has an empty array."""
    item = lambda f: F.when((F.col("field") == f) & F.col("value").isNotNull(), F.struct(F.col(order or "value").alias("_o"), F.col("value").alias("value")))
    listed = lambda f: F.transform(F.sort_array(F.collect_list(item(f))), lambda s: s["value"])
    got = eav.groupBy("doc_id").agg(*[F.flatten(F.transform(listed(f), word_tokens)).alias(f) for f in text], *[F.array_sort(F.array_distinct(listed(f))).alias(f) for f in sets])
    return got


def excel(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """A sheet as strings, its first row as header. Needs openpyxl, which is optional. The format ends at 1,048,576 rows, which is what
    the driver holds."""
    try:
        from openpyxl import load_workbook
    except ImportError as e:
        raise ImportError("reading Excel files needs openpyxl") from e
    rows = list(load_workbook(path, read_only=True)[sheet].iter_rows(values_only=True))
    names = header(rows[0])
    return spark.createDataFrame([tuple(None if v is None else str(v) for v in r[: len(names)]) for r in rows[1:]], ", ".join(f"`{n}` string" for n in names))


def header(row: Sequence) -> list[str]:
    """The strings at the start of a row, up to the first cell that is none."""
    out = []
    for cell in row:
        if not isinstance(cell, str):
            break
        out.append(cell)
    return out


def join_candidates(tables: dict[str, Sequence[str]]) -> dict[str, dict[str, set[str]]]:
    """For each table, the tables that share column names with it."""
    out: dict[str, dict[str, set[str]]] = {}
    for a, b in combinations(tables, 2):
        if both := set(tables[a]) & set(tables[b]):
            out.setdefault(a, {})[b] = both
            out.setdefault(b, {})[a] = both
    return out


def dedup_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key, that with the least (order); of rows that tie, the one least in the other columns. Null comes last.

    Aggregated, not sorted by one task, so a hot key is combined before it travels."""
    rest = [c for c in df.columns if c not in (key, order)]
    row = F.struct(F.col(order).isNull().alias("_none"), F.col(order), *rest)
    return df.groupBy(key).agg(F.min(row).alias("_row")).select(*[F.col(key) if c == key else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def lookup(facts: DataFrame, dimension: DataFrame, on, columns: Sequence[str], default: str | None = None) -> DataFrame:
    """Facts with columns of a dimension; a missing key gives nulls or the default. Spark picks the join by size."""
    got = facts.join(dimension, on, "left")
    return got.withColumns({c: F.coalesce(F.col(c), F.lit(default)) for c in columns}) if default is not None else got


# --- transcripts ---


def split_speaker(df: DataFrame, text_col: str) -> DataFrame:
    """speaker and turn of ``speaker:<tab>turn``; a text that doesn't split in two has no speaker."""
    parts = F.split(F.col(text_col), ":\t")
    two = F.size(parts) == 2
    return df.withColumn("speaker", F.when(two, parts[0])).withColumn("turn", F.when(two, parts[1]).otherwise(F.col(text_col)))


def path_parts(path: Column) -> tuple[Column, Column]:
    """(folders joined, file name) of a path; its first part is left out."""
    p = F.split(path, "/")
    return F.array_join(F.slice(p, 2, F.greatest(F.size(p) - 2, F.lit(0))), "/"), F.element_at(p, -1)


def rolling_turns(turns: DataFrame, file: str, order: str, speaker: str, text: str, n: int = 3) -> DataFrame:
    """(file, order, offset, speaker, text): each turn and the n - 1 after it in its file, numbered from 1."""
    w = Window.partitionBy(file).orderBy(order)
    ahead = [F.struct(F.lit(k + 1).alias("offset"), F.lead(F.coalesce(F.col(speaker), F.lit("")), k).over(w).alias("speaker"), F.lead(F.coalesce(F.col(text), F.lit("")), k).over(w).alias("text")) for k in range(n)]
    rows = turns.select(file, order, F.array(*ahead).alias("_a"))
    return rows.select(file, order, F.explode(F.filter("_a", lambda s: s["text"].isNotNull())).alias("r")).select(file, order, "r.offset", "r.speaker", "r.text")


def turn_features(tokens: Column, offset: Column, speaker: Column | None = None) -> Column:
    """Array of (field, value) of one turn: all, initial, medial and final tokens of tN, and its speaker if given and not null."""
    name = F.concat(F.lit("t"), offset.cast("string"))
    tag = lambda suffix, values: F.transform(values, lambda v: F.struct(F.concat(name, F.lit(suffix)).alias("field"), v.alias("value")))
    one = lambda i: F.array_compact(F.array(F.try_element_at(tokens, F.lit(i))))
    medial = F.slice(tokens, 2, F.greatest(F.size(tokens) - 2, F.lit(0)))
    made = [tag("", tokens), tag(",initial", one(1)), tag(",medial", medial), tag(",final", one(-1))]
    return F.concat(*made, *([tag(",speaker", F.array_compact(F.array(speaker)))] if speaker is not None else []))


def context(df: DataFrame, id_col: str, keys: DataFrame, width: int = 2) -> DataFrame:
    """Rows whose id is within the width of a key (key): an equi-join on the ids spelled out; edges are left out by the join."""
    near = keys.select("key", F.explode(F.sequence(F.col("key") - width, F.col("key") + width)).alias(id_col))
    return near.join(df, id_col)


# --- mail ---

#: Lines that quote somebody else or head a quotation.
QUOTED = r"writes in|(?:writes|wrote|says|said):\s*$|^\s*(?:In article|Quoted from|[|>}{#\]:+])"
PARAGRAPH_BREAK = r"(?m)\n\s*\n|^\s*--\s*$"


def parse_post(df: DataFrame, raw: str) -> DataFrame:
    """headers (map, lower-case names) and body: split at the first blank line."""
    parts = F.split(F.regexp_replace(F.col(raw), "\r\n", "\n"), "\n\n", 2)
    pairs = F.filter(F.transform(F.split(parts[0], "\n"), lambda h: F.split(h, ":\\s*", 2)), lambda p: F.size(p) == 2)
    latest = F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda p: F.lower(p[0]))), lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda p: F.lower(p[0]) == k), -1)[1])))
    return df.withColumn("headers", latest).withColumn("body", F.coalesce(F.get(parts, F.lit(1)), F.lit("")))


def quoted(line: Column) -> Column:
    return line.rlike(QUOTED)


def signature(body: Column) -> Column:
    """The last paragraph without white space; null if there is one paragraph only."""
    parts = F.split(F.regexp_replace(body, r"^\s+|\s+$", ""), PARAGRAPH_BREAK)
    return F.when(F.size(parts) > 1, F.regexp_replace(F.element_at(parts, -1), r"\s+", ""))


def repeated_signatures(df: DataFrame, body: str) -> DataFrame:
    """(signature, n) of last paragraphs that several documents end with."""
    return df.select(signature(F.col(body)).alias("signature")).filter("signature is not null").groupBy("signature").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def mark_lines(df: DataFrame, id_col: str, body: str) -> DataFrame:
    """(id, line_no, line, ignored): quoted lines and lines of a repeated signature are to be ignored; blank lines are dropped."""
    sigs = repeated_signatures(df, body).select("signature", F.lit(True).alias("_repeated"))
    text = F.regexp_replace(F.col(body), r"^\s+|\s+$", "")
    rows = df.select(F.col(id_col), F.split(text, PARAGRAPH_BREAK).alias("_p"), signature(F.col(body)).alias("_own"))
    # documents without a signature get a key of their own, so that they don't meet in one task
    key = F.coalesce("_own", F.concat(F.lit("\0"), F.xxhash64(id_col, "_p").cast("string")))
    rows = rows.withColumn("signature", key).join(sigs, "signature", "left")
    last = F.size("_p") - 1
    lines = F.flatten(F.transform("_p", lambda p, i: F.transform(F.filter(F.split(p, "\n"), lambda x: F.trim(x) != ""), lambda x: F.struct(x.alias("line"), (F.coalesce(F.col("_repeated"), F.lit(False)) & (i == last)).alias("sig")))))
    out = rows.select(id_col, F.posexplode(lines).alias("line_no", "l"))
    return out.select(id_col, F.col("line_no").cast("long").alias("line_no"), "l.line", (F.col("l.sig") | quoted(F.col("l.line"))).alias("ignored"))


def line_starts(body: Column) -> Column:
    """Distinct first characters of the lines."""
    return F.array_distinct(F.filter(F.transform(F.split(body, "\n"), lambda x: F.left(x, F.lit(1))), lambda c: c != ""))


def or_default(value: Column, default: str = "<Not assigned>") -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def post_fields(df: DataFrame, id_col: str, raw: str) -> DataFrame:
    """The columns that a mail's features come from: subject, body and ignored text, newsgroups, sender, date, line starts.

    The date is that of the header, whatever its zone; null if it can't be read."""
    posts = parse_post(df, raw)
    lines = mark_lines(posts, id_col, "body").groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("line_no", "line", "ignored"))).alias("_l"))
    text = lambda flag: F.array_join(F.transform(F.filter("_l", lambda x: x["ignored"] if flag else ~x["ignored"]), lambda x: x["line"]), "\n")
    h = lambda name: F.trim(F.col("headers")[name])
    day = F.regexp_extract(h("date"), r"(\d{1,2} [A-Z][a-z]{2} \d{4})", 1)
    return posts.join(lines, id_col, "left").select(
        id_col, h("subject").alias("subject"), F.coalesce(text(False), F.lit("")).alias("body"), F.coalesce(text(True), F.lit("")).alias("ignored"),
        F.transform(F.split(h("newsgroups"), ","), lambda x: F.trim(x)).alias("newsgroup"), h("from").alias("from"), h("organization").alias("organization"), h("distribution").alias("distribution"),
        F.try_to_timestamp(day, F.lit("d MMM yyyy")).cast("date").alias("date"), line_starts(F.col("body")).alias("line_start"),
    )
