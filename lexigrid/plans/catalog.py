"""Queries of the library over the test tables and, for each, the same in DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrid.functions.tokenize import boundary_tokens, display_tokens, word_tokens
from lexigrid.operators import clusters as C
from lexigrid.operators import facets, positions, views
from lexigrid.operators.index import Index, cumulative, documents_spec, prefix_range
from lexigrid.operators.query import AndNot, MatchAll, MatchAny, MatchPhrase, add_clause, clause_query, clauses_from_querystring, clauses_to_querystring, from_rows, search, split_features, to_rows
from lexigrid.sources import tables as S
from lexigrid.spec import RANGE, SCALAR, SET, CorpusSpec, FieldSpec, spec_of
from lexigrid.storage import materialize, shared_dir, spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

WORDS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
TOK = f"regexp_extract_all(lower(text), '{WORDS}')"
D = f"d AS (SELECT doc_id, lang, source, n_chars, {TOK} AS a FROM documents)"
P = D + ", p AS (SELECT v AS value, doc_id, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(a) AS v FROM d) GROUP BY v, doc_id)"
L = D + ", l AS (SELECT doc_id, a[i] AS value, i - 1 AS pos, a FROM (SELECT doc_id, a, unnest(generate_series(1, len(a))) AS i FROM d WHERE len(a) > 0))"
N = "(SELECT count(*) FROM documents)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> Index:
    return Index.build(spread(table(spark, sf, "documents")), documents_spec())


# --- tokens and features ---


@query("field_features_text", f"WITH {P} SELECT value, CAST(count(*) AS BIGINT) AS doc_count, CAST(sum(tf) AS BIGINT) AS location_count, count(*) / CAST({N} AS DOUBLE) AS relative_doc_count FROM p GROUP BY value HAVING count(*) >= 10")
def _(spark, sf):
    return facets.field_features(documents(spark, sf), "text", 10)


@query("field_features_top", f"WITH {P} SELECT value, CAST(count(*) AS BIGINT) AS doc_count, CAST(sum(tf) AS BIGINT) AS location_count, count(*) / CAST({N} AS DOUBLE) AS relative_doc_count FROM p GROUP BY value ORDER BY doc_count DESC, value LIMIT 25")
def _(spark, sf):
    return facets.field_features(documents(spark, sf), "text", 1, 25)


@query("field_features_scalar", f"SELECT lang AS value, CAST(count(*) AS BIGINT) AS doc_count, CAST(0 AS BIGINT) AS location_count, count(*) / CAST({N} AS DOUBLE) AS relative_doc_count FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def _(spark, sf):
    return facets.field_features(documents(spark, sf), "lang")


@query("field_features_range", f"SELECT n_chars AS value, CAST(count(*) AS BIGINT) AS doc_count, count(*) / CAST({N} AS DOUBLE) AS relative_doc_count FROM documents GROUP BY n_chars")
def _(spark, sf):
    return facets.field_features(documents(spark, sf), "n_chars")


@query("range_encoding_cumulative", "SELECT n_chars AS value, CAST(count(*) AS BIGINT) AS doc_count, CAST(sum(count(*)) OVER (ORDER BY n_chars) AS BIGINT) AS cumulative_count FROM documents GROUP BY n_chars")
def _(spark, sf):
    return cumulative(documents(spark, sf), "n_chars")


@query("boundary_tokens", r"WITH b AS (SELECT unnest(list_filter(list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS value FROM documents) SELECT value, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY value")
def _(spark, sf):
    return table(spark, sf, "documents").select(F.explode(boundary_tokens(F.col("text"))).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("display_tokens", rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '(?:{WORDS})\s*')) AS BIGINT) AS n, md5(array_to_string(regexp_extract_all(text, '(?:{WORDS})\s*'), '|')) AS shown FROM documents")
def _(spark, sf):
    t = display_tokens(F.col("text"), "after")
    return table(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, "|")).alias("shown"))


@query("postings_tf", f"WITH {P} SELECT 'text' AS field, value, doc_id, tf FROM p")
def _(spark, sf):
    return documents(spark, sf).postings("text")


@query("tf_partition", f"WITH {P} SELECT value, tf, CAST(count(*) AS BIGINT) AS doc_count FROM p GROUP BY value, tf")
def _(spark, sf):
    return documents(spark, sf).postings("text").groupBy("value", "tf").agg(F.count(F.lit(1)).alias("doc_count"))


@query("field_summary", f"""WITH {P}, t AS (SELECT doc_id, count(*) AS n, sum(tf) AS l FROM p GROUP BY doc_id)
SELECT 'text' AS field, 'str' AS value_type, CAST(count(*) AS BIGINT) AS doc_count, CAST(max(n) AS BIGINT) AS max_value_count, CAST(sum(l) AS BIGINT) AS location_count, (SELECT count(DISTINCT value) FROM p) AS unique_values, (SELECT min(value) FROM p) AS min_value, (SELECT max(value) FROM p) AS max_value, false AS range_encoded FROM t
UNION ALL SELECT 'lang', 'str', count(lang), 1, 0, count(DISTINCT lang), min(lang), max(lang), false FROM documents
UNION ALL SELECT 'source', 'str', count(source), 1, 0, count(DISTINCT source), min(source), max(source), false FROM documents
UNION ALL SELECT 'n_chars', 'int', count(n_chars), 1, 0, count(DISTINCT n_chars), CAST(min(n_chars) AS VARCHAR), CAST(max(n_chars) AS VARCHAR), true FROM documents""")
def _(spark, sf):
    return documents(spark, sf).field_summary()


@query("doc_feature_set", "WITH " + D + " SELECT doc_id, CAST(len(list_distinct(a)) + (lang IS NOT NULL)::INT + (source IS NOT NULL)::INT + (n_chars IS NOT NULL)::INT AS BIGINT) AS features FROM d")
def _(spark, sf):
    i = documents(spark, sf)
    return i.docs.select("doc_id", (F.size(F.array_distinct("text")) + sum(F.col(c).isNotNull().cast("int") for c in ("lang", "source", "n_chars"))).cast("long").alias("features"))


# --- lookups and boolean queries ---


def _matches(name: str, where: str, build):
    QUERIES[name] = lambda spark, sf: build(documents(spark, sf))
    ORACLES[name] = f"WITH {D} SELECT doc_id FROM d WHERE {where}"


HAS = "list_contains(a, '{}')".format
BETWEEN = "len(list_filter(a, lambda x: x >= '{}' AND x < '{}')) > 0".format
_matches("match_literal", HAS("the"), lambda i: i.lookup(("text", "the")))
_matches("match_absent", HAS("zzzz absent"), lambda i: i.lookup(("text", "zzzz absent")))
_matches("match_scalar", "lang = 'fr'", lambda i: i.lookup(("lang", "fr")))
_matches("match_range_tokens", BETWEEN("tha", "thb"), lambda i: i.lookup(("text", "tha", "thb")))
_matches("match_prefix", "len(list_filter(a, lambda x: starts_with(x, 'éo'))) > 0", lambda i: i.lookup(prefix_range("text", "éo")))
_matches("match_range_number", "n_chars >= 1000 AND n_chars < 2000", lambda i: i.lookup(("n_chars", 1000, 2000)))
_matches("match_range_number_open_end", "n_chars >= 5000", lambda i: i.lookup(("n_chars", 5000, None)))
_matches("match_range_number_open_start", "n_chars < 300", lambda i: i.lookup(("n_chars", None, 300)))
_matches("match_any", f"{HAS('the')} OR {HAS('der')}", lambda i: MatchAny(("text", "the"), ("text", "der")).evaluate(i))
_matches("match_all", f"{HAS('the')} AND {HAS('of')} AND lang = 'en'", lambda i: MatchAll(("text", "the"), ("text", "of"), ("lang", "en")).evaluate(i))
_matches("match_nested", f"({HAS('la')} AND ({HAS('et')} OR {HAS('y')})) OR n_chars < 200", lambda i: MatchAny(MatchAll(("text", "la"), MatchAny(("text", "et"), ("text", "y"))), ("n_chars", None, 200)).evaluate(i))
_matches("match_andnot", f"lang = 'en' AND NOT {HAS('was')}", lambda i: AndNot(("lang", "en"), ("text", "was")).evaluate(i))
_matches("match_empty_queries", "false", lambda i: MatchAny().evaluate(i).union(MatchAll().evaluate(i)))
_matches("clause_query", f"({HAS('the')} OR {HAS('der')}) AND (source = 'src1' OR n_chars >= 3000) AND ({HAS('of')} OR {HAS('die')})", lambda i: clause_query(i, [[("text", "the"), ("text", "der")], [("source", "src1"), ("n_chars", 3000, None)], [7]], {7: [("text", "of"), ("text", "die")]}))


@query("match_range_date", "SELECT o_orderkey AS doc_id FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1996-03-01' AND CAST(o_orderdate AS DATE) < DATE '1996-06-01'")
def _(spark, sf):
    import datetime as dt

    orders = table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    i = Index.build(orders, CorpusSpec((FieldSpec("day", RANGE), FieldSpec("o_orderstatus", SCALAR)), "o_orderkey"))
    return i.lookup(("day", dt.date(1996, 3, 1), dt.date(1996, 6, 1)))


@query("feature_counts", f"WITH {P} SELECT CAST(count(*) AS BIGINT) AS doc_count, CAST(sum(tf) AS BIGINT) AS location_count FROM p WHERE value = 'the'")
def _(spark, sf):
    return documents(spark, sf).counts(("text", "the"))


@query("match_features_docs", f"WITH {D} SELECT doc_id, CAST({HAS('the')}::INT + (n_chars >= 1000 AND n_chars < 2000)::INT + (lang = 'en')::INT + ({BETWEEN('a', 'b')})::INT AS BIGINT) AS matched FROM d")
def _(spark, sf):
    i = documents(spark, sf)
    fs = [("text", "the"), ("n_chars", 1000, 2000), ("lang", "en"), ("text", "a", "b")]
    return i.docs.select("doc_id", sum((i.predicate(f).cast("int") for f in fs), F.lit(0)).cast("long").alias("matched"))


# --- positions ---


def _phrase(name: str, where: str, *features):
    QUERIES[name] = lambda spark, sf: MatchPhrase(features).evaluate(documents(spark, sf))
    joins = " ".join(f"JOIN l l{k} ON l{k}.doc_id = l0.doc_id AND l{k}.pos = l0.pos + {k}" for k in range(1, len(features)))
    ORACLES[name] = f"WITH {L} SELECT DISTINCT l0.doc_id FROM l l0 {joins} WHERE {where}"


_phrase("phrase_2", "l0.value = 'of' AND l1.value = 'the'", ("text", "of"), ("text", "the"))
_phrase("phrase_3", "l0.value = 'and' AND l1.value = 'the' AND l2.value = 'of'", ("text", "and"), ("text", "the"), ("text", "of"))
_phrase("phrase_with_range", "l0.value = 'the' AND l1.value >= 'th' AND l1.value < 'ti'", ("text", "the"), ("text", "th", "ti"))


@query("phrase_by_position", f"WITH {L} SELECT DISTINCT l0.doc_id FROM l l0 JOIN l l1 ON l1.doc_id = l0.doc_id AND l1.pos = l0.pos + 1 WHERE l0.value = 'the' AND l1.value = ','")
def _(spark, sf):
    return positions.phrase_by_position(documents(spark, sf), [("text", "the"), ("text", ",")])


LAYOUT = L + ", y AS (SELECT doc_id, CAST(len(a) AS BIGINT) AS n, (len(a) + 15) // 16 + 1 AS passages FROM d WHERE len(a) > 0), z AS (SELECT doc_id, n, CAST(passages AS BIGINT) AS passages, CAST(sum(passages) OVER (ORDER BY doc_id) - passages AS BIGINT) AS first_passage FROM y)"


@query("passage_layout", f"WITH {LAYOUT} SELECT * FROM z")
def _(spark, sf):
    return positions.passage_layout(documents(spark, sf), "text")


@query("feature_passages", f"WITH {L}, k AS (SELECT doc_id, pos // 16 AS p FROM l WHERE value = 'the') SELECT doc_id, CAST(p AS BIGINT) AS passage FROM k UNION SELECT doc_id, p + 1 FROM k")
def _(spark, sf):
    return positions.feature_passages(documents(spark, sf), ("text", "the"))


@query("passages_to_docs", f"WITH {LAYOUT}, k AS (SELECT doc_id, pos // 16 AS p FROM l WHERE value = 'the'), w AS (SELECT first_passage + p AS passage FROM k JOIN z USING (doc_id) UNION SELECT first_passage + p + 1 FROM k JOIN z USING (doc_id)) SELECT DISTINCT doc_id FROM z JOIN w ON passage BETWEEN first_passage AND first_passage + passages - 1")
def _(spark, sf):
    i = documents(spark, sf)
    layout = materialize(positions.passage_layout(i, "text"), "layout")
    wanted = positions.feature_passages(i, ("text", "the")).join(layout, "doc_id").select((F.col("first_passage") + F.col("passage")).alias("passage"))
    return positions.passages_to_docs(wanted, layout)


@query("concordance", f"WITH {L} SELECT doc_id, CAST(pos AS BIGINT) AS pos, value, array_to_string(list_slice(a, greatest(pos - 4, 1), pos), ' ') AS before, array_to_string(list_slice(a, pos + 2, pos + 6), ' ') AS after FROM l WHERE value >= 'tha' AND value < 'thb'")
def _(spark, sf):
    lines = positions.concordance(documents(spark, sf), ("text", "tha", "thb"), 5)
    return lines.select("doc_id", "pos", "value", F.array_join("before", " ").alias("before"), F.array_join("after", " ").alias("after"))


@query("collocates", f"WITH {L}, m AS (SELECT doc_id, pos FROM l WHERE value = 'of') SELECT l.value, CAST(count(*) AS BIGINT) AS n FROM m JOIN l ON l.doc_id = m.doc_id AND l.pos BETWEEN m.pos - 3 AND m.pos + 3 AND l.pos <> m.pos GROUP BY l.value")
def _(spark, sf):
    return positions.collocates(documents(spark, sf), ("text", "of"), 3)


@query("snippets", f"WITH {D} SELECT doc_id, CAST(32 AS BIGINT) AS start, CAST(48 AS BIGINT) AS \"end\", array_to_string(list_slice(a, 33, 48), ' ') AS passage FROM d WHERE len(a) > 32")
def _(spark, sf):
    i = documents(spark, sf)
    got = positions.passages(i, "text", i.docs.select("doc_id", F.lit(32).cast("long").alias("start")), 16)
    return got.select("doc_id", "start", "end", F.array_join("tokens", " ").alias("passage"))


@query("highlight", f"WITH {D} SELECT doc_id, md5(array_to_string(list_transform(a, lambda x: CASE WHEN x = 'the' OR (x >= 'of' AND x < 'og') THEN '[' || x || ']' ELSE x END), ' ')) AS marked FROM d")
def _(spark, sf):
    return positions.highlight(documents(spark, sf), "text", [("text", "the"), ("text", "of", "og")]).select("doc_id", F.md5("text").alias("marked"))


# --- facets ---

STATS = "d AS doc_count, d / CAST(n AS DOUBLE) AS relative_doc_count, h AS hits, h / CAST(n AS DOUBLE) AS relative_hits, h / CAST(nullif(d + q - h, 0) AS DOUBLE) AS jaccard_similarity, h / CAST(nullif(d, 0) AS DOUBLE) AS feature_proportion, h / CAST(nullif(q, 0) AS DOUBLE) AS query_proportion"
QD = f"WITH {D}, qd AS (SELECT *, ({HAS('the')})::INT AS hit FROM d), t AS (SELECT count(*) AS n, sum(hit) AS q FROM qd)"


@query("facet_scalar_by_query", f"{QD}, f AS (SELECT 'lang' AS field, lang AS value, hit FROM qd WHERE lang IS NOT NULL UNION ALL SELECT 'source', source, hit FROM qd WHERE source IS NOT NULL), g AS (SELECT field, value, CAST(count(*) AS BIGINT) AS d, CAST(sum(hit) AS BIGINT) AS h FROM f GROUP BY ALL) SELECT field, value, {STATS} FROM g, t")
def _(spark, sf):
    i = documents(spark, sf)
    return facets.facet(i, i.predicate(("text", "the")), "lang", "source")


@query("facet_tokens_by_query", f"{QD}, f AS (SELECT unnest(list_distinct(a)) AS value, hit FROM qd), g AS (SELECT 'text' AS field, value, CAST(count(*) AS BIGINT) AS d, CAST(sum(hit) AS BIGINT) AS h FROM f GROUP BY value) SELECT field, value, {STATS} FROM g, t WHERE h / CAST(nullif(d + q - h, 0) AS DOUBLE) > 0 ORDER BY jaccard_similarity DESC, field, value LIMIT 30")
def _(spark, sf):
    i = documents(spark, sf)
    return facets.table_filter(facets.facet(i, i.predicate(("text", "the")), "text"), "jaccard_similarity", True, 30, 0)


@query("facet_by_ids", f"WITH {D}, qd AS (SELECT d.*, (l.doc_id IS NOT NULL)::INT AS hit FROM d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 0) l USING (doc_id)), t AS (SELECT count(*) AS n, sum(hit) AS q FROM qd), g AS (SELECT 'lang' AS field, lang AS value, CAST(count(*) AS BIGINT) AS d, CAST(sum(hit) AS BIGINT) AS h FROM qd WHERE lang IS NOT NULL GROUP BY lang) SELECT field, value, {STATS} FROM g, t")
def _(spark, sf):
    return facets.facet_by_ids(documents(spark, sf), table(spark, sf, "labels").filter("quality = 0").select("doc_id"), "lang")


@query("facet_orders_by_segment", f"WITH o AS (SELECT o_orderkey, c_mktsegment AS value, (o_orderpriority = '1-URGENT')::INT AS hit FROM orders JOIN customer ON o_custkey = c_custkey), t AS (SELECT count(*) AS n, coalesce(sum(hit), 0) AS q FROM o), g AS (SELECT 'c_mktsegment' AS field, value, CAST(count(*) AS BIGINT) AS d, CAST(sum(hit) AS BIGINT) AS h FROM o WHERE value IS NOT NULL GROUP BY value) SELECT field, value, {STATS} FROM g, t")
def _(spark, sf):
    both = S.lookup(table(spark, sf, "orders"), table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", ["c_mktsegment"]).filter("c_mktsegment is not null")
    i = Index.build(both, CorpusSpec((FieldSpec("c_mktsegment", SCALAR), FieldSpec("o_orderpriority", SCALAR)), "o_orderkey"))
    return facets.facet(i, i.predicate(("o_orderpriority", "1-URGENT")), "c_mktsegment")


CELLS = f"{P}, e AS (SELECT p.value, d.lang AS grp, count(*) AS a FROM p JOIN d USING (doc_id) GROUP BY ALL), f AS (SELECT value, sum(a) AS f FROM e GROUP BY value HAVING sum(a) >= 10), g AS (SELECT lang AS grp, count(*) AS g FROM documents GROUP BY lang), c AS (SELECT e.grp, e.value, CAST(a AS DOUBLE) AS a, CAST(f AS DOUBLE) AS f, CAST(g AS DOUBLE) AS g, CAST({N} AS DOUBLE) AS n FROM e JOIN f USING (value) JOIN g USING (grp))"


@query("keywords_chi2", f"WITH {CELLS}, w AS (SELECT grp, value, a, f - a AS b, g - a AS c, n - f - g + a AS d FROM c), x AS (SELECT grp, value, (a * d - b * c) * (a * d - b * c) * (a + b + c + d) / nullif((a + b) * (c + d) * (b + d) * (a + c), 0) AS chi2 FROM w), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY chi2 DESC, value DESC) AS INT) AS rank FROM x WHERE chi2 IS NOT NULL) SELECT * FROM r WHERE rank <= 45")
def _(spark, sf):
    return facets.keywords(documents(spark, sf), "lang", "text", 10, 45)


@query("crosstab_top_features", f"WITH {CELLS}, x AS (SELECT grp, value, CAST(a AS BIGINT) AS hits, a / (f + g - a) AS jaccard_similarity FROM c), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY jaccard_similarity DESC, value) AS INT) AS rank FROM x) SELECT * FROM r WHERE rank <= 10")
def _(spark, sf):
    return facets.crosstab(documents(spark, sf), "lang", "text", 10, 10)


@query("sample_docs")
def _(spark, sf):
    return facets.sample_docs(documents(spark, sf), 20, 1).select("doc_id", "lang", "source", "n_chars")


# --- sources ---


@query("rolling_turns", "WITH t AS (SELECT conv_id, turn, role, text FROM conversations), w AS (SELECT *, lead(coalesce(text, ''), 1) OVER v AS t1, lead(coalesce(text, ''), 2) OVER v AS t2, lead(coalesce(role, ''), 1) OVER v AS r1, lead(coalesce(role, ''), 2) OVER v AS r2 FROM t WINDOW v AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, 1 AS \"offset\", coalesce(role, '') AS speaker, coalesce(text, '') AS text FROM w UNION ALL SELECT conv_id, turn, 2, r1, t1 FROM w WHERE t1 IS NOT NULL UNION ALL SELECT conv_id, turn, 3, r2, t2 FROM w WHERE t2 IS NOT NULL")
def _(spark, sf):
    return S.rolling_turns(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


@query("turn_position_features", f"WITH t AS (SELECT conv_id, turn, role, {TOK} AS a FROM conversations), f AS (SELECT conv_id, turn, 't1' AS field, unnest(a) AS value FROM t UNION ALL SELECT conv_id, turn, 't1,initial', a[1] FROM t WHERE len(a) > 0 UNION ALL SELECT conv_id, turn, 't1,final', a[len(a)] FROM t WHERE len(a) > 0 UNION ALL SELECT conv_id, turn, 't1,medial', unnest(list_slice(a, 2, len(a) - 1)) FROM t WHERE len(a) > 2 UNION ALL SELECT conv_id, turn, 't1,speaker', role FROM t WHERE role IS NOT NULL) SELECT field, value, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY ALL")
def _(spark, sf):
    rows = table(spark, sf, "conversations").select(F.explode(S.turn_features(word_tokens(F.col("text")), F.lit(1), F.col("role"))).alias("f"))
    return rows.groupBy("f.field", "f.value").agg(F.count(F.lit(1)).alias("n"))


@query("context_turns", "WITH t AS (SELECT CAST(conv_id * 100 + turn AS BIGINT) AS turn_id, role FROM conversations), k AS (SELECT turn_id AS key FROM t WHERE role = 'system') SELECT k.key, t.turn_id, t.role FROM k JOIN t ON t.turn_id BETWEEN k.key - 2 AND k.key + 2")
def _(spark, sf):
    t = table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("turn_id"), "role")
    return S.context(t, "turn_id", t.filter("role = 'system'").select(F.col("turn_id").alias("key")), 2).select("key", "turn_id", "role")


@query("context_rows", "SELECT k.doc_id AS key, d.doc_id, d.n_chars FROM (SELECT doc_id FROM documents WHERE n_chars >= 9000) k JOIN documents d ON d.doc_id BETWEEN k.doc_id - 1 AND k.doc_id + 1")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return S.context(d, "doc_id", d.filter("n_chars >= 9000").select(F.col("doc_id").alias("key")), 1).select("key", "doc_id", "n_chars")


@query("dimension_lookup", "SELECT o_orderkey, c_name, coalesce(n_name, '<Not assigned>') AS n_name, coalesce(r_name, '<Not assigned>') AS r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    o = S.lookup(o, table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey"), "o_custkey", ["c_name"])
    o = S.lookup(o, table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey"), "c_nationkey", ["n_name"], "<Not assigned>")
    o = S.lookup(o, table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey", ["r_name"], "<Not assigned>")
    return o.select("o_orderkey", "c_name", "n_name", "r_name")


@query("dedup_first", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def _(spark, sf):
    return S.dedup_first(table(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id")


@query("dedup_first_pages", "SELECT min(page_id) AS page_id FROM pages GROUP BY url")
def _(spark, sf):
    return S.dedup_first(table(spark, sf, "pages").select("page_id", "url"), "url", "page_id").select("page_id")


LAST = r"regexp_replace((string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\n'))[-1], '\s+', '', 'g')"


@query("repeated_last_paragraph", rf"WITH s AS (SELECT {LAST} AS signature FROM documents WHERE len(string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\n')) > 1) SELECT signature, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY signature HAVING count(*) > 1")
def _(spark, sf):
    # the collection has no blank lines, so its lines play the part of paragraphs
    spaced = table(spark, sf, "documents").select(F.regexp_replace(F.regexp_replace("text", r"^\s+|\s+$", ""), "\n", "\n\n").alias("text"))
    return S.repeated_signatures(spaced, "text")


@query("line_marking", r"WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)) AS a FROM documents), g AS (SELECT doc_id, a, CASE WHEN len(a) > 1 THEN regexp_replace(a[-1], '\s+', '', 'g') END AS sig FROM s), r AS (SELECT sig FROM g WHERE sig IS NOT NULL GROUP BY sig HAVING count(*) > 1), x AS (SELECT doc_id, a[i] AS line, i = len(a) AND sig IN (SELECT sig FROM r) AS last FROM (SELECT doc_id, a, sig, unnest(generate_series(1, len(a))) AS i FROM g)) SELECT doc_id, CAST(count(*) AS BIGINT) AS lines, CAST(count(*) FILTER (coalesce(last, false) OR regexp_matches(line, 'writes in|(?:writes|wrote|says|said):\s*$|^\s*(?:In article|Quoted from|[|>}{#\]:+])')) AS BIGINT) AS ignored FROM x WHERE trim(line) <> '' GROUP BY doc_id")
def _(spark, sf):
    spaced = table(spark, sf, "documents").select("doc_id", F.regexp_replace(F.regexp_replace("text", r"^\s+|\s+$", ""), "\n", "\n\n").alias("text"))
    return S.mark_lines(spaced, "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if("ignored").alias("ignored"))


@query("paragraph_docs", r"WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), '. ') AS a FROM documents), f AS (SELECT doc_id, list_filter(a, lambda x: trim(x) <> '') AS a FROM s) SELECT doc_id, CAST(i - 1 AS BIGINT) AS para_no, md5(a[i]) AS body FROM (SELECT doc_id, a, unnest(generate_series(1, len(a))) AS i FROM f)")
def _(spark, sf):
    spaced = table(spark, sf, "documents").select("doc_id", F.replace(F.regexp_replace("text", r"^\s+|\s+$", ""), F.lit(". "), F.lit("\n\n")).alias("text"))
    return S.paragraphs(spaced, "doc_id", "text").select("doc_id", "para_no", F.md5("text").alias("body"))


@query("eav_unpivot", "SELECT CAST(p_partkey AS BIGINT) AS doc_id, unnest(['p_brand', 'p_type', 'p_size']) AS field, unnest([coalesce(p_brand, ''), coalesce(p_type, ''), coalesce(CAST(p_size AS VARCHAR), '')]) AS value FROM part")
def _(spark, sf):
    return S.unpivot(table(spark, sf, "part"), "p_partkey", ["p_brand", "p_type", "p_size"])


@query("eav_regroup", "SELECT CAST(n_regionkey AS BIGINT) AS doc_id, 'n_name' AS field, string_agg(n_name, '|' ORDER BY n_name) AS items FROM nation GROUP BY n_regionkey")
def _(spark, sf):
    eav = S.unpivot(table(spark, sf, "nation"), "n_regionkey", ["n_name"])
    return S.regroup(eav).select(F.col("doc_id").cast("long").alias("doc_id"), "field", F.array_join("values", "|").alias("items"))


@query("dense_ids", "SELECT page_id, CAST(row_number() OVER (ORDER BY page_id) - 1 AS BIGINT) AS doc_id FROM pages")
def _(spark, sf):
    return S.dense_ids(table(spark, sf, "pages").select("page_id"), "page_id").select("page_id", F.col("doc_id").cast("long").alias("doc_id"))


@query("line_start_characters", "WITH s AS (SELECT doc_id, list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: x[1:1]), lambda c: c <> '')) AS a FROM documents) SELECT doc_id, array_to_string(list_sort(a), '') AS starts FROM s")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(S.line_starts(F.col("text"))), "").alias("starts"))


@query("parse_post", r"WITH s AS (SELECT page_id, replace(html, chr(13) || chr(10), chr(10)) AS t FROM pages) SELECT page_id, md5(CASE WHEN strpos(t, chr(10) || chr(10)) > 0 THEN substr(t, strpos(t, chr(10) || chr(10)) + 2) ELSE '' END) AS body FROM s")
def _(spark, sf):
    return S.parse_post(table(spark, sf, "pages").select("page_id", "html"), "html").select("page_id", F.md5("body").alias("body"))


@query("dense_ids_of_strings", "SELECT c_name, CAST(row_number() OVER (ORDER BY c_name) - 1 AS BIGINT) AS doc_id FROM customer")
def _(spark, sf):
    return S.dense_ids(table(spark, sf, "customer").select("c_name"), "c_name").select("c_name", F.col("doc_id").cast("long").alias("doc_id"))


@query("eav_documents", f"WITH e AS (SELECT p_brand AS b, string_agg(lower(p_type), ' ' ORDER BY p_type, p_partkey) AS t, list_sort(list_distinct(list(CAST(p_size AS VARCHAR)))) AS s FROM part GROUP BY p_brand) SELECT dense_rank() OVER (ORDER BY b) AS doc_id, md5(array_to_string(regexp_extract_all(t, '{WORDS}'), ' ')) AS p_type, array_to_string(s, ' ') AS p_size FROM e")
def _(spark, sf):
    part = table(spark, sf, "part")
    ids = S.dense_ids(part.select("p_brand").distinct(), "p_brand").select("p_brand", (F.col("doc_id") + 1).cast("long").alias("doc_id"))
    eav = S.unpivot(part.join(ids, "p_brand"), "doc_id", ["p_type", "p_size"])
    return S.eav_documents(eav, ["p_type"], ["p_size"]).select("doc_id", F.md5(F.array_join("p_type", " ")).alias("p_type"), F.array_join("p_size", " ").alias("p_size"))


@query("parquet_by_ids", "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (1, 5, 77, 1000000)")
def _(spark, sf):
    return S.parquet(spark, f"{sf}/documents.parquet", "doc_id", [1, 5, 77, 1000000]).select("doc_id", "lang", "source")


@query("paragraphs_of_lines", r"WITH s AS (SELECT doc_id, string_split(replace(text, '. ', chr(10) || chr(10)), chr(10)) AS a FROM documents), l AS (SELECT doc_id, i, a[i] AS line, trim(regexp_replace(a[i], '\s', '', 'g')) = '' AS blank FROM (SELECT doc_id, a, unnest(generate_series(1, len(a))) AS i FROM s)), m AS (SELECT *, NOT blank AND coalesce(lag(blank) OVER w, true) AS start FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)), n AS (SELECT *, sum(start::INT) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS para_no FROM m) SELECT doc_id, CAST(para_no AS BIGINT) AS para_no, md5(string_agg(line, chr(10) ORDER BY i)) AS body FROM n WHERE NOT blank GROUP BY doc_id, para_no")
def _(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.replace("text", F.lit(". "), F.lit("\n\n")), "\n")).alias("line_no", "line"))
    return S.paragraphs_of_lines(lines, "doc_id").select("doc_id", "para_no", F.md5("text").alias("body"))


@query("split_speaker", r"SELECT conv_id, turn, CASE WHEN len(p) = 2 THEN p[1] END AS speaker, md5(CASE WHEN len(p) = 2 THEN p[2] ELSE raw END) AS said FROM (SELECT conv_id, turn, role || ':' || chr(9) || text AS raw, string_split(role || ':' || chr(9) || text, ':' || chr(9)) AS p FROM conversations)")
def _(spark, sf):
    raw = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("no"), F.concat(F.col("role"), F.lit(":\t"), F.col("text")).alias("raw"))
    return S.split_speaker(raw, "raw").select("conv_id", F.col("no").alias("turn"), "speaker", F.md5("turn").alias("said"))


@query("path_parts", "SELECT page_id, array_to_string(list_slice(p, 2, len(p) - 1), '/') AS folder, p[-1] AS name FROM (SELECT page_id, string_split(url, '/') AS p FROM pages)")
def _(spark, sf):
    folder, name = S.path_parts(F.col("url"))
    return table(spark, sf, "pages").select("page_id", folder.alias("folder"), name.alias("name"))


@query("post_fields", r"WITH s AS (SELECT doc_id, lang, source, string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)) AS a FROM documents WHERE text IS NOT NULL) SELECT doc_id, 'about ' || lang AS subject, lang || '|' || source AS newsgroup, source AS sender, DATE '1993-04-05' AS date, array_to_string(list_sort(list_distinct(list_filter(list_transform(a, lambda x: x[1:1]), lambda c: c <> ''))), '') AS line_start FROM s")
def _(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null")
    head = F.concat(F.lit("Subject: about "), F.col("lang"), F.lit("\nNewsgroups: "), F.col("lang"), F.lit(", "), F.col("source"), F.lit("\nFrom: "), F.col("source"), F.lit("\nDate: Mon, 5 Apr 1993 10:00:00 GMT\n\n"))
    got = S.post_fields(d.select("doc_id", F.concat(head, F.regexp_replace("text", r"^\s+|\s+$", "")).alias("raw")), "doc_id", "raw")
    return got.select("doc_id", "subject", F.array_join("newsgroup", "|").alias("newsgroup"), F.col("from").alias("sender"), "date", F.array_join(F.array_sort("line_start"), "").alias("line_start"))


@query("sheet_defaults", "SELECT o_orderkey, coalesce(nullif(c_mktsegment, ''), '<Not assigned>') AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def _(spark, sf):
    c = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return S.lookup(table(spark, sf, "orders"), c, "o_custkey", ["c_mktsegment"]).select("o_orderkey", S.or_default(F.col("c_mktsegment")).alias("segment"))


# --- ids, codecs and stored indexes ---


@query("doc_ids_extent", "SELECT CAST(count(*) AS BIGINT) AS total, max(doc_id) AS max_doc_id FROM documents")
def _(spark, sf):
    i = documents(spark, sf)
    return spark.createDataFrame([(i.total(), i.max_doc_id())], "total bigint, max_doc_id bigint")


@query("docs_of_keys", "SELECT d.doc_id, source FROM documents d JOIN (SELECT DISTINCT doc_id FROM labels) USING (doc_id)")
def _(spark, sf):
    i = documents(spark, sf)
    return i.fetch(table(spark, sf, "labels").select("doc_id").distinct()).select("doc_id", "source")


@query("keys_of_ids", "SELECT d.doc_id, source FROM documents d JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id)")
def _(spark, sf):
    return documents(spark, sf).keys(table(spark, sf, "labels").filter("quality = 1").select("doc_id"), "source")


@query("match_literal_of_range", f"WITH {D} SELECT doc_id FROM d WHERE n_chars = (SELECT min(n_chars) FROM documents)")
def _(spark, sf):
    i = documents(spark, sf)
    return i.lookup(("n_chars", i.docs.agg(F.min("n_chars")).first()[0]))


@query("range_positions", f"WITH {L} SELECT doc_id, CAST(pos AS BIGINT) AS pos, value FROM l WHERE value >= 'of' AND value < 'og'")
def _(spark, sf):
    return positions.hits(documents(spark, sf), [("text", "of", "og")])


@query("search_phrase", f"WITH {L} SELECT DISTINCT l0.doc_id FROM l l0 JOIN l l1 ON l1.doc_id = l0.doc_id AND l1.pos = l0.pos + 1 WHERE l0.value = 'of' AND l1.value = 'this'")
def _(spark, sf):
    return search(["of", "this"], "text", "phrase").evaluate(documents(spark, sf))


def _query_round_trip(i: Index):
    q = MatchAll(MatchAny(("text", "the"), ("text", "der")), ("n_chars", 500, None))
    return from_rows(to_rows(q, i.codec), i.codec).evaluate(i)


def _clauses_round_trip(i: Index):
    text = clauses_to_querystring(add_clause([[("text", "the"), ("lang", "fr")], [("n_chars", None, 9000)]], [("lang", "fr"), ("lang", "en")]), i.codec)
    return clause_query(i, clauses_from_querystring(text, i.codec))


def _split_features(i: Index):
    literals, ranges = split_features([("lang", "en"), ("text", "tha", "thb"), ("text", "of")])
    return MatchAll(*literals, *ranges).evaluate(i)


_matches("query_rows", f"({HAS('the')} OR {HAS('der')}) AND n_chars >= 500", _query_round_trip)
_matches("clause_querystring", f"{HAS('the')} AND n_chars < 9000 AND (lang = 'fr' OR lang = 'en')", _clauses_round_trip)
_matches("split_query_features", f"lang = 'en' AND {BETWEEN('tha', 'thb')} AND {HAS('of')}", _split_features)


def _stored(spark, sf) -> Index:
    """The test index written to the shared folder and read back, so that lookups go to its postings."""
    path = f"{shared_dir(spark)}/lexigrid/index-{uuid.uuid4().hex}"
    documents(spark, sf).write(path)
    return Index.read(spark, path)


def _stored_match(name: str, where: str, build):
    QUERIES[name] = lambda spark, sf: build(_stored(spark, sf))
    ORACLES[name] = f"WITH {D} SELECT doc_id FROM d WHERE {where}"


_stored_match("stored_boolean", f"({HAS('la')} AND ({HAS('et')} OR {HAS('y')})) OR n_chars < 200 OR ({BETWEEN('tha', 'thb')} AND NOT {HAS('was')})", lambda i: MatchAny(MatchAll(("text", "la"), MatchAny(("text", "et"), ("text", "y"))), ("n_chars", None, 200), AndNot(("text", "tha", "thb"), ("text", "was"))).evaluate(i))


@query("stored_phrase", f"WITH {L} SELECT DISTINCT l0.doc_id FROM l l0 JOIN l l1 ON l1.doc_id = l0.doc_id AND l1.pos = l0.pos + 1 WHERE l0.value = 'the' AND l1.value >= 'th' AND l1.value < 'ti'")
def _(spark, sf):
    return MatchPhrase((("text", "the"), ("text", "th", "ti"))).evaluate(_stored(spark, sf))


@query("stored_counts", f"WITH {P} SELECT CAST(count(*) AS BIGINT) AS doc_count, CAST(sum(tf) AS BIGINT) AS location_count FROM p WHERE value = 'of'")
def _(spark, sf):
    return _stored(spark, sf).counts(("text", "of"))


@query("facet_panel", f"{QD}, f AS (SELECT unnest(list_distinct(a)) AS value, hit FROM qd), g AS (SELECT 'text' AS field, value, CAST(count(*) AS BIGINT) AS d, CAST(sum(hit) AS BIGINT) AS h FROM f GROUP BY value) SELECT field, value, {STATS} FROM g, t WHERE h > 0 ORDER BY jaccard_similarity DESC, field, value LIMIT 15")
def _(spark, sf):
    i = documents(spark, sf)
    return views.panels(i, i.lookup(("text", "the")), [views.Panel("words", ("text",))])["words"]


@query("concordance_html", f"WITH {L} SELECT doc_id, CAST(pos AS BIGINT) AS pos, md5('<tr><td>' || replace(replace(replace(array_to_string(list_slice(a, greatest(pos - 1, 1), pos), ' '), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td><td><mark>' || value || '</mark></td><td>' || replace(replace(replace(array_to_string(list_slice(a, pos + 2, pos + 3), ' '), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td></tr>') AS html FROM l WHERE value = 'of'")
def _(spark, sf):
    return positions.concordance_html(positions.concordance(documents(spark, sf), ("text", "of"), 2)).withColumn("html", F.md5("html"))


@query("co_occurring_groups", "WITH s AS (SELECT doc_id, list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: x[1:1]), lambda c: c <> '')) AS a FROM documents), e AS (SELECT doc_id, unnest(a) AS v FROM s), c AS (SELECT x.v AS grp, y.v AS other, CAST(count(*) AS BIGINT) AS hits FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.v <> y.v GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY hits DESC, other) AS INT) AS rank FROM c) SELECT * FROM r WHERE rank <= 4")
def _(spark, sf):
    i = Index.build(table(spark, sf, "documents"), CorpusSpec((FieldSpec("starts", SET, S.line_starts(F.col("text"))),)))
    return facets.co_occurring(i, "starts", 4)


# --- clusters ---

K, MIN_DOCS = 8, 10
CL = f"{P}, fc AS (SELECT 'text' AS field, value, CAST(count(*) AS BIGINT) AS doc_count FROM p GROUP BY value HAVING count(*) >= {MIN_DOCS}), st AS (SELECT CAST((row_number() OVER (ORDER BY substr(md5('0:text:' || value), 1, 15), value) - 1) % {K} + 1 AS BIGINT) AS cluster_id, field, value, doc_count FROM fc), m AS (SELECT cluster_id, field, value, doc_id, doc_count FROM p JOIN st USING (value)), cov AS (SELECT cluster_id, doc_id, count(*) AS times FROM m GROUP BY ALL), cs AS (SELECT cluster_id, n, total, docs_any, total / CAST(docs_any + n AS DOUBLE) AS objective FROM (SELECT cluster_id, count(*) AS n, CAST(sum(doc_count) AS BIGINT) AS total FROM st GROUP BY cluster_id) JOIN (SELECT cluster_id, count(*) AS docs_any FROM cov GROUP BY cluster_id) USING (cluster_id))"
QL = "ql AS (SELECT doc_id FROM d WHERE lang = 'en'), t AS (SELECT (SELECT count(*) FROM documents) AS n, count(*) AS q FROM ql)"


def _state(spark, sf):
    """(index, state) of the test clustering, the state kept; members are made only where they are read."""
    i = documents(spark, sf)
    return i, materialize(C.initial(i, K, MIN_DOCS, ["text"]), "clusters")


def _once(spark, sf):
    """(index, members, state) where the members are read once: those of other features are left to the join with the state."""
    i, state = _state(spark, sf)
    return i, i.membership("text"), state


def _kept(spark, sf):
    """The same with the members kept: what follows reads them many times."""
    i, state = _state(spark, sf)
    return i, materialize(C.members_of(i, state, "text"), "members", "snappy"), state


@query("cluster_init", f"WITH {CL} SELECT cluster_id, field, value, doc_count FROM st")
def _(spark, sf):
    return _state(spark, sf)[1]


@query("cluster_summary", f"WITH {CL} SELECT cluster_id, CAST(n AS BIGINT) AS feature_count, total AS hits, CAST(docs_any AS BIGINT) AS doc_count, docs_any / CAST({N} AS DOUBLE) AS relative_doc_count FROM cs")
def _(spark, sf):
    i, members, state = _once(spark, sf)
    return C.summary(members, state, i.total())


@query("cluster_docs", f"WITH {CL} SELECT cluster_id, doc_id FROM cov")
def _(spark, sf):
    _, members, state = _once(spark, sf)
    return C.cluster_docs(members, state)


@query("cluster_top_features", f"WITH {CL}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY doc_count DESC, field, value) AS INT) AS rank FROM st) SELECT * FROM r WHERE rank <= 5")
def _(spark, sf):
    return C.clustering(_state(spark, sf)[1], 5)


@query("cluster_objective", f"WITH {CL} SELECT cluster_id, CAST(n AS BIGINT) AS n, total, CAST(docs_any AS BIGINT) AS docs_any, objective FROM cs")
def _(spark, sf):
    _, members, state = _once(spark, sf)
    return C.cluster_stats(C.coverage(members, state), state).select("cluster_id", "n", "total", "docs_any", "objective")


REMOVAL = f"{CL}, o AS (SELECT value, count(*) AS o FROM m JOIN cov USING (cluster_id, doc_id) WHERE times = 1 GROUP BY value), rm AS (SELECT cluster_id, field, value, CASE WHEN docs_any - coalesce(o, 0) > 0 AND coalesce(o, 0) < doc_count THEN objective - (total - doc_count) / CAST(docs_any - coalesce(o, 0) + n - 1 AS DOUBLE) ELSE -1.0 END AS delta FROM st JOIN cs USING (cluster_id) LEFT JOIN o USING (value))"


@query("cluster_removal_delta", f"WITH {REMOVAL} SELECT cluster_id, field, value, CAST(delta AS DOUBLE) AS delta FROM rm")
def _(spark, sf):
    _, members, state = _once(spark, sf)
    return C.removal_deltas(members, state)


@query("cluster_addition_delta", f"WITH {CL}, x AS (SELECT cov.cluster_id, m.field, m.value, m.doc_count, count(*) AS x FROM m JOIN cov ON cov.doc_id = m.doc_id AND cov.cluster_id <> m.cluster_id GROUP BY ALL) SELECT cluster_id, field, value, (total + doc_count) / CAST(docs_any + doc_count - x + n + 1 AS DOUBLE) - objective AS delta FROM x JOIN cs USING (cluster_id)")
def _(spark, sf):
    _, members, state = _kept(spark, sf)
    return C.addition_deltas(members, state)


def _propose_sql(features: str, without: str) -> str:
    return f"{CL}, x AS (SELECT cov.cluster_id, m.value, count(*) AS x FROM m JOIN cov ON cov.doc_id = m.doc_id WHERE {features.replace('cluster_id', 'm.cluster_id')} AND {without.replace('cluster_id', 'cov.cluster_id')} GROUP BY ALL), g AS (SELECT f.field, f.value, f.doc_count, cs.cluster_id, (total + f.doc_count) / CAST(n + 1 + docs_any + f.doc_count - coalesce(x, 0) AS DOUBLE) - total / CAST(n + docs_any AS DOUBLE) AS gain FROM (SELECT * FROM st WHERE {features}) f CROSS JOIN (SELECT * FROM cs WHERE {without}) cs LEFT JOIN x ON x.cluster_id = cs.cluster_id AND x.value = f.value), b AS (SELECT field, value, doc_count, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY gain DESC, cluster_id DESC) AS r FROM g) WHERE r = 1)"


@query("cluster_propose", f"WITH {_propose_sql('cluster_id = 3', 'cluster_id <> 3')} SELECT field, value, cluster_id FROM b")
def _(spark, sf):
    _, members, state = _kept(spark, sf)
    return C.propose(members, C.delete_clusters(state, [3]), state.filter("cluster_id = 3"))


@query("cluster_dissolve", f"WITH {_propose_sql('cluster_id IN (2, 5)', 'cluster_id NOT IN (2, 5)')} SELECT cluster_id, field, value, doc_count FROM st WHERE cluster_id NOT IN (2, 5) UNION ALL SELECT cluster_id, field, value, doc_count FROM b")
def _(spark, sf):
    _, members, state = _kept(spark, sf)
    return C.dissolve(members, state, [2, 5])


@query("cluster_split", f"WITH {_propose_sql('cluster_id = 4', 'cluster_id <> 4')}, z AS (SELECT cluster_id AS goal, {K} + row_number() OVER (ORDER BY count(*) DESC, cluster_id DESC) AS id FROM b GROUP BY cluster_id ORDER BY count(*) DESC, cluster_id DESC LIMIT 2) SELECT cluster_id, field, value, doc_count FROM st WHERE cluster_id <> 4 UNION ALL SELECT CAST(coalesce(z.id, 4) AS BIGINT), field, value, doc_count FROM b LEFT JOIN z ON z.goal = b.cluster_id")
def _(spark, sf):
    _, members, state = _kept(spark, sf)
    return C.split(members, state, 4, 3)


@query("cluster_merge", f"WITH {CL} SELECT CASE WHEN cluster_id IN (1, 6) THEN 1 ELSE cluster_id END AS cluster_id, field, value, doc_count FROM st")
def _(spark, sf):
    return C.merge(_state(spark, sf)[1], [1, 6])


@query("cluster_delete", f"WITH {CL} SELECT cluster_id, field, value, doc_count FROM st WHERE cluster_id NOT IN (1, 7)")
def _(spark, sf):
    return C.delete_clusters(_state(spark, sf)[1], [1, 7])


@query("cluster_create", f"WITH {CL} SELECT CASE WHEN value >= 'th' AND value < 'ti' THEN {K} + 1 ELSE cluster_id END AS cluster_id, field, value, doc_count FROM st")
def _(spark, sf):
    state = _state(spark, sf)[1]
    return C.create(state, state.filter("value >= 'th' and value < 'ti'"))


@query("cluster_replace", f"WITH {CL} SELECT CASE WHEN value < 'e' THEN 2 ELSE cluster_id END AS cluster_id, field, value, doc_count FROM st WHERE cluster_id <> 2 OR value < 'e'")
def _(spark, sf):
    state = _state(spark, sf)[1]
    return C.replace(state, state.filter("value < 'e'").withColumn("cluster_id", F.lit(2).cast("long")))


@query("facet_clusters", f"WITH {CL}, {QL}, g AS (SELECT cluster_id, CAST(count(*) AS BIGINT) AS d, CAST(count(ql.doc_id) AS BIGINT) AS h FROM cov LEFT JOIN ql USING (doc_id) GROUP BY cluster_id) SELECT cluster_id, d AS doc_count, d / CAST(n AS DOUBLE) AS relative_doc_count, h AS hits, h / CAST(d + q - h AS DOUBLE) AS jaccard_similarity, h / CAST(d AS DOUBLE) AS feature_proportion, h / CAST(q AS DOUBLE) AS query_proportion FROM g, t")
def _(spark, sf):
    i, members, state = _once(spark, sf)
    return C.facet_clusters(members, state, i.lookup(("lang", "en")), i.total())


FF = f"{CL}, {QL}, hh AS (SELECT value, CAST(count(*) AS BIGINT) AS h FROM m JOIN ql USING (doc_id) GROUP BY value), g AS (SELECT cluster_id, field, value, doc_count AS d, coalesce(h, 0) AS h FROM st LEFT JOIN hh USING (value))"


@query("facet_clustering", f"WITH {FF} SELECT cluster_id, field, value, {STATS} FROM g, t")
def _(spark, sf):
    i, members, state = _once(spark, sf)
    return C.facet_features(members, state, i.lookup(("lang", "en")), i.total())


@query("matching_feature_count", f"WITH {FF} SELECT cluster_id, CAST(count(*) FILTER (h > 0) AS BIGINT) AS matching_feature_count FROM g GROUP BY cluster_id")
def _(spark, sf):
    i, members, state = _once(spark, sf)
    return C.matching_features(C.facet_features(members, state, i.lookup(("lang", "en")), i.total()))


XT = f"{CL}, g AS (SELECT lang AS grp, count(*) AS g FROM documents GROUP BY lang), h AS (SELECT d.lang AS grp, cluster_id, count(*) AS h FROM cov JOIN d USING (doc_id) GROUP BY ALL), x AS (SELECT grp, cluster_id, h / CAST(docs_any + g - h AS DOUBLE) AS j FROM h JOIN g USING (grp) JOIN cs USING (cluster_id)), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY j DESC, cluster_id) AS INT) AS cluster_rank FROM x)"


@query("crosstab_top_clusters", f"WITH {XT}, y AS (SELECT d.lang AS grp, cluster_id, field, value, m.doc_count, CAST(count(*) AS BIGINT) AS hits FROM m JOIN d USING (doc_id) GROUP BY ALL), z AS (SELECT grp, cluster_id, cluster_rank, field, value, hits, hits / CAST(doc_count + g - hits AS DOUBLE) AS jaccard_similarity FROM y JOIN r USING (grp, cluster_id) JOIN g USING (grp) WHERE cluster_rank <= 3), q AS (SELECT *, CAST(row_number() OVER (PARTITION BY grp, cluster_id ORDER BY jaccard_similarity DESC, field, value) AS INT) AS rank FROM z) SELECT * FROM q WHERE rank <= 10")
def _(spark, sf):
    i, members, state = _kept(spark, sf)
    return C.crosstab(i, members, state, "lang")


@query("suggested_clustering_fields", "SELECT 'text' AS field")
def _(spark, sf):
    return spark.createDataFrame([(f,) for f in documents(spark, sf).suggested_clustering_fields()], "field string")


@query("cluster_delete_features", f"WITH {CL} SELECT cluster_id, field, value, doc_count FROM st WHERE NOT (value >= 'a' AND value < 'b')")
def _(spark, sf):
    state = _state(spark, sf)[1]
    return C.delete_features(state, state.filter("value >= 'a' and value < 'b'"))


@query("cluster_one", f"WITH {CL} SELECT cluster_id, field, value, doc_count FROM st WHERE cluster_id = 3 ORDER BY doc_count DESC, field, value LIMIT 12")
def _(spark, sf):
    return C.cluster_features(_state(spark, sf)[1], 3, 12)


@query("cluster_labels", f"WITH {CL}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY doc_count DESC, field, value) AS k FROM st) SELECT cluster_id, string_agg(value, ', ' ORDER BY k) AS label FROM r WHERE k <= 3 GROUP BY cluster_id")
def _(spark, sf):
    return C.label(_state(spark, sf)[1])


@query("cluster_recount", f"WITH {CL}, e AS (SELECT value, CAST(count(*) AS BIGINT) AS n FROM p JOIN d USING (doc_id) WHERE lang = 'en' GROUP BY value) SELECT cluster_id, field, value, coalesce(n, 0) AS doc_count FROM st LEFT JOIN e USING (value)")
def _(spark, sf):
    i, _, state = _kept(spark, sf)
    return C.recount(Index(i.docs.filter("lang = 'en'"), i.kinds).membership("text"), state)


@query("browse_clause_of_clusters", f"WITH {CL} SELECT doc_id FROM d WHERE (lang = 'fr' OR doc_id IN (SELECT doc_id FROM cov WHERE cluster_id IN (2, 3))) AND {HAS('the')}")
def _(spark, sf):
    i, members, state = _once(spark, sf)
    return clause_query(i, [[("lang", "fr"), 2, 3], [("text", "the")]], cluster_docs=C.cluster_docs(members, state))


@query("cluster_refine")
def _(spark, sf):
    _, members, state = _once(spark, sf)
    return C.refine(members, state, 10, 42)


@query("cluster_clusters")
def _(spark, sf):
    _, members, state = _once(spark, sf)
    return C.cluster_clusters(C.as_features(members, state), 3, 10, 42)


@query("consensus")
def _(spark, sf):
    i, members, state = _kept(spark, sf)
    return C.consensus(members, [state, C.merge(state, [1, 2])], 3, 10, 42)


@query("browse_clusters", f"WITH {CL}, {QL}, g AS (SELECT cluster_id, CAST(count(*) AS BIGINT) AS d, CAST(count(ql.doc_id) AS BIGINT) AS h FROM cov LEFT JOIN ql USING (doc_id) GROUP BY cluster_id) SELECT cluster_id, h AS hits, h / CAST(d + q - h AS DOUBLE) AS jaccard_similarity FROM g, t WHERE h > 0 ORDER BY jaccard_similarity DESC, cluster_id LIMIT 5")
def _(spark, sf):
    i, members, state = _once(spark, sf)
    return views.browse(i, members, state, [[("lang", "en")]], top_clusters=5).clusters.select("cluster_id", "hits", "jaccard_similarity")


@query("browse_features", f"WITH {FF}, j AS (SELECT cluster_id, field, value, h AS hits, h / CAST(d + q - h AS DOUBLE) AS jaccard_similarity FROM g, t), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY jaccard_similarity DESC, field, value) AS INT) AS rank FROM j) SELECT * FROM r WHERE rank <= 15 OR cluster_id = 2")
def _(spark, sf):
    i, members, state = _kept(spark, sf)
    return views.browse(i, members, state, [[("lang", "en")]], expanded=[2]).features.select("cluster_id", "field", "value", "hits", "jaccard_similarity", "rank")


@query("browse_everything", f"WITH {CL} SELECT cluster_id, CAST(docs_any AS BIGINT) AS doc_count, docs_any / CAST({N} AS DOUBLE) AS jaccard_similarity FROM cs ORDER BY jaccard_similarity DESC, cluster_id LIMIT 30")
def _(spark, sf):
    i, members, state = _once(spark, sf)
    return views.browse(i, members, state, []).clusters.select("cluster_id", "doc_count", "jaccard_similarity")


@query("tabular_spec", "SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0 AND c_acctbal < 1000")
def _(spark, sf):
    i = Index.build(table(spark, sf, "customer"), spec_of(table(spark, sf, "customer"), "c_custkey", ("c_name",)))
    return MatchAll(("c_mktsegment", "BUILDING"), ("c_acctbal", 0.0, 1000.0)).evaluate(i).agg(F.count(F.lit(1)).alias("n"))
