"""Positions: phrases by join, passages, concordances and collocates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.values import Feature, check_feature
from lexigrid.operators.index import Index, running_sum, within


def fits(x: Column, feature: Feature) -> Column:
    return x == F.lit(feature[1]) if len(feature) == 2 else within(x, feature[1], feature[2])


def hits(index: Index, features: Sequence[Feature]) -> DataFrame:
    """(doc_id, pos, value) of a sequence's positions that match any of the features: from the postings of a stored index, else filtered inside the
    document row, before exploding."""
    fs = [check_feature(f) for f in features]
    field = fs[0][0]
    if index.stored is not None:
        found = index.stored.filter((F.col("field") == field) & _any([fits(F.col("value"), f) for f in fs]))
        return found.select("doc_id", F.explode("positions").alias("pos"), "value").select("doc_id", F.col("pos").cast("long").alias("pos"), "value")
    ok = lambda x: _any([fits(x, f) for f in fs])
    rows = index.docs.select("doc_id", F.explode(F.filter(F.transform(field, lambda v, i: F.struct(i.cast("long").alias("pos"), v.alias("value"))), lambda s: ok(s["value"]))).alias("h"))
    return rows.select("doc_id", "h.pos", "h.value")


def _any(cs: list[Column]) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out = out | c
    return out


def passage_layout(index: Index, field: str) -> DataFrame:
    """(doc_id, n, passages, first_passage): blocks of passage_size tokens, one blank block after each document.

    First passages are prefix sums over ids; ids are cut into ranges, so no task sees all documents."""
    size = index.passage_size
    per = index.docs.select("doc_id", F.size(field).cast("long").alias("n")).filter("n > 0").withColumn("passages", (F.ceil(F.col("n") / size) + 1).cast("long"))
    return running_sum(per, "doc_id", "passages", "_upto").select("doc_id", "n", "passages", (F.col("_upto") - F.col("passages")).alias("first_passage"))


def feature_passages(index: Index, feature: Feature) -> DataFrame:
    """(doc_id, passage) inside the document: those with the feature and each one's next."""
    p = hits(index, [feature]).select("doc_id", F.floor(F.col("pos") / index.passage_size).cast("long").alias("p"))
    return p.select("doc_id", F.explode(F.array(F.col("p"), F.col("p") + 1)).alias("passage")).distinct()


#: Passages of one bucket when passage numbers meet documents.
BUCKET = 4096


def passages_to_docs(passages: DataFrame, layout: DataFrame) -> DataFrame:
    """(doc_id) of global passage numbers (passage), by the layout's ranges. Both sides go to buckets of BUCKET numbers; a document is in each
    bucket that it reaches into, so one row stands for many passages and no passage is spelled out."""
    last = F.col("first_passage") + F.col("passages") - 1
    own = layout.select("doc_id", "first_passage", last.alias("last"), F.explode(F.sequence(F.floor(F.col("first_passage") / BUCKET), F.floor(last / BUCKET))).alias("bucket"))
    wanted = passages.select("passage", F.floor(F.col("passage") / BUCKET).alias("bucket")).distinct()
    both = own.join(wanted, "bucket").filter("passage between first_passage and last")
    return both.select("doc_id").distinct()


def phrase_by_position(index: Index, features: Sequence[Feature]) -> DataFrame:
    """(doc_id): positions shifted by their place in the phrase meet at its start. For indexes kept as location tables."""
    parts = None
    for k, f in enumerate(features):
        p = hits(index, [f]).select("doc_id", (F.col("pos") - k).alias("at"), F.lit(k).alias("k"))
        parts = p if parts is None else parts.unionByName(p)
    got = parts.groupBy("doc_id", "at").agg(F.count_distinct("k").alias("n")).filter(F.col("n") == len(features))
    return got.select("doc_id").distinct()


def concordance(index: Index, feature: Feature, window: int = 10, display: Column | None = None) -> DataFrame:
    """(doc_id, pos, value, before, match, after): matching on index tokens, showing ``display`` tokens if given."""
    field = feature[0]
    shown = display if display is not None else F.col(field)
    lines = index.docs.withColumn("_shown", shown).select("doc_id", "_shown", F.explode(F.filter(F.transform(field, lambda v, i: F.struct(i.alias("pos"), v.alias("value"))), lambda s: fits(s["value"], feature))).alias("h"))
    pos = F.col("h.pos")
    return lines.select(
        "doc_id", pos.cast("long").alias("pos"), F.col("h.value").alias("value"),
        F.slice("_shown", F.greatest(pos - window, F.lit(0)) + 1, pos - F.greatest(pos - window, F.lit(0))).alias("before"),
        F.get("_shown", pos).alias("match"),
        F.slice("_shown", pos + 2, window).alias("after"),
    )


def collocates(index: Index, feature: Feature, window: int = 5) -> DataFrame:
    """(value, n): tokens within the window of a match, counted."""
    lines = concordance(index, feature, window)
    return lines.select(F.explode(F.concat("before", "after")).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def passages(index: Index, field: str, starts: DataFrame, size: int, display: Column | None = None) -> DataFrame:
    """(doc_id, start, end, tokens) for (doc_id, start); the end is not clipped, the tokens are."""
    shown = display if display is not None else F.col(field)
    both = index.docs.select("doc_id", shown.alias("_shown")).join(starts, "doc_id").filter(F.col("start") < F.size("_shown"))
    return both.select("doc_id", "start", (F.col("start") + size).alias("end"), F.slice("_shown", (F.col("start") + 1).cast("int"), size).alias("tokens"))


def highlight(index: Index, field: str, features: Sequence[Feature], left: str = "[", right: str = "]") -> DataFrame:
    """(doc_id, text): the tokens joined by spaces, matches marked."""
    mark = lambda x: F.when(_any([fits(x, f) for f in features]), F.concat(F.lit(left), x, F.lit(right))).otherwise(x)
    return index.docs.select("doc_id", F.array_join(F.transform(field, mark), " ").alias("text"))


def concordance_html(lines: DataFrame) -> DataFrame:
    """(doc_id, pos, html): a table row for each line."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cell = lambda c: F.concat(F.lit("<td>"), safe(c), F.lit("</td>"))
    return lines.select("doc_id", "pos", F.concat(F.lit("<tr>"), cell(F.array_join("before", " ")), F.lit("<td><mark>"), safe(F.col("match")), F.lit("</mark></td>"), cell(F.array_join("after", " ")), F.lit("</tr>")).alias("html"))
