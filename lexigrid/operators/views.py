"""The tables behind the exploration views: field overview, one field, and a clause query over a clustering."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.operators import clusters as C
from lexigrid.operators import facets
from lexigrid.operators.index import Index
from lexigrid.operators.query import clause_query
from lexigrid.storage import materialize

TOP_FEATURES, TOP_CLUSTERS, SAMPLE = 15, 30, 20


@dataclass(frozen=True)
class Panel:
    """A titled list of a field's features."""

    title: str
    fields: tuple[str, ...]
    order_by: str = "jaccard_similarity"
    first_k: int = TOP_FEATURES
    keep_above: float = 0


def overview(index: Index) -> DataFrame:
    return index.field_summary()


def field_view(index: Index, field: str, min_docs: int = 10, top_k: int | None = None) -> DataFrame:
    return facets.field_features(index, field, min_docs, top_k)


def field_page(index: Index, field: str, min_docs: int = 10, top_k: int | None = None, sample: int = SAMPLE, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """A field's features, and a sample of documents beside them."""
    return field_view(index, field, min_docs, top_k), facets.sample_docs(index, sample, seed)


def panels(index: Index, ids: DataFrame, wanted: Sequence[Panel]) -> dict[str, DataFrame]:
    """Each panel's features against the documents (doc_id)."""
    return {p.title: facets.table_filter(facets.facet_by_ids(index, ids, *p.fields), p.order_by, True, p.first_k, p.keep_above) for p in wanted}


@dataclass(frozen=True)
class Browse:
    """What the main view shows of a query."""

    docs: DataFrame
    clusters: DataFrame
    features: DataFrame
    matching: DataFrame
    sample: DataFrame


def browse(index: Index, members: DataFrame, state: DataFrame, clauses: Sequence[Sequence], expanded: Sequence[int] = (), top_clusters: int = TOP_CLUSTERS, top_features: int = TOP_FEATURES, sample: int = SAMPLE, seed: int = 0) -> Browse:
    """Clusters by likeness to the query, then the features of those alone, then a sample of documents.

    Without clauses every document matches and nothing needs to be counted against the query: the likeness is the relative count."""
    total = index.total()
    if not clauses:
        s = C.summary(members, state, total)
        top = s.select("cluster_id", "doc_count", "relative_doc_count", F.col("relative_doc_count").alias("jaccard_similarity"), "feature_count")
        top = materialize(facets.table_filter(top, "jaccard_similarity", True, top_clusters, 0, ("cluster_id",)), "browse-clusters")
        feats = state.join(F.broadcast(top.select("cluster_id")), "cluster_id", "left_semi").withColumn("jaccard_similarity", F.col("doc_count") / F.lit(total)).withColumn("hits", F.col("doc_count"))  # top_clusters rows
        ids = index.all_doc_ids()
    else:
        named = {c for clause in clauses for c in clause if isinstance(c, int)}
        in_clusters = C.cluster_docs(members, state.filter(F.col("cluster_id").isin(list(named)))) if named else None
        ids = materialize(clause_query(index, clauses, cluster_docs=in_clusters), "browse-docs")
        top = materialize(facets.table_filter(C.facet_clusters(members, state, ids, total), "jaccard_similarity", True, top_clusters, 0, ("cluster_id",)), "browse-clusters")
        kept = state.join(F.broadcast(top.select("cluster_id")), "cluster_id", "left_semi")  # top_clusters rows
        feats = C.facet_features(members, kept, ids, total)
    matching = C.matching_features(feats)
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("jaccard_similarity"), *C.FEATURE))
    shown = feats.withColumn("rank", rank).filter((F.col("rank") <= top_features) | F.col("cluster_id").isin(list(expanded) or [-1]))
    docs = facets.sample_docs(Index(index.fetch(ids), index.kinds, index.passage_size), sample, seed)
    return Browse(ids, top, shown, matching, docs)


def neighbours(state_ids: Sequence[int], cluster_id: int) -> dict[str, int]:
    """First, previous, next and last cluster, going round at the ends."""
    ids = sorted(state_ids)
    at = ids.index(cluster_id)
    return {"first": ids[0], "previous": ids[at - 1], "next": ids[(at + 1) % len(ids)], "last": ids[-1]}


def export_html(df: DataFrame, limit: int) -> str:
    """The first rows as an HTML table; a report for people, so it has a limit."""
    from html import escape

    cell = lambda tag, v: f"<{tag}>{escape('' if v is None else str(v))}</{tag}>"
    rows = ["<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in df.limit(limit).collect()]
    return "<table><tr>" + "".join(cell("th", c) for c in df.columns) + "</tr>" + "".join(rows) + "</table>"
