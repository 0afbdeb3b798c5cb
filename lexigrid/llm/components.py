"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.storage import materialize

#: Up to so many edges (16 bytes each) are joined on the driver; beyond, components are found by rounds of joins.
DRIVER_EDGES = 400_000


def components(edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(id, component) for every id in (a, b): component is the smallest id that it is linked with, over any number of links.

    Both ways give the same result. Rounds alternate taking the least label of a node and its neighbours with jumping to
    the label's own label. A node with very many links is met by its neighbours' rows, which adaptive skew joins split,
    and its least label is taken by partial aggregation.
    """
    spark = edges.sparkSession
    pairs = edges.select("a", "b").limit(driver_edges + 1).toPandas() if driver_edges else None
    if pairs is not None and len(pairs) <= driver_edges:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for a, b in zip(pairs["a"].tolist(), pairs["b"].tolist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                up[max(ra, rb)] = min(ra, rb)
        return _frame(spark, [(x, root(x)) for x in sorted(up)])
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    label = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(label, both["b"] == label["id"]).groupBy("a").agg(F.min("component").alias("low"))
        step = label.join(near, label["id"] == near["a"]).select("id", F.least("component", "low").alias("component"), F.col("component").alias("was"))
        jump = step.select(F.col("id").alias("at"), F.col("component").alias("far"))
        new = step.join(jump, step["component"] == jump["at"]).select("id", F.least("component", "far").alias("component"), "was")
        new = materialize(new, "labels")
        label = new.select("id", "component")
        if not new.filter("component <> was").limit(1).count():
            return label


def _frame(spark, rows: list[tuple[int, int]]) -> DataFrame:
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"id": pd.Series([r[0] for r in rows], dtype="int64"), "component": pd.Series([r[1] for r in rows], dtype="int64")}), "id bigint, component bigint")
