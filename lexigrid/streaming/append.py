"""New documents appended to an index's tables as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexigrid.operators.index import Index
from lexigrid.spec import CorpusSpec


def append_documents(stream: DataFrame, spec: CorpusSpec, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch's documents and postings go to a folder named by its number, so a batch that runs again replaces its own files. The folder
    is an index that Index.read() opens at any time after the first batch."""

    def write(batch: DataFrame, number: int) -> None:
        index = Index.build(batch, spec)
        index.docs.write.mode("overwrite").parquet(f"{path}/docs/batch={number}")
        if index.arrays:
            index.located().sortWithinPartitions("field", "value", "doc_id").write.mode("overwrite").parquet(f"{path}/postings/batch={number}")

        index.settings().write.mode("overwrite").text(f"{path}/settings")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
