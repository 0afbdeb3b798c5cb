"""Postings of a document, grouped where the document is read: no shuffle, and no buffer a posting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Documents grouped at a time.
BLOCK = 1000


def grouped(batches: Iterator[pa.RecordBatch], spots: bool) -> Iterator[pa.RecordBatch]:
    """(value, doc_id, tf, positions) of rows (doc_id, tokens); positions are increasing, or null if they aren't wanted."""
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            docs, lists = (batch.column(c).slice(at, BLOCK) for c in ("doc_id", "tokens"))
            size = pc.list_value_length(lists).fill_null(0).to_numpy()
            tokens = lists.flatten().dictionary_encode(null_encoding="encode")
            if not len(tokens):
                continue
            width = len(tokens.dictionary)
            key = np.repeat(np.arange(len(size)), size) * width + tokens.indices.to_numpy()
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
            row, value = np.divmod(key[order][first], width)
            ends = np.r_[first, len(tokens)]
            positions = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place[order].astype(np.int32))) if spots else pa.nulls(len(first), pa.list_(pa.int32()))
            yield pa.record_batch([tokens.dictionary.take(pa.array(value)), docs.take(pa.array(row)), pa.array(np.diff(ends).astype(np.int64)), positions], names=["value", "doc_id", "tf", "positions"])
