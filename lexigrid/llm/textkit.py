"""Vectorised text primitives over Arrow string columns: byte views, ASCII-space words, 64-bit span hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lexigrid.shipping import ship

#: A slice handed to the vectorised code holds about so many bytes of text; one longer document is a slice of its own.
SLICE_BYTES = 3 << 20
#: Words longer than this are hashed one by one, so that the tables of powers keep a fixed size.
LONG_WORD = 256
_BLOCK = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ROOT = np.uint64(0x9E3779B97F4A7C15)
_tables: list[np.ndarray] = []


def python_stage(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def _powers() -> list[np.ndarray]:
    if not _tables:
        for root in (int(_ROOT), pow(int(_ROOT), -1, 1 << 64)):
            steps = np.full(_BLOCK + LONG_WORD + 1, root, np.uint64)
            steps[0] = 1
            _tables.append(np.multiply.accumulate(steps))
    return _tables


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, in place on a fresh array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each part has about ``limit`` bytes in ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = int(size[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of all rows, and each row's first word (n + 1 entries)."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    inside = ~SPACE[buf]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    full = off[1:] > off[:-1]
    before[off[:-1][full]] = False
    after[off[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; spans are in order and equal bytes have equal hashes, wherever they stand."""
    power, inverse = _powers()
    out = np.empty(len(starts), np.uint64)
    long = np.flatnonzero(ends - starts > LONG_WORD)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(starts, base + _BLOCK - LONG_WORD, "left")))
        top = min(int(ends[to - 1]), base + _BLOCK)
        part = buf[base:top].astype(np.uint64)
        part += np.uint64(1)
        part *= power[: len(part)]
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum(part, out=total[1:])
        s, e = starts[at:to] - base, np.minimum(ends[at:to] - base, len(part))
        out[at:to] = (total[e] - total[s]) * inverse[s]
        at = to
    out += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    out = mix(out)
    for i in long:
        out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def segments(first: np.ndarray) -> np.ndarray:
    """Row number of each item, from each row's first item (n + 1 entries)."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def texts(column: pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return [t or "" for t in column.to_pylist()]
