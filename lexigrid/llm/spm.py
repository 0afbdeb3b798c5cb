"""Encoding and decoding with a SentencePiece model on the tokenizers library.

The model's protobuf is parsed here; its normaliser, metaspace marker, pieces with scores and byte fallback are rebuilt.
A unigram model becomes a Unigram model with the same scores; a BPE model becomes merges ranked by the merged piece's
score. Words can be split before merging when no piece holds the marker behind another character, which is read from
the vocabulary. Batches are encoded by the library's threads. Parity with the sentencepiece library is checked for
every text unless switched off.

Defined cases: null text counts as empty and has no ids; strings that look like control pieces are ordinary text;
repeated rows and ids all stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.textkit import python_stage, slices, texts
from lexigrid.storage import spread

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THREADS = 2
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message: ints for varints, bytes for the rest."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size = varint()
            yield key >> 3, data[at : at + size]
            at += size


def parse_model(data: bytes) -> dict:
    """Pieces (text, score, kind) and the settings that encoding needs."""
    pieces: list[tuple[str, float, int]] = []
    model = {"pieces": pieces, "type": 1, "byte_fallback": False, "unk": 0, "charsmap": b"", "dummy_prefix": True, "strip": True, "escape": True}
    for n, v in _fields(data):
        if n == 1:
            f = dict(_fields(v))
            pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif n == 2:
            f = dict(_fields(v))
            model |= {"type": f.get(3, 1), "byte_fallback": bool(f.get(35, 0)), "unk": f.get(40, 0)}
        elif n == 3:
            f = dict(_fields(v))
            model |= {"charsmap": f.get(2, b""), "dummy_prefix": bool(f.get(3, 1)), "strip": bool(f.get(4, 1)), "escape": bool(f.get(5, 1))}
    return model


def build(model: dict):
    """A tokenizers.Tokenizer with the model's behaviour."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    pieces = model["pieces"]
    steps = []
    if model["charsmap"]:
        steps.append(normalizers.Precompiled(model["charsmap"]))
    if model["strip"]:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model["dummy_prefix"]:
        steps.append(normalizers.Prepend(MARK))
    if model["escape"]:
        steps.append(normalizers.Replace(" ", MARK))
    unk = next((p for p, _, k in pieces if k == UNKNOWN), None)
    if model["type"] == 1:
        core = models.Unigram([(p, s) for p, s, _ in pieces], model["unk"], model["byte_fallback"])
    elif model["type"] == 2:
        score = {p: s for p, s, k in pieces if k in (NORMAL, USER)}
        merges = [(-s, -i, p[:i], p[i:]) for p, s in score.items() for i in range(1, len(p)) if p[:i] in score and p[i:] in score]
        merges.sort()  # of equal scores the longer left part first: a run then grows from its left end
        core = models.BPE(vocab={p: i for i, (p, _, _) in enumerate(pieces)}, merges=[(a, b) for _, _, a, b in merges], unk_token=unk, fuse_unk=True, byte_fallback=model["byte_fallback"])
    else:
        raise ValueError("only unigram and BPE models can be rebuilt")
    t = Tokenizer(core)
    if steps:
        t.normalizer = normalizers.Sequence(steps)
    if not any(MARK in p.lstrip(MARK) for p, _, k in pieces if k in (NORMAL, USER)):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    tail = [decoders.Strip(" ", 1, 0)] if model["dummy_prefix"] else []
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return t


def load(model: str | bytes = MODEL, threads: int = THREADS):
    """A tokenizer from a model's path or bytes."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    return build(parse_model(read_model(model)))


def read_model(model: str | bytes) -> bytes:
    if isinstance(model, bytes):
        return model
    with open(model, "rb") as f:
        return f.read()


@lru_cache(maxsize=1)
def _core(raw: bytes, threads: int, by_units: bool) -> tuple:
    """(tokenizer, its normalizer, settings, which pieces open with a marker, whether by units). Kept for all tasks of a worker: the library
    never gives back some 10 MB of a tokenizer that has been used, so one a task would fill the worker in the end."""
    parsed = parse_model(raw)
    core = load(raw, threads)
    normalizer = core.normalizer
    by_units = by_units and core.pre_tokenizer is not None
    if by_units:
        core.normalizer = None
    opens = np.array([p[:1] == MARK for p, _, _ in parsed["pieces"]])
    return core, normalizer, {k: v for k, v in parsed.items() if k != "pieces"}, opens, by_units


class Index(dict):
    """Numbers units as they are first met and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = at = len(self)
        self.new.append(unit)
        return at


class Encoder:
    """Encodes batches of texts by their units, each a run of markers with what follows.

    Units never share a piece if no piece holds a marker behind another character, so a text's ids are its units' ids in a
    row. Each unit that a task has not met is encoded once, by the library, in multithreaded batches, and decoded by it to see that it comes back.
    Models without that property are encoded and decoded text by text."""

    #: Units that are remembered before the table starts anew.
    MEMORY = 300_000

    def __init__(self, model: str | bytes = MODEL, threads: int = THREADS, by_units: bool = True):
        self.core, self.normalizer, parsed, self.opens, self.by_units = _core(read_model(model), threads, by_units)
        self.plain = not parsed["charsmap"] and not parsed["strip"] and parsed["escape"]
        self.prefix = parsed["dummy_prefix"]
        self.pattern = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.reset()

    def reset(self) -> None:
        self.index = Index()
        self.ids = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.start = self.size = np.zeros(0, np.int64)
        self.back = np.zeros(0, bool)

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        if self.plain:
            text = (MARK if self.prefix else "") + text.replace(" ", MARK)
        else:
            text = self.normalizer.normalize_str(text) if self.normalizer else text
        parts = text.split(MARK)
        if "" not in parts[1:] and not parts[0]:
            return parts[1:]  # each stands for itself behind one marker
        # any other unit has one marker more in front: no key of the first kind holds a marker, so the two never meet
        return [u[1:] if u[:1] == MARK and u[1:2] != MARK and len(u) > 1 else MARK + u for u in self.pattern.findall(text)]

    def learn(self, new: list[str]) -> None:
        """Ids of units: those behind one marker are encoded and decoded in long strings, which the library splits at the markers;
        others, and strings that don't come back, unit by unit."""
        full = [u[1:] if u[0] == MARK else MARK + u for u in new]
        start, size, back = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), np.ones(len(new), bool)
        made: list[np.ndarray] = []
        used = self.used

        def keep(i, ids: np.ndarray, first: np.ndarray) -> None:
            nonlocal used
            start[i], size[i] = used + first, np.diff(np.append(first, len(ids)))
            made.append(ids)
            used += len(ids)

        plain = [i for i, u in enumerate(new) if u[0] != MARK]
        single = [i for i, u in enumerate(new) if u[0] == MARK]
        parts = [plain[at : at + 1000] for at in range(0, len(plain), 1000)]
        strings = ["".join(map(full.__getitem__, p)) for p in parts]
        lists = [e.ids for e in self.core.encode_batch_fast(strings, add_special_tokens=False)]
        for part, text, ids, again in zip(parts, strings, lists, self.core.decode_batch(lists, skip_special_tokens=False)):
            ids_ = np.array(ids, np.int32)
            first = np.flatnonzero(self.opens[ids_])
            if again == self.shown(text) and len(first) == len(part):
                keep(part, ids_, first)
            else:
                single += part
        lists = [e.ids for e in self.core.encode_batch_fast([full[i] for i in single], add_special_tokens=False)]
        for i, ids, again in zip(single, lists, self.core.decode_batch(lists, skip_special_tokens=False)):
            keep([i], np.array(ids, np.int32), np.zeros(1, np.int64))
            back[i] = again == self.shown(full[i])
        self.start, self.size, self.back = np.concatenate([self.start, start]), np.concatenate([self.size, size]), np.concatenate([self.back, back])
        while used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : used] = np.concatenate(made)
        self.used = used

    def shown(self, unit: str) -> str:
        text = unit.replace(MARK, " ")
        return text[1:] if self.prefix and text[:1] == " " else text

    def batch(self, body: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """(all ids, offsets of the texts in them, whether each text decodes to itself)."""
        if not self.by_units:
            ids = [e.ids for e in self.core.encode_batch_fast(body, add_special_tokens=False)]
            back = self.core.decode_batch(ids, skip_special_tokens=False)
            off = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
            return np.array([x for i in ids for x in i], np.int32), off, [a == b.replace(MARK, " ") for a, b in zip(back, body)]
        if len(self.index) > self.MEMORY:
            self.reset()
        units = [self.units(t) for t in body]
        first = np.concatenate([[0], np.cumsum([len(us) for us in units])]).astype(np.int64)
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(units)), np.int64, int(first[-1]))
        if self.index.new:
            self.learn(self.index.new)
            self.index.new = []
        size, start = self.size[at], self.start[at]
        end = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(end[-1]) + np.repeat(start - end[:-1], size)]
        bad = np.concatenate([[0], np.cumsum(~self.back[at])])
        return ids, end[first], (bad[first[1:]] == bad[first[:-1]]).tolist()


def same_ids(lists: list, ids: np.ndarray, off: np.ndarray) -> list[bool]:
    """Whether each list or array equals its part of ``ids``."""
    if [len(x) for x in lists] != np.diff(off).tolist():
        return [np.array_equal(x, ids[a:b]) for x, a, b in zip(lists, off[:-1], off[1:])]
    bad = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int32), *lists]) != ids)])
    return (bad[off[1:]] == bad[off[:-1]]).tolist()


def encoded(t: Encoder, other, body: list[str]) -> tuple[pa.Array, list[bool], list]:
    """(ids, whether they decode to the text, parity) of every text; a text that recurs is handed to each library once."""
    number: dict[str, int] = {}
    at = [number.setdefault(x, len(number)) for x in body]
    once = list(number)
    ids, off, same = t.batch(once)
    parity = same_ids(other.encode(once, out_type="numpy", num_threads=1), ids, off) if other else [None] * len(once)
    lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))
    if len(once) < len(body):
        lists, same, parity = lists.take(pa.array(at)), [same[i] for i in at], [parity[i] for i in at]
    return lists, same, parity


def encode(docs: DataFrame, path: str = MODEL, verify: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_chars, decoded_same, parity): token ids of every whole text; whether decoding them gives the text again
    (a marker counts as a space), and whether the sentencepiece library has the same ids (null if not verified)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(read_model(path))  # the driver's file; its size is the vocabulary's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Encoder(model.value)
        other = None
        if verify:
            import sentencepiece

            other = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        for part in slices(batches, "text", 1 << 20):
            body = texts(part.column("text"))
            lists, same, parity = encoded(t, other, body)
            yield pa.RecordBatch.from_arrays([part.column("id"), lists, pa.array(map(len, body), pa.int64()), pa.array(same, pa.bool_()), pa.array(parity, pa.bool_())], ["id", "ids", "n_chars", "decoded_same", "parity"])

    return rows.transform(python_stage, run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, n_chars bigint, decoded_same boolean, parity boolean")


def decode(rows: DataFrame, path: str = MODEL, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from token ids; null ids give null."""
    got = rows.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    model = rows.sparkSession.sparkContext.broadcast(read_model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(model.value)
        for b in batches:
            ids = b.column("ids").to_pylist()
            back = t.decode_batch([x or [] for x in ids], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([None if i is None else s for i, s in zip(ids, back)], pa.string())], ["id", "text"])

    return got.transform(python_stage, run, f"id {got.schema['id'].dataType.simpleString()}, text string")


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    got = encode(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return got.select(F.col("id").alias("doc_id"), "n_chars", F.size("ids").cast("long").alias("n_tokens"), "decoded_same", "parity", "ids")
