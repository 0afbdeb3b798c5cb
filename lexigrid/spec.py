"""Declaration of a corpus: its key and how each field becomes features."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrid.functions.tokenize import word_tokens
from lexigrid.functions.values import HANDLERS, SchemaValidationError, ValueHandler

SEQUENCE, SET, SCALAR, RANGE = "sequence", "set", "scalar", "range"


@dataclass(frozen=True)
class FieldSpec:
    """``sequence`` keeps positions and counts, ``set`` distinct members, ``scalar`` one value, ``range`` one ordered value."""

    name: str
    kind: str
    source: str | Column | None = None
    tokeniser: Callable[[Column], Column] = word_tokens

    def column(self, df: DataFrame) -> Column:
        raw = F.col(self.source or self.name) if not isinstance(self.source, Column) else self.source
        kind = df.select(raw).schema[0].dataType
        if self.kind == SEQUENCE:
            return (raw if isinstance(kind, T.ArrayType) else self.tokeniser(raw)).alias(self.name)
        if self.kind == SET:
            return F.array_distinct(F.filter(raw if isinstance(kind, T.ArrayType) else F.array(raw), lambda x: x.isNotNull())).alias(self.name)
        return raw.alias(self.name)


def handler_of(kind: T.DataType) -> ValueHandler:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        kind = T.LongType()
    if isinstance(kind, T.FloatType):
        kind = T.DoubleType()
    if isinstance(kind, T.TimestampNTZType):
        kind = T.TimestampType()
    for h in HANDLERS:
        if h.spark == kind:
            return h
    raise SchemaValidationError(f"no handler for {kind.simpleString()}")


@dataclass(frozen=True)
class CorpusSpec:
    fields: tuple[FieldSpec, ...]
    key: str = "doc_id"
    keep: tuple[str, ...] = field(default=())

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if len(set(names)) < len(names):
            raise SchemaValidationError("two fields have one name")
        if bad := [f.kind for f in self.fields if f.kind not in (SEQUENCE, SET, SCALAR, RANGE)]:
            raise SchemaValidationError(f"no such container: {bad[0]}")

    def project(self, df: DataFrame) -> DataFrame:
        """doc_id and one column for each field; types are checked here, before anything runs."""
        out = df.select(F.col(self.key).cast("long").alias("doc_id"), *self.keep, *(f.column(df) for f in self.fields))
        for f in self.fields:
            kind = out.schema[f.name].dataType
            handler_of(kind.elementType if isinstance(kind, T.ArrayType) else kind)
        return out


def spec_of(df: DataFrame, key: str, text: tuple[str, ...] = ()) -> CorpusSpec:
    """A spec from a table's columns: the named ones are sequences, other scalars of a known type are scalars, the rest is left out."""
    fields = []
    for c in df.schema:
        if c.name == key:
            continue
        if c.name in text:
            fields.append(FieldSpec(c.name, SEQUENCE))
            continue
        try:
            handler_of(c.dataType)
        except SchemaValidationError:
            continue
        fields.append(FieldSpec(c.name, SCALAR))
    return CorpusSpec(tuple(fields), key)
