"""Codecs of scalar values, and of features, for text, URLs and query strings."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import date, datetime
from html import escape
from urllib.parse import parse_qsl, quote, unquote, urlencode

from pyspark.sql import types as T


class SchemaValidationError(Exception):
    """A field or a handler registry contradicts itself."""


@dataclass(frozen=True)
class ValueHandler:
    """One scalar type: its Python type, Spark type and text form."""

    name: str
    python: type
    spark: T.DataType

    def to_str(self, value) -> str:
        return value.isoformat() if isinstance(value, date) else repr(value) if self.python is float else str(value)

    def from_str(self, text: str):
        return self.python.fromisoformat(text) if self.python in (date, datetime) else self.python(text)

    def to_url(self, value) -> str:
        return quote(self.to_str(value), safe="")

    def from_url(self, text: str):
        return self.from_str(unquote(text))

    def to_html(self, value) -> str:
        return escape(self.to_str(value))


STRING = ValueHandler("str", str, T.StringType())
INTEGER = ValueHandler("int", int, T.LongType())
FLOAT = ValueHandler("float", float, T.DoubleType())
DATE = ValueHandler("date", date, T.DateType())
DATETIME = ValueHandler("datetime", datetime, T.TimestampType())
HANDLERS = (STRING, INTEGER, FLOAT, DATE, DATETIME)


class Registry:
    """Handlers by exact Python type and by name; either must be unique."""

    def __init__(self, handlers: Iterable[ValueHandler] = HANDLERS):
        self.by_type: dict[type, ValueHandler] = {}
        self.by_name: dict[str, ValueHandler] = {}
        for h in handlers:
            self.add(h)

    def add(self, handler: ValueHandler) -> None:
        if handler.name in self.by_name or handler.python in self.by_type:
            raise SchemaValidationError(f"{handler.name} or its type is taken")
        self.by_name[handler.name] = self.by_type[handler.python] = handler

    def of(self, value) -> ValueHandler:
        if type(value) not in self.by_type:
            raise TypeError(f"no handler for {type(value).__name__}")
        return self.by_type[type(value)]


Feature = tuple  # (field, value) or (field, start, end): start inclusive, end exclusive, at most one of them None


def check_feature(feature: Sequence) -> Feature:
    feature = tuple(feature)
    if len(feature) not in (2, 3):
        raise ValueError("a feature has a field and a value, or a field, a start and an end")
    if len(feature) == 3 and feature[1] is None and feature[2] is None:
        raise ValueError("a range needs a start or an end")
    if len(feature) == 2 and feature[1] is None:
        raise ValueError("a literal feature needs a value")
    return feature


class FeatureCodec:
    """Features as URL paths, query strings and HTML, with each field's handler."""

    def __init__(self, handlers: dict[str, ValueHandler]):
        self.handlers = handlers

    def _of(self, field: str) -> ValueHandler:
        if field not in self.handlers:
            raise KeyError(field)
        return self.handlers[field]

    def to_url(self, feature: Feature) -> str:
        field, *values = check_feature(feature)
        h = self._of(field)
        return "/".join([quote(field, safe=""), *("" if v is None else h.to_url(v) for v in values)])

    def from_url(self, url: str) -> Feature:
        field, *values = url.split("/")
        field = unquote(field)
        h = self._of(field)
        made = [h.from_url(v) if v or len(values) == 1 else None for v in values]
        return check_feature((field, *made))

    def to_pairs(self, feature: Feature) -> list[tuple[str, str]]:
        field, *values = check_feature(feature)
        h = self._of(field)
        keys = ("v",) if len(values) == 1 else ("v1", "v2")
        return [("f", field), *((k, h.to_str(v)) for k, v in zip(keys, values) if v is not None)]

    def to_querystring(self, feature: Feature) -> str:
        return urlencode(self.to_pairs(feature))

    def from_pairs(self, pairs: Sequence[tuple[str, str]]) -> Feature:
        if not pairs or pairs[0][0] != "f":
            raise ValueError("a feature starts with its field")
        field, rest = pairs[0][1], dict(pairs[1:])
        h = self._of(field)
        if "v" in rest:
            return check_feature((field, h.from_str(rest["v"])))
        return check_feature((field, *(h.from_str(rest[k]) if k in rest else None for k in ("v1", "v2"))))

    def from_querystring(self, text: str) -> Feature:
        return self.from_pairs(parse_qsl(text, keep_blank_values=True))

    def to_html(self, feature: Feature) -> str:
        field, *values = check_feature(feature)
        h = self._of(field)
        shown = [h.to_html(v) if v is not None else "" for v in values]
        return f"{escape(field)}: {shown[0]}" if len(shown) == 1 else f"{escape(field)}: [{shown[0]} - {shown[1]})"


_SUFFIXES = ((1e9, "G"), (1e6, "M"), (1e3, "k"), (1.0, ""), (1e-3, "m"), (1e-6, "μ"), (1e-9, "n"))


def si_magnitude(x: float) -> str:
    """Three significant digits with an SI suffix."""
    if x == 0:
        return "0"
    for scale, suffix in _SUFFIXES:
        if abs(x) >= scale:
            return f"{x / scale:.3g}{suffix}"
    return f"{x:.3g}"


def similarity_text(x: float) -> str:
    """Three decimals without the leading zero."""
    return f"{x:.3f}".replace("0.", ".", 1) if 0 <= x < 1 else f"{x:.3f}"
