"""Composable queries: compiled to one predicate on the document row, so a whole query is a single scan without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.values import Feature, FeatureCodec, check_feature
from lexigrid.operators.index import Index, within
from lexigrid.spec import SEQUENCE


class Query:
    """A node; ``column`` compiles it for an index."""

    kind = ""

    def column(self, index: Index) -> Column:
        raise NotImplementedError

    def ids(self, index: Index) -> DataFrame:
        """(doc_id), distinct, from the postings of a stored index."""
        raise NotImplementedError

    def evaluate(self, index: Index) -> DataFrame:
        """(doc_id) of the matching documents: set operations on postings if the index is stored, else one predicate on the document rows."""
        if index.stored is not None:
            return self.ids(index)
        return index.docs.filter(self.column(index)).select("doc_id")


@dataclass(frozen=True)
class Has(Query):
    """A single feature, literal or range."""

    feature: Feature
    kind = "has"

    def ids(self, index: Index) -> DataFrame:
        return index.lookup(self.feature)

    def column(self, index: Index) -> Column:
        return index.predicate(self.feature)


def _node(x) -> Query:
    return x if isinstance(x, Query) else Has(check_feature(x))


class _Many(Query):
    def __init__(self, *args):
        self.args = tuple(_node(a) for a in args)

    def __eq__(self, other):
        return type(self) is type(other) and self.args == other.args

    def __hash__(self):
        return hash((self.kind, self.args))

    def __repr__(self):
        return f"{type(self).__name__}{self.args!r}"


class MatchAny(_Many):
    """Documents with any of the arguments; none without arguments."""

    kind = "any"

    def ids(self, index: Index) -> DataFrame:
        out = index.docs.select("doc_id").filter("false")
        for a in self.args:
            out = out.union(a.ids(index))
        return out.distinct()

    def column(self, index: Index) -> Column:
        out = F.lit(False)
        for a in self.args:
            out = out | a.column(index)
        return out


class MatchAll(_Many):
    """Documents with all of the arguments; none without arguments."""

    kind = "all"

    def ids(self, index: Index) -> DataFrame:
        if not self.args:
            return index.docs.select("doc_id").filter("false")
        out = self.args[0].ids(index)
        for a in self.args[1:]:
            out = out.join(a.ids(index), "doc_id", "left_semi")
        return out

    def column(self, index: Index) -> Column:
        if not self.args:
            return F.lit(False)
        out = self.args[0].column(index)
        for a in self.args[1:]:
            out = out & a.column(index)
        return out


class AndNot(_Many):
    """Documents with the first argument and none of the others."""

    kind = "not"

    def ids(self, index: Index) -> DataFrame:
        out = self.args[0].ids(index)
        for a in self.args[1:]:
            out = out.join(a.ids(index), "doc_id", "left_anti")
        return out

    def column(self, index: Index) -> Column:
        return self.args[0].column(index) & ~MatchAny(*self.args[1:]).column(index)


@dataclass(frozen=True)
class MatchPhrase(Query):
    """Features of one sequence at consecutive positions of one document; ranges may be elements."""

    features: tuple
    kind = "phrase"

    def checked(self, index: Index) -> list[Feature]:
        fs = [check_feature(f) for f in self.features]
        if len({f[0] for f in fs}) > 1:
            raise ValueError("a phrase has one field")
        if fs and index.kinds.get(fs[0][0]) != SEQUENCE:
            raise ValueError(f"{fs[0][0]} has no positions")
        return fs

    def ids(self, index: Index) -> DataFrame:
        from lexigrid.operators.positions import phrase_by_position

        fs = self.checked(index)
        return phrase_by_position(index, fs) if fs else index.docs.select("doc_id").filter("false")

    def column(self, index: Index) -> Column:
        fs = self.checked(index)
        if not fs:
            return F.lit(False)
        field = fs[0][0]
        k = len(fs)

        def fits(x: Column, f: Feature) -> Column:
            return x == F.lit(f[1]) if len(f) == 2 else within(x, f[1], f[2])

        def inside(t: Column) -> Column:
            def at(i: Column) -> Column:
                out = fits(F.get(t, i), fs[0])
                for j in range(1, k):
                    out = out & fits(F.get(t, i + j), fs[j])
                return out

            quick = F.array_contains(t, F.lit(fs[0][1])) if len(fs[0]) == 2 else F.lit(True)
            return quick & (F.size(t) >= k) & F.exists(F.sequence(F.lit(0), F.greatest(F.size(t) - k, F.lit(0))), at)

        # the tokens are bound once a row: inlined, they would be made anew at every position
        return F.coalesce(F.exists(F.array(F.col(field)), inside), F.lit(False))


REGISTRY: dict[str, type] = {c.kind: c for c in (MatchAny, MatchAll, AndNot)}


# --- rows of (key, value): qt type, a arity, f field, v or v1 / v2 ---


def to_rows(query: Query, codec: FeatureCodec) -> list[tuple[str, str]]:
    if isinstance(query, Has):
        return codec.to_pairs(query.feature)
    args = [Has(f) for f in query.features] if isinstance(query, MatchPhrase) else query.args
    rows = [("qt", query.kind), ("a", str(len(args)))]
    for a in args:
        rows += to_rows(a, codec)
    return rows


def from_rows(rows: Sequence[tuple[str, str]], codec: FeatureCodec) -> Query:
    rows, at = list(rows), 0

    def node() -> Query:
        nonlocal at
        key, value = rows[at]
        at += 1
        if key == "qt":
            n = int(rows[at][1])
            at += 1
            args = [node() for _ in range(n)]
            return MatchPhrase(tuple(a.feature for a in args)) if value == "phrase" else REGISTRY[value](*args)
        if key != "f":
            raise ValueError(f"unexpected {key!r}")
        start = at - 1
        while at < len(rows) and rows[at][0] in ("v", "v1", "v2"):
            at += 1
        return Has(codec.from_pairs(rows[start:at]))

    made = node()
    if at != len(rows):
        raise ValueError("rows are left over")
    return made


# --- clause queries: all of the clauses, any component of each; a component is a feature or a cluster id ---


def clause_predicate(index: Index, clauses: Sequence[Sequence], clusters: dict[int, Sequence[Feature]] | None = None) -> Column:
    out = F.lit(True)
    for clause in clauses:
        parts: list = []
        for c in clause:
            parts += list((clusters or {}).get(c, ())) if isinstance(c, int) else [c]
        out = out & MatchAny(*parts).column(index)
    return out


def clause_query(index: Index, clauses: Sequence[Sequence], clusters: dict[int, Sequence[Feature]] | None = None, cluster_docs: DataFrame | None = None) -> DataFrame:
    """(doc_id); no clauses match all documents. Clusters are given as a few features each, or all of them as a table (cluster_id, doc_id) that
    is joined, whatever the number of their features."""
    if cluster_docs is None:
        return index.docs.filter(clause_predicate(index, clauses, clusters)).select("doc_id")
    docs, where = index.docs, F.lit(True)
    for k, clause in enumerate(clauses):
        ids, features = [c for c in clause if isinstance(c, int)], [c for c in clause if not isinstance(c, int)]
        part = MatchAny(*features).column(index)
        if ids:
            hit = cluster_docs.filter(F.col("cluster_id").isin(ids)).select("doc_id").distinct().withColumn(f"_in{k}", F.lit(True))
            docs, part = docs.join(hit, "doc_id", "left"), part | F.coalesce(F.col(f"_in{k}"), F.lit(False))
        where = where & part
    return docs.filter(where).select("doc_id")


def clauses_to_querystring(clauses: Sequence[Sequence], codec: FeatureCodec) -> str:
    pairs: list[tuple[str, str]] = []
    for clause in clauses:
        for c in clause:
            pairs += [("c", str(c))] if isinstance(c, int) else codec.to_pairs(c)
        pairs.append(("g", str(len(clause))))
    return urlencode(pairs)


def clauses_from_querystring(text: str, codec: FeatureCodec) -> list[list]:
    """Unknown keys are passed over; a last clause without its end mark is closed."""
    clauses: list[list] = []
    now: list = []
    held: list[tuple[str, str]] = []

    def flush() -> None:
        if held:
            now.append(codec.from_pairs(held))
            held.clear()

    for key, value in parse_qsl(text, keep_blank_values=True):
        if key in ("v", "v1", "v2") and held:
            held.append((key, value))
            continue
        if key in ("c", "f", "g"):
            flush()
        if key == "c":
            now.append(int(value))
        elif key == "f":
            held.append((key, value))
        elif key == "g" and now:
            clauses.append(now)
            now = []
    flush()
    return [*clauses, now] if now else clauses


def add_clause(clauses: Sequence[Sequence], new: Sequence) -> list[list]:
    """The clauses with ``new`` at the end; its components leave older clauses, and emptied ones go."""
    kept = [[c for c in clause if c not in new] for clause in clauses]
    return [c for c in kept if c] + ([list(new)] if new else [])


def search(text_tokens: Sequence[str], field: str, mode: str = "any") -> Query:
    """What a search box asks for: any or all of the tokens, or the phrase of them."""
    features = [(field, t) for t in text_tokens]
    if mode == "phrase":
        return MatchPhrase(tuple(features))
    if mode not in ("any", "all"):
        raise ValueError(mode)
    return MatchAny(*features) if mode == "any" else MatchAll(*features)


# --- documents in memory ---


def _values(v) -> list:
    return list(v) if isinstance(v, (list, tuple, set, frozenset)) else [] if v is None else [v]


def feature_set(doc: dict) -> set[tuple]:
    return {(f, v) for f, vs in doc.items() for v in _values(vs)}


def split_features(features) -> tuple[list[Feature], list[Feature]]:
    """(literals, ranges)."""
    fs = [check_feature(f) for f in features]
    return [f for f in fs if len(f) == 2], [f for f in fs if len(f) == 3]


def value_matches(value, feature: Feature) -> bool:
    if len(feature) == 2:
        return value == feature[1]
    _, low, high = feature
    return (low is None or value >= low) and (high is None or value < high)


def match_features(doc: dict, features) -> set[Feature]:
    """Which of the features one document has."""
    literals, ranges = split_features(features)
    return {f for f in literals + ranges if any(value_matches(v, f) for v in _values(doc.get(f[0])))}
