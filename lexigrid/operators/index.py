"""The index: projected documents, and the feature tables derived from them."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrid.functions.ranges import quantile_cuts, range_of
from lexigrid.functions.values import Feature, FeatureCodec, check_feature
from lexigrid.operators.located import grouped
from lexigrid.shipping import ship
from lexigrid.spec import RANGE, SCALAR, SEQUENCE, SET, CorpusSpec, FieldSpec, handler_of

PASSAGE = 16
POSTINGS = "field string, value string, doc_id bigint, tf bigint, positions array<int>"


class Index:
    """Features of a corpus. All tables are lazy; ``write`` and ``read`` keep them as Parquet.

    ``stored`` is the table of postings (field, value, doc_id, tf, positions) of an index that was read: lookups, counts, boolean queries and
    phrases then read the postings in question and no documents."""

    def __init__(self, docs: DataFrame, kinds: dict[str, str], passage_size: int = PASSAGE, stored: DataFrame | None = None):
        self.docs, self.kinds, self.passage_size, self.stored = docs, kinds, passage_size, stored

    @staticmethod
    def build(df: DataFrame, spec: CorpusSpec, passage_size: int = PASSAGE) -> "Index":
        return Index(spec.project(df), {f.name: f.kind for f in spec.fields}, passage_size)

    # --- fields ---

    @property
    def arrays(self) -> list[str]:
        return [f for f, k in self.kinds.items() if k in (SEQUENCE, SET)]

    @property
    def scalars(self) -> list[str]:
        return [f for f, k in self.kinds.items() if k in (SCALAR, RANGE)]

    def handlers(self) -> dict:
        out = {}
        for f in self.kinds:
            kind = self.docs.schema[f].dataType
            out[f] = handler_of(kind.elementType if isinstance(kind, T.ArrayType) else kind)
        return out

    @property
    def codec(self) -> FeatureCodec:
        return FeatureCodec(self.handlers())

    # --- documents ---

    def all_doc_ids(self) -> DataFrame:
        return self.docs.select("doc_id")

    def total(self) -> int:
        return self.docs.count()

    def max_doc_id(self) -> int | None:
        """The greatest id; None for an empty index."""
        return self.docs.agg(F.max("doc_id")).first()[0]

    def fetch(self, ids: DataFrame) -> DataFrame:
        """Documents of the ids in a table (doc_id)."""
        return self.docs.join(ids.select("doc_id"), "doc_id", "left_semi")

    def fetch_in_order(self, ids: DataFrame, at: str = "at") -> DataFrame:
        """Documents of a table (doc_id, at), in the order of ``at``, once for each row; ids that aren't in the index are passed over."""
        return ids.select("doc_id", at).join(self.docs, "doc_id").orderBy(at, "doc_id")

    def keys(self, ids: DataFrame, *columns: str) -> DataFrame:
        """(doc_id, columns) for ids that must all exist, such as the keys that the spec keeps."""
        return self.checked_ids(ids).join(self.docs.select("doc_id", *columns), "doc_id")

    def checked_ids(self, ids: DataFrame) -> DataFrame:
        """The ids, failing the query if one is not in the index."""
        known = self.docs.select("doc_id", F.lit(True).alias("known"))
        ok = ids.join(known, "doc_id", "left")
        return ok.filter(F.coalesce(F.col("known"), F.raise_error(F.concat(F.lit("no such doc_id: "), F.col("doc_id").cast("string"))).cast("boolean"))).select("doc_id")

    # --- predicates on a document row: no shuffle, and scalar ones reach the scan ---

    def predicate(self, feature: Feature) -> Column:
        field, *values = check_feature(feature)
        if field not in self.kinds:
            raise KeyError(field)
        if self.kinds[field] in (SEQUENCE, SET):
            if len(values) == 1:
                return F.coalesce(F.array_contains(field, F.lit(values[0])), F.lit(False))
            return F.coalesce(F.exists(field, lambda x: within(x, *values)), F.lit(False))
        # never null, and in a form that reaches the files
        return F.col(field).eqNullSafe(F.lit(values[0])) if len(values) == 1 else F.col(field).isNotNull() & within(F.col(field), *values)

    def lookup(self, feature: Feature) -> DataFrame:
        """(doc_id) of the documents that have the feature."""
        if (found := self._found(feature)) is not None:
            return found.select("doc_id") if len(feature) == 2 else found.select("doc_id").distinct()
        return self.docs.filter(self.predicate(feature)).select("doc_id")

    def _found(self, feature: Feature) -> DataFrame | None:
        """The postings of an array field's feature, if they are stored; files are sorted, so few are read."""
        field, *values = check_feature(feature)
        if field not in self.kinds:
            raise KeyError(field)
        if self.stored is None or self.kinds[field] not in (SEQUENCE, SET) or not isinstance(self.docs.schema[field].dataType.elementType, T.StringType):
            return None
        value = F.col("value")
        return self.stored.filter(F.col("field") == field).filter(value == F.lit(values[0]) if len(values) == 1 else within(value, *values))

    def counts(self, feature: Feature) -> DataFrame:
        """One row (doc_count, location_count) of a feature; locations exist for sequences only."""
        field, *values = check_feature(feature)
        if (found := self._found(feature)) is not None:
            n = F.coalesce(F.sum("tf"), F.lit(0)) if self.kinds[field] == SEQUENCE else F.lit(0)
            docs = F.count(F.lit(1)) if len(values) == 1 else F.count_distinct("doc_id")
            return found.agg(docs.alias("doc_count"), n.cast("long").alias("location_count"))
        n = F.lit(0).cast("long")
        if self.kinds[field] == SEQUENCE:
            n = F.size(F.filter(field, lambda x: (x == F.lit(values[0])) if len(values) == 1 else within(x, *values))).cast("long")
        return self.docs.filter(self.predicate(feature)).select(n.alias("n")).agg(F.count(F.lit(1)).alias("doc_count"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("location_count"))

    # --- long tables ---

    def postings(self, *fields: str) -> DataFrame:
        """(field, value, doc_id, tf) of array fields: text form of the value and its count in the document."""
        fields = fields or tuple(self.arrays)
        rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("array<string>").alias("tokens")) for f in fields])
        flat = self.docs.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.field", F.explode("r.tokens").alias("value"))
        return flat.groupBy("field", "value", "doc_id").agg(F.count(F.lit(1)).alias("tf"))

    def membership(self, *fields: str) -> DataFrame:
        """(field, value, doc_id), distinct, without a shuffle; scalars count as sets of one."""
        fields = fields or tuple(self.kinds)
        made = [F.array_distinct(F.col(f).cast("array<string>")) if self.kinds[f] in (SEQUENCE, SET) else F.array_compact(F.array(F.col(f).cast("string"))) for f in fields]
        if len(fields) == 1:
            return self.docs.select(F.lit(fields[0]).alias("field"), F.explode(made[0]).alias("value"), "doc_id")
        rows = F.array(*[F.struct(F.lit(f).alias("field"), m.alias("values")) for f, m in zip(fields, made)])
        return self.docs.select("doc_id", F.explode(rows).alias("r")).select("r.field", F.explode("r.values").alias("value"), "doc_id")

    def locations(self, field: str) -> DataFrame:
        """(value, doc_id, pos) of a sequence."""
        if self.kinds.get(field) != SEQUENCE:
            raise ValueError(f"{field} has no positions")
        return self.docs.select("doc_id", F.posexplode(field).alias("pos", "value")).select("value", "doc_id", F.col("pos").cast("long").alias("pos"))

    def features(self, field: str, min_docs: int = 1) -> DataFrame:
        """(value, doc_count, location_count) with one shuffle, combined on the map side. Scalars have no locations."""
        if field not in self.kinds:
            raise KeyError(field)
        if self.kinds[field] == SEQUENCE:
            one = lambda d, l: lambda v: F.struct(v.alias("value"), F.lit(d).alias("d"), F.lit(l).alias("l"))
            rows = F.concat(F.transform(F.array_distinct(field), one(1, 0)), F.transform(field, one(0, 1)))
            got = self.docs.select(F.explode(rows).alias("r")).groupBy("r.value").agg(F.sum("r.d").alias("doc_count"), F.sum("r.l").alias("location_count"))
        else:
            value = F.explode(F.array_distinct(field)) if self.kinds[field] == SET else F.col(field)
            got = self.docs.select(value.alias("value")).filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("doc_count")).withColumn("location_count", F.lit(0).cast("long"))
        return got.filter(F.col("doc_count") >= min_docs)

    def doc_counts(self, field: str, min_docs: int = 1) -> DataFrame:
        """(value, doc_count) of features(), where locations aren't asked for: a token that its document repeats leaves it once."""
        if field not in self.kinds:
            raise KeyError(field)
        value = F.explode(F.array_distinct(field)) if self.kinds[field] in (SEQUENCE, SET) else F.col(field)
        got = self.docs.select(value.alias("value")).filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("doc_count"))
        return got.filter(F.col("doc_count") >= min_docs)

    def field_summary(self) -> DataFrame:
        """One row a field: uniques, least and greatest value, documents, most values in a document, locations, range flag."""
        parts = []
        for f, kind in self.kinds.items():
            many = kind in (SEQUENCE, SET)
            distinct = F.array_distinct(f) if many else F.array_compact(F.array(f))
            size = F.size(F.col(f)) if many else F.lit(1)
            per = self.docs.filter(F.col(f).isNotNull()).select(F.size(distinct).alias("n"), (size if kind == SEQUENCE else F.lit(0)).alias("l"), F.lit(1).alias("d")).agg(F.count_if(F.col("n") > 0).alias("doc_count"), F.max("n").cast("long").alias("max_value_count"), F.sum("l").cast("long").alias("location_count"))
            ends = self.features(f).agg(F.count(F.lit(1)).alias("unique_values"), F.min("value").cast("string").alias("min_value"), F.max("value").cast("string").alias("max_value"))
            parts.append(per.crossJoin(ends).select(F.lit(f).alias("field"), F.lit(self.handlers()[f].name).alias("value_type"), "doc_count", "max_value_count", "location_count", "unique_values", "min_value", "max_value", F.lit(kind == RANGE).alias("range_encoded")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def suggested_clustering_fields(self) -> list[str]:
        """Fields with more than one value in some document."""
        return sorted(r["field"] for r in self.field_summary().filter("max_value_count > 1").select("field").collect())

    # --- storage ---

    def located(self) -> DataFrame:
        """(field, value, doc_id, tf, positions) of array fields; positions are null but for sequences.

        A document's tokens are grouped in the task that reads it; only if an id occurs more than once are postings shuffled to be put together."""
        ship(self.docs.sparkSession)
        again = bool(self.docs.groupBy("doc_id").count().filter("count > 1").limit(1).count())
        parts = None
        for f in self.arrays:
            spots = self.kinds[f] == SEQUENCE
            rows = self.docs.select("doc_id", F.col(f).cast("array<string>").alias("tokens")).filter("tokens is not null")
            part = rows.mapInArrow(lambda it, spots=spots: grouped(it, spots), "value string, doc_id bigint, tf bigint, positions array<int>")
            if again:
                merged = F.sort_array(F.flatten(F.collect_list("positions"))) if spots else F.lit(None).cast("array<int>")
                part = part.groupBy("value", "doc_id").agg(F.sum("tf").alias("tf"), merged.alias("positions"))
            part = part.select(F.lit(f).alias("field"), "value", "doc_id", "tf", "positions")
            parts = part if parts is None else parts.unionByName(part)
        return parts

    def settings(self) -> DataFrame:
        """One row with the fields' kinds and the passage size as JSON."""
        return self.docs.sparkSession.createDataFrame([(json.dumps({"kinds": self.kinds, "passage_size": self.passage_size}),)], "value string").coalesce(1)

    def write(self, path: str) -> None:
        """Replace the whole index at once: documents, postings in order of value and id, settings.

        They are written to a new folder, and then one rename of a small file makes it the current one: a reader has the old index or
        the new, and an index may be written over the path that it was read from. The version before stays for readers that have it open; older ones go.
        Postings are cut into ranges of (value, doc_id), so those of a very frequent value are spread over many files."""
        spark = self.docs.sparkSession
        version = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        self.docs.write.parquet(f"{path}/{version}/docs")
        if self.arrays:
            # from what was written: else each text would be cut into tokens again, once to find the ranges and once to fill them
            Index(spark.read.schema(self.docs.schema).parquet(f"{path}/{version}/docs"), self.kinds).located().repartitionByRange("field", "value", "doc_id").sortWithinPartitions("field", "value", "doc_id").write.partitionBy("field").parquet(f"{path}/{version}/postings")
        self.settings().write.text(f"{path}/{version}/settings")
        point(spark, path, version)

    @staticmethod
    def read(spark: SparkSession, path: str) -> "Index":
        """The current version of a written index, or one that is appended to batch by batch."""
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        mark = jvm.org.apache.hadoop.fs.Path(f"{path}/current")
        if mark.getFileSystem(conf).exists(mark):
            path = f"{path}/{spark.read.text(f'{path}/current').first()[0]}"
        s = json.loads(spark.read.text(f"{path}/settings").first()[0])
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/postings")
        # the schema is given: a column of folder names may be read as a number, and an empty table has no files
        stored = spark.read.schema(POSTINGS).parquet(f"{path}/postings") if at.getFileSystem(conf).exists(at) else None
        return Index(spark.read.parquet(f"{path}/docs").drop("batch"), s["kinds"], s["passage_size"], stored)


def point(spark: SparkSession, path: str, version: str, keep: int = 2) -> None:
    """Make a version the current one by an atomic rename, and delete all but the last ``keep``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(conf)
    fresh = p(f"{path}/current-{version}")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fresh, p(f"{path}/current"), how)
    made = sorted(f.getPath().getName() for f in fs.listStatus(p(path)) if f.getPath().getName().startswith("v-"))
    for old in made[:-keep]:
        fs.delete(p(f"{path}/{old}"), True)


def within(x: Column, start, end) -> Column:
    """start <= x < end, either bound may be None."""
    parts = ([x >= F.lit(start)] if start is not None else []) + ([x < F.lit(end)] if end is not None else [])
    return parts[0] if len(parts) == 1 else parts[0] & parts[1]


def prefix_range(field: str, prefix: str) -> Feature:
    """All values that start with the prefix, as a range."""
    return (field, prefix, prefix + "\U0010ffff")


def cumulative(index: Index, field: str) -> DataFrame:
    """(value, cumulative_count): documents with a value up to this one. Ordered by ranges with per-range totals, not in one task."""
    counts = index.features(field).select("value", "doc_count")
    return running_sum(counts, "value", "doc_count", "cumulative_count")


def running_sum(df: DataFrame, order: str, amount: str, name: str) -> DataFrame:
    """Prefix sums over distinct numeric ``order`` values: quantile ranges, a window inside each, and offsets of the ranges before."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not isinstance(df.schema[order].dataType, T.NumericType):
        raise ValueError(f"{order} is not numeric")
    cut = df.withColumn("_part", range_of(F.col(order), quantile_cuts(df, order, parts)))
    total = cut.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    before = total.withColumn("_before", F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).select("_part", "_before")  # one row a range
    inner = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("_in", F.sum(amount).over(inner)).join(F.broadcast(before), "_part").withColumn(name, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def documents_spec() -> CorpusSpec:
    """The test collection: text as a sequence, lang and source as scalars, n_chars as a range."""
    return CorpusSpec((FieldSpec("text", SEQUENCE), FieldSpec("lang", SCALAR), FieldSpec("source", SCALAR), FieldSpec("n_chars", RANGE)))
