"""Objects laid out for keyed reads, with an index of their labels.

Three tables under one folder, each in buckets by a hash that a reader can tell beforehand:
``objects`` by namespace and name; ``postings``, one row per object and label, by namespace
and pair; ``counts``, how many objects of a namespace hold a pair, likewise. A lookup
reads one bucket of objects. A selector reads the postings' bucket of its rarest pair, keeps
of these what lies in the buckets of its other pairs, and fetches the objects from the
buckets that they lie in: what it reads grows with what it finds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.functions.labels import matches
from muster.plans.containment import pairs

BUCKET = "_bucket"


def _bucket(buckets: int, *values: Column) -> Column:
    return F.pmod(F.xxhash64(*values), F.lit(buckets)).cast("int").alias(BUCKET)


@dataclass(frozen=True)
class ObjectIndex:
    """Objects with a ``labels`` map, unique by ``key`` (the namespace first), under ``path``.

    Objects with a null in their key are not found by any read, and stay out.
    """

    path: str
    key: Sequence[str] = ("namespace", "name")
    labels: str = "labels"
    buckets: int = 64

    def write(self, objects: DataFrame) -> None:
        """Writes all three tables; a hot bucket, of a pair that very many objects hold, is split
        among tasks and files. Rows are sorted, so that a file's statistics tell its keys."""
        for k in self.key:
            objects = objects.where(F.col(k).isNotNull())
        space = self.key[0]
        objects.limit(0).write.parquet(f"{self.path}/schema")
        home = objects.withColumn(BUCKET, _bucket(self.buckets, *self.key))
        self._put(home, "objects", self.key)
        pair = F.explode(pairs(F.col(self.labels))).alias("_pair")
        postings = home.select(*self.key, F.col(BUCKET).alias("_home"), pair)
        postings = postings.withColumn(BUCKET, _bucket(self.buckets, F.col(space), F.col("_pair")))
        self._put(postings, "postings", [space, "_pair", *self.key[1:]])
        counts = postings.groupBy(BUCKET, space, "_pair").agg(F.count(F.lit(1)).alias("_n"))
        self._put(counts, "counts", [space, "_pair"])

    def _put(self, rows: DataFrame, kind: str, order: Sequence[str]) -> None:
        placed = rows.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, *order)
        placed.write.partitionBy(BUCKET).parquet(f"{self.path}/{kind}")

    def _read(self, spark: SparkSession, kind: str) -> DataFrame:
        schema = spark.read.parquet(f"{self.path}/schema").schema
        keys = [f"`{k}` {schema[k].dataType.simpleString()}" for k in self.key]
        ddl = {
            "objects": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema),
            "postings": ", ".join([*keys, "_home INT, _pair STRING"]),
            "counts": f"{keys[0]}, _pair STRING, _n BIGINT",
        }
        return spark.read.schema(f"{ddl[kind]}, {BUCKET} INT").parquet(f"{self.path}/{kind}")

    def get(self, spark: SparkSession, *key: str) -> DataFrame:
        """The object of that key, or no row: from one bucket."""
        found = self._read(spark, "objects").where(F.col(BUCKET) == _bucket(self.buckets, *map(F.lit, key)))
        for k, v in zip(self.key, key, strict=True):
            found = found.where(F.col(k) == v)
        return found.drop(BUCKET)

    def _held(self, spark: SparkSession, kind: str, namespace: str, key: str, value: str) -> DataFrame:
        """Rows of one pair, from one bucket."""
        pair = f"{len(key)}:{key}={value}"
        where = F.col(BUCKET) == _bucket(self.buckets, F.lit(namespace), F.lit(pair))
        found = self._read(spark, kind).where(where & (F.col(self.key[0]) == namespace) & (F.col("_pair") == pair))
        return found.drop(BUCKET)

    def select(self, spark: SparkSession, namespace: str, selector: Mapping[str, str]) -> DataFrame:
        """The objects of a namespace whose labels contain every pair; the empty selector takes
        all of it, by a scan. One small count per pair is read first, to begin with the rarest."""
        objects = self._read(spark, "objects")
        if not selector:
            return objects.where(F.col(self.key[0]) == namespace).drop(BUCKET)
        n = {}
        for k, v in selector.items():
            row = self._held(spark, "counts", namespace, k, v).select("_n").first()
            n[k] = row[0] if row else 0
        first, *rest = sorted(selector, key=lambda k: (n[k], k))
        found = self._held(spark, "postings", namespace, first, selector[first]).drop("_pair")
        for k in rest:
            other = self._held(spark, "postings", namespace, k, selector[k]).select(*self.key)
            found = found.join(other, list(self.key), "left_semi")
        # The objects' buckets are told by the postings, so that Spark can leave out the others.
        found = found.withColumnsRenamed({k: f"_{k}" for k in self.key})
        same = [F.col(k) == F.col(f"_{k}") for k in self.key]
        if not n[first]:
            return objects.where(F.lit(False)).drop(BUCKET)
        out = objects.join(found, [objects[BUCKET] == F.col("_home"), *same], "left_semi").drop(BUCKET)
        return out.where(matches(F.col(self.labels), selector))
