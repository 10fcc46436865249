"""Tables of one row per key that a stream keeps up to date.

Each micro-batch writes the rows that it changes under ``delta/batch=<id>``; now and then all
current rows are written under ``base/batch=<id>``. The table as of a batch is its newest
row per key in the last base before and the deltas since, so that reading it costs the same
after any number of batches. Rows lie in buckets by a hash of the key, and a batch reads
only the buckets that it touches.

A batch may be run again: it reads what was there before it and replaces its own folder. A
folder counts once it has been committed as a whole, so a crash leaves the table as it was.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.sources import files

BUCKET = "_bucket"
#: Marks rows whose key is no longer there.
GONE = "_gone"


@dataclass(frozen=True)
class KeyedTable:
    """``path`` belongs to the table alone. A base is written every ``every`` batches."""

    path: str
    keys: Sequence[str]
    buckets: int = 16
    every: int = 16

    def bucket(self) -> Column:
        """The bucket of a row; ``buckets`` may not change once there are rows."""
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _batches(self, spark: SparkSession, kind: str) -> list[int]:
        """Numbers of the committed folders of a kind."""
        top = f"{self.path}/{kind}"
        found = [n for n in files.names(spark, top) if n.startswith("batch=")]
        return sorted(int(n[6:]) for n in found if files.exists(spark, f"{top}/{n}/_SUCCESS"))

    def _folders(self, spark: SparkSession, before: int | None) -> list[tuple[str, int]]:
        bases = [b for b in self._batches(spark, "base") if before is None or b < before]
        last = bases[-1] if bases else -1
        deltas = [b for b in self._batches(spark, "delta") if b > last and (before is None or b < before)]
        return [("base", b) for b in bases[-1:]] + [("delta", b) for b in deltas]

    def read(
        self, spark: SparkSession, before: int | None = None, buckets: Iterable[int] | None = None
    ) -> DataFrame | None:
        """The current rows, or those before a batch, of all or some buckets; None if there
        are no rows."""
        rows = self._rows(spark, before, buckets)
        return None if rows is None else self._present(rows)

    def _rows(self, spark: SparkSession, before: int | None, buckets: Iterable[int] | None) -> DataFrame | None:
        out, read = None, 0
        for kind, batch in self._folders(spark, before):
            if not self.has_rows(spark, kind, batch):
                continue
            rows, read = spark.read.parquet(f"{self.path}/{kind}/batch={batch}"), read + 1
            if buckets is not None:
                rows = rows.where(F.col(BUCKET).isin(*buckets))
            rows = rows.drop(BUCKET).withColumn("_batch", F.lit(batch))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        if read < 2:
            return None if out is None else out.drop("_batch")
        more = [c for c in out.columns if c not in (*self.keys, "_batch")]
        if not more:
            return out.select(*self.keys).distinct()
        newest = out.groupBy(*self.keys).agg(F.max_by(F.struct(*more), "_batch").alias("_row"))
        return newest.select(*self.keys, "_row.*")

    def has_rows(self, spark: SparkSession, kind: str, batch: int) -> bool:
        """Whether a ``delta`` or ``base`` holds any rows."""
        folders = files.names(spark, f"{self.path}/{kind}/batch={batch}")
        return any(n.startswith(f"{BUCKET}=") for n in folders)

    @staticmethod
    def _present(rows: DataFrame) -> DataFrame:
        if GONE not in rows.columns:
            return rows
        return rows.where(~F.coalesce(F.col(GONE), F.lit(False))).drop(GONE)

    def write(self, rows: DataFrame, batch: int) -> None:
        """The rows that a batch changes, one per key; ``GONE`` true for keys that go."""
        self._put(rows, "delta", batch)

    def _put(self, rows: DataFrame, kind: str, batch: int) -> None:
        placed = rows.withColumn(BUCKET, self.bucket()).hint("rebalance", BUCKET)
        placed.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/{kind}/batch={batch}")

    def compact(self, spark: SparkSession, batch: int) -> bool:
        """After a batch: a new base, if enough deltas have come since the last one.

        Folders that this batch would need if it ran again stay; older ones are removed.
        """
        folders = self._folders(spark, batch + 1)
        if sum(kind == "delta" for kind, _ in folders) < self.every:
            return False
        rows = self._rows(spark, batch + 1, None)
        if rows is None:
            return False
        self._put(self._present(rows), "base", batch)
        kept = [b for kind, b in folders if kind == "base"]
        for kind in ("base", "delta"):
            for old in self._batches(spark, kind):
                if kept and (old < kept[0] if kind == "base" else old <= kept[0]):
                    files.remove(spark, f"{self.path}/{kind}/batch={old}")
        return True
