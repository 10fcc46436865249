"""Jobs with user functions: map, combine, reduce over Arrow tables.

The functions are Python, vectorised over Arrow record batches. A mapper's rows are combined
in the map task before anything is shuffled. Combined rows are dealt by key *and* by the
map task they come from, combined again, and only then meet by key alone: a key that every
map task holds reaches its reducer as a few rows, from tasks that each had a part of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a task holds before it combines them.
HELD = 200_000
#: Parts that a key's combined rows are dealt to before they meet.
SALTS = 16

Mapper = Callable[[pa.RecordBatch], "pa.RecordBatch | pa.Table"]
Combiner = Callable[[pa.Table], pa.Table]
#: Gets a key and its rows as a stream of tables, and returns a table.
Reducer = Callable[[tuple, Iterator[pa.Table]], pa.Table]


@dataclass(frozen=True)
class Job:
    """``mapper`` turns a batch of input rows into rows of ``mapped`` (a DDL schema).

    ``combiner`` turns any rows of that schema into fewer that mean the same, by ``keys``; it
    may be given rows of any keys, its own results among them, in any order and number of
    times. ``reducer`` gets each key once, with all its rows, and returns rows of ``reduced``;
    without one the combined rows are the result. Keys must not be null.
    """

    mapper: Mapper
    keys: Sequence[str]
    mapped: str
    combiner: Combiner | None = None
    reducer: Reducer | None = None
    reduced: str | None = None

    def run(self, rows: DataFrame, salts: int = SALTS, held: int = HELD) -> DataFrame:
        """The job's result over rows; lazy. Without combiner a key's rows stream through one
        task, however many they are; with one they are few."""
        spark = rows.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        schema = StructType.fromDDL(self.mapped)
        arrow = to_arrow_schema(schema)
        keys = list(self.keys)
        out = rows.mapInArrow(_mapping(self.mapper, self.combiner, arrow, held), schema)
        if self.combiner:
            salt = F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt")
            # Rows of a key are the same number in each part, however unlike the parts' sizes are.
            out = out.select("*", salt).repartition(parts, *keys, "_salt").drop("_salt")
            out = out.mapInArrow(_mapping(lambda batch: batch, self.combiner, arrow, held), schema)
        out = out.repartition(parts, *keys).sortWithinPartitions(*keys)
        result = StructType.fromDDL(self.reduced or self.mapped)
        return out.mapInArrow(_reducing(self, arrow, to_arrow_schema(result)), result)


def _table(found: pa.RecordBatch | pa.Table, schema: pa.Schema) -> pa.Table:
    table = pa.Table.from_batches([found]) if isinstance(found, pa.RecordBatch) else found
    return table.select(schema.names).cast(schema)


def _mapping(mapper: Mapper, combiner: Combiner | None, schema: pa.Schema, held: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        rows = 0
        for batch in batches:
            if not len(batch):
                continue
            found = _table(mapper(batch), schema)
            if combiner is None:
                yield from found.to_batches()
                continue
            waiting.append(found)
            rows += len(found)
            if rows >= held:
                done = _table(combiner(pa.concat_tables(waiting)), schema)
                if 2 * len(done) > held:
                    # Combining doesn't help any more: make room.
                    yield from done.to_batches()
                    done = done.slice(0, 0)
                waiting, rows = [done], len(done)
        if rows:
            yield from _table(combiner(pa.concat_tables(waiting)), schema).to_batches()

    return run


def _reducing(job: Job, mapped: pa.Schema, reduced: pa.Schema) -> Callable:
    """For rows sorted by key: a key at a time, as a stream."""
    keys = list(job.keys)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
        for batch in batches:
            if not len(batch):
                continue
            table = _table(batch, mapped)
            new = pa.array([False] * (len(table) - 1), pa.bool_())
            for k in keys:
                column = table[k].combine_chunks()
                new = pc.or_(new, pc.not_equal(column[1:], column[:-1]))
            cuts = [0, *(i + 1 for i, x in enumerate(new.to_pylist()) if x), len(table)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield tuple(table[k][a].as_py() for k in keys), table.slice(a, b - a)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole batches combined; the last key of each waits for the next."""
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            table = _table(batch, mapped)
            table = pa.concat_tables([rest, table]) if rest is not None else table
            last = [pc.equal(table[k], table[k][-1]) for k in keys]
            same = last[0]
            for x in last[1:]:
                same = pc.and_(same, x)
            done, rest = table.filter(pc.invert(same)), job.combiner(table.filter(same))
            rest = _table(rest, mapped)
            if len(done):
                yield from _table(job.combiner(done), mapped).to_batches()
        if rest is not None:
            yield from rest.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if job.combiner:
            batches = merge(batches)
        if job.reducer is None:
            for batch in batches:
                yield from _table(batch, reduced).to_batches()
            return
        stream = parts(batches)
        ahead = next(stream, None)
        while ahead is not None:
            key = ahead[0]

            def own(key: tuple = key) -> Iterator[pa.Table]:
                nonlocal ahead
                while ahead is not None and ahead[0] == key:
                    table = ahead[1]
                    ahead = next(stream, None)
                    yield table

            values = own()
            found = _table(job.reducer(key, values), reduced)
            for _ in values:  # what the reducer left
                pass
            yield from found.to_batches()

    return run
