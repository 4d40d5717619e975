"""Folds over the rows of a key in order, in one linear pass: for rules whose state a window can't hold."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def fold(rows: DataFrame, keys: list[str], order: list[str], reads: list[str], adds: str, start: Callable[[], object], step: Callable[..., tuple]) -> DataFrame:
    """rows with the columns `adds` (a DDL string), which step(state, *values of reads) gives as (state, added...).

    One shuffle by key and one sort; the rows of a key pass one after another, and only the
    state is held, so a key may have any number of rows. start() makes the state of a new key.
    """
    added = StructType.fromDDL(adds)
    kinds = [to_arrow_type(f.dataType) for f in added]
    names = [*rows.columns, *added.names]
    at_keys, at_reads = ([rows.columns.index(c) for c in cs] for cs in (keys, reads))
    schema = StructType([*rows.schema, *added])

    def run(batches):
        last, state = object(), None
        for batch in batches:
            out = [[] for _ in kinds]
            marks = zip(*(batch.column(i).to_pylist() for i in at_keys), strict=True)
            values = zip(*(batch.column(i).to_pylist() for i in at_reads), strict=True)
            for mark, told in zip(marks, values, strict=True):
                if mark != last:
                    last, state = mark, start()
                state, *found = step(state, *told)
                for column, x in zip(out, found, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
