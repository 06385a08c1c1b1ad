"""Arrow batch plumbing for operators that need whole texts in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def slices(batches: Iterator[pa.RecordBatch], rows: int | None) -> Iterator[pa.RecordBatch]:
    """The batches that aren't empty, cut to at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows or max(1, batch.num_rows)):
            yield batch.slice(at, rows or batch.num_rows)


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, object]], schema: str | StructType, rows: int | None = None) -> DataFrame:
    """Apply ``fn`` to each Arrow batch, handed over as column lists; to parts of ``rows`` rows, if many rows come out of one.

    ``fn`` returns the output columns (lists or numpy arrays of one length, which may differ
    from the input's). Nothing is kept between batches, so memory is bounded by a batch.
    """
    target = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            columns = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
            out = fn(columns)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type, from_pandas=True) for f in arrow], schema=arrow)

    return df.mapInArrow(run, target)


def fold_partitions(df: DataFrame, start: Callable[[], object], step: Callable[[object, dict[str, list]], object], flush: Callable[[object], dict[str, object]], schema: str | StructType, full: Callable[[object], bool] = lambda state: False) -> DataFrame:
    """Pre-aggregate a partition in Python: ``step`` folds batches into a state, ``flush`` emits it.

    ``full`` says when a state must be emitted early, which bounds its memory; the emitted rows
    are partial results for a following Spark aggregation.
    """
    target = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(target)

    def emit(state: object) -> pa.RecordBatch:
        out = flush(state)
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type, from_pandas=True) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for batch in batches:
            if batch.num_rows:
                state = step(state, {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
                if full(state):
                    yield emit(state)
                    state = start()
        yield emit(state)

    return df.mapInArrow(run, target)
