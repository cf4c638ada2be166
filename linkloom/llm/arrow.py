"""Python over Arrow batches of texts. Columns beside the text pass as Arrow arrays, so 64-bit ids keep every digit, with nulls among them or not."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes in ``column``, at least one row each; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    start = held = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield batch.slice(start)


def map_text(rows: DataFrame, column: str, new: list[tuple[str, str]], function: Callable[[list], list]) -> DataFrame:
    """``rows`` with ``column`` replaced by the columns ``new`` (name, type), which ``function`` makes of a list of its values."""
    kept = [f for f in rows.schema.fields if f.name != column]
    schema = T.StructType([*kept, *[T.StructField(n, T._parse_datatype_string(t)) for n, t in new]])
    names, types = [f.name for f in schema.fields], [_ARROW[t] for _, t in new]
    others = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, column):
                made = function(batch.column(column).to_pylist())
                arrays = [batch.column(n) for n in others] + [pa.array(x, t) for x, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(run, schema)
