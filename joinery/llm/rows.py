"""Carrying whole rows through Python: all columns travel in one struct, so that no added name can clash."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joinery.runtime import ship, spread

#: Arrow batches are worked on in slices of about so many characters, whatever number of rows Spark puts in one.
SLICE_CHARS = 6_000_000


def packed(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One column `_row`: a struct of `columns` (default: all)."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns]).alias("_row"))


def unpacked(rows: DataFrame) -> list:
    """The columns of `_row`, to select."""
    return [F.col(f"_row.`{f.name}`") for f in rows.schema["_row"].dataType.fields]


def map_texts(rows: DataFrame, added: T.StructType, make: Callable[[], Callable[[list], dict]], text: str = "text") -> DataFrame:
    """rows (with `_row`, which holds the column `text`) and the columns `added`.

    make() is called once in each task; what it returns turns a list of texts into a dict of columns. If the text
    should not travel further, leave it out of `_row` and give it as a column `_text` of rows.
    """
    ship(rows.sparkSession)
    outside = "_text" in rows.columns
    keep = [f for f in rows.schema.fields if f.name != "_text"]
    schema = T.StructType([*keep, *added.fields])
    names = [f.name for f in keep]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            column = batch.column("_text") if outside else pc.struct_field(batch.column("_row"), text)
            size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(column):
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_CHARS)))
                made = work(column.slice(at, end - at).to_pylist())
                arrays = [batch.column(n).slice(at, end - at) for n in names]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(made[f.name], _arrow(f.dataType)) for f in added.fields], [*names, *(f.name for f in added.fields)])
                at = end

    return spread(rows).mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}[kind.simpleString()]


def added(spec: str) -> T.StructType:
    """A schema from DDL."""
    return T.StructType.fromDDL(spec)
