"""Additive: assembly indices of streams. The reference surface has no stream; these are the same functions on readStream."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joinery.plans.options import StringOptions
from joinery.plans.solve import RESULT, _mapped, solve_string, solve_strings
from joinery.runtime import ship


def assembly_stream(stream: DataFrame, column: str, options: StringOptions = StringOptions()) -> DataFrame:
    """Stateless: each record's result as it arrives; a failed record has an error and the stream goes on."""
    ship(stream.sparkSession)
    schema = T.StructType([*stream.schema.fields, *RESULT.fields])
    return stream.mapInPandas(_mapped(lambda rows: solve_strings([r[column] for r in rows], options), stream.columns), schema)


def index_windows(stream: DataFrame, when: str, key: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Results rolled up by time window and key; rows later than the watermark are left out by Spark."""
    return stream.withWatermark(when, late).groupBy(F.window(when, width), key).agg(F.count("*").alias("n"), F.avg("assembly_index").alias("mean_index"), F.max("assembly_index").alias("largest_index"))


def growing_strings(stream: DataFrame, key: str, symbol: str) -> DataFrame:
    """Per key, the string of all symbols so far and its Re-Pair bound, updated with every batch."""
    ship(stream.sparkSession)
    kind = stream.schema[key].dataType

    def step(k: tuple, batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        text = state.get[0] if state.exists else ""
        for batch in batches:
            text += "".join(batch[symbol])
        state.update((text,))
        row = solve_string(text, StringOptions(algorithm="repair"))
        yield pd.DataFrame({key: [k[0]], "length": [len(text)], "bound": [row["assembly_index"]]})

    out = T.StructType([T.StructField(key, kind), T.StructField("length", T.IntegerType()), T.StructField("bound", T.IntegerType())])
    return stream.groupBy(key).applyInPandasWithState(step, out, "text string", "update", "NoTimeout")
