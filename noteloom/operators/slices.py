"""Python functions over frames of a few rows, however many an Arrow batch holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def map_slices(rows: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, most: int) -> DataFrame:
    """``run`` as for mapInPandas, but over frames of up to ``most`` rows: a batch stays packed, so that rows of whole tables take as much of a worker's memory as a few of them.

    Arrays are lists and structs dicts.
    """
    made = to_arrow_schema(StructType.fromDDL(schema))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, b.num_rows, most):
                part = b.slice(at, most)
                yield pd.DataFrame({n: pd.Series(c.to_pylist(), dtype=object) for n, c in zip(b.schema.names, part.columns, strict=True)})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(frames(batches)):
            yield pa.RecordBatch.from_pandas(out, schema=made, preserve_index=False)

    return rows.mapInArrow(each, schema)
