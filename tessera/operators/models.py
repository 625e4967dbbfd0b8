"""Models of the caller over columns: loaded once a task, fed in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, StructField, StructType


def apply_model(rows: DataFrame, inputs: list[str], output: str, kind: DataType, load: Callable[[], Callable[..., list[Any]]], batch: int = 32) -> DataFrame:
    """``rows`` with a column ``output`` that a model makes of the columns ``inputs``.

    ``load`` runs once in each task and gives a function from lists, one for each input, to a list of as many outputs:
    an encoder of texts, a scorer of pairs of query and content, a compressor.  Columns beyond the rows' own aren't
    read; an empty partition loads nothing; a model that gives another number of outputs is an error.
    """
    schema = StructType([*rows.schema.fields, StructField(output, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for rows_ in batches:
            if rows_.num_rows and model is None:
                model = load()
            for at in range(0, rows_.num_rows, batch):
                some = rows_.slice(at, batch)
                made = list(model(*(some.column(c).to_pylist() for c in inputs)))
                if len(made) != some.num_rows:
                    raise ValueError(f"{len(made)} outputs for {some.num_rows} rows")
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(made, arrow)], names=[*some.schema.names, output])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    return rows.mapInArrow(run, schema)
