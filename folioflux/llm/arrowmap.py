"""Numpy functions over the texts of a DataFrame, an Arrow batch at a time, beside the rows' own columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioflux.llm.wordarrays import slices

#: (bytes, offsets, texts) of a slice -> one Arrow array for each field.
SliceFunction = Callable[[np.ndarray, np.ndarray, pa.Array], list[pa.Array]]


def packed(docs: DataFrame, text: str, columns: list[str] | None = None) -> tuple[DataFrame, Callable[[pa.RecordBatch], pa.Array]]:
    """_row, a struct of the columns asked for (all by default): new columns can then clash with none. And a function that
    takes the column `text` out of a batch: from the struct where it is one of those columns, so that texts are sent
    once, else from a column of its own."""
    names = docs.columns if columns is None else columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")
    if text in names:
        at = names.index(text)
        return docs.select(row), lambda batch: batch.column(0).field(at)
    return docs.select(row, F.col(f"`{text}`").alias("_text")), lambda batch: batch.column(1)


def map_texts(docs: DataFrame, text: str, fields: str, make: Callable[[], SliceFunction], columns: list[str] | None = None) -> DataFrame:
    """_row and the fields (DDL) that the function made by `make`, once a task, gives for each text; null texts are empty.

    Rows stay in their partition and order; at most one Arrow batch and one slice of it are in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            work = work or make()
            texts = text_in(batch)
            for at, to, data, offsets in slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *work(data, offsets, texts.slice(at, to - at))], names=names)

    rows, text_in = packed(docs, text, columns)
    schema = rows.select("_row").schema
    for field in StructType.fromDDL(fields).fields:
        schema = schema.add(field)
    names = schema.names
    return rows.mapInArrow(run, schema)
