"""Shared by the vector operators: which vectors take part, and blocks of them as one row each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

USABLE = "id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"


def usable(df: DataFrame, id_col: str, vector_col: str, *more: str) -> DataFrame:
    """(id, v as doubles, more...) of the vectors that are not null or zero and hold no null or non-finite component."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), *more).where(USABLE)


def matrix(column) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix of doubles."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1)


def array(column) -> np.ndarray:
    return np.asarray(column.combine_chunks())
