"""Pandas functions that are declared at import and made when a session is there."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows that a function is given at one time, and whose results are held with them.
SLICE = 256


def slices(batch: tuple[pd.Series, ...]) -> Iterator[tuple[pd.Series, ...]]:
    """A batch in parts of SLICE rows, in order; an empty one as it is."""
    for at in range(0, max(len(batch[0]), 1), SLICE):
        yield tuple(c.iloc[at : at + SLICE].reset_index(drop=True) for c in batch)


def sliced(f: Callable) -> Callable[[Iterator[tuple[pd.Series, ...]]], Iterator]:
    """`f`, of series or of an iterator of series, over batches whose results leave slice by slice.

    A batch of Arrow may hold ten thousand long texts; what a function makes of them is as large again, several times over.
    """
    if inspect.isgeneratorfunction(f):
        return lambda batches: f(part if len(part) > 1 else part[0] for b in batches for part in slices(b))
    return lambda batches: (f(*part) for b in batches for part in slices(b))


def vectorised(ddl: str) -> Callable[[Callable], Callable[..., Column]]:
    """Like `pandas_udf`, but the return type is only parsed at the first call, and results are held for SLICE rows at a time."""

    def wrap(f: Callable) -> Callable[..., Column]:
        parts = sliced(f)

        def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            yield from parts((b,) for b in batches)

        def many(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            yield from parts(batches)

        def one_struct(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            yield from parts((b,) for b in batches)

        def many_structs(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            yield from parts(batches)

        struct = ddl.startswith("struct<")

        def call(*columns: Column | str) -> Column:
            run = (many_structs if struct else many) if len(columns) > 1 else one_struct if struct else one
            return F.pandas_udf(run, ddl)(*columns)

        call.__doc__ = f.__doc__
        return call

    return wrap
