"""Functions of one's own: window kernels and column kernels, in numpy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

KINDS = {"double": "double", "bigint": "long"}


@dataclass(frozen=True)
class WindowFunction:
    """fn(arrays of one frame) -> number or None. With ``frames``: fn(arrays, starts, ends) -> a number for each frame, called once for many rows in order
    (``operators.windows.window_kernel``), which spares the call for each row."""

    fn: Callable
    arity: int
    output: str = "double"
    frames: bool = False

    def over(self, args: list[Column], w: WindowSpec) -> Column:
        fn, whole = self.fn, self.output == "bigint"

        def kernel(*series: pd.Series) -> float:
            out = fn(*[s.to_numpy() for s in series])
            return None if out is None else int(out) if whole else float(out)

        return F.pandas_udf(kernel, KINDS[self.output])(*args).over(w)


@dataclass(frozen=True)
class ColumnFunction:
    """fn(arrays of a whole column, NaN for null) -> array. It sees rows in storage order, all of them, or those of each value of ``partition``.

    Without ``partition`` the query's rows go through one task: right for a whole-column kernel, and as slow as that. Elementwise kernels
    (ordered=False) run on batches in parallel.
    """

    fn: Callable
    arity: int
    ordered: bool = True
    partition: tuple[str, ...] = ()

    def apply(self, df: DataFrame, args: list[str], out: str, order: list[str]) -> DataFrame:
        fn = self.fn
        schema = type(df.schema)(list(df.schema.fields)).add(out, "double")

        def put(pdf: pd.DataFrame) -> pd.DataFrame:
            values = np.asarray(fn(*[pdf[a].to_numpy(dtype=float, na_value=np.nan) for a in args]), dtype=float)
            if values.shape != (len(pdf),):
                raise ValueError(f"a column function gives one value a row: {len(pdf)}, not {values.shape}")
            return pdf.assign(**{out: pd.Series(values, index=pdf.index).astype(object).where(~np.isnan(values), None)})

        if not self.ordered:

            def batches(it):
                for pdf in it:
                    yield put(pdf)

            return df.mapInPandas(batches, schema)
        marked = df.withColumn("__all", F.lit(0)) if not self.partition else df
        keys = list(self.partition) or ["__all"]

        def group(pdf: pd.DataFrame) -> pd.DataFrame:
            return put(pdf.sort_values(order, kind="stable"))[schema.fieldNames()]

        return marked.groupBy(*keys).applyInPandas(group, schema)


def dot(x: np.ndarray, y: np.ndarray) -> float:
    return float(np.dot(x, y))


def matvec(a: np.ndarray, x: np.ndarray, rows: int) -> np.ndarray:
    """a: a matrix of ``rows`` rows, column after column."""
    return a.reshape(-1, rows).T @ x


def matmat(a: np.ndarray, b: np.ndarray, rows: int, inner: int) -> np.ndarray:
    """Product of two column-major matrices, column-major."""
    return (a.reshape(inner, rows).T @ b.reshape(-1, inner).T).T.reshape(-1)
