"""Rolling least squares of y on several factors."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewater.operators.windows import Frame, Pass

FLOOR = 1e-12


def fit_windows(y: np.ndarray, x: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(intercept and coefficients, R2) for the window of up to ``rows`` rows that ends at each row; NaN rows where there is no fit: fewer than
    k + 1 rows, or a pivot of the scaled normal matrix at or below FLOOR of its diagonal."""
    n, k = x.shape
    coef, r2 = np.full((n, k + 1), np.nan), np.full(n, np.nan)
    block = max(1, (1 << 22) // max(1, rows * (k + 1)))
    for lo in range(0, n, block):
        ends = np.arange(lo, min(n, lo + block))
        take = ends[:, None] - np.arange(rows - 1, -1, -1)[None, :]
        live = take >= 0
        take = np.maximum(take, 0)
        anchor = np.maximum(ends - rows + 1, 0)
        wx = np.where(live[..., None], x[take] - x[anchor][:, None, :], 0.0)
        wy = np.where(live, y[take] - y[anchor][:, None], 0.0)
        m = live.sum(axis=1).astype(float)
        mx, my = wx.sum(axis=1) / m[:, None], wy.sum(axis=1) / m
        wx, wy = np.where(live[..., None], wx - mx[:, None, :], 0.0), np.where(live, wy - my[:, None], 0.0)
        a, b, syy = np.einsum("nri,nrj->nij", wx, wx), np.einsum("nri,nr->ni", wx, wy), (wy * wy).sum(axis=1)
        ok = m >= k + 1
        low = np.zeros_like(a)
        for i in range(k):  # Cholesky, all windows at once
            pivot = a[:, i, i] - (low[:, i, :i] ** 2).sum(axis=1)
            with np.errstate(invalid="ignore"):
                ok &= (a[:, i, i] > 0) & (pivot > FLOOR * a[:, i, i])
            root = np.sqrt(np.where(ok, pivot, 1.0))
            low[:, i, i] = root
            for j in range(i + 1, k):
                low[:, j, i] = (a[:, j, i] - (low[:, j, :i] * low[:, i, :i]).sum(axis=1)) / root
        z, beta = np.zeros((len(ends), k)), np.zeros((len(ends), k))
        for i in range(k):
            z[:, i] = (b[:, i] - (low[:, i, :i] * z[:, :i]).sum(axis=1)) / low[:, i, i]
        for i in range(k - 1, -1, -1):
            beta[:, i] = (z[:, i] - (low[:, i + 1 :, i] * beta[:, i + 1 :]).sum(axis=1)) / low[:, i, i]
        good = ends[ok]
        coef[good, 1:] = beta[ok]
        coef[good, 0] = (y[anchor] + my - ((x[anchor] + mx) * beta).sum(axis=1))[ok]
        flat = syy > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            r2[ends[ok & flat]] = np.clip((z * z).sum(axis=1) / syy, 0, 1)[ok & flat]
    return coef, r2


class _Fit(Pass):
    """Fits over frames of ``rows`` rows, streamed."""

    def __init__(self, y: int, xs: list[int], parts: list[int], rows: int):
        super().__init__([], parts, 0, Frame("rows", rows - 1))
        self.y, self.xs, self.rows = y, xs, rows

    def compute(self, t: pa.Table, begin: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        lo, to = self.done, self.done + len(begin)
        y = t.column(self.y).to_numpy().astype(float)
        x = np.column_stack([t.column(c).to_numpy().astype(float) for c in self.xs])
        out = np.full((len(begin), len(self.xs) + 2), np.nan)
        edge = np.unique(begin).tolist()
        for i, j in itertools.pairwise([*edge, to]):
            at = max(i, lo)
            coef, r2 = fit_windows(y[i:j], x[i:j], self.rows)
            out[at - lo : j - lo] = np.column_stack([coef, r2])[at - i :]
        return [out]


def rolling_fit(df: DataFrame, y: str, factors: list[str], rows: int, partition: list[str], order: list[str], prefix: str = "fit", overlap: int = 0) -> DataFrame:
    """Adds prefix_intercept, prefix_<factor> and prefix_r2. Rows of a partition are streamed in order; only the last rows - 1 are carried from batch to batch,
    so a partition of any length fits in memory. A null or NaN argument gives null for the windows that hold it."""
    names = [f"{prefix}_intercept", *[f"{prefix}_{f}" for f in factors], f"{prefix}_r2"]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    at = {c: i for i, c in enumerate(df.columns)}
    y_at, x_at, part_at, columns = at[y], [at[f] for f in factors], [at[p] for p in partition], df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _Fit(y_at, x_at, part_at, rows)
        for t in itertools.chain((pa.Table.from_batches([b]) for b in batches), [None]):
            got = one.add(t)
            if got is not None and len(got[0]):
                made = [pa.array(c, mask=np.isnan(c)) for c in got[1][0].T]
                yield from pa.table([*got[0].columns, *made], [*columns, *names]).combine_chunks().to_batches()

    parts = df.repartition(*partition) if partition else df.coalesce(1)
    return parts.sortWithinPartitions(*partition, *order).mapInArrow(run, schema)
