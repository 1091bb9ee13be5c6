"""Least squares from sums of products.

One pass over the rows gives each group the moment matrix of a constant and
some columns; whatever is wanted of them (regressions of any column on others,
folds left out, groups pooled, blocks before a block) is sums and differences
of such matrices.  Only they, a row for each group, are solved in numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cells(size: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(size) for j in range(i, size)]


def cell_names(size: int) -> list[str]:
    return [f"m{i}_{j}" for i, j in cells(size)]


def known(names: list[str]) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & F.col(c).isNotNull()
    return out


def moments(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys and m0_0 (rows), m0_1, ...: sums of products of a constant and the
    names, over rows where none is null."""
    values = [F.lit(1.0), *[F.col(c).cast("double") for c in names]]
    return df.where(known(names)).groupBy(*keys).agg(*[F.sum(values[i] * values[j]).alias(f"m{i}_{j}") for i, j in cells(len(values))])


def without_own(sums: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Each group's moments replaced by those of the other groups with its keys (folds)."""
    all_ = Window.partitionBy(*keys)
    return sums.withColumns({c: F.sum(c).over(all_) - F.col(c) for c in cell_names(size)})


def before_own(sums: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """Each group's moments replaced by those of the groups before it."""
    past = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumns({c: F.sum(c).over(past) for c in cell_names(size)})


def pooled(sums: DataFrame, keys: list[str], size: int) -> DataFrame:
    return sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in cell_names(size)])


def unpacked(rows: pd.Series, size: int) -> np.ndarray:
    """Matrices (row, size, size) of arrays of cells."""
    flat = np.stack([np.asarray(x, float) for x in rows]) if len(rows) else np.empty((0, len(cells(size))))
    out = np.empty((len(rows), size, size))
    for s, (i, j) in enumerate(cells(size)):
        out[:, i, j] = out[:, j, i] = flat[:, s]
    return out


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions of symmetric systems; the shortest one where columns are collinear."""
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(a, hermitian=True) @ b


def packed(size: int) -> Column:
    return F.array(*[F.col(c) for c in cell_names(size)])


def regress(sums: DataFrame, names: list[str], x: list[str], y: str, name: str, least: int | None = None, ridge: float = 0.0) -> DataFrame:
    """sums with name (array: constant, then x) and name_ssr, the fit of y on x;
    null with fewer than `least` rows (default: twice the unknowns)."""
    size = len(names) + 1
    at, to = [0, *[names.index(c) + 1 for c in x]], names.index(y) + 1
    need = least or 2 * len(at)

    @F.pandas_udf("struct<beta: array<double>, ssr: double>")
    def fit(rows: pd.Series) -> pd.DataFrame:
        m = unpacked(rows, size)
        beta, ssr = np.empty(len(m), object), np.full(len(m), np.nan)
        good = np.isfinite(m).all((1, 2)) & (m[:, 0, 0] >= need)
        if good.any():
            a, b = m[good][:, at][:, :, at] + ridge * np.eye(len(at)), m[good][:, at][:, :, to]
            found = solve(a, b[:, :, None])[:, :, 0]
            for i, v in zip(np.flatnonzero(good), found, strict=True):
                beta[i] = v.tolist()
            own = m[good]
            ssr[good] = own[:, to, to] - 2 * (found * b).sum(1) + np.einsum("ni,nij,nj->n", found, own[:, at][:, :, at], found)
        return pd.DataFrame({"beta": beta, "ssr": pd.Series(ssr).astype(object).where(np.isfinite(ssr), None)})

    made = sums.withColumn("__fit", fit(packed(size)))
    return made.withColumns({name: F.col("__fit.beta"), f"{name}_ssr": F.col("__fit.ssr")}).drop("__fit")


def fitted(beta: str, x: list[str]) -> Column:
    out = F.col(beta)[0]
    for i, c in enumerate(x):
        out = out + F.col(beta)[i + 1] * F.col(c)
    return out
