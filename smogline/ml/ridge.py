"""Ridge regression by mergeable normal equations (M4).

The moments of a group (row count, and the sums of all products of two of: 1, the features, the label) are all that a
ridge fit needs. They are one partial aggregate per group, so a group of any size sends one row a task through the
shuffle. Tables of moments add up: new rows are merged in, rows that leave are taken out, and finer groups roll up to
coarser ones, without reading the rows that stay. The fit itself solves one small system per group, in closed form, where
its row of moments lies.

A fit minimises sum((y - b0 - x b)^2) + alpha * sum(b^2); the intercept is not penalised.

Defined results: rows with a null or NaN in a feature or in the label take no part; null keys are a group of their own;
a group without rows left has null coefficients; ``alpha`` 0 with dependent features gives the least-norm solution.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

N = "n"


def _product_names(d: int) -> list[tuple[int, int, str]]:
    """(i, j, column) of the products of z = [1, features, label], i <= j; (0, 0) is the row count."""
    return [(i, j, N if j == 0 else f"z_{i}_{j}") for i in range(d + 2) for j in range(i, d + 2)]


def _total(name: str) -> Column:
    return F.sum(name).alias(name)


def moments(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row of moments per group (one row in all without ``keys``)."""
    z = [F.col(c).cast("double") for c in (*features, label)]
    whole = reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) for c in z])
    named = [f"_z{i}" for i in range(1, len(z) + 1)]
    rows = df.filter(whole).select(*keys, *[c.alias(n) for c, n in zip(z, named, strict=True)])
    sums = []
    for i, j, name in _product_names(len(features)):
        if j == 0:
            sums.append(F.count(F.lit(1)).alias(N))
        else:
            other = F.col(f"_z{j}")
            sums.append(F.sum(other if i == 0 else F.col(f"_z{i}") * other).alias(name))
    return rows.groupBy(*keys).agg(*sums)


def merge(tables: Sequence[DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """Moments of all the tables' rows; with fewer ``keys`` than the tables have, rolled up to those."""
    both = reduce(DataFrame.unionByName, tables)
    return both.groupBy(*keys).agg(*[_total(c) for c in both.columns if c == N or c.startswith("z_")])


def downdate(table: DataFrame, gone: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Moments after the rows of ``gone`` left (they must have been part of ``table``)."""
    minus = gone.select(*keys, *[(-F.col(c)).alias(c) for c in gone.columns if c not in keys])
    return merge([table, minus], keys)


def solve(table: DataFrame, features: Sequence[str], alpha: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, intercept, coefficients in the order of ``features``, sse of the fitted rows) per group."""
    d, keys = len(features), list(keys)
    names = _product_names(d)
    schema = T.StructType([table.schema[k] for k in keys] + [
        T.StructField(N, T.LongType()), T.StructField("intercept", T.DoubleType()),
        T.StructField("coefficients", T.ArrayType(T.DoubleType())), T.StructField("sse", T.DoubleType())])

    def fit(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd
        for pdf in batches:
            fits: list[list] = [[], [], []]
            for sums in pdf[[c for _, _, c in names]].itertuples(index=False):
                g = np.zeros((d + 2, d + 2))
                for (i, j, _), v in zip(names, sums, strict=True):
                    g[i, j] = g[j, i] = np.nan if v is None else v
                n = g[0, 0]
                if not n > 0:
                    one = (None, None, None)
                else:
                    c = g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) / n
                    left = c[:d, :d] + alpha * np.eye(d)
                    b = np.linalg.solve(left, c[:d, d]) if alpha else np.linalg.lstsq(left, c[:d, d], rcond=None)[0]
                    one = (float((g[0, d + 1] - g[0, 1:d + 1] @ b) / n), b.tolist(),
                           float(c[d, d] - 2 * b @ c[:d, d] + b @ c[:d, :d] @ b))
                for part, v in zip(fits, one, strict=True):
                    part.append(v)
            out = {k: pdf[k] for k in keys} | {N: pdf[N].fillna(0).astype("int64")}
            yield pd.DataFrame(out | {"intercept": pd.Series(fits[0], index=pdf.index, dtype="object"),
                                      "coefficients": pd.Series(fits[1], index=pdf.index, dtype="object"),
                                      "sse": pd.Series(fits[2], index=pdf.index, dtype="object")})

    return table.select(*keys, *[c for _, _, c in names]).mapInPandas(fit, schema)


def predict(df: DataFrame, fits: DataFrame, features: Sequence[str], keys: Sequence[str],
            name: str = "pred_delta") -> DataFrame:
    """``df`` with the fitted value of its group; null where the group has no fit or a feature is null."""
    own = fits.select(*[F.col(k).alias(f"_fit_{k}") for k in keys], F.col("intercept").alias("_b0"),
                      F.col("coefficients").alias("_b"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_fit_{k}")) for k in keys])
    value = reduce(lambda a, b: a + b, [F.get("_b", F.lit(i)) * F.col(c).cast("double") for i, c in enumerate(features)],
                   F.col("_b0"))
    return (df.join(own, same, "left").withColumn(name, value)
            .drop("_b0", "_b", *[f"_fit_{k}" for k in keys]))
