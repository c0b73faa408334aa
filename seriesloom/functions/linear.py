"""Small linear systems in column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import settled

#: A pivot's least share of its diagonal entry: below it the matrix counts as singular.
LEAST_PIVOT = 1e-14


def with_solution(df: DataFrame, n: int, matrix: str, right: str, out: str) -> DataFrame:
    """Adds {out}0 .. of the symmetric positive definite system {matrix}{i}{j} (j >= i) x = {right}{i}; null where it is singular.

    A root-free Cholesky factorisation (pivots and multipliers), one projection for each column of the factor. The product of the pivots, the determinant, is
    held against the product of the diagonal, which bounds it.
    """
    at = lambda k, i, j: f"sol {k} {min(i, j)} {max(i, j)}"
    first = {at(0, i, j): F.col(f"{matrix}{i}{j}") for i in range(n) for j in range(i, n)} | {f"sol b 0 {i}": F.col(f"{right}{i}") for i in range(n)}
    step = df.withColumns(first)
    for k in range(n - 1):
        ratio = {i: F.try_divide(F.col(at(k, k, i)), F.col(at(k, k, k))) for i in range(k + 1, n)}
        rest = {at(k + 1, i, j): F.col(at(k, i, j)) - ratio[i] * F.col(at(k, k, j)) for i in range(k + 1, n) for j in range(i, n)}
        step = step.withColumns(rest | {f"sol b {k + 1} {i}": F.col(f"sol b {k} {i}") - ratio[i] * F.col(f"sol b {k} {k}") for i in range(k + 1, n)})
    share = F.lit(1.0)
    for k in range(n):
        share = share * F.try_divide(F.col(at(k, k, k)), F.col(at(0, k, k)))
    step = step.withColumn("sol whole", F.abs(share) > LEAST_PIVOT)
    for k in reversed(range(n)):
        known = F.col(f"sol b {k} {k}")
        for j in range(k + 1, n):
            known = known - F.col(at(k, k, j)) * F.col(f"{out}{j}")
        step = step.withColumn(f"{out}{k}", F.when(F.col("sol whole"), F.try_divide(known, F.col(at(k, k, k)))))
    return settled(step.select(*(F.col(f"`{c}`") for c in df.columns), *(f"{out}{k}" for k in range(n))), *(f"{out}{k}" for k in range(n)))
