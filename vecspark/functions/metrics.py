"""Distances: a column expression and a NumPy block kernel for each metric.

``l2`` is the squared Euclidean distance, ``mips`` ranks by falling inner product
and reports it as it is, ``cosine`` is one minus the cosine (a zero vector has
cosine 0 with any). Everything is computed in double precision.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def inner_product(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def l2_squared(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def norm(v: Column | str) -> Column:
    return F.sqrt(inner_product(v, v))


def fast_l2(x: Column | str, q: Column | str, norm_squared: Column | None = None) -> Column:
    """The squared distance without the query's own norm: the same ranks."""
    own = inner_product(x, x) if norm_squared is None else norm_squared
    return own - 2 * inner_product(x, q)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    size = norm(a) * norm(b)
    return F.lit(1.0) - F.when(size > 0, inner_product(a, b) / size).otherwise(0.0)


def _l2_block(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * (q @ x.T), 0.0)


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def _l2_exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return ((x - q) * (x - q)).sum(axis=-1)


def _cosine_exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=-1) * np.linalg.norm(q, axis=-1)
    return 1.0 - np.divide((x * q).sum(axis=-1), size, out=np.zeros(np.broadcast(x, q).shape[:-1]), where=size > 0)


@dataclass(frozen=True)
class Metric:
    """``key`` is minimised; ``report`` turns it into the value shown."""

    name: str
    column: Callable[[Column | str, Column | str], Column]
    block: Callable[[np.ndarray, np.ndarray], np.ndarray]
    exact: Callable[[np.ndarray, np.ndarray], np.ndarray]
    sign: float = 1.0


METRICS: dict[str, Metric] = {
    "l2": Metric("l2", l2_squared, _l2_block, _l2_exact),
    "mips": Metric("mips", inner_product, lambda q, x: -(q @ x.T), lambda q, x: -(x * q).sum(axis=-1), -1.0),
    "cosine": Metric("cosine", cosine_distance, lambda q, x: 1.0 - _unit(q) @ _unit(x).T, _cosine_exact),
}


def metric(name: str) -> Metric:
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(METRICS)}")
    return METRICS[name]


def register(spark) -> None:
    """``l2_sq``, ``inner_product`` and ``cosine_distance`` for SQL text, as SQL functions that Catalyst inlines."""
    total = "aggregate(zip_with(cast({a} as array<double>), cast({b} as array<double>), (x, y) -> {f}), 0D, (s, x) -> s + x)"
    l2, ip = total.format(a="a", b="b", f="(x - y) * (x - y)"), total.format(a="a", b="b", f="x * y")
    size = " * ".join(f"sqrt({total.format(a=c, b=c, f='x * y')})" for c in "ab")
    for name, body in (("l2_sq", l2), ("inner_product", ip), ("cosine_distance", f"1D - if({size} > 0, {ip} / ({size}), 0D)")):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a array<double>, b array<double>) RETURNS double RETURN {body}")
