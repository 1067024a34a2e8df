"""Vector-valued functions: normalising, preparing for inner products, casts, quantising."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.functions.metrics import doubles, inner_product, norm

CASTS = {"float": "array<float>", "int8": "array<tinyint>", "uint8": "array<smallint>", "double": "array<double>"}


def normalised(v: Column | str) -> Column:
    """v / |v|; a zero vector stays zero."""
    size = norm(v)
    return F.transform(doubles(v), lambda x: F.when(size > 0, x / size).otherwise(0.0))


def mips_base(df: DataFrame, vec_col: str, out_col: str = "prepared") -> DataFrame:
    """Vectors scaled by the largest norm with one more component, which makes them unit vectors.

    Nearest by squared distance among them, for queries prepared by
    :func:`mips_query`, is largest by inner product. The one global number is an
    aggregate; it joins as a single row.
    """
    top = df.agg(F.max(norm(vec_col)).alias("vs_top"))
    v, m = doubles(vec_col), F.col("vs_top")
    rest = F.lit(1.0) - inner_product(vec_col, vec_col) / (m * m)
    both = F.concat(F.transform(v, lambda x: x / m), F.array(F.when(rest > 0, F.sqrt(rest)).otherwise(0.0)))
    return df.join(F.broadcast(top)).withColumn(out_col, F.when(m > 0, both).otherwise(F.concat(v, F.array(F.lit(0.0))))).drop("vs_top")


def mips_query(v: Column | str) -> Column:
    return F.concat(normalised(v), F.array(F.lit(0.0)))


def cast_to(v: Column | str, kind: str) -> Column:
    if kind not in CASTS:
        raise ValueError(f"unknown element type {kind!r}")
    return (F.col(v) if isinstance(v, str) else v).cast(CASTS[kind])


def quantised(v: Column | str, bias: float, scale: float) -> Column:
    """(x - bias) * (254 / scale), cut towards zero, as bytes."""
    return F.transform(doubles(v), lambda x: ((x - bias) * (254.0 / scale)).cast("int").cast("tinyint"))


def dequantised(v: Column | str, bias: float, scale: float) -> Column:
    """(x - bias) * scale: the reading side's convention, no inverse of :func:`quantised`."""
    return F.transform(doubles(v), lambda x: (x - bias) * scale)


def residual(v: Column | str, centre: Column | str) -> Column:
    return F.zip_with(doubles(v), doubles(centre), lambda x, c: x - c)


def half_precision(v: Column | str) -> Column:
    """Values rounded to 16-bit floats and widened again."""

    @F.pandas_udf("array<float>")
    def rounded(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.asarray(x, dtype=np.float16).astype(np.float32))

    return rounded(v)


def bfloat16(v: Column | str) -> Column:
    """Values cut to the upper 16 bits of their 32-bit floats, rounded to nearest even."""

    @F.pandas_udf("array<float>")
    def rounded(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            bits = np.asarray(x, dtype="<f4").view("<u4").astype(np.uint64)
            return (((bits + 0x7FFF + (bits >> 16 & 1)) >> 16 << 16).astype("<u4")).view("<f4")

        return s.map(one)

    return rounded(v)


def vector_base64(v: Column | str, dim: int) -> Column:
    """The 32-bit floats of the first ``dim`` components, zeros where there are fewer, in base 64."""

    @F.pandas_udf("string")
    def encoded(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            out = np.zeros(dim, dtype="<f4")
            out[: min(dim, len(x))] = np.asarray(x, dtype="<f4")[:dim]
            return base64.b64encode(out.tobytes()).decode()

        return s.map(one)

    return encoded(v)


def rotation(dim: int, seed: int = 0) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def rotated(v: Column | str, matrix: np.ndarray) -> Column:
    @F.pandas_udf("array<double>")
    def turned(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.asarray(x, dtype=np.float64) @ matrix)

    return turned(v)
