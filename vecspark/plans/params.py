"""Checked parameters shared by the index objects."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from vecspark.functions.metrics import METRICS

DTYPES = ("float", "int8", "uint8")


@dataclass(frozen=True)
class IndexConfig:
    """What is fixed when an index is made."""

    dim: int
    metric: str = "l2"
    dtype: str = "float"
    max_vectors: int | None = None

    def __post_init__(self):
        if self.metric not in METRICS:
            raise ValueError(f"unknown metric {self.metric!r}")
        if self.dtype not in DTYPES:
            raise ValueError(f"unknown element type {self.dtype!r}")
        if self.metric == "mips" and self.dtype != "float":
            raise ValueError("inner products need float vectors")
        if self.dim < 1:
            raise ValueError("dim must be positive")
        if self.max_vectors is not None and self.max_vectors < 1:
            raise ValueError("max_vectors must be positive")


def list_size_for(k: int, complexity: int) -> int:
    """``complexity``, raised to ``k`` with a warning if it is less."""
    if k < 1 or complexity < 1:
        raise ValueError("k and complexity must be positive")
    if k > complexity:
        warnings.warn(f"k={k} is more than complexity={complexity}; complexity is raised to it", stacklevel=3)
        return k
    return complexity
