"""What the operators of this subpackage share: batches of text, rows to Arrow and back."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from vecspark.storage import MADE, bucketed, forget, given_back, lean, stored, worker_cache  # noqa: F401


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of about ``most_bytes`` of ``column`` (a longer row stands alone)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def arrow_rows(schema: pa.Schema, columns: Iterable[Any]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def row_wise(docs: DataFrame, text_col: str, make: Callable[[list, pa.RecordBatch], dict[str, Any]], added: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with the columns that ``make(texts, batch)`` gives for each batch of rows.

    Columns named as those of ``docs`` replace them; others must be in ``added``
    (name -> type), replacing clashing ones. A column ``vs_keep`` selects the rows
    that stay. Everything else passes as it is, without a shuffle. A worker keeps
    nothing for its next task.
    """
    extra = [StructField(n, _parse_datatype_string(t)) for n, t in (added or {}).items()]
    plain = docs.drop(*(f.name for f in extra))
    schema = StructType([*plain.schema.fields, *extra])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                new = make(part.column(at).to_pylist(), part)
                columns = [pa.array(new[f.name], type=f.type) if f.name in new else part.column(i) for i, f in enumerate(arrow)]
                out = pa.RecordBatch.from_arrays(columns, names=arrow.names)
                yield out.filter(pa.array(new["vs_keep"], type=pa.bool_())) if "vs_keep" in new else out

    return plain.mapInArrow(lean(run), schema)


def bundled(docs: DataFrame, id_col: str, text_col: str, kept: dict[str, tuple[str, str]] | None = None, most_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` as segments of about ``most_bytes`` of text: ``seg``, ``ids``, ``packed`` (the whole rows, compressed).

    ``kept`` names more columns that stand beside, as (column, type). The table
    lies in buckets by ``seg``, so what comes back for a segment finds it there.
    """
    kept = kept or {}
    kinds = [("ids", (id_col, "bigint")), *kept.items()]
    schema = pa.schema([("seg", pa.int64()), *(f for f in to_arrow_schema(StructType([StructField(n, _parse_datatype_string(f"array<{t}>")) for n, (_, t) in kinds]))), ("packed", pa.binary())])
    beside = [f"vs_{n}" for n, _ in kinds]
    wide = docs.select("*", *(docs[c].cast(t).alias(f"vs_{n}") for n, (c, t) in kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, text_col, most_bytes):
                rows = part.select([n for n in part.schema.names if n not in beside])
                yield arrow_rows(schema, [[number], *([part.column(n).to_pylist()] for n in beside), [packed(rows)]])
                number += 1

    columns = ", ".join(f"{n} array<{t}>" for n, (_, t) in kinds)
    return bucketed(wide.mapInArrow(lean(run), f"seg bigint, {columns}, packed binary"), "seg", docs)


def packed(rows: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(rows)
    return out.getvalue().to_pybytes()


def unbundled(raw: pa.BinaryScalar) -> pa.Table:
    """The rows of a segment."""
    return pa.ipc.open_stream(raw.as_buffer()).read_all()
