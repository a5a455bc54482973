"""Rows of sorted Arrow batches as Python values, for operators that walk an order row by row. Values never pass through pandas, so
64-bit numbers keep their digits and nulls are None."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


def same(a, b) -> bool:
    """Equality of keys: null equals null, and NaN equals NaN."""
    return a == b or (a != a and b != b)


def same_key(a: tuple, b: tuple) -> bool:
    return a == b or all(map(same, a, b))


def rows(batch, columns: list[str]) -> list[tuple]:
    """The values of some columns, one tuple a row."""
    if not columns:
        return [()] * batch.num_rows
    return list(zip(*(batch.column(c).to_pylist() for c in columns), strict=True))


def appended(batch, fields, found: list[tuple]):
    """``batch`` with further columns, one tuple of their values a row."""
    import pyarrow as pa

    columns = list(zip(*found, strict=True)) if found else [()] * len(fields)
    made = [pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays([*batch.columns, *made], schema=pa.schema([*batch.schema, *fields]))


def whole_groups(batches: Iterable, keys: list[str]) -> Iterator[tuple]:
    """Batches sorted by ``keys`` as (batch, key tuples) that never part a group of equal keys; only a group is held beyond a batch."""
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = rows(batch, keys)
        start = len(own)
        while start > 0 and same_key(own[start - 1], own[-1]):
            start -= 1
        if start == 0 and (not held or same_key(rows(held[0].slice(0, 1), keys)[0], own[-1])):
            held.append(batch)
            continue
        whole = pa.concat_batches([*held, batch.slice(0, start)]) if held else batch.slice(0, start)
        if whole.num_rows:
            yield whole, rows(whole, keys)
        held = [batch.slice(start)]
    if held:
        whole = pa.concat_batches(held)
        yield whole, rows(whole, keys)


def arrow_fields(fields) -> list:
    """The Arrow fields of Spark's."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(T.StructType(fields)))
