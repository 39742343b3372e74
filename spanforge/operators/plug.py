"""Calls of plugged-in models, parsers and writers, by Arrow batches: built once a worker, tried again, and never the job's end."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def attempted(call: Callable[[], Any], attempts: int, base: float, cap: float = 10.0) -> tuple[Any, bool]:
    """(what the call gives, false), or (null, true) if all attempts failed; waits ``base`` * 2^n seconds in between."""
    for n in range(attempts):
        try:
            return call(), False
        except Exception:  # noqa: BLE001  a plug-in's failure must not end the job
            if n + 1 < attempts:
                time.sleep(min(base * 2**n, cap))
    return None, True


def call_with(df: DataFrame, make: Callable[[], Callable[..., Any]], *, inputs: list[str], out_col: str, kind: str, failed_col: str | None = None, attempts: int = 1, base: float = 0.0, whole: bool = False) -> DataFrame:
    """Adds ``out_col`` (type ``kind``): what the callable that ``make`` builds gives for a row's ``inputs``, or with ``whole``
    for those of a batch at once, as lists.  Failures give null and, if it is named, ``failed_col``."""
    from pyspark.sql.types import _parse_datatype_string

    spark_kind = _parse_datatype_string(kind)
    schema = T.StructType.fromJson(df.schema.jsonValue()).add(out_col, spark_kind)
    schema = schema.add(failed_col, T.BooleanType()) if failed_col else schema
    places, arrow = [df.columns.index(c) for c in inputs], to_arrow_type(spark_kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        for batch in batches:
            columns = [batch.column(p).to_pylist() for p in places]
            if whole:
                found, failed = attempted(lambda: call(*columns), attempts, base)  # noqa: B023
                made = [(x, False) for x in found] if not failed else [(None, True)] * batch.num_rows
            else:
                made = [attempted(lambda: call(*row), attempts, base) for row in zip(*columns)]  # noqa: B023
            out = [pa.array([x for x, _ in made], arrow)] + ([pa.array([f for _, f in made], pa.bool_())] if failed_col else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], schema.names)

    return df.mapInArrow(run, schema)
