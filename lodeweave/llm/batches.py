"""Python steps over texts in batches of bounded memory."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of a batch at most (one longer row alone): it is held by the JVM and by the worker, each more than once.
BYTES = 8 << 20
#: Bytes of a column's text that become Python strings at once (one longer text alone).
AT_ONCE = 1 << 20

#: What this worker keeps from one task to the next: the step's name and its resource.
_kept: dict[str, object] = {}


def forget(but: str) -> None:
    """Drops what this worker keeps of other steps. Inner functions reach workers with copies of the globals they name, so they call this."""
    if _kept and but not in _kept:
        _kept.clear()
        trim()


def kept(name: str, make: Callable[[], object]) -> object:
    """What make() gives, kept in this worker while tasks of the same step follow; another step's resource goes first."""
    forget(name)
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def trim() -> None:
    """Gives free memory back: workers stay and wait beside the steps that follow."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def slices(batch: pa.RecordBatch, column: int, size: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts in column have about size bytes."""
    low = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if total and total + n > size:
            yield batch.slice(low, i - low)
            low, total = i, 0
        total += n
    if low < batch.num_rows:
        yield batch.slice(low)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, name: str = "") -> DataFrame:
    """df.mapInArrow(fn, schema) over batches of at most BYTES.

    Spark reads that bound from the session when it plans the step, which is when the result is used, so the
    session keeps it (a smaller bound of its own stays). A worker gives free memory back at the end of each
    partition and drops what a step of another name kept.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(conf.get(key)).lower().removesuffix("b")
    if not (now.isdigit() and 0 < int(now) <= BYTES):
        conf.set(key, str(BYTES))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(name)
        try:
            yield from fn(batches)
        finally:
            trim()

    return df.mapInArrow(work, schema)
