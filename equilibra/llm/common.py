"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


SLICE = 256  # rows of a batch that are Python values at the same time


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's own reader (any store it can reach)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; 0 for a null id."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def crc_remainder(doc_id: object, n: int) -> int:
    """The same rule in Python (tests)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def once(kind: str, version: object, make: Callable[[], object]) -> object:
    """Build a helper object once per Python worker; later tasks of the worker reuse it.

    Functions shipped by value get new globals in every task, so the store is a
    module entry of the worker process.  It keeps one object at a time, so a
    worker that outlives a stage does not hoard.
    """
    store = sys.modules.setdefault("_worker_store", types.ModuleType("_worker_store")).__dict__
    held = store.get("kept")
    if held is None or held[:2] != (kind, version):
        store["kept"] = held = None
        held = store["kept"] = (kind, version, make())
    return held[2]


def add_columns(df: DataFrame, source: str, added: str, fn: Callable[[list], Sequence[Sequence]]) -> DataFrame:
    """Append columns computed per Arrow batch from one column; all other columns pass through.

    ``fn`` gets the values of ``source`` (None for null) and returns one
    sequence per column of the DDL string ``added``.  ``SLICE`` rows at a time
    become Python values, and no row moves between tasks.
    """
    extra = StructType.fromDDL(added)
    clash = {f.name.lower() for f in extra} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"columns already present: {sorted(clash)}")
    at = [c.lower() for c in df.columns].index(source.lower())
    types = list(to_arrow_schema(extra).types)
    names = [*df.columns, *extra.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                made = fn(batch.column(at).to_pylist())
                cols = [pa.array(v, type=t) for v, t in zip(made, types)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=names)

    return df.mapInArrow(run, StructType([*df.schema.fields, *extra.fields]))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name not used by ``df``."""
    used = {c.lower() for c in df.columns}
    name, k = f"_{stem}", 0
    while name.lower() in used:
        k += 1
        name = f"_{stem}{k}"
    return name


def hashed_sample(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """The ``rows`` rows of smallest hash: a bounded, repeatable sample (a top-k, no full sort)."""
    h = F.xxhash64(F.col(key), F.lit(seed))
    return df.orderBy(h, F.col(key)).limit(rows)
