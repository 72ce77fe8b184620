"""Helpers shared by the operators: column picking, size-checked broadcasts, hashing of words, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelstone.session import cut_lineage

# A side of a join is broadcast up to this many rows of a few numbers each, counted beforehand; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
# Hashes of words a Python worker remembers, between two texts.
REMEMBERED_WORDS = 200_000
# Rows turned into Python objects at a time.
SLICE_ROWS = 256

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {x.lower() for x in df.columns}
    while name in taken:
        name += "_"
    return name


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` (a written table, cheap to count) for broadcast when it has few rows; otherwise leave the choice to the optimiser."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def staged(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again."""
    return cut_lineage(df)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers one to one."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8: what ``bytes.split`` cuts at is exactly that set."""
    return text.encode().split() if text else []


class _Hashes(dict):
    """Hashes of words already met; long words are not kept."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


_HASHES = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_HASHES) > REMEMBERED_WORDS:
        _HASHES.clear()
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit names of the ``width``-word shingles; a shorter sequence is one shingle, no words are none."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = word_hashes(words)
    n = max(1, len(words) - width + 1)
    size = min(width, len(words))
    out = np.full(n, np.uint64(size), dtype=np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def arrow_map(df: DataFrame, fn: Callable[[dict[str, list]], dict], schema: str | StructType, *, rows: int = SLICE_ROWS) -> DataFrame:
    """Apply ``fn`` (columns as lists -> columns as lists or arrays) to small slices of Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = fn({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
