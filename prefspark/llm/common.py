"""Small helpers shared by the operators: tables, saved intermediate tables,
and direct access to the UTF-8 buffer of an Arrow string column."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from prefspark.session import ensure_checkpoint_dir, ship_package


#: Texts sent to a Python worker at once. The operators' arrays take several times as much.
BATCH_BYTES = 8 << 20
_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder (only set where unset), the package on the workers, and
    smaller Arrow batches where the session has Spark's default."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if (spark.conf.get(_BATCH_CONF, None) or f"{_BATCH_DEFAULT}b").removesuffix("b") == str(_BATCH_DEFAULT):
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet below the shared checkpoint folder and read
    back: cuts the lineage, survives lost executors, and is compressed."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(columns, base: str) -> str:
    """``base`` with underscores appended until no column has that name (names
    compare as Spark compares them, without case)."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def utf8_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    arr = pc.fill_null(column, "").cast(pa.large_binary())
    buffers = arr.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def texts_of(column) -> list[bytes]:
    """The UTF-8 bytes of each row; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "").cast(pa.large_binary()).to_pylist()


def runs(offsets: np.ndarray, most: int):
    """(first, last) row ranges whose texts hold about ``most`` bytes together;
    one longer text makes a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def code_points(text: bytes, position: int) -> int:
    """Code points before byte ``position``."""
    return len(text[:position].decode("utf-8", "surrogatepass"))


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over an unsigned 64-bit array."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform doubles in (0, 1) from unsigned 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
