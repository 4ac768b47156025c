"""What the operators of this subpackage share: cut lineage, scratch tables, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where all is one process (tests) it may be unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master or "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="stepwell-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage; it survives the loss of executors, as it is read from the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As cut(), but columnar and compressed: for tables of the size of the input. Row groups are small, as a task that
    writes holds one in memory beside its Python worker."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 32 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def smallest_hashes(df: DataFrame, columns: list[str], most: int, total: int) -> DataFrame:
    """A bounded, repeatable sample: the ``most`` rows of smallest hash. A threshold on the hash, set by the number of
    rows, first leaves some four times as many, so that no task gathers ``most`` rows from every partition."""
    hashed = F.xxhash64(*columns)
    if total > 4 * most:
        df = df.where(F.pmod(hashed, F.lit(total)) < 4 * most)
    return df.orderBy(F.pmod(hashed, F.lit(max(1, total))), hashed, *columns).limit(most)


def text_bytes(column: str = "text", name: str = "text"):
    """Text as UTF-8 bytes, null as empty: Python workers get it without decoding."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias(name)


def binaries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a null-free binary column, without copying."""
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def column(batch, name: str) -> pa.Array:
    """A column of a batch or table as one array."""
    got = batch.column(name)
    return got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got


def map_arrow(df: DataFrame, each: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow of a function of one batch."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from each(batch)

    return df.mapInArrow(over, schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the result (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
