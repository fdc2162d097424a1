"""Helpers of the training-data operators: reading, stage tables, UTF-8 buffers, rolling hashes, bit filters."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker takes at once; a longer document is taken alone.
BLOCK_BYTES = 1 << 19
#: Rows of a batch between Spark and Python; documents are long, so the default of 10,000 would hold much at once.
BATCH_ROWS = 1000
FILES_PER_CORE = 8
#: Rows that a task takes at least of a stage table whose rows are counted.
TASK_ROWS = 1 << 14


def through_python(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow; lowers the session's batches to BATCH_ROWS rows where they are larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(key)) > BATCH_ROWS:
        df.sparkSession.conf.set(key, BATCH_ROWS)
    return df.mapInArrow(function, schema)


def spread(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Deals a small table out so that a task has about so many rows, as each is about to become many."""
    return df.repartition(max(1, -(-df.count() // rows)), key)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def qualified(spark: SparkSession, path: str) -> str:
    """A path as a URI of the file system that Spark resolves it to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder that all executors share, as a URI; where none is set (as in tests), one below the warehouse."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{qualified(spark, top).rstrip('/')}/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes the stage tables and archives of this application, once no DataFrame that reads them is needed."""
    _delete(spark, shared_dir(spark))
    _written.clear()


#: Paths of the stage tables of this process, in the order in which they were written.
_written: list[str] = []


def mark() -> int:
    return len(_written)


def finish(df: DataFrame, name: str, since: int, whole: bool = False) -> DataFrame:
    """Writes df as a stage table and deletes those written since the mark, which only df needed."""
    used = _written[since:]
    out = stage_table(df, name, whole)
    for path in used:
        _delete(df.sparkSession, path)
    _written[since : since + len(used)] = []
    return out


def stage_table(df: DataFrame, name: str, whole: bool = False, rows: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, and survives a lost executor.

    whole: rows come from whole texts or from shuffles of their size, so each partition is a task. Others, which are small
    beside the texts, are written by FILES_PER_CORE tasks a core at most, for fewer small files.
    rows: how many rows it is made from. So many tasks as these ask for then write it, one a core at least: little data in
    many partitions makes few files, and much data keeps its partitions.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))
    elif not whole:
        df = df.coalesce(FILES_PER_CORE * spark.sparkContext.defaultParallelism)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def as_text(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0, one more than rows) and bytes of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_string(column.type)):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n or column.buffers()[1] is None:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[off[0] : off[-1]] if body is not None else np.zeros(0, np.uint8)
    return off - off[0], data


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches between rows into parts of at most `most` bytes of text (one row at least), with their buffers."""
    for batch in batches:
        off, data = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, end - at), off[at : end + 1] - off[at], data[off[at] : off[end]]
            at = end


def mixed(h: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Rolling:
    """Hashes of any ranges of a byte sequence, equal for equal contents wherever they lie; for candidates, not for proofs."""

    def __init__(self) -> None:
        self.table = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
        self.base = 0x9E3779B97F4A7C15
        self.back = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << int(n - 1).bit_length()
            for name, base in (("up", self.base), ("down", self.back)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def prefix(self, data: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        return self.sums((self.table if table is None else table)[data])

    def sums(self, values: np.ndarray) -> np.ndarray:
        self._powers(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=sums[1:])
        return sums

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.down[start])


class BitFilter:
    """A Bloom filter as a numpy bit array; its size is fixed when it is made."""

    def __init__(self, bits: np.ndarray, hashes: int) -> None:
        self.bits, self.hashes = bits, hashes

    @staticmethod
    def places(h: np.ndarray, n_bits: int, hashes: int) -> Iterator[np.ndarray]:
        step = mixed(h + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        for k in range(hashes):
            yield (h + np.uint64(k) * step) & np.uint64(n_bits - 1)

    @classmethod
    def of(cls, h: np.ndarray, n_bits: int, hashes: int = 3) -> BitFilter:
        bits = np.zeros(n_bits // 8, np.uint8)
        for p in cls.places(h, n_bits, hashes):
            np.bitwise_or.at(bits, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
        return cls(bits, hashes)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for p in self.places(h, len(self.bits) * 8, self.hashes):
            out &= (self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


#: A filter travels in blocks of this many bytes.
FILTER_BLOCK = 1 << 15


def _bits(batches: Iterator[pa.RecordBatch], n_bits: int) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(n_bits // 8, np.uint8)
    for b in batches:
        bits |= BitFilter.of(b.column("h").to_numpy().view(np.uint64), n_bits).bits
    for at in range(0, len(bits), FILTER_BLOCK):
        if (part := bits[at : at + FILTER_BLOCK]).any():
            yield pa.RecordBatch.from_arrays([pa.array([at // FILTER_BLOCK], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["block", "bits"])


def _either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    have: dict[int, np.ndarray] = {}
    for b in batches:
        for block, bits in zip(b.column("block").to_pylist(), b.column("bits").to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(bits), np.uint8)
            have[block] = have[block] | part if block in have else part
    for block, part in have.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["block", "bits"])


def collected_filter(hashes: DataFrame, n_bits: int) -> BitFilter:
    """The filter of the column h (long, no nulls), made on the executors and merged there block by block; the driver gets n_bits in all."""
    bits = np.zeros(n_bits // 8, np.uint8)
    parts = through_python(hashes.select("h"), lambda it: _bits(it, n_bits), "block int, bits binary").repartition("block")
    for row in through_python(parts, _either, "block int, bits binary").collect():
        part = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
        bits[row["block"] * FILTER_BLOCK : row["block"] * FILTER_BLOCK + len(part)] = part
    return BitFilter(bits, 3)


def power_of_two(n: float, least: int, most: int) -> int:
    return min(most, max(least, 1 << max(0, int(np.ceil(np.log2(max(1.0, n)))))))
