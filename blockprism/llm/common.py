"""What the operators share: scratch tables, batches of text, size-checked joins."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only if it has at most so many rows of few, short columns.
BROADCAST_ROWS = 500_000
#: Python works through a batch in pieces of about so many bytes of text.
PIECE_BYTES = 4 << 20

_own_dir: dict[str, str] = {}
_held: dict[str, Any] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors see.

    A folder of this machine is taken only where the setting is absent and Spark
    runs in one process, as in tests.
    """
    sc = spark.sparkContext
    if at := sc.getConf().get("spark.checkpoint.dir"):
        return at
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own_dir:
        _own_dir[sc.applicationId] = tempfile.mkdtemp(prefix="blockprism-")
    return _own_dir[sc.applicationId]


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation.

    They are dropped when asked for, or else when the JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self._path(self.root, lambda fs, path: fs.deleteOnExit(path))

    def _path(self, at: str, do) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(at)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            fs.mkdirs(path)
        do(fs, path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.root}/{name}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        for name in names:
            self._path(f"{self.root}/{name}", lambda fs, path: fs.delete(path, True))


def held(name: str, make: Callable[[], Any]) -> Any:
    """An object that a worker keeps from task to task, until a task of another operator begins."""
    if name not in _held:
        _held.clear()
        _give_back()
        _held[name] = make()
    return _held[name]


def _give_back() -> None:
    """Memory that is free, which the allocators would keep, to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems have no such call
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: int, most: int = PIECE_BYTES, holding: str = "") -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each has about ``most`` bytes in column ``text``, one row at least.

    What the worker keeps under another name than ``holding`` is let go.
    """
    if holding not in _held:
        _held.clear()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(byte_lengths(batch.column(text)))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to
    _give_back()


def byte_lengths(texts: pa.Array) -> np.ndarray:
    """Bytes of each text; a null has none."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null is empty."""
    return [x or b"" for x in texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary()).to_pylist()]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, one behind another, and where each begins (and the last ends); a null is empty."""
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "")
    width = np.int32 if pa.types.is_string(texts.type) else np.int64
    offsets = np.frombuffer(texts.buffers()[1], width, texts.offset + len(texts) + 1)[texts.offset :].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def with_kept(docs: DataFrame, keep: Sequence[str], *columns) -> DataFrame:
    """The columns, and ``keep`` of the documents in one struct ``kept``, so that no names clash."""
    return docs.select(*columns, *([F.struct(*keep).alias("kept")] if keep else []))


def schema_of(ddl: str, rows: DataFrame) -> T.StructType:
    """The schema written in ``ddl``, and the column ``kept`` if the rows have it."""
    schema = T._parse_datatype_string(ddl)
    return T.StructType([*schema.fields, *(f for f in rows.schema.fields if f.name == "kept")])


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], size: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` left-joined with ``table``, which has a key once at most and was written before.

    A table of up to ``most`` rows (or of ``size``, where rows have lists) is
    broadcast.  A larger one is joined by a shuffle, whose hot keys adaptive
    execution splits: a key occurs once in ``table``, so the part of ``rows`` that
    a task gets can be cut at will.  A null key equals a null.
    """
    values = [c for c in table.columns if c not in keys]
    small = F.broadcast(table) if (table.count() if size is None else size) <= most else table
    match = reduce(lambda a, b: a & b, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys))
    return rows.alias("l").join(small.alias("r"), match, "left").select("l.*", *(F.col(f"r.{c}") for c in values))


def unique_keyed(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """``(row_key, doc_id, text)`` with a key of type long that no two rows share.

    The id itself serves where it is never null nor repeated; otherwise the rows
    are written once with a generated key, which then is stable.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    odd = docs.groupBy("doc_id").count().filter(F.col("doc_id").isNull() | (F.col("count") > 1))
    if odd.isEmpty():
        return docs.select(F.col("doc_id").alias("row_key"), "doc_id", "text")
    return scratch.write(docs.select(F.monotonically_increasing_id().alias("row_key"), "doc_id", "text"), "keyed")
