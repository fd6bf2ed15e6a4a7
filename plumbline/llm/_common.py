"""Helpers the operators share: tables in the shared folder, size-checked broadcasts, Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

_fallback: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's checkpoint folder. Only where none is set and driver and tasks are one
    process (tests, a bench) a temporary one serves; a cluster without one is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _fallback:
        _fallback["dir"] = tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(shutil.rmtree, _fallback["dir"], ignore_errors=True)
    return _fallback["dir"]


class Scratch:
    """An operator's tables in the shared folder. A stored table cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def stored(self, df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
        """``df`` written and read back."""
        path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        writer = df.write.option("compression", codec) if codec else df.write
        writer.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = back
        return back

    def dropped(self, *but: DataFrame) -> None:
        """Deletes the tables stored so far, but those; call it when nothing that is still to run reads them."""
        context = self.spark.sparkContext
        for path, df in list(self.paths.items()):
            if not any(df is x for x in but):
                at = context._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
                del self.paths[path]


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back."""
    return Scratch(df.sparkSession).stored(df, name, codec)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast of a stored ``df`` if a count shows it has at most ``rows`` rows; otherwise leave the join to shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_key(*columns: str) -> list[Column]:
    """128 bits of a row's content as two longs; equal rows have equal keys."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in columns]
    return [F.xxhash64(F.lit(11), *parts), F.xxhash64(F.lit(29), *parts)]


_remembered: dict[str, Callable[[], None]] = {}


def sole(operator: str, forget: Callable[[], None]) -> None:
    """Call it before an operator remembers things in a worker, which outlives its tasks and may serve other operators later:
    what others remember is forgotten by their ``forget``, so that a pipeline's workers hold one memo, not one for each stage."""
    others = [k for k in _remembered if k != operator]
    for other in others:
        _remembered.pop(other)()
    if others:
        pa.default_memory_pool().release_unused()
    _remembered[operator] = forget


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column's values as UTF-8 bytes; null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that Python objects of one batch stay few."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
