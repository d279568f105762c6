"""What several of the operators share: reading tables, scratch folders, and stretches of Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorpool.session import configure, shared_dir

# Text handled at once inside a task, in bytes: bounds the Python memory of every operator.
STRETCH_BYTES = 4 << 20
# Where stored tables lie, as long as anybody holds them.
_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the library's settings, its Python workers able to import the library.

    A cluster gets the package as any other, by ``--py-files`` or installed; workers of a local session find it where
    the driver has it.
    """
    context = spark.sparkContext
    if context.master.startswith("local"):
        root = str(Path(__file__).resolve().parents[2])
        paths = context.environment.get("PYTHONPATH", "").split(":")
        if root not in paths:
            context.environment["PYTHONPATH"] = ":".join([root, *filter(None, paths)])
    return configure(spark)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{directory}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder under the one all executors share."""
    return f"{shared_dir(spark)}/llm-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows stored in the shared folder and read again: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    _places[stored] = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete what :func:`written` has stored, once all that was made of it is stored as well."""
    for df in stored:
        spark, path = df.sparkSession, _places.pop(df, None)
        if path is not None:
            found = spark._jvm.org.apache.hadoop.fs.Path(path)
            found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


_kept: dict[str, Callable[[], None]] = {}
_owner = [""]


def keeps(owner: str, forget: Callable[[], None]) -> None:
    """Name what clears the caches an operator keeps in the worker process between tasks."""
    _kept[owner] = forget


def claim(owner: str) -> None:
    """Called by a task when it begins: what other operators have cached in this worker goes, and free memory with it.

    Workers outlive tasks, and several operators in a row would else add up there.
    """
    if _owner[0] != owner:
        for name, forget in _kept.items():
            if name != owner:
                forget()
        _owner[0] = owner
        gc.collect()
    release()


def release() -> None:
    """Give memory that is free, but still held by allocators, back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def hex_sha256(data: bytes | str) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode("utf-8", "surrogatepass")).hexdigest()


def stretches(batches: Iterable[pa.RecordBatch], text: int = 1, limit: int = STRETCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that column ``text`` of a piece holds about ``limit`` bytes or a single row."""
    for batch in batches:
        release()
        column, start, n = batch.column(text), 0, batch.num_rows
        if column.nbytes <= limit:
            if n:
                yield batch
            continue
        held = 0
        for i in range(n):
            held += len(column[i].as_buffer() or b"") if column[i].is_valid else 0
            if held >= limit or i == n - 1:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
    release()


def per_text(
    df: DataFrame, key: str, text: str, schema: str, build: Callable[[], Callable[[str], tuple]]
) -> DataFrame:
    """One row per row of ``df``: the key and what ``build()`` says of the whole text (null counts as empty).

    ``build`` runs once in each task. Keys keep their type; ``schema`` names the columns after the key.
    """
    narrow = df.select(F.col(key).alias("__key"), text_or_empty(text).alias("__text"))
    spark = df.sparkSession
    kind = narrow.schema["__key"].dataType.simpleString()
    shape = spark.createDataFrame([], f"`{key}` {kind}, {schema}").schema
    fields = shape.fields[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        claim(build.__module__)
        of = build()
        types = [to_arrow_type(f.dataType) for f in fields]
        for batch in stretches(batches):
            rows = [of(t) for t in batch.column(1).to_pylist()]
            columns: Sequence[Sequence] = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], [f.name for f in shape.fields]
            )

    return narrow.mapInArrow(run, shape)


def per_row(
    df: DataFrame, text: str, build: Callable[[], Callable[[list[str], pa.RecordBatch], pa.RecordBatch]], limit: int = STRETCH_BYTES
) -> DataFrame:
    """The rows of ``df`` as ``build()`` returns them: it gets the texts of a stretch (null as empty) and its batch.

    It may drop rows and replace values; the columns stay as they are. ``build`` runs once in each task.
    """
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(build.__module__)
        of = build()
        for batch in stretches(batches, text=place, limit=limit):
            done = of([t or "" for t in batch.column(place).to_pylist()], batch)
            if done.num_rows:
                yield done

    return df.mapInArrow(run, df.schema)
