"""Files in the folder that driver and executors share, and small Spark helpers.

Everything that an operator writes goes below ``spark.checkpoint.dir``. Task files get their final name only when they
are complete, names carry the task attempt, and only the names in a table that Spark committed are ever read, so a lost
executor or a task that runs twice leaves nothing behind that a reader could pick up.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

CHECKPOINT_DIR = "spark.checkpoint.dir"


_own: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder as a URI. Unset, where Spark runs in one process as in tests: a folder of our own."""
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError(f"{CHECKPOINT_DIR} must name a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="geoladder-"))
    return _own[0]


def new_folder(spark: SparkSession, what: str) -> str:
    """URI of a fresh folder below the shared one."""
    return f"{shared_root(spark)}/geoladder/{what}-{uuid.uuid4().hex}"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; plain paths are local (that is, mounted everywhere)."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def attempt() -> str:
    """A name that no other task attempt has."""
    c = TaskContext.get()
    return f"{c.partitionId():06d}-{c.taskAttemptId()}" if c else uuid.uuid4().hex


class SharedFile:
    """Writes a file under a temporary name and renames it when it is complete."""

    def __init__(self, folder: str, name: str):
        self.fs, path = open_fs(folder)
        self.fs.create_dir(path, recursive=True)
        self.path, self.part, self.size = f"{path}/{name}", f"{path}/.{name}.{uuid.uuid4().hex}", 0
        self.out = self.fs.open_output_stream(self.part)
        self.uri = f"{folder}/{name}"

    def write(self, data) -> int:
        """Appends; returns the offset at which the data begin."""
        at = self.size
        self.out.write(data)
        self.size += len(data) if isinstance(data, (bytes, bytearray)) else memoryview(data).nbytes
        return at

    def close(self) -> str:
        self.out.close()
        self.fs.move(self.part, self.path)
        return self.uri


def read_shared(uri: str) -> pa.Buffer:
    """The whole file, memory-mapped where the file system is mounted."""
    fs, path = open_fs(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        with pa.memory_map(path) as m:
            return m.read_buffer()
    with fs.open_input_file(path) as f:
        return f.read_buffer()


def written(df: DataFrame, spark: SparkSession, what: str) -> DataFrame:
    """The same rows, cut off from their lineage by a Parquet table in the shared folder."""
    path = new_folder(spark, what)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.geoladder_folder = path
    return out


def read_table(table: DataFrame) -> pa.Table:
    """The rows of a table of ``written`` that is known to be small, in the order of its tasks; the JVM takes no part."""
    fs, path = open_fs(table.geoladder_folder)
    return pq.read_table(path, filesystem=fs, use_threads=False)


def count_rows(table: DataFrame) -> int:
    """The number of rows of a table of ``written``, from its files' footers."""
    fs, path = open_fs(table.geoladder_folder)
    return ds.dataset(path, filesystem=fs, format="parquet").count_rows()


def written_here(table: pa.Table, spark: SparkSession, what: str, files: int = 16) -> DataFrame:
    """A table like those of ``written`` from the driver's own few rows, in several files for as many tasks."""
    path = new_folder(spark, what)
    per = max(1, -(-table.num_rows // files))
    for i in range(0, max(1, table.num_rows), per):
        out = SharedFile(path, f"part-{i // per:05d}.parquet")
        pq.write_table(table.slice(i, per), out.out)
        out.close()
    out = spark.read.schema(from_arrow_schema(table.schema)).parquet(path)
    out.geoladder_folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing will read any more."""
    for t in tables:
        fs, path = open_fs(t.geoladder_folder)
        fs.delete_dir(path)


def delete_file(uri: str) -> None:
    fs, path = open_fs(uri)
    fs.delete_file(path)


def discard_folder(folder: str) -> None:
    """Deletes a folder of task files that nothing will read any more; it may never have been made."""
    fs, path = open_fs(folder)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_dir(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now; it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Gives memory that this process has freed back to the system; the C library keeps up to 64 MB or more of it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if give_back:
        give_back(0)


def small_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """Bounds the Arrow batches that Python workers get by bytes, since texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def rehashed(*cols: str) -> Column:
    """A second join key that depends on the first alone.

    Joining on (key, rehashed(key)) makes Spark shuffle both sides for the join itself even where one side is already
    partitioned by the key, and a partition that is read straight from such a shuffle can be split by adaptive
    execution when one key holds a large share of the rows.
    """
    return F.xxhash64(*cols, F.lit(0x5EED))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table does not have, whatever the case they are compared in."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"__{name}"
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def utf8(col: Column) -> Column:
    """The text's bytes, null counted as empty."""
    return F.coalesce(col, F.lit("")).cast("binary")
