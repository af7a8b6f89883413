"""What the operators share: table access, shared-folder tables, text helpers."""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_dir

#: Of Spark: whether a job's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Of Spark: rows of a batch on its way to Python. Ten thousand documents or messages are too much memory.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``fresh_dir`` that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession, rows: str = "1000"):
    """Shuffle files of the jobs inside go when each of them ends; batches for Python are small."""
    wanted = {CLEANUP: "true", BATCH: rows}
    before = {k: v for k in wanted if (v := spark.conf.get(k, None)) is not None}
    for k in before:
        spark.conf.set(k, wanted[k])
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def store(df: DataFrame, path: str, *by: str, parts: int | None = None) -> None:
    """Write a table to a folder; with ``by`` a folder for each value, dealt out to ``parts`` tasks."""
    with brief_shuffles(df.sparkSession):
        out = df.repartition(parts, *by) if parts else df
        w = out.write.option("compression", "zstd")
        (w.partitionBy(*by) if by else w).parquet(path)


def exchange(df: DataFrame, path: str, *by: str, parts: int) -> None:
    """Like ``store`` by ``by`` with large rows, for ``read_part``, but the tasks write the files themselves.

    Spark's writer has a JVM start other processes for each file of a local store
    (for its mode), and for a moment each of them holds the JVM's memory again.
    A file is moved to its place when it is whole, so that a second attempt of a
    task leaves the same files.
    """
    schema = df.schema
    rest = [f.name for f in schema if f.name not in by]

    def write(batches):
        import pyarrow.parquet as pq
        from pyarrow import fs
        from pyspark import TaskContext

        where, base = fs.FileSystem.from_uri(path)
        name = f"part-{TaskContext.get().partitionId():05d}.parquet"

        def runs():
            for b in batches:
                keys = list(zip(*(b.column(k).to_pylist() for k in by)))
                lo = 0
                for key, own in itertools.groupby(keys):
                    n = len(list(own))
                    yield key, b.select(rest).slice(lo, n)
                    lo += n

        for key, own in itertools.groupby(runs(), lambda x: x[0]):
            folder = "/".join([base, *(f"{k}={v}" for k, v in zip(by, key))])
            where.create_dir(folder, recursive=True)
            draft = f"{folder}/_{uuid.uuid4().hex}"
            first = next(own)[1]
            with where.open_output_stream(draft, compression=None) as out, pq.ParquetWriter(out, first.schema, compression="zstd", compression_level=3, use_dictionary=False, write_statistics=False) as w:
                for b in itertools.chain([first], (x[1] for x in own)):
                    w.write_batch(b)
            try:
                where.move(draft, f"{folder}/{name}")
            except OSError:
                if where.get_file_info(f"{folder}/{name}").type == fs.FileType.NotFound:
                    raise
                where.delete_file(draft)  # another attempt was first
        yield from ()

    with brief_shuffles(df.sparkSession, rows="64"):
        sent = df.repartition(parts, *by).sortWithinPartitions(*by).mapInArrow(write, "n long")
        sent.write.mode("overwrite").parquet(f"{path}/_done")  # no rows; shuffle files of a collect would stay


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read the files again."""
    spark = df.sparkSession
    path = fresh_dir(spark, tag)
    store(df, path)
    return spark.read.schema(df.schema).parquet(path)


def by_split(df: DataFrame, *columns) -> DataFrame:
    """``columns`` and ``_split``, a number for the part of a file that a row is in.

    A split is read in one task and in the same order each time, so that what is
    found out about its rows can be laid beside it. A plain read of files serves
    as it is; any other table is copied to the shared folder first.
    """
    if df._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        df = materialize(df, "copy")
    return df.select(*columns, F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("_split"))


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores in front until no column has it (in any case of letters)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def read_part(folder: str, column: str, value: int, names: list[str]) -> pa.Table | None:
    """In a task: the rows of a table in the shared folder that lie in one of its partitions, or None."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    where, base = fs.FileSystem.from_uri(f"{folder}/{column}={value}")
    try:
        found = sorted(f.path for f in where.get_file_info(fs.FileSelector(base)) if f.path.endswith(".parquet"))
    except FileNotFoundError:
        return None
    parts = [pq.ParquetFile(where.open_input_file(f)).read(columns=names, use_threads=False) for f in found]
    return pa.concat_tables(parts) if parts else None


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str, batch: int = 1024) -> DataFrame:
    """Per-task generator over rows, moved as Arrow batches.

    ``make()`` runs once in each task and returns ``f(*columns) -> rows`` where
    each column is a Python list (one Arrow batch). Output is cut into batches
    of at most ``batch`` rows, so memory follows the batch, not the partition.
    """
    out = spark_arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                rows = iter(f(*(c.to_pylist() for c in part.columns)))
                while chunk := list(itertools.islice(rows, batch)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*chunk), out)], schema=out)
            b = part = rows = chunk = None  # not kept while the next batch comes
        f = None
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """In a task: memory that is free in this worker goes back to the system, as the worker stays."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def spark_arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def groups(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of at most ``most`` characters, or one longer text each."""
    lo = size = 0
    for k, t in enumerate(texts):
        if k > lo and size + len(t) > most:
            yield lo, k
            lo, size = k, 0
        size += len(t)
    if texts:
        yield lo, len(texts)


class Memo(dict):
    """A dictionary that fills itself and starts anew at ``limit`` entries."""

    def __init__(self, f: Callable, limit: int = 400_000):
        super().__init__()
        self.f, self.limit = f, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.f(key)
        return value


class Rows(dict):
    """Keys to rows of a matrix that ``f(keys)`` computes for many new keys at once.

    Starts anew when ``limit`` rows are taken; one call may go beyond it.
    """

    def __init__(self, f: Callable[[list], np.ndarray], limit: int = 200_000):
        super().__init__()
        self.f, self.limit = f, limit
        self.matrix: np.ndarray | None = None

    def index(self, keys: list) -> np.ndarray:
        new = [k for k in dict.fromkeys(keys) if k not in self]
        if new:
            if len(self) + len(new) > self.limit and len(self):
                self.clear()
                new = list(dict.fromkeys(keys))
            made, n = self.f(new), len(self)
            if self.matrix is None:
                self.matrix = np.empty((0, *made.shape[1:]), made.dtype)
            if len(self.matrix) < n + len(new):
                grown = np.empty((max(2 * len(self.matrix), n + len(new), 1024), *made.shape[1:]), made.dtype)
                grown[:n] = self.matrix[:n]
                self.matrix = grown
            self.matrix[n : n + len(new)] = made
            self.update(zip(new, range(n, n + len(new))))
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))


def word_of(chunk: str) -> str:
    """A white-space-delimited chunk as a word: lower case, letters and digits only."""
    w = chunk.lower()
    return w if w.isalnum() else "".join(filter(str.isalnum, w))


def fold(doc_id: str, n: int, keep: int):
    """crc32(doc_id as text) mod n equals keep; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % n == keep
