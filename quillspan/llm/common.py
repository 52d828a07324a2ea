"""What the corpus operators share: storage, hashing and bounded Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import AbstractContextManager, contextmanager

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

#: Characters of text that a Python step holds at once, besides one whole document.
BLOCK_CHARS = 4_000_000
#: Rows of an Arrow batch between the JVM and Python.
BATCH_ROWS = 1_000
#: Keys that are broadcast at most (some 32 MB).
BROADCAST_KEYS = 1_000_000
#: Spark's setting that deletes a query's shuffle files when it ends; whoever reads the plan again has them made again.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_HELD: list[DataFrame] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only on a local master (tests, a laptop) that names none is a local one made and set; a cluster must name one.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillspan-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def saved(df: DataFrame, small: bool = False) -> DataFrame:
    """A reliable checkpoint of df: later reads don't repeat its work and survive lost executors.

    A small one (links, labels, what a fraction of the rows leaves) is written in two files a core at most,
    whatever the number of shuffle partitions. The shuffle files behind it are deleted at once: left to the collection of
    the driver's garbage, those of a whole stage may lie on the disks together.
    """
    spark = df.sparkSession
    shared_dir(spark)
    with setting(spark, FREED, "true"):  # the plan is made inside, as it notes the setting
        return (df.coalesce(2 * spark.sparkContext.defaultParallelism) if small else df.select("*")).checkpoint()


def held(df: DataFrame) -> DataFrame:
    """df on the executors' disks, for what is read more than once; a lost executor's part is computed again."""
    _HELD.append(df.persist(StorageLevel.DISK_ONLY))
    return _HELD[-1]


def let_go(*frames: DataFrame) -> None:
    """Free what `held` keeps: these, or all of it once results are written."""
    for df in frames or tuple(_HELD):
        df.unpersist()
    _HELD[:] = [df for df in _HELD if frames and not any(df is x for x in frames)]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder for written files in the shared folder."""
    return f"{shared_dir(spark)}/quillspan/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that was written, from whatever store it is in."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clean_up(spark: SparkSession) -> None:
    """Free and delete what the operators have kept, once their results are written elsewhere."""
    let_go()
    remove(spark, f"{shared_dir(spark)}/quillspan")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, as one document can be very long.

    Lazy results are read later, so the setting stays with the session; a smaller one is kept.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for what runs inside; one that this Spark doesn't know is left."""
    try:
        before = spark.conf.get(name)  # its default, where it isn't set
    except PySparkException:
        yield
        return
    try:
        spark.conf.set(name, value)
        yield
    finally:
        spark.conf.set(name, before)


def arrow_rows(spark: SparkSession, rows: int) -> AbstractContextManager[None]:
    """Batches of so many rows, for what runs inside (rows that hold a file or a tile are large)."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def free_name(columns: Iterable[str], name: str) -> str:
    """A column name that none of the columns has, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(frames: Iterable[pd.DataFrame], column: str = "text", chars: int = BLOCK_CHARS) -> Iterator[pd.DataFrame]:
    """The same rows in frames of at most `chars` characters of a column (or one row)."""
    for frame in frames:
        if not len(frame):
            continue
        sizes = np.fromiter((len(x) if isinstance(x, str) else 0 for x in frame[column]), np.int64, len(frame))
        part = np.cumsum(sizes) // chars
        if part[-1] == part[0]:
            yield frame
        else:
            for _, block in frame.groupby(part, sort=True):
                yield block


def by_frames(df: DataFrame, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """A function from frames to frames over each partition, in small Arrow batches.

    As mapInPandas, but integers that stand beside nulls stay integers.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    small_batches(df.sparkSession)
    target = to_arrow_schema(_parse_datatype_string(schema))
    exact = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            gaps = any(c.null_count and c.type in exact for c in batch.columns)
            yield pa.Table.from_batches([batch]).to_pandas(types_mapper=exact.get if gaps else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in function(frames(batches)):
            if len(frame):
                yield pa.RecordBatch.from_pandas(frame, schema=target, preserve_index=False)
        give_back()

    return df.mapInArrow(run, schema)


def collect_garbage(spark: SparkSession) -> None:
    """Have each executor collect its garbage, after which it gives unused heap back to the system: before work that needs it for Python."""
    slots = spark.sparkContext.defaultParallelism
    spark.range(0, slots, 1, slots).selectExpr("java_method('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


def give_back() -> None:
    """Return freed memory of this worker to the system: workers live on and stand beside a JVM that needs it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def framed(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Rows as a frame of plain objects: integers beside a None stay what they are."""
    return pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=object) for k, c in enumerate(columns)})


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the one of SplitMix64): every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's bigint."""
    return x.view(np.int64)
