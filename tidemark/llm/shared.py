"""Tables that cut lineage, in the folder that driver and executors share; sums in trees; names of our own."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where it is unset (local tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="tidemark-"))


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lost executors redo nothing before it."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(*frames: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more, through Hadoop's own file system."""
    for f in frames:
        spark = f.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in {p.rsplit("/", 1)[0] for p in f.inputFiles()}:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def col(name: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, lengthened until they are unlike all that are taken (Spark ignores case)."""
    seen = {c.lower() for c in taken}
    out = []
    for n in names:
        while n.lower() in seen:
            n += "_"
        seen.add(n.lower())
        out.append(n)
    return out


def tidy() -> None:
    """Give the memory that this process no longer uses back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """The same function over batches; when it ends, its worker, which lives on, gives unused memory back."""

    def wrapped(batches):
        yield from run(batches)
        bpe = sys.modules.get("tidemark.llm.bpe")
        if bpe:
            bpe.task_ended()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim:
            trim(0)

    return wrapped


def map_rows(df: DataFrame, run: Callable) -> DataFrame:
    """``mapInArrow`` over whole rows that keeps the schema, whatever the columns are called: ``run`` finds them by place."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(lean(run), plain.schema).toDF(*df.columns)


#: Partial sums of at most so many partitions travel, and so many meet in one group: two levels, whatever the input.
MOST_PARTS, FAN = 1 << 14, 1 << 7


def tree_sum(frame: DataFrame, partial: Callable, add: Callable[[list[bytes]], bytes]) -> DataFrame:
    """(slot, sums): what ``partial`` yields for each partition as (slot int, sums binary) rows, added up by slot."""
    kinds = "slot int, sums binary"

    def merge(key, table):
        return pa.table({"slot": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([add(table.column("sums").to_pylist())], pa.binary())})

    parts = frame.coalesce(MOST_PARTS).mapInArrow(lean(partial), kinds).withColumn("some", F.floor(F.spark_partition_id() / FAN))
    return parts.groupBy("slot", "some").applyInArrow(merge, kinds).groupBy("slot").applyInArrow(merge, kinds)
