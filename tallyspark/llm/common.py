"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HOT = 1000
BATCH_BYTES = 4 << 20  # of an Arrow batch on its way to Python; one row more at most


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the folder that the cluster names in spark.checkpoint.dir.

    Only on a local master that names none (tests) a temporary folder is set; on a cluster executors wouldn't see it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table of compressed columns beside the checkpoints, for what is large and read more than once."""
    spark = df.sparkSession
    durable(spark.range(0))  # names the folder where there is none
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def drop_written(df: DataFrame) -> None:
    """Remove a table of written() that nothing is made from any more: what was made of it stands in tables and checkpoints of its own."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by bytes too: by rows alone, ten thousand long texts would travel at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def give_back() -> None:
    """Python workers outlive their tasks: what their allocators keep would stand beside the next stage's needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with batches bounded by bytes and memory given back at the end of each task."""
    bounded_batches(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def spare(columns: list[str], *names: str) -> list[str]:
    """Names for helper columns that no column has yet, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], many: str, how: str = "inner") -> DataFrame:
    """rows joined with groups (a row for each key; `many`: how many rows it has), where one key may have a third of all rows.

    Groups with more than one row in HOT are fewer than HOT, so they are broadcast; only the others' rows are shuffled. Both
    frames are read twice, so they should be checkpointed. Keys aren't null.
    """
    total = groups.agg(F.sum(many)).first()[0] or 0
    hot = F.col(many) * HOT > total
    large = F.broadcast(groups.where(hot))
    rest = rows.join(F.broadcast(groups.where(hot).select(*keys)), keys, "left_anti")
    return rows.join(large, keys).unionByName(rest.join(groups.where(~hot), keys, how))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; plain lower() where every character is one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id written as text, modulo `by`; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by
