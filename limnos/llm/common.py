"""Shared helpers of the text operators."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch (10,000 by Spark's default, whole texts among them) become Python values for about so many bytes at a time.
PIECE = 1_000_000
#: Words are maximal runs of other characters than these (fixed by the contract).
WORD_BREAKS = "\x20\x09\x0a\x0b\x0c\x0d"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_ONE_BREAK = str.maketrans({c: " " for c in WORD_BREAKS})


def words_of(text: str | None) -> list[str]:
    """The words of a text in order; none for null or blank."""
    return [w for w in text.translate(_ONE_BREAK).split(" ") if w] if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is set only where spark.checkpoint.dir is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: df written as a table in the shared folder, and read again. A lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of a job that end with it: `with Scratch(spark, name) as tables: tables.write(df, "step")`. They are deleted at the end of the block, so what outlives it is written elsewhere first."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.n = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", 0

    def __enter__(self) -> "Scratch":
        return self

    def write(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}-{name}"
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in smaller ones, so that what a worker holds besides a batch is made of about PIECE bytes of it. Rows without bytes stay together."""
    for b in batches:
        rows = max(1, PIECE * b.num_rows // max(1, b.nbytes))
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        del b  # not held while the next one is read
        pa.default_memory_pool().release_unused()


def map_batches(df: DataFrame, step: Callable[[dict[str, list]], dict[str, list]], schema: str, setup: Callable | None = None) -> DataFrame:
    """mapInArrow over dicts of Python lists, a piece of a batch at a time. setup() runs once in each task and its value is step's second argument."""
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = () if setup is None else (setup(),)
        for b in pieces(batches):
            held = {n: c.to_pylist() for n, c in zip(b.schema.names, b.columns)}
            del b
            out = step(held, *more)
            yield pa.RecordBatch.from_pydict({f.name: pa.array(out[f.name], f.type) for f in target}, schema=target)

    return df.mapInArrow(run, schema)


def map_texts(df: DataFrame, flag: Callable, schema: str | None = None, text: str = "text", setup: Callable | None = None) -> DataFrame:
    """mapInArrow over whole rows of df with their other columns untouched. flag(texts[, setup()]) returns a mask of rows to keep, or the new texts."""
    where = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = () if setup is None else (setup(),)
        for b in pieces(batches):
            got = flag(b.column(where).to_pylist(), *more)
            if isinstance(got, np.ndarray):
                yield b.filter(pa.array(got.astype(bool)))
            else:
                yield b.set_column(where, b.schema.field(where), pa.array(got, b.schema.field(where).type))
            del b

    return df.mapInArrow(run, schema or df.schema)


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % n


def py_crc_mod(key: int | None, n: int) -> int | None:
    return None if key is None else zlib.crc32(str(key).encode()) % n


def isotonic(hits: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Pool-adjacent-violators over ordered bins: hits and rows by bin to a non-decreasing rate by bin (empty bins take their left neighbour's)."""
    blocks: list[list[float]] = []
    for h, n in zip(hits, rows):
        blocks.append([float(h), float(n), 1])
        while len(blocks) > 1 and (blocks[-1][1] == 0 or blocks[-2][1] == 0 or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.concatenate([np.full(int(k), h / n if n else 0.5) for h, n, k in blocks]) if blocks else np.zeros(0)


def labelled_sample(labels: DataFrame, label: str, id_col: str, most: int, rest: int = 2, mod: int = 4) -> DataFrame:
    """About `most` labelled training rows at most (crc32 of the id modulo `mod` is not `rest`): (id, y), written as a table.

    Where there are more, those stay whose hash lies under a share of its range that keeps fewer than `most` by three standard deviations; no
    task sorts or gathers them. The bound is a parameter; the result may be broadcast. Repeated ids: y is 1 if at least half of their labels are. Null labels or ids: left out."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & (crc_mod(F.col("id"), mod) != rest))
    n = rows.count()
    if n > most:
        share = max(0.0, most - 3 * most**0.5) / n
        rows = rows.where(F.xxhash64("id", F.lit(rest)) < int(-(2**63) + share * 2**64))
    return materialize(rows.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y")), "labelled")
