"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; a temporary one only where none is set and all run in one process (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="sedimenta-"))
    return context.getCheckpointDir().rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it again.

    A lost executor then costs a re-read, not a recomputation, and what is
    consumed twice is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete the files behind a staged DataFrame that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for name in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, chunk: int = 1000) -> DataFrame:
    """mapInArrow, `chunk` rows at a time so that a worker's memory stays bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, chunk):
                out = work(batch.slice(start, chunk))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def id_text(column: str = "doc_id") -> Column:
    """An id as text; a null id counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def remainder(column: str, modulus: int) -> Column:
    return F.crc32(id_text(column)) % modulus


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A batch's texts; null reads as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for working columns that no column of df has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def commonest(counts: DataFrame, most: int, n: str = "n") -> DataFrame:
    """The rows of counts with the greatest n, at most `most`, cut where n steps to another sixteenth of an octave.

    The cut comes from a histogram, so no task sorts or gathers all rows.
    """
    step = F.floor(F.log2(F.col(n)) * 16)
    held, cut = 0, None
    for row in counts.groupBy(step.alias("step")).agg(F.count("*").alias("k")).orderBy(F.desc("step")).collect():
        held += row.k
        if held > most:
            break
        cut = row.step
    return counts.where(step >= cut) if cut is not None else counts.limit(0)


def hashed_sample(df: DataFrame, column: str, rows: int) -> list:
    """At most `rows` distinct values of a column, those of the least hashes.

    Only hashes below a bound that leaves about four times as many go on, so
    neither a task nor the driver gets more of the values than that.
    """
    share = min(1.0, 4 * rows / max(1, df.count()))
    h = F.xxhash64(column)
    few = df.where(F.pmod(h, F.lit(1 << 31)) < int(share * (1 << 31)))
    picked = few.groupBy(h.alias("h")).agg(F.min(column).alias(column)).orderBy("h").limit(rows)
    return [r[0] for r in picked.select(column).collect()]
