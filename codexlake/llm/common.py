"""What the operators of this subpackage share: the shared folder, written intermediate tables, session settings, row keys."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.session import ship

#: Rows and bytes of an Arrow batch that goes to a Python worker; texts can be very long, so batches are small.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI below spark.checkpoint.dir. Where that is unset, a local session (tests) gets a temporary folder and any other an error."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    where = f"{top.rstrip('/')}/codexlake-{uuid.uuid4().hex}"
    atexit.register(_removed_at_exit, spark, where)  # results are read from it until then
    return where


def _removed_at_exit(spark: SparkSession, where: str) -> None:
    with contextlib.suppress(Exception):  # a session that has ended can't, and needn't
        parent, _, name = where.rpartition("/")
        forget(spark, parent, name)


def written(df: DataFrame, where: str, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder ``where``, read again: cuts lineage and survives lost executors."""
    path = f"{where}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, where: str, *names: str) -> None:
    """Remove written tables that nothing reads any more, and let the driver collect what it holds of the jobs behind them: only then are their shuffle files removed."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    jvm = spark.sparkContext._jvm
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{where}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the session's Arrow batches, which can otherwise hold thousands of very long texts (smaller bounds stay), and send this package to the executors."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def row_key() -> list[Column]:
    """Two documents that share an id are told apart by their texts."""
    return [F.col("doc_id"), F.xxhash64(F.col("text")).alias("text_key")]


def lower_ascii(column: Column) -> Column:
    """A-Z to lower case and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: A side of at most so many rows and bytes of strings may be broadcast; larger ones are shuffled.
BROADCAST_ROWS, BROADCAST_TEXT = 500_000, 32 << 20


def small_side(df: DataFrame, text_columns: tuple[str, ...] = ()) -> DataFrame:
    """df, hinted for broadcast if a count shows that it is small; df should be a written table."""
    size = F.coalesce(F.sum(sum((F.length(F.col(c).cast("string")) for c in text_columns), F.lit(0))), F.lit(0))
    n, chars = df.agg(F.count(F.lit(1)), size).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and chars <= BROADCAST_TEXT else df
