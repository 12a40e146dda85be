"""What the operators share: scratch tables, words, row keys and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a small side is broadcast; its rows are a few numbers wide.
BROADCAST_ROWS = 20_000
#: The same where a row is one or two 64-bit keys.
KEY_ROWS = 300_000


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of this machine only where none is named (local tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


#: Bytes of a batch of rows that goes to a Python worker, where the session doesn't say; texts may be long.
BATCH_BYTES = "2m"


def small_batches(spark: SparkSession) -> None:
    """Batches of rows are bounded by bytes for the session, unless it has its own bound: Spark's default of 64 MB is held
    several times over by the executor and its worker."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: its lineage ends there.

    Lost executors lose none of it. The session's end deletes it."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete_at_end(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(text: str = "text") -> Column:
    """The text; a null one counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def packed_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one, so that columns of an operator can't clash with them."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def join_small(big: DataFrame, small: DataFrame, key: str, how: str = "left", salts: int = 64, most: int | None = None) -> DataFrame:
    """Joins on ``key``; ``small`` has one row a key, and one key may hold a third of ``big``.

    ``small`` is counted: up to ``most`` (BROADCAST_ROWS) rows it is broadcast, beyond that its rows are repeated for
    ``salts`` salts that spread each key of ``big``, also where its rows are equal: by their places. Spark takes repeated rows
    for as many as there were before, so that join is sorted by a hint: else they could all be broadcast through the driver."""
    if small.count() <= (BROADCAST_ROWS if most is None else most):
        return big.join(F.broadcast(small), key, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    spread = big.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return spread.join(salted, [key, "_salt"], how).drop("_salt")
