"""Incremental ingestion: new files are picked up once, upserted, split and resumed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from cadenza.operators.sets import skip_completed
from cadenza.sources.sinks import upsert_partitioned


def ingest_new_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "subject", transform: Callable[[DataFrame], DataFrame] = lambda df: df, kind: str = "parquet") -> StreamingQuery:
    """Reads the files that came since the last call, replaces their subjects in ``target``, and ends."""

    def upsert(rows: DataFrame, _: int) -> None:
        upsert_partitioned(transform(rows), target, key)

    stream = spark.readStream.schema(schema).format(kind).load(source)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(upsert).start()


#: The store that keeps its rows on disk: states hold every subject.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Assigner(StatefulProcessor):
    """A stratum's counts of train and all, read and written once for all rows of a call."""

    def __init__(self, key: str, strata: str, share: float):
        self.key, self.strata, self.share = key, strata, share

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "train long, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        train, n = self.counts.get() if self.counts.exists() else (0, 0)
        for batch in rows:
            groups = []
            for _ in range(len(batch)):
                hit = n == 0 or train / n < self.share
                train, n = train + hit, n + 1
                groups.append("train" if hit else "holdout")
            yield batch[[self.key, self.strata]].assign(split_group=groups)
        self.counts.update((train, n))

    def close(self) -> None:
        pass


def assign_stream(subjects: DataFrame, strata: str = "cap_size", key: str = "subject", share: float = 0.75, shards: int = 1) -> DataFrame:
    """A stream of subjects to (key, strata, split_group), once for each subject: a subject joins train while its stratum's share is
    under ``share``. A subject that comes again, in the same or a later run and in whatever stratum, keeps its group and
    gives no row; a null subject is left out.

    Subjects that came before are dropped by Spark's own state, dealt by subject; the others, each once, are dealt to ``shards`` of
    their stratum by a hash and pass its task in batches, which keeps two numbers. The share holds within one subject for
    each stratum and shard. The session's state store must be one that transformWithState takes (STORE)."""
    kinds = dict(subjects.dtypes)
    new = subjects.where(F.col(key).isNotNull()).select(key, strata, F.pmod(F.xxhash64(key), F.lit(shards)).alias("_shard")).dropDuplicates([key])
    schema = f"{key} {kinds[key]}, {strata} {kinds[strata]}, split_group string"
    return new.groupBy(strata, "_shard").transformWithStateInPandas(_Assigner(key, strata, share), schema, "Append", "None")


def pending(work: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Stages and subjects without an output yet."""
    return skip_completed(work, manifest, keys)


def retry(work: DataFrame, done: DataFrame, errors: DataFrame, key: str) -> DataFrame:
    """Subjects that failed and weren't done since, and those never tried, with ``retried``."""
    left = work.join(done.select(key), key, "left_anti")
    failed = errors.select(key).distinct().withColumn("retried", F.lit(True))
    return left.join(failed, key, "left").fillna(False, ["retried"])
